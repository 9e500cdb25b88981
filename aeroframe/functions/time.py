"""Calendar features, time keys and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aeroframe import values as V

# layouts accepted for a timestamp given as text (fixed values)
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd",
    "MM-dd-yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy",
]

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_HAS_OFFSET = r"\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$"


def parse_timestamp(text: Column) -> Column:
    """First accepted layout that fits; anything else is null."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in TIMESTAMP_FORMATS])


def utc_offset(text: Column) -> Column:
    """Offset written at the end of the text as ``+hh:mm``; null when there is none."""
    trimmed = F.trim(text)
    raw = F.regexp_extract(trimmed, _OFFSET, 1)
    plain = F.regexp_replace(raw, ":", "")
    return F.when(
        trimmed.rlike(_HAS_OFFSET),
        F.when(raw == "Z", F.lit("+00:00")).otherwise(
            F.concat(F.substring(plain, 1, 3), F.lit(":"), F.substring(plain, 4, 2))),
    )


def local_part(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_HAS_OFFSET), F.trim(F.regexp_replace(trimmed, _OFFSET, ""))).otherwise(trimmed)


def iso_text(text: Column) -> Column:
    """ISO form of any accepted layout, keeping the written offset; else null."""
    local = parse_timestamp(local_part(text))
    micros = F.date_format(local, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.coalesce(utc_offset(text), F.lit("")))


def instant(text: Column) -> Column:
    """The moment meant by the text: local part minus its offset (none means UTC)."""
    offset = F.coalesce(utc_offset(text), F.lit("+00:00"))
    return F.to_utc_timestamp(parse_timestamp(local_part(text)), offset)


def parse_date_time(date: Column, time: Column) -> Column:
    """Strict ``yyyy-MM-dd`` and ``HH:mm:ss`` from two columns; else null."""
    joined = F.concat_ws(" ", F.trim(date), F.trim(time))
    shaped = joined.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(shaped & date.isNotNull() & time.isNotNull(),
                  F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_date(text: Column) -> Column:
    """Year-month-day with one or two digits for month and day; else null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(trimmed, F.lit("yyyy-M-d")))


def parse_clock(text: Column) -> Column:
    """Seconds since midnight of an ``H:m:s`` text (61 seconds at most); else null."""
    trimmed = F.trim(text)
    shaped = trimmed.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:([0-5]?\d|6[01])$")
    part = [F.split(trimmed, ":").getItem(i).try_cast("int") for i in range(3)]
    return F.when(shaped, part[0] * 3600 + part[1] * 60 + part[2])


def season(month: Column) -> Column:
    chain = None
    for name, months in V.SEASONS.items():
        hit = month.isin(list(months))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(month.isNotNull(), V.SEASON_ELSE)


def calendar_columns(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)          # Monday is 0
    return {
        "day_of_week": weekday,
        "month": F.month(ts),
        "season": season(F.month(ts)),
        "weekend_flag": F.coalesce(weekday.isin(5, 6), F.lit(False)),
    }


def time_keys(ts: Column) -> dict[str, Column]:
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return {
        "date": F.date_format(ts, "yyyy-MM-dd"),
        "time": F.concat(F.date_format(ts, "HH:mm:ss"), fraction),
        "hour_ts": F.date_trunc("hour", ts),
        "day_ts": F.date_trunc("day", ts),
    }
