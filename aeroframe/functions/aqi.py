"""National air-quality index as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe import values as V


def _column_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def standard_pollutant_name(name: Column) -> Column:
    """Exact synonym first, then without blanks and hyphens in lower case; unknown is null."""
    synonyms = _column_map(V.POLLUTANT_SYNONYMS)
    folded = F.lower(F.regexp_replace(F.trim(name), "[ -]", ""))
    return F.coalesce(F.try_element_at(synonyms, name), F.try_element_at(synonyms, folded))


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= 0)


def truncate_concentration(pollutant: str, x: Column) -> Column:
    """Cut to whole numbers (CO and Pb: tenths); negative, NaN and null give null."""
    x = x.cast("double")
    # rounding to six decimals before the cut: half a millionth is added, which stays in primitive code
    fixed = x + 5e-7
    if pollutant in V.ONE_DECIMAL_POLLUTANTS:
        cut = F.floor(fixed * 10).cast("double") / 10
    else:
        cut = F.floor(fixed).cast("double")
    return F.when(_valid(x), cut)


def _segments(pollutant: str, cut: Column, rounded: bool) -> Column:
    """Truncated values fall on the steps of the table, so the segments have no gaps and one
    upper-bound test per segment is enough."""
    chain = None
    for low, high, index_low, index_high in V.BREAKPOINTS[pollutant]:
        value = F.lit((index_high - index_low) / (high - low)) * (cut - low) + index_low
        chain = F.when(cut <= high, value) if chain is None else chain.when(cut <= high, value)
    # the last branch carries the null test: null <= high is unknown, never true
    chain = chain.when(cut.isNotNull(), F.lit(V.INDEX_CAP))
    return F.rint(chain).cast("int") if rounded else chain


def sub_index(pollutant: str, x: Column, rounded: bool = True) -> Column:
    """Piecewise-linear sub-index, capped at 500; rounded half to even."""
    return _segments(pollutant, truncate_concentration(pollutant, x), rounded)


def with_sub_indices(df: DataFrame, columns: dict[str, str], rounded: bool = True) -> DataFrame:
    """Add ``<column>_index`` per pollutant.

    Two projections: truncation is computed once per value and the segment tests refer to it, which
    keeps the generated code small enough to be compiled.
    """
    cuts = df.withColumns({f"_cut_{c}": truncate_concentration(p, F.col(c)) for p, c in columns.items()})
    indexed = cuts.withColumns({f"{c}_index": _segments(p, F.col(f"_cut_{c}"), rounded) for p, c in columns.items()})
    return indexed.drop(*[f"_cut_{c}" for c in columns.values()])


def requirements_met(concentrations: dict[str, Column]) -> Column:
    """At least three valid pollutants, one of them particulate matter."""
    ok = {p: F.coalesce(_valid(c.cast("double")), F.lit(False)) for p, c in concentrations.items()}
    count = reduce(lambda a, b: a + b, [v.cast("int") for v in ok.values()])
    particulate = [ok[p] for p in V.PARTICULATES if p in ok]
    return (count >= 3) & (reduce(or_, particulate) if particulate else F.lit(False))


def category(index: Column) -> Column:
    """Name by upper bound (50, 100, 200, 300, 400, above).

    All bounds are multiples of 50, so one division finds the place in a list. The index is mentioned
    twice only: filters on the category stay small when they are pushed below the index computation.
    """
    step = V.AQI_CATEGORIES[0][0]
    names: list[str] = []
    for bound, name in V.AQI_CATEGORIES:
        names += [name] * (bound // step - len(names))
    names.append(V.AQI_WORST)
    place = F.least(F.greatest(F.ceil(index / step), F.lit(1)), F.lit(len(names))).cast("int")
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), place))


def category_order(name: Column) -> Column:
    names = [n for _, n in V.AQI_CATEGORIES] + [V.AQI_WORST]
    return F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int")


def with_index(
    df: DataFrame,
    columns: dict[str, str] | None = None,
    enforce_requirements: bool = False,
    rounded: bool = True,
    tied: bool = False,
) -> DataFrame:
    """Add ``<column>_index`` per pollutant, ``aqi`` and ``dominant`` (and ``tied`` as a list).

    ``columns`` maps pollutant to column; by default every known column that is present.
    """
    columns = columns or {p: c for p, c in V.POLLUTANT_COLUMNS.items() if c in df.columns}
    named = sorted(columns)          # name order decides ties
    index_of = {p: f"{columns[p]}_index" for p in named}
    out = with_sub_indices(df, columns, rounded)

    parts = [F.col(index_of[p]) for p in named]
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    if enforce_requirements:
        top = F.when(requirements_met({p: F.col(columns[p]) for p in named}), top)
    out = out.withColumn("aqi", top)

    chain = None
    for p in named:
        hit = F.col(index_of[p]) == F.col("aqi")
        chain = F.when(hit, p) if chain is None else chain.when(hit, p)
    out = out.withColumn("dominant", chain)
    if tied:
        hits = [F.when(F.col(index_of[p]) == F.col("aqi"), F.lit(p)) for p in named]
        out = out.withColumn("tied", F.array_compact(F.array(*hits)))
    return out
