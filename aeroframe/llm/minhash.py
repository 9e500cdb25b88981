"""Near-duplicates by circulant MinHash, banding and exact verification on full shingle sets.

Two permutations of the 32-bit numbers make all coordinates: the first scatters the shingles, the second
is shifted circularly by k for coordinate k. Texts that agree in a band share a bucket.

Rows with equal sets collapse to one class first. Each class is compared with the one leader it meets most
often, then with some texts of the main component around it. What then shares a bucket but not yet a component
is a text that is alike without reaching the threshold. In a large group such texts are described by their
differences from a common centre: two of them can only be linked if they share a stated number of differences, so
each lists its first differences, as many as prefix filtering needs, and only texts that meet in one are compared.
Before whole sets are read, 1,024 parity bits of each set bound from below in how many shingles two texts differ.
A family of m texts needs about m comparisons, not m * m, and every candidate pair ends compared, connected or
excluded by that bound. A pair at similarity 0.8 misses all 32 bands of 4 with probability 5e-8.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; repeated rows
are copies of each other; an id on several texts counts with each of them; rows without an id are linked with
nothing and get a null component; an empty table gives an empty result. Component ids are the smallest ids
reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aeroframe.llm import common, shingles

BANDS, ROWS = 32, 4
PERCENT = 80
CHANCES = 2
DIRECT_TEXTS = 64                # in larger groups texts are compared by their differences from a centre
PARITY_WORDS = 16                # 64-bit numbers of parity bits per text
_A, _B, _SCATTER = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint64(0x9E3779B97F4A7C15)


def signature(values: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation of the scattered set, shifted by k."""
    scattered = (shingles.mixed(values * _SCATTER) >> np.uint64(32)).astype(np.uint32) * _A
    out = np.empty(size, np.uint32)
    with np.errstate(over="ignore"):
        shifts = np.arange(size, dtype=np.uint32) * _A
        for i in range(0, len(values), 4096):               # the permutation is a bijection of the 32-bit numbers
            x = scattered[i:i + 4096, None].T + shifts[:, None]
            x ^= x >> np.uint32(15)
            x *= _B
            least = x.min(1)
            out = np.minimum(out, least) if i else least
    return out ^ (out >> np.uint32(13))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different bands never sharing keys on purpose."""
    s = sig.astype(np.uint64).reshape(-1, rows)
    key = np.arange(len(s), dtype=np.uint64)
    for c in s.T:
        key = shingles.mixed(key * _SCATTER + c + np.uint64(1))
    return key.view(np.int64)


def digests(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, n_shingles, same, bands): set size, digest of the whole set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, bands = [], [], []
            for s in shingles.sets(batch.column(2), size):
                n.append(len(s))
                same.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "tag", "n_shingles", "same", "bands"])

    tag = F.col("tag") if "tag" in documents.columns else F.lit(None).cast("binary").alias("tag")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tag, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, tag binary, n_shingles long, same binary, bands array<long>")


def full_sets(documents: DataFrame, size: int) -> DataFrame:
    """(id, shingles): digest of the set as in ``digests``, and the whole sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [s.tobytes() for s in shingles.sets(batch.column(0), size)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh128_digest, raw), pa.binary()), pa.array(raw, pa.binary())], names=["id", "shingles"])

    return documents.select("text").mapInArrow(run, "id binary, shingles binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * common >= percent * united."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            common_ = shingles.count_common(x, y)
            out.append(100 * common_ >= percent * ((len(x) + len(y)) // 8 - common_))
        return pa.array(out, pa.bool_())

    with_b = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "set_b"}), "b")
    with_both = with_b.join(sets.withColumnsRenamed({"id": "a", "shingles": "set_a"}), "a")
    return with_both.where(similar.asNondeterministic()("set_a", "set_b")).select("a", "b")


_EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): alternating large and small stars.

    Each round is written; its digest tells when nothing changes any more. The number of tasks follows the
    number of edges.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, known = common.materialise(pairs.distinct(), "stars"), None
    while True:
        n, digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if known == (n, digest):
            break
        known, tasks = (n, digest), 1 + n // _EDGES_PER_TASK
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        lower = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        joined = large.join(lower, "u").coalesce(tasks)
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = common.materialise(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(tasks), "stars")
    heads = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(heads)


def _open(buckets: DataFrame, comps: DataFrame, seed: int = 0) -> DataFrame:
    """Members of the buckets that hold several components, with their own and the bucket's main one.

    ``other`` is a member of the main one, by chance of the seed.
    """
    named = buckets.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    chance = F.min(F.struct(F.xxhash64(F.lit(seed), "key", "id").alias("h"), F.col("id").alias("id")))
    held = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), chance.alias("o"))
    mixed = held.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component", "o.id")).alias("most"))
    return named.join(mixed.where("k > 1").select("key", F.col("most.component").alias("main"), F.col("most.id").alias("other")), "key")


def _fits(a: str, b: str, percent: int) -> F.Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _parities(shingles_: str) -> F.Column:
    """struct<m0 long, ...>: for every bit whether an odd number of the set's shingles falls on it."""
    names = [f"m{k}" for k in range(PARITY_WORDS)]

    @F.arrow_udf(f"struct<{', '.join(f'{m} long' for m in names)}>")
    def parities(held: pa.Array) -> pa.Array:
        bits = 64 * PARITY_WORDS
        odd = np.zeros((len(held), bits), np.uint8)
        for row, x in zip(odd, held.to_pylist()):
            place = np.frombuffer(x, np.uint64) % np.uint64(bits)
            row[:] = np.bincount(place.astype(np.int64), minlength=bits) & 1
        words = np.packbits(odd, axis=1).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(w)) for w in words.T], names=names)

    return parities.asNondeterministic()(shingles_)


def _may_link(x: str, y: str, nx: str, ny: str, percent: int) -> F.Column:
    """False only for sets that cannot be linked, by their parities x, y and sizes nx, ny.

    A bit that is odd in one set only stands for a shingle that only one of them has, so d such bits mean at
    least d differences; a link allows (100 - percent) / (100 + percent) of both sizes together.
    """
    differing = F.lit(0)
    for k in range(PARITY_WORDS):
        differing = differing + F.bit_count(F.col(f"{x}.m{k}").bitwiseXOR(F.col(f"{y}.m{k}")))
    return (100 + percent) * differing <= (100 - percent) * (F.col(nx) + F.col(ny))


def _centres(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(main, core): for every large group of (id, main) the sorted shingles that most of about 256 members have.

    Any set would do as a centre: the better it is, the fewer pairs are compared.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if held:
                main = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held])))
                yield pa.RecordBatch.from_arrays([main, pa.array(np.concatenate(held))], names=["main", "x"])

    sizes = texts.groupBy("main").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > DIRECT_TEXTS)
    some = texts.join(sizes, "main").where(F.expr("pmod(xxhash64(id), greatest(1, m div 256)) = 0"))
    some = common.materialise(some.join(sets, "id").select("main", "shingles"), "centre-texts")
    counted = some.mapInArrow(spread, "main binary, x long").groupBy("main", "x").agg(F.count(F.lit(1)).alias("k"))
    cores = counted.join(some.groupBy("main").agg(F.count(F.lit(1)).alias("of")), "main").where("2 * k > of")
    return cores.groupBy("main").agg(F.sort_array(F.collect_list("x")).alias("core"))


def _differences(own: str, core: str, percent: int) -> F.Column:
    """far, listed, asked and the first differences of a text from its centre, as ``_around_centres`` needs them.

    Shingles that the centre does not have come first: they are the rare ones.
    """

    @F.arrow_udf("struct<far long, listed int, asked int, first array<long>>")
    def differences(own: pa.Array, core: pa.Array) -> pa.Array:
        rows: list[tuple[int, int, int, np.ndarray]] = []
        ends = np.cumsum(core.value_lengths().to_numpy())
        flat, at = core.flatten().to_numpy(), 0
        for x, end in zip(own.to_pylist(), ends.tolist()):
            x, y, at = np.frombuffer(x, np.int64), flat[at:end], end
            added, missing = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            n, weight = len(added) + len(missing), 100 * len(missing) + percent * len(added)
            far = weight - (100 - percent) * len(y)
            listed = n + (weight + 1) // -(100 + percent) + 1
            asked = n + far // -100 + 1 if far > 0 else 0
            rows.append((far, listed, asked, np.concatenate((np.sort(added), np.sort(missing)))[:max(listed, asked, 0)]))
        columns = list(zip(*rows)) or [[]] * 4
        types = {"far": pa.int64(), "listed": pa.int32(), "asked": pa.int32(), "first": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

    return differences.asNondeterministic()(own, core)


def _around_centres(texts: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare within the large groups of (id, component, main, n, parity), and (id, group, far) of their texts.

    A text lacks a shingles of its group's centre of size l and adds b. If two texts share o of these
    differences, their common and united sizes are l - a - a' + o and l + b + b' - o. With
    far = 100 a + percent b - (100 - percent) l, a link needs (100 + percent) o >= far + 100 a' + percent b'.
    If far > 0 then 100 o >= far as well. Prefix filtering: of d differences in any common order, one of the
    first d - o + 1 is shared. Pairs of two texts with far <= 0 are not covered.
    """
    centres = common.materialise(_centres(texts, sets), "centres")     # apart, so that the texts of a hot group can be split
    known = texts.join(centres, "main").join(sets, "id").withColumn("d", _differences("shingles", "core", percent))
    spread = common.materialise(known.select("id", "component", "main", "n", "parity", "d.*"), "differences")
    each = spread.select("id", "component", "main", "n", "parity", "listed", "asked", F.posexplode("first").alias("place", "x"))
    met = each.groupBy("main", "x").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    # differences of one component only lead nowhere
    placed = common.materialise(each.join(met.select("main", "x"), ["main", "x"]), "first-differences")
    asks = placed.where("place < asked").select("main", "x", F.col("id").alias("i"), F.col("component").alias("ci"), F.col("n").alias("ni"), F.col("parity").alias("pi"))
    lists = placed.where("place < listed").select("main", "x", F.col("id").alias("j"), F.col("component").alias("cj"), F.col("n").alias("nj"), F.col("parity").alias("pj"))
    may = (F.col("ci") != F.col("cj")) & _may_link("pi", "pj", "ni", "nj", percent)
    pairs = asks.join(lists, ["main", "x"]).where(may).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    return pairs, spread.select("id", F.col("main").alias("group"), (F.col("far") > 0).alias("far"))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tag, component) for every row of ``documents`` (doc_id, text and perhaps a binary tag).

    The tag is handed through; ``component`` tells groups with one smallest id apart.
    """
    rows = common.materialise(digests(documents, size), "digests")
    usable = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = common.materialise(usable.groupBy(F.col("same").alias("id")).agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    members = classes.select("id", "least", "n", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = common.materialise(members.join(shared, "key"), "buckets")
    wanted = buckets.select("id", "least").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("least"), "text").where(F.col("doc_id").isNotNull())
    # rows of an id with another text drop out by their digest; repeated rows have one digest and one set
    sets = full_sets(texts.join(wanted.select("least").distinct(), "least"), size).join(wanted.select("id"), "id", "left_semi")
    sets = common.materialise(sets.dropDuplicates(["id"]), "sets")

    # the text that meets most others leads a bucket; a text is compared with the leader it meets most often
    met = buckets.groupBy("id").agg(F.sum("k").alias("met"))
    known = buckets.select("id", "key").join(met, "id")
    lead = known.groupBy("key").agg(F.max(F.struct("met", F.col("id").alias("l"))).alias("lead"))
    best = known.join(lead, "key").where("id <> lead.l").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("k"))
    best = best.groupBy("id").agg(F.max(F.struct("k", "lead")).alias("m")).select("id", F.col("m.lead.l").alias("o"))
    tested = common.materialise(best.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct(), "pairs")
    edges = common.materialise(linked(tested, sets, percent), "links")
    comps = components(edges)

    # what stands outside meets one text of the main component per bucket, so at most as many as it has bands
    for turn in range(CHANCES):
        outside = _open(buckets, comps, turn).where("component <> main")
        pairs = outside.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = common.materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        edges = common.materialise(edges.unionAll(linked(pairs, sets, percent)), "links")
        tested = tested.unionAll(pairs)
        comps = components(edges)

    # whatever shares a bucket and is neither compared nor connected: inside a large group by differences from its
    # centre, else directly, each pair in its first common band only
    open_ = common.materialise(_open(buckets, comps).join(classes.select("id", "bands"), "id"), "open")
    # a text belongs to the largest family that it meets
    meets = open_.select("id", "component", "main").distinct()
    family = meets.groupBy("main").agg(F.count(F.lit(1)).alias("k"))
    largest = meets.join(family, "main").groupBy("id", "component").agg(F.max(F.struct("k", "main")).alias("m"))
    texts = largest.select("id", "component", "m.main").join(sets, "id")
    sized = (F.length("shingles") / 8).cast("long").alias("n")
    texts = common.materialise(texts.select("id", "component", "main", sized, _parities("shingles").alias("parity")), "groups")
    alike, grouped = _around_centres(texts, sets, percent)
    each = open_.join(texts.select("id", "parity"), "id").join(grouped, "id", "left")
    left = each.where("component <> main").select("key", "band", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("bands").alias("bx"), F.col("parity").alias("px"), F.col("group").alias("gx"), F.col("far").alias("fx"))
    right = each.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), "main", F.col("bands").alias("by"), F.col("parity").alias("py"), F.col("group").alias("gy"), F.col("far").alias("fy"))
    new = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & _fits("nx", "ny", percent) & _may_link("px", "py", "nx", "ny", percent)
    covered = F.coalesce((F.col("gx") == F.col("gy")) & (F.col("fx") | F.col("fy")), F.lit(False))
    seen = F.arrays_overlap(F.slice("bx", F.lit(1), F.col("band")), F.slice("by", F.lit(1), F.col("band")))
    rest = left.join(right, "key").where(new & ~covered & ~seen).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = common.materialise(rest.unionAll(alike).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    edges = common.materialise(edges.unionAll(linked(rest, sets, percent)), "links")
    comps = components(edges)

    named = classes.select("id", "least").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select(F.col("id").alias("same"), "component", "component_id")
    done = rows.select("doc_id", "tag", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(ids, "same", "left")
    smallest = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == smallest, F.lit(True))
    return done.select("doc_id", "n_shingles", smallest.alias("component_id"), kept.alias("kept"), "tag", "component")
