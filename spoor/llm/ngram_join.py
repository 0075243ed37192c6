"""N-gram Jaccard join by grouped prefixes: documents whose shingle sets overlap by a given share are connected.

A document is the set of its distinct word shingles (64-bit hashes). All sets are sorted by one order, the shingles that
most documents have last, so two sets that overlap enough share a shingle among the first few of each: their prefixes.

1. Equal sets are one set, and sets with the same prefix and size are one group.
2. Groups that share a prefix shingle make pairs, which sizes, places in the prefix and bitmaps filter.
3. Pairs are expanded into their members, whose whole sets are compared exactly.

A set's bitmap has a bit for each of 512 classes of hashes, set if the set has an odd number of them. Two bitmaps differ in
no more bits than the sets do in shingles, so the filter loses nothing, and it spares most near misses their comparison.

Pairs that are connected already need no comparison, so there are two rounds. The first compares each member with one
hub of its shingle and size class (the group whose prefix has the shingle earliest) and with one member of its own group:
a number of pairs linear in the prefixes, which joins up the members of a large group of near copies. The second forms all
pairs of *different* components on a shingle or in a group; there the largest component of a shingle meets the others, and
never itself. A pair whose prefixes also share one of the two shingles before one isn't made there, as it is made earlier.
What both rounds leave out is connected, so components are those of all links.

The order is exact and the same for all documents: counted over all of them are the shingles that come first by hash in
each (a fifth of its set), and the ``RANKED`` most frequent ones, a table of bounded size, go last, by frequency. The bound
decides how much work is left, never which pairs are found.

Defined cases: null and wordless texts are empty sets, which are linked with nothing and are their own component; fewer
words than a shingle make one of the whole sequence; very long texts are taken whole; rows that repeat or share an id
count with that id; null ids are in no component's name (a component of null ids alone has none); two shingles of one
hash count as one (one in 10^7 for a set of a million); ties in the order go by hash; an empty table gives an empty one;
other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm import common
from spoor.llm.simhash import components

WIDTH = 3
PERCENT = 90
RANKED = 1 << 20
BITS = 26
WORDS = [f"w{i}" for i in range(8)]  # of a set's bitmap
EARLIER = ["p1", "p2"]  # the shingles just before one in its prefix


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    k = min(width, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h + w[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_length(n: int, percent: int) -> int:
    """Two sets of which one has n shingles and that overlap by percent share one of the first so many."""
    return n - -(-percent * n // 100) + 1


class Order:
    """Shingles by (rank, hash): those without a rank come first."""

    def __init__(self, listed: np.ndarray, ranks: np.ndarray) -> None:
        """listed: ascending hashes."""
        self.listed, self.ranks = listed, ranks

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Order:
        by = np.argsort(hashes)
        listed, ranks = hashes[by], np.empty(len(by), np.int32)
        ranks[np.lexsort((listed, counts[by]))] = np.arange(1, len(by) + 1, dtype=np.int32)
        return cls(listed, ranks)

    def first(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """The k first of ascending hashes."""
        if not len(self.listed):
            return hashes[:k]
        at = np.minimum(np.searchsorted(self.listed, hashes), len(self.listed) - 1)
        rank = np.where(self.listed[at] == hashes, self.ranks[at], 0)
        plain = hashes[rank == 0][:k]
        return plain if len(plain) == k else hashes[np.argsort(rank, kind="stable")[:k]]


def frequent(texts: DataFrame, width: int, percent: int, most: int) -> Order:
    """The order after the most frequent shingles of texts, of which no more than ``most`` come to the driver."""

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slice_ in _slices(common.as_bytes(b.column(0))):
                found = [s[: 2 * prefix_length(len(s), percent)] for s in (shingles(t, width) for t in slice_)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    counts = texts.mapInArrow(early, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = common.cut(counts, "shingle-counts")
    sizes = counts.groupBy("n").agg(F.count("*").alias("shingles")).withColumn("log", F.floor(F.log2("n") * 8).cast("int"))
    # classes of counts, at most 8 a doubling, from the most frequent down as long as all fit
    total, least = 0, None
    for r in sizes.groupBy("log").agg(F.sum("shingles").alias("shingles"), F.min("n").alias("n")).orderBy(F.desc("log")).collect():
        total += r.shingles
        if total > most:
            break
        least = r.n
    if least is None:
        return Order(np.empty(0, np.uint64), np.empty(0, np.int32))
    listed = counts.where(F.col("n") >= least).toArrow()
    return Order.of(listed["shingle"].to_numpy().view(np.uint64), listed["n"].to_numpy())


def _slices(texts: list[bytes], most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Texts in runs of about so many bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _digest(*arrays: np.ndarray) -> bytes:
    h = xxhash.xxh3_128()
    for a in arrays:
        h.update(a.tobytes())
    return h.digest()


def signatures(named: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """(doc_id, digest, n, key, prefix, bitmap) of rows (doc_id, text): digest names the set, key its prefix and size."""
    sent = named.sparkSession.sparkContext.broadcast((order.listed, order.ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*sent.value)
        for b in batches:
            digest, n, key, prefix, bitmap = [], [], [], [], np.zeros((b.num_rows, len(WORDS)), np.int64)
            for t in common.as_bytes(b.column(1)):
                s = shingles(t, width)
                p = order.first(s, prefix_length(len(s), percent)) if len(s) else s
                odd = np.bincount((s & np.uint64(64 * len(WORDS) - 1)).astype(np.int64), minlength=64 * len(WORDS)) & 1
                bitmap[len(n)] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                n.append(len(s))
                digest.append(_digest(s))
                key.append(_digest(p, np.array([len(s)])))
                prefix.append(p.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), *map(pa.array, bitmap.T.copy())],
                ["doc_id", "digest", "n", "key", "prefix", *WORDS],
            )

    words = ", ".join(f"{w} long" for w in WORDS)
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, digest binary, n long, key binary, prefix array<long>, {words}")


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return (100 + percent) * shared >= percent * (n + m)


def _may(a: str, b: str, percent: int) -> Column:
    """Whether sets of n shingles may overlap enough if the first that they share stands at ``place`` (from 0)."""
    c = lambda t, x: F.col(f"{t}.{x}")
    left = F.least(c(a, "n") - c(a, "place"), c(b, "n") - c(b, "place"))
    return _enough(left, c(a, "n"), c(b, "n"), percent)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets may overlap enough by their bitmaps; true where one isn't known."""
    c = lambda t, x: F.col(f"{t}.{x}")
    apart = reduce(Column.__add__, [F.bit_count(c(a, w).bitwiseXOR(c(b, w))) for w in WORDS])
    return F.coalesce((100 + percent) * apart <= (100 - percent) * (c(a, "n") + c(b, "n")), F.lit(True))


def _met(a: str, b: str) -> Column:
    """Whether prefixes share one of the shingles just before this one, where the pair has been made."""
    same = reduce(Column.__or__, [F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x in EARLIER for y in EARLIER])
    return F.coalesce(same, F.lit(False))


def crossing(told: DataFrame, percent: int) -> DataFrame:
    """All pairs of groups of different labels that may overlap enough, each made at few of the shingles it shares."""
    a, b = told.where("label <> main").alias("a"), told.alias("b")
    other = (F.col("b.label") == F.col("b.main")) | (F.col("a.label") < F.col("b.label"))
    met = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where((F.col("a.label") != F.col("b.label")) & other & _may("a", "b", percent) & ~_met("a", "b") & _alike("a", "b", percent))
    return met.select(F.col("a.gid").alias("ga"), F.col("a.label").alias("la"), F.col("b.gid").alias("gb"), F.col("b.label").alias("lb"))


def verified(pairs: DataFrame, named: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets, each a struct (sid, digest, doc_id), those (u, v) that overlap enough, by their whole sets.

    The sets are made again of the texts they came from, after a bitmap of fixed size has kept most others out, and
    shuffled by their digests once; the pairs come to them.
    """
    spark = pairs.sparkSession
    asked = pairs.select(_bit("a.doc_id").alias("bit")).union(pairs.select(_bit("b.doc_id")))
    rows = asked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros((1 << BITS) // 8, np.uint8)  # 8 MB, whatever the number of rows
    for r in rows:
        start = (r.bucket - 1) * len(r.bits)
        bitmap[start : start + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in batches:
            at = b.column(1).to_numpy() - 1
            b = b.filter(pa.array((bitmap[at >> 3] >> (at & 7)) & 1 == 1))
            for start in range(0, b.num_rows, 64):
                found = [shingles(t, width) for t in common.as_bytes(b.column(0).slice(start, 64))]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["digest", "shingles"])

    made = named.select("text", _bit("doc_id").alias("bit")).mapInArrow(run, "digest binary, shingles array<long>")
    whole = made.groupBy("digest").agg(F.any_value("shingles").alias("shingles"))
    one, two = (whole.select(F.col("digest").alias(d), F.col("shingles").alias(s)) for d, s in (("one", "x"), ("two", "y")))
    both = pairs.select("a.sid", F.col("b.sid").alias("other"), F.col("a.digest").alias("one"), F.col("b.digest").alias("two")).join(one, "one").join(two, "two")
    near = both.where(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent))
    return near.select(F.greatest("sid", "other").alias("u"), F.least("sid", "other").alias("v")).distinct()


def _bit(doc_id: str) -> Column:
    """From 1 to 2 ** BITS."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << BITS)) + 1


def _set(side: str) -> Column:
    return F.struct(*(F.col(f"{side}.{c}") for c in ("sid", "digest", "doc_id"))).alias(side)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, ranked: int = RANKED) -> DataFrame:
    """(doc_id, n_shingles, component_id): the groups that links of percent or more connect, named by their least id."""
    spark = docs.sparkSession
    common.reachable(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = frequent(named.select("text"), width, percent, ranked)
    signed = common.cut(signatures(named, order, width, percent), "signatures")

    some = signed.where("n > 0")
    groups = common.cut(some.groupBy("key").agg(F.max("n").alias("n"), F.max("prefix").alias("prefix")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    bitmap = [F.max(w).alias(w) for w in WORDS]
    sets = some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), *bitmap)
    sets = common.cut(sets.join(groups.select("key", "gid", "n"), "key").drop("key").withColumn("sid", F.monotonically_increasing_id()), "sets")
    hubs = sets.groupBy("gid", "n").agg(F.min_by(F.struct("sid", "digest", "doc_id", *WORDS), "sid").alias("hub"), F.count("*").alias("members")).select("gid", "n", "members", "hub.*")

    all_places = groups.select("gid", "n", "prefix", F.posexplode("prefix").alias("place", "shingle"))
    all_places = all_places.select("gid", "n", "place", "shingle", *(F.get("prefix", F.col("place") - i).alias(p) for i, p in enumerate(EARLIER, 1)))
    shared = all_places.groupBy("shingle").agg(F.count("*").alias("groups")).where("groups > 1").select("shingle")
    places = common.cut(all_places.join(shared, "shingle"), "places")

    # first round: members against hubs
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    classed = places.withColumn("of_size", size_class)
    best = classed.groupBy("shingle", "of_size").agg(F.min(F.struct("place", "n", "gid")).alias("best")).select("shingle", "of_size", "best.*")
    met = classed.alias("a").join(best.alias("b"), ["shingle", "of_size"]).where((F.col("a.gid") != F.col("b.gid")) & _may("a", "b", percent))
    met = met.select(F.col("a.gid").alias("mine"), F.col("b.gid").alias("other")).distinct()
    of_other = hubs.withColumnRenamed("gid", "other").alias("b")
    across = met.join(of_other, "other").join(sets.alias("a"), F.col("mine") == F.col("a.gid"))
    within = sets.alias("a").join(hubs.where("members > 1").alias("b"), F.col("a.gid") == F.col("b.gid")).where("a.sid <> b.sid")
    pairs = reduce(DataFrame.union, [x.where(_alike("a", "b", percent)).select(_set("a"), _set("b")) for x in (across, within)])
    pairs = common.cut(pairs, "pairs")
    first = common.cut(verified(pairs, named, width, percent), "links")

    # second round: members of different components
    stars = components(first)
    marked = sets.join(stars.select(F.col("u").alias("sid"), "v"), "sid", "left")
    marked = common.cut(marked.select("gid", "n", "sid", "digest", "doc_id", F.coalesce("v", "sid").alias("label"), *WORDS), "labels")
    alone = [F.when(F.count("*") == 1, F.max(w)).alias(w) for w in WORDS]
    labels = marked.groupBy("gid", "n", "label").agg(*alone)
    own = labels.join(labels.groupBy("gid").count().where("count > 1").select("gid"), "gid").withColumns({"shingle": F.xxhash64("gid", F.lit("group")), "place": F.lit(0)} | {p: F.lit(None).cast("long") for p in EARLIER})
    what = ["shingle", "place", "gid", "n", "label", *EARLIER, *WORDS]
    spots = common.cut(places.join(labels, ["gid", "n"]).select(what).union(own.select(what)), "spots")
    mixed = spots.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    counted = spots.join(mixed, "shingle").groupBy("shingle", "label").agg(F.count("*").alias("spots"))
    main = common.cut(counted.groupBy("shingle").agg(F.max_by("label", F.struct("spots", "label")).alias("main")), "main-labels")
    told = common.cut(spots.join(main, "shingle"), "mixed-spots")
    crossed = crossing(told, percent).distinct()
    a, b = marked.alias("a"), marked.alias("b")
    pairs = crossed.join(a, (F.col("ga") == F.col("a.gid")) & (F.col("la") == F.col("a.label"))).join(b, (F.col("gb") == F.col("b.gid")) & (F.col("lb") == F.col("b.label"))).where(_alike("a", "b", percent))
    pairs = common.cut(pairs.select(F.least(_set("a"), _set("b")).alias("a"), F.greatest(_set("a"), _set("b")).alias("b")).distinct(), "pairs")
    stars = components(first.union(verified(pairs, named, width, percent)))

    rooted = sets.join(stars.select(F.col("u").alias("sid"), "v"), "sid", "left").select("digest", "doc_id", F.coalesce("v", "sid").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    parts = common.cut(rooted.join(heads, "root").select("digest", "component_id"), "parts")
    return signed.join(parts, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
