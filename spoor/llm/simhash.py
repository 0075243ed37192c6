"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * r`` bits share a variant within ``r`` bits of both, so each *distinct*
fingerprint emits its ball of radius ``r`` and collisions on a variant are the candidates. A variant's
group holds at most as many distinct fingerprints as the ball has members (65 for ``r = 1``), whatever
the corpus looks like; copies never meet there, since equal fingerprints are one row.

Defined cases: a null or wordless text has fingerprint zero; fewer words than a shingle make one shingle;
very long texts are
hashed whole, in slices; rows that repeat or share an id keep their own row and count with that id; a tie in a
fingerprint's bit (set in just half of the hashes) leaves it unset; of rows with one id the lesser text hash stays
first; an empty table gives an empty one; other columns, whatever their names, aren't read by ``near_duplicates``
and pass through ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common

SEED = 42
WIDTH = 3
AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    set_in = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    for start in range(0, n, AT_ONCE):
        h = np.fromiter(hashes, "<u8", min(AT_ONCE, n - start))
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, h, fp): fp is the fingerprint as a signed long, h a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in common.as_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "h", "fp"])

    common.reachable(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, u > v, that connect all pairs within ``distance`` bits.

    Every member of a variant's group is linked with the group's least member, which keeps what is
    connected connected; the pair is verified all the same.
    """
    if distance != 2:
        raise ValueError("the ball is built for two bits: one on either side")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ball = distinct.repartition(parts, "fp").select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = ball.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("least"))
    near = met.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= distance))
    return near.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): every node of a component that isn't its least node, with that least node.

    Alternating large and small stars: a round needs aggregates that combine on the map side and joins that
    split hot keys, and O(log n) rounds suffice. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now, before = common.cut(edges, name), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now, before = now, common.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name), mark
        for path in {p.rsplit("/", 1)[0] for p in old.inputFiles()}:
            common.remove(spark, path)


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, first_id, root) for each distinct fingerprint of rows; root is one fingerprint of its component."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    stars = components(links(distinct.select("fp")))
    out = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    return out.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the groups that links of two bits or fewer connect."""
    rows = common.cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = _rooted(rows)
    heads = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least doc_id, null ids last.

    A kept row is known by its id and its text's hash, so rows without an id, or with a shared one, are told
    apart; only where a row repeats in both is a further deduplication needed.
    """
    rows = common.cut(fingerprints(docs), "fingerprints")
    roots = _rooted(rows).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    own = rows.groupBy("fp").agg(F.min(place).alias("row"))
    kept = common.cut(own.join(roots, "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("k_id"), F.col("row.h").alias("k_h")), "kept")
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    on = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    out = left.join(kept.hint("shuffle_hash"), on, "left_semi").select("row.*")
    repeated = rows.join(kept, on, "left_semi").groupBy("doc_id", "h").count().where("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
