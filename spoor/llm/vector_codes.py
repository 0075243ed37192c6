"""Vector compression by product codes, with annular norm pruning of the nearest-entry search.

Vectors become integers and are cut into equal parts; each part position has a codebook of a few entries, fitted over
all vectors in a fixed number of rounds. To find a part's nearest entry, the entries stand sorted by norm. Two points lie
at least as far apart as their norms, so after the entry of the closest norm has given a distance, a binary search bounds
the interval of norms that can hold a nearer or an equally near one, and only entries within it (ends included) are
evaluated, in exact integers. As the distance shrinks, so does the interval.

A round is one pass: tasks sum their parts by entry, Spark adds the sums, and the driver gets the codebooks alone.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped, and so are rows of another
length than the row of the least id has; where parts can't be equal, vectors are padded with zeros; null ids sort last, and
ties of ids are ordered by their vectors; with fewer rows than entries, each row starts one; equal entries keep the lower
index and the others stay unused; integers are held within the bound that keeps an error a long (32,768 before scaling at
64 components); empty vectors have code zero; repeated rows count each; an empty table gives an empty one; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLACK = 1e-9


@dataclass(frozen=True)
class Codebooks:
    """books: integers by part, entry and position within the part; length: that of the vectors."""

    books: np.ndarray
    length: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def most(length: int) -> int:
    """The largest integer of a component with which a whole vector's squared distance is still a long."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def whole(vectors: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """Integers by row, part and position of rows of finite doubles."""
    rows, length = vectors.shape
    with np.errstate(over="ignore"):
        ints = np.clip(np.floor(vectors * scale), -most(length), most(length)).astype(np.int64)
    width = -(-length // parts)
    return np.pad(ints, ((0, 0), (0, width * parts - length))).reshape(rows, parts, width)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index, and how many were evaluated."""
    norms = np.sqrt((book.astype(float) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    ring, entries, own = norms[order], book[order], np.sqrt((points.astype(float) ** 2).sum(axis=1))
    slack = SLACK * (1 + own + ring[-1])  # far above the rounding of norms: at most more entries are evaluated

    after = np.clip(np.searchsorted(ring, own), 1, len(ring) - 1) if len(ring) > 1 else np.zeros(len(own), int)
    start = after - (own - ring[after - 1] < ring[after] - own) if len(ring) > 1 else after
    index, distance = order[start], ((points - entries[start]) ** 2).sum(axis=1)
    reach = np.sqrt(distance.astype(float)) + slack
    low, high = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    evaluated = len(points)
    for j in range(len(ring)):
        at = np.flatnonzero((low <= j) & (j < high) & (j != start) & (np.abs(own - ring[j]) <= reach))
        evaluated += len(at)
        d = ((points[at] - entries[j]) ** 2).sum(axis=1)
        better = (d < distance[at]) | ((d == distance[at]) & (order[j] < index[at]))
        won = at[better]
        index[won], distance[won] = order[j], d[better]
        reach[won] = np.sqrt(d[better].astype(float)) + slack[won]
    return index, distance, evaluated


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(vec_id, v[, label]): rows with finite vectors, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = [F.col(label_col).alias("label")] if label_col else []
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), *label).where(F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), length)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of rows (vec_id, v); None of an empty table."""
    spark = rows.sparkSession
    first = rows.select(F.col("vec_id").isNull().alias("last"), "vec_id", "v").orderBy("last", "vec_id", "v").limit(1).collect()
    if not first:
        return None
    length = len(first[0].v)
    even = rows.where(F.size("v") == length)
    starts = even.select(F.col("vec_id").isNull().alias("last"), "vec_id", "v").orderBy("last", "vec_id", "v").limit(entries).collect()
    books = whole(np.array([r.v for r in starts], float).reshape(len(starts), length), parts, scale).transpose(1, 0, 2).copy()
    if not length:
        return Codebooks(books, 0)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            book = sent.value
            count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
            for b in batches:
                points = whole(_matrix(b.column(0), length), parts, scale)
                for p in range(parts):
                    index = nearest(points[:, p], book[p])[0]
                    np.add.at(count[p], index, 1)
                    np.add.at(total[p], index, points[:, p])
            place = np.flatnonzero(np.repeat(count.ravel() > 0, book.shape[2]))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.repeat(count.ravel(), book.shape[2])[place]), pa.array(total.ravel()[place])], ["place", "n", "total"])

        added = even.select("v").mapInArrow(sums, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        flat = books.ravel().copy()
        for r in added.collect():  # at most one row for each integer of the codebooks
            flat[r.place] = int(r.total) // r.n
        books = flat.reshape(books.shape)
        sent.unpersist()
    return Codebooks(books, length)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """rows (vec_id, v, ...) that have the codebooks' length, with code and error in place of v."""
    sent, length = rows.sparkSession.sparkContext.broadcast(codebooks.books), codebooks.length
    others = [c for c in rows.columns if c != "v"]
    parts = len(codebooks.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = whole(_matrix(b.column(0), length), parts) if length else np.zeros((b.num_rows, parts, 0), np.int64)
            code, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for p in range(parts if length else 0):
                index, distance, _ = nearest(points[:, p], sent.value[p])
                code[:, p] = index
                error += distance
            names = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], names, pa.array(error)], [*others, "code", "error"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.where(F.size("v") == length).select("v", *others).mapInArrow(run, f"{kinds}, code string, error long")


def decode(code: str, codebooks: Codebooks) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([codebooks.books[p, e] for p, e in enumerate(bytes.fromhex(code))])[: codebooks.length]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    common.reachable(vectors.sparkSession)
    rows = kept(vectors, id_col, vector_col, label_col)
    codebooks = fit(rows.select("vec_id", "v"))
    if codebooks is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = common.cut(encode(rows, codebooks), "codes")
    totals = common.cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT id, p, v, min((d, e)) AS best FROM (
    SELECT r.id, r.p, r.v, b.e, list_sum(list_transform(list_zip(r.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts r JOIN b{i} b ON r.p = b.p) GROUP BY id, p, v
), s{i} AS MATERIALIZED (
  SELECT p, e, list(floor_of ORDER BY k) AS v FROM (
    SELECT p, e, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
    FROM (SELECT p, best[2] AS e, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{i}) GROUP BY p, e, k) GROUP BY p, e
), b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{i} b LEFT JOIN s{i} s ON b.p = s.p AND b.e = s.e
),"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)
), b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM parts WHERE id <= {ENTRIES}),
{"".join(_round(i) for i in range(ROUNDS + 1))}
coded AS (
  SELECT id, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY id
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (id), books
"""
