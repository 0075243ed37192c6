"""Fill-in-the-middle transformation over a distinct-text index.

Rows are grouped by their text's digest, and a group's content is verified: the set of its texts, compared as texts, has
one member. Documents' ids are joined back to the distinct texts by digest. For each text the byte offsets of its code
points are computed once, where its first document stands, as an Elias-Fano list of two to four bits a code point; each
document's seeded cut is then two selects and three byte slices, without decoding the text. The lists aren't shuffled:
only distinct texts are, once, and ids.

A digest that more than one row in ``SPREAD`` bears is dealt over salted copies of its row, so that no task gets
a hot group; there can be no more than ``SPREAD`` of those, so their list (digests and counts) has a proven bound.

Defined cases: a null text is the empty one; empty texts and those that hold a sentinel stay plain; very long texts are
cut whole; a null id is seeded as the empty text; repeated rows, and texts under several ids, are each cut by their own
id; texts that share a digest are told apart by a second hash of another kind; an empty table gives an empty one; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
SPREAD = 4096
SAMPLED = 512


@dataclass(frozen=True)
class Boundaries:
    """An ascending list of offsets under Elias-Fano: low bits packed, high bits unary, every 512th one's place sampled."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray) -> Boundaries:
        """offsets: ascending, at least one."""
        n, top = len(offsets), int(offsets[-1])
        width = max(0, (top // n).bit_length() - 1)
        high = (offsets >> width) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        low = ((offsets[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
        return cls(n, width, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), high[::SAMPLED].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th offset: from the sample before it, words of the unary part are counted until the one is met."""
        at, left = int(self.places[i // SAMPLED]), i % SAMPLED
        if left:
            end = int(self.places[i // SAMPLED + 1]) if i // SAMPLED + 1 < len(self.places) else 8 * len(self.high)
            bits = np.unpackbits(self.high[at // 8 : end // 8 + 1], bitorder="little")[at % 8 :]
            at += int(np.flatnonzero(bits)[left])
        out = (at - i) << self.low_bits
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            out |= ((int(self.low[k >> 3]) >> (k & 7)) & 1) << b
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.count, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Boundaries:
        count, width, lows, highs = struct.unpack_from("<QBQQ", data)
        body = np.frombuffer(data, np.uint8, offset=25)
        return cls(count, width, body[:lows], body[lows : lows + highs], body[lows + highs :].view("<u4"))


def boundaries(text: bytes) -> Boundaries:
    """Where each code point of UTF-8 text begins, and where the last ends."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return Boundaries.of(np.append(starts, len(text)))


def seeds(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))  # type: ignore[return-value]


def cut_form(text: bytes, index: Boundaries, doc_id: str, seed: int = SEED) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points before the middle, code points in it, output)."""
    n = index.count - 1
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if not n or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = index.select(a), index.select(b)
    before, middle, after = (PREFIX.encode(), text[:x]), (MIDDLE.encode(), text[x:y]), (SUFFIX.encode(), text[y:])
    if h4 % 100 < SPM_BELOW:
        return "spm", a, b - a, b"".join(after + before + middle)
    return "psm", a, b - a, b"".join(before + after + middle)


def restore(output: bytes, form: str) -> bytes:
    """The text again, from an output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second.encode(), 1)
    two, middle = rest.split(MIDDLE.encode(), 1)
    return one + middle + two if form == "psm" else two + middle + one


def _cuts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, id as text, digest, text), the transformed texts. Rows of one text stand together, and its bounds
    are computed at the first of them."""
    known, body, index = None, b"", boundaries(b"")
    for b in batches:
        columns: list[list] = [[], [], [], [], []]
        for doc_id, digest, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), common.as_bytes(b.column(3)), strict=True):
            if digest != known or text != body:
                known, body, index = digest, text, boundaries(text)
            for column, value in zip(columns, (index.count - 1, *cut_form(text, index, doc_id, seed)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        n, form, before, middle, out = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([b.column(0), n, form, before, middle, out.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, spread: int = SPREAD, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each document's text with its middle moved to the end.

    Whole texts are shuffled once, copies within a task as one; what is joined to them is ids and digests.
    """
    spark = docs.sparkSession
    common.reachable(spark)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("seeded"), body.alias("body"))
    keyed = keyed.withColumn("digest", digest(F.col("body")))
    members = keyed.select("doc_id", "seeded", "digest", F.xxhash64("body").alias("h"))
    total = docs.count()
    hot = common.cut(members.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") * spread > total), "copies")
    hot = F.broadcast(hot.select("digest", F.ceil(F.col("copies") * spread / max(total, 1)).cast("int").alias("salts")))  # ``spread`` rows at most

    # the distinct texts of a digest, compared as texts: one of each, where the digest is a good one
    texts = lambda rows: rows.groupBy("digest").agg(F.collect_set("body").alias("bodies"))
    cold = texts(keyed.join(hot, "digest", "left_anti")).join(members.join(hot, "digest", "left_anti").hint("shuffle_hash"), "digest")
    salted = texts(keyed.join(hot, "digest", "left_semi")).join(hot, "digest").select("digest", "bodies", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    warm = salted.join(members.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("seeded"), F.col("salts")).cast("int")).hint("shuffle_hash"), ["digest", "salt"])
    own = F.when(F.size("bodies") == 1, F.col("bodies")[0]).otherwise(F.filter("bodies", lambda t: F.xxhash64(t) == F.col("h"))[0])
    schema = f"doc_id {members.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    made = [rows.select("doc_id", "seeded", "digest", own.alias("body")).mapInArrow(lambda batches: _cuts(batches, seed), schema) for rows in (cold, warm)]
    return made[0].unionByName(made[1])


def restored(output: Column | str, form: Column | str) -> Column:
    """``restore`` as a column."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = lambda text, by, i: F.split_part(text, F.lit(by), F.lit(i))
    first, middle = F.substring(output, 4, 2**31 - 1), part(output, MIDDLE, 2)
    psm = F.concat(part(first, SUFFIX, 1), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(first, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


SQL = """
WITH seeded AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, body, length(body) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM seeded
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN body
    WHEN 'psm' THEN '<P>' || substr(body, 1, a) || '<S>' || substr(body, b + 1) || '<M>' || substr(body, a + 1, b - a)
    ELSE '<S>' || substr(body, b + 1) || '<P>' || substr(body, 1, a) || '<M>' || substr(body, a + 1, b - a) END AS output FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(body) AS restored_sha256
FROM made
"""
