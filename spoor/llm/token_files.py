"""Token ids as files of patched frame-of-reference blocks, and their reader.

A file's row is a segment: whole documents in ascending id order, their lengths, and one payload. The payload
cuts the segment's ids into blocks of 512; a block keeps its minimum, the offsets from it packed at the width
that holds ``PERCENTILE`` of them, and the other offsets' upper bits in an exception list. Block starts and
exception starts are indexed, so a block can be read alone. Parquet is only the container: Spark's committer
makes the files whole or absent when executors are lost, on any file system Spark can write.

Defined cases: a null text is empty and so has only the end id; rows that share an id stand side by side,
ordered by their text; null ids come first; very long texts are encoded whole, and a document is never
split over segments; rows equal in id and text are alike, so their order shows in nothing; an empty table writes
files without segments; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import common
from spoor.llm.encoder import encoder, runs_of

BLOCK, PERCENTILE, SEGMENT = 512, 0.96, 1 << 18
SHARD_BYTES = 64 << 20
_HEAD = struct.Struct("<4sIQQQ")  # magic, block, ids, packed words, exceptions


def _lanes(width: int) -> list[tuple[int, int]]:
    return [divmod(j * width, 64) for j in range(64)]


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values below 2**width -> (k, BLOCK/64*width) words of 64 bits."""
    v = np.ascontiguousarray(rows.astype(np.uint64).reshape(-1, 64).T)
    out = np.zeros((width, v.shape[1]), np.uint64)
    for j, (word, off) in enumerate(_lanes(width)):
        out[word] |= v[j] << np.uint64(off)
        if off + width > 64:
            out[word + 1] |= v[j] >> np.uint64(64 - off)
    return np.ascontiguousarray(out.T).reshape(len(rows), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, w.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j, (word, off) in enumerate(_lanes(width)):
        x = w[word] >> np.uint64(off)
        if off + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - off))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), -1)


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload for unsigned 32-bit ids."""
    n = len(ids)
    k = -(-n // block)
    grid = np.full(k * block, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(k, block)
    least = grid.min(axis=1) if k else np.zeros(0, np.uint32)
    off = grid - least[:, None]
    at = min(block - 1, int(percentile * block))
    typical = np.partition(off, at, axis=1)[:, at] if k else np.zeros(0, np.uint32)
    width = np.maximum(1, np.frexp(typical.astype(np.float64))[1]).astype(np.uint8)
    high = (off.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    rows, places = np.nonzero(high)
    sizes = width.astype(np.int64) * (block // 64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    patches = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=k))]).astype(np.uint64)
    words = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        packed = _pack(off[of] & np.uint32((1 << int(w)) - 1), int(w))
        words[(starts[of].astype(np.int64)[:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    head = _HEAD.pack(b"PFOR", block, n, len(words), len(rows))
    parts = (least.astype("<u4"), width, starts.astype("<u8"), patches.astype("<u8"), words.astype("<u8"), places.astype("<u2"), high[rows, places].astype("<u4"))
    return b"".join([head, *(p.tobytes() for p in parts)])


def unpack_ids(payload: bytes) -> np.ndarray:
    """The ids of a payload, as little-endian unsigned 32-bit integers."""
    magic, block, n, n_words, n_patches = _HEAD.unpack_from(payload)
    if magic != b"PFOR":
        raise ValueError("not a block payload")
    k, pos, got = -(-n // block), _HEAD.size, []
    for kind, count in (("<u4", k), ("u1", k), ("<u8", k + 1), ("<u8", k + 1), ("<u8", n_words), ("<u2", n_patches), ("<u4", n_patches)):
        got.append(np.frombuffer(payload, kind, count, pos))
        pos += got[-1].nbytes
    least, width, starts, patches, words, places, high = got
    off = np.empty((k, block), np.uint64)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        size = int(w) * (block // 64)
        off[of] = _unpack(words[starts[of].astype(np.int64)[:, None] + np.arange(size)], int(w))
    rows = np.repeat(np.arange(k), np.diff(patches.astype(np.int64)))
    off[rows, places] |= high.astype(np.uint64) << width[rows].astype(np.uint64)
    return (off + least[:, None].astype(np.uint64)).ravel()[:n].astype("<u4")


def write_ids(docs: DataFrame, path: str, vocab: str, end_id: int) -> None:
    """Encode docs and write their ids under path, a shard for each range of ids."""
    spark = docs.sparkSession
    common.reachable(spark)
    bytes_in = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, bytes_in // SHARD_BYTES))
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, start = encoder(vocab), TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def segment() -> pa.RecordBatch:
            lengths = pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64()))
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = [pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(id_type)), lengths, pa.array([pack_ids(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "start", "n_ids", "doc_ids", "lengths", "payload"])

        for b in batches:
            id_type, texts = b.schema.field(0).type, common.texts(b.column(1))
            keys = b.column(0).to_pylist()
            for a, z in runs_of(texts):
                for key, ids in zip(keys[a:z], enc.encode(texts[a:z])):
                    held.append(ids + end)
                    names.append(key)
                    size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield segment()
                    start += size
                    held, names, size = [], [], 0
        if held:
            yield segment()

    rows = docs.select("doc_id", "text")
    dealt = rows.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    schema = f"shard int, start long, n_ids long, doc_ids array<{kind.simpleString()}>, lengths array<long>, payload binary"
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_documents(docs_type: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids from the files; start counts all ids before it."""
    spark = files.sparkSession
    common.reachable(spark)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each shard written
    before = np.concatenate([[0], np.cumsum([r.n for r in totals], dtype=np.int64)]).tolist()
    bases = spark.createDataFrame([(r.shard, b) for r, b in zip(totals, before)], "shard int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, ids, lengths, payload in zip(*(b.column(i) for i in range(5))):
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                raw = memoryview(unpack_ids(payload.as_py()).tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist())]
                columns = [ids.values, pa.array(np.full(len(n), shard.as_py(), np.int32)), pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "local", "n_tokens", "ids_crc32"])

    picked = files.select("shard", "start", "doc_ids", "lengths", "payload")
    rows = picked.mapInArrow(run, f"doc_id {docs_type}, shard int, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, vocab: str, end_id: int = 2) -> DataFrame:
    """Write docs' ids under path and describe each document from the files."""
    write_ids(docs, path, vocab, end_id)
    return read_documents(docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.read.parquet(path))
