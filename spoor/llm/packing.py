"""Packing documents into sequences: bounded-space online best fit.

Each partition keeps ``OPEN`` windows. A document's full windows leave at once; its remainder goes to the open
window with the least room that holds it. If none does, the fullest is emitted: the remainder's head fills its
gap when that is at least ``CUT`` ids, and the rest is placed again. What stays open at a partition's end is
merged in rounds over groups of ``FAN`` partitions, so no task gathers more than a fixed number of windows.
The last window of all is cut at powers of two, which need no padding.

Defined cases: a null text is empty and so has only the end id; repeated rows and ids are packed row by row;
a very long text fills window after window; of windows that fit alike the first opened is taken; an empty table gives
no pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import common
from spoor.llm.encoder import encoder, runs_of

WINDOW, OPEN, CUT, FAN = 1024, 64, 8, 64
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Sequence ids: the round in the upper bits, then the partition or group, then a counter.
_ROUND, _PART = 56, 28


class _Packer:
    """The open windows of one partition. A piece is (doc, start, total, ids as bytes)."""

    def __init__(self, window: int, most_open: int, cut: int):
        self.window, self.most, self.cut = window, most_open, cut
        self.room: list[tuple[int, int]] = []  # (room, window's number), ascending
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list[tuple]]]:
        """Place a document; yields (number, pieces) of windows that are full or emitted."""
        total = len(ids) // 4
        at = 0
        while total - at >= self.window:
            yield self._new(), [(doc, at, total, ids[4 * at : 4 * (at + self.window)])]
            at += self.window
        while at < total:
            rest = total - at
            k = bisect_left(self.room, (rest, -1))
            if k < len(self.room):
                room, number = self.room.pop(k)
                self.held[number].append((doc, at, total, ids[4 * at :]))
                if room == rest:
                    yield number, self.held.pop(number)
                else:
                    insort(self.room, (room - rest, number))
                return
            if len(self.room) < self.most:
                number = self._new()
                self.held[number] = [(doc, at, total, ids[4 * at :])]
                insort(self.room, (self.window - rest, number))
                return
            room, number = self.room.pop(0)
            pieces = self.held.pop(number)
            if room >= self.cut:
                pieces.append((doc, at, total, ids[4 * at : 4 * (at + room)]))
                at += room
            yield number, pieces


def _table(windows: list[tuple[int, list[tuple]]], high: int, id_type: pa.DataType, part: int | None, keep_ids: bool) -> pa.RecordBatch:
    """Rows of whole windows (part is None), or of windows still open, which carry their ids."""
    rows = [(d, s, len(x) // 4, zlib.crc32(x), t, high | w, x) for w, ps in windows for d, s, t, x in ps]
    offsets = []
    for _, ps in windows:
        at = 0
        for p in ps:
            offsets.append(at)
            at += len(p[3]) // 4
    columns = list(zip(*rows)) if rows else [[]] * 7
    n = len(rows)
    arrays = [pa.array(columns[0], id_type), *(pa.array(columns[i], pa.int64()) for i in range(1, 6)), pa.array(offsets, pa.int64())]
    arrays += [pa.array([part] * n, pa.int32()), pa.array(columns[6] if keep_ids or part is not None else [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "part", "ids"])


def pack(docs: DataFrame, vocab: str, end_id: int = 0, window: int = WINDOW, most_open: int = OPEN, cut: int = CUT, keep_ids: bool = False) -> DataFrame:
    """Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids with keep_ids."""
    spark = docs.sparkSession
    common.reachable(spark)
    end = end_id.to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, packer = encoder(vocab), TaskContext.get().partitionId(), _Packer(window, most_open, cut)
        id_type = None
        for b in batches:
            id_type, texts = b.schema.field(0).type, common.texts(b.column(1))
            keys = b.column(0).to_pylist()
            for a, z in runs_of(texts):
                whole = [w for key, ids in zip(keys[a:z], enc.encode(texts[a:z])) for w in packer.add(key, ids + end)]
                yield _table(whole, part << _PART, id_type, None, keep_ids)
        if packer.held:
            yield _table(list(packer.held.items()), part << _PART, id_type, part, keep_ids)

    def merge(level: int, last: bool):
        def run(t: pa.Table) -> pa.Table:
            """Concatenate a group's open windows and cut them anew."""
            t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            high = level << _ROUND | t.column("group")[0].as_py() << _PART
            stream = zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")))
            whole, now, room = [], [], window
            for d, s, total, ids in stream:
                while ids:
                    head, ids = ids[: 4 * room], ids[4 * room :]
                    now.append((d, s, total, head))
                    s, room = s + len(head) // 4, room - len(head) // 4
                    if not room:
                        whole.append((len(whole), now))
                        now, room = [], window
            open_one = []
            if now and last:
                for w in _powers(now):
                    whole.append((len(whole), w))
            elif now:
                open_one.append((len(whole), now))
            id_type = t.schema.field("doc_id").type
            made = [_table(whole, high, id_type, None, keep_ids), _table(open_one, high, id_type, t.column("group")[0].as_py(), keep_ids)]
            return pa.Table.from_batches(made)

        return run

    level, now = 0, common.cut(docs.select("doc_id", "text").mapInArrow(run, schema), "packed")
    done = [now.where("part is null")]
    while (most := now.where("part is not null").agg(F.max("part")).first()[0]) is not None:
        level, last = level + 1, most < FAN
        grouped = now.where("part is not null").withColumn("group", F.floor(F.col("part") / FAN).cast("long")).groupBy("group")
        now = common.cut(grouped.applyInArrow(merge(level, last), schema), "merged")
        done.append(now.where("part is null"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*COLUMNS, *(["ids"] if keep_ids else []))


def _powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cut a window's pieces into windows whose sizes are powers of two, largest first."""
    left = sum(len(p[3]) // 4 for p in pieces)
    pieces = list(pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        left, room, now = left - size, size, []
        while room:
            d, s, total, ids = pieces.pop(0)
            now.append((d, s, total, ids[: 4 * room]))
            if len(ids) > 4 * room:
                pieces.insert(0, (d, s + room, total, ids[4 * room :]))
            room -= len(now[-1][3]) // 4
        yield now
