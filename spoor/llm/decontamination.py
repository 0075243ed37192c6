"""Benchmark decontamination with an FM-index per shard of training text.

A shard's words become symbols of the benchmark's alphabet. Only maximal runs in which every word and every
pair of neighbours also occurs in some test phrase can hold an occurrence, so only those runs are indexed,
which is exact. The index is a suffix array's BWT in a wavelet matrix with rank tables; all phrases are
searched backward at once, occurrences are located by walking to sampled suffix positions, and the hit words
of a document are merged into removal spans.

The benchmark is the stated query set: it is taken in blocks of ``BLOCK_WORDS`` words, one pass over the
documents each, so what is sent to the tasks is bounded whatever its size.

Defined cases: null and wordless texts have no words, windows or hits; an item of fewer words than a window is
one window; items that share an id count once; a null item id counts as the empty text; repeated document rows
are separate rows; very long texts are searched whole, their runs dealt over shards; occurrences that overlap hit a
word once; an empty benchmark or table gives rows without hits, or none; other columns, whatever their names, are
not read by ``report`` and pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common

WINDOW = 10
BLOCK_WORDS = 1_000_000
SAMPLE = 4
SHARD_BYTES = 16 << 20
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: A-Z to a-z, separators to a space.
_TABLE = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i in _KEPT else 0x20 for i in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NONE = b"\x00"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Phrases:
    """A block of test phrases as symbols: windows, the items of each, and the neighbours that occur."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        names: dict[str, int] = {}
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ws = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            if ws:
                item = names.setdefault(name, len(names))
                for i in range(max(1, len(ws) - window + 1)):
                    found.setdefault(tuple(ws[i : i + window]), set()).add(item)
        self.names = list(names)
        self.sizes = np.array([len(k) for k in found], np.int64)
        self.least = int(self.sizes.min()) if found else 0
        self.grid = np.zeros((len(found), window), np.int64)  # right-aligned, as the search goes backward
        for row, k in zip(self.grid, found):
            row[window - len(k) :] = k
        self.item_starts = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)
        self.items = np.array([i for v in found.values() for i in sorted(v)], np.int64)
        self.sigma = len(self.symbol) + 1
        a, b = self.grid[:, :-1].ravel(), self.grid[:, 1:].ravel()
        self.pairs = np.unique((a * self.sigma + b)[a > 0])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Zeros are separators: each counts as its own least symbol, by position."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 if n else 1) + np.where(zeros, 0, behind)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if not n or new.max() == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """BWT of a symbol text in a wavelet matrix, with sampled suffix positions."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]  # the text ends with a separator, which precedes its first symbol
        self.n, self.bits = n, max(1, int(sigma - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        starts = np.concatenate([[True], text[:-1] == 0])  # walks don't cross separators
        kept = starts | (np.arange(n) % sample == 0)
        self.sampled = np.where(kept[order], order, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the BWT."""
        lo, hi = np.zeros_like(at), at
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one, ones = ((symbol >> b) & 1).astype(bool), self.ones[k]
            lo1, hi1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(one, self.zeros[k] + lo1, lo - lo1), np.where(one, self.zeros[k] + hi1, hi - hi1)
        return hi - lo

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        at, symbol, start = row, np.zeros_like(row), np.zeros_like(row)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] > ones[at]
            symbol = symbol << 1 | one
            at1, start1 = ones[at].astype(np.int64), ones[start].astype(np.int64)
            at = np.where(one, self.zeros[k] + at1, at - at1)
            start = np.where(one, self.zeros[k] + start1, start - start1)
        return self.first[symbol] + at - start

    def search(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to): the rows of each right-aligned phrase that occurs; zeros pad on the left."""
        live = np.arange(len(grid))
        lo, hi = np.zeros(len(grid), np.int64), np.full(len(grid), self.n, np.int64)
        for column in range(grid.shape[1] - 1, -1, -1):
            c = grid[live, column]
            on = c > 0
            if not on.any():
                break
            lo[on], hi[on] = (self.first[c[on]] + self.rank(c[on], x[on]) for x in (lo, hi))
            keep = hi > lo
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The text positions of all rows in the ranges, range by range."""
        sizes = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        out, walked, left = np.full(len(rows), -1, np.int64), 0, np.arange(len(rows))
        while len(left):
            at = self.sampled[rows[left]]
            done = at >= 0
            out[left[done]] = at[done] + walked
            left = left[~done]
            rows[left] = self.before(rows[left])
            walked += 1
        return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


class _Shard:
    """Documents of a task whose candidate runs share one index."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.counts: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = self.flat = 0

    def add(self, texts: list[bytes]) -> None:
        """Tokenise, and keep the runs that can hold an occurrence with their places in the shard's word order."""
        flat: list[bytes] = []
        for t in texts:
            ws = words_of(t)
            self.counts.append(len(ws))
            flat += ws
            flat.append(_NONE)
        ids = np.fromiter(map(self.p.symbol.get, flat, repeat(0)), np.int64, len(flat))
        starts, ends = _runs(ids > 0)
        keep = ends - starts >= max(1, self.p.least)
        mark = np.zeros(len(ids) + 1, np.int8)
        mark[starts[keep]], mark[ends[keep]] = 1, -1
        inside = np.flatnonzero(np.cumsum(mark[:-1]))
        if len(inside) and self.p.least:
            # cut where two neighbours are no pair of any phrase, then drop what is too short
            joined = np.diff(inside, append=-1) == 1
            code = ids[inside] * self.p.sigma + np.append(ids[inside[1:]], 0)
            spot = np.searchsorted(self.p.pairs, code).clip(0, max(0, len(self.p.pairs) - 1))
            joined &= (self.p.pairs[spot] == code) if len(self.p.pairs) else False
            begin = np.concatenate([[True], ~joined[:-1]])
            group = np.cumsum(begin) - 1
            keep = (np.bincount(group) >= self.p.least)[group]
            at, group = inside[keep], group[keep]
            if len(at):
                gap = np.flatnonzero(np.diff(group)) + 1  # a separator after each run
                self.symbols.append(np.append(np.insert(ids[at], gap, 0), 0))
                self.places.append(np.append(np.insert(at + self.flat, gap, -1), -1))
        self.flat += len(ids)
        self.size += sum(map(len, texts))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of hit words (document, first word, end) and (document, item) pairs, by document."""
        begins = np.concatenate([[0], np.cumsum(np.array(self.counts, np.int64) + 1)])
        none = np.zeros(0, np.int64)
        if not self.symbols:
            return none, none, none, none, none
        places = np.concatenate(self.places)
        index = FMIndex(np.concatenate(self.symbols), self.p.sigma)
        phrase, lo, hi = index.search(self.p.grid)
        at = places[index.locate(lo, hi)]
        of = np.repeat(phrase, hi - lo)
        change = np.zeros(self.flat + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.p.sizes[of], -1)
        starts, ends = _runs(np.cumsum(change[:-1]) > 0)
        doc = np.searchsorted(begins, starts, "right") - 1
        n = (self.p.item_starts[1:] - self.p.item_starts[:-1])[of]
        item = self.p.items[np.repeat(self.p.item_starts[of] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        pairs = np.unique((np.searchsorted(begins, np.repeat(at, n), "right") - 1) * len(self.p.names) + item)
        return doc, starts - begins[doc], ends - begins[doc], pairs // len(self.p.names), pairs % len(self.p.names)


def _spans(text: bytes, words: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as code points of the text."""
    places = [m.span() for m in _WORD.finditer(text)]
    at = [(places[a][0], places[b - 1][1]) for a, b in words]
    return [{"start": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in at]


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """The items as (name, text), and the number of blocks of bounded size to take them in."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-total // (6 * block_words)))


def _phrases(items: DataFrame, blocks: int, k: int, window: int) -> Phrases:
    block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()  # a block of bounded size
    return Phrases([(r.name, r.text.encode()) for r in block], window)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): hit words, removal spans in code points, and the items found."""
    spark = docs.sparkSession
    common.reachable(spark)
    items, blocks = _blocks(benchmark, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, words array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"

    def passed(k: int, source: DataFrame, schema: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(_phrases(items, blocks, k, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            shard, keys, texts = _Shard(phrases), [], []

            def result(keep: pa.RecordBatch | None = None) -> pa.RecordBatch:
                doc, first, end, holder, item = shard.hits()
                n_hit = np.bincount(doc, end - first, len(shard.counts)).astype(np.int64) if len(doc) else np.zeros(len(shard.counts), np.int64)
                words: dict[int, list] = {}
                for d, a, b in zip(doc.tolist(), first.tolist(), end.tolist()):
                    words.setdefault(d, []).append((a, b))
                names: dict[int, list] = {}
                for d, i in zip(holder.tolist(), item.tolist()):
                    names.setdefault(d, []).append(phrases.names[i])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                order = range(len(shard.counts))
                arrays = [
                    pa.concat_arrays(keys),
                    pa.array(shard.counts, pa.int64()),
                    pa.array(n_hit),
                    pa.array([[{"start": a, "end": b} for a, b in words.get(d, ())] for d in order], span),
                    pa.array([_spans(texts[d], words[d]) if d in words else [] for d in order], span),
                    pa.array([sorted(names.get(d, ())) for d in order], pa.list_(pa.string())),
                ]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "words", "spans", "items"])

            for b in batches:
                raw = common.as_bytes(b.column(1))
                at = 0
                while at < len(raw):
                    end, size = at, 0
                    while end < len(raw) and size < 2 << 20:
                        size += len(raw[end])
                        end += 1
                    shard.add(raw[at:end])
                    keys.append(b.column(0)[at:end])
                    texts += raw[at:end]
                    at = end
                    if shard.size >= SHARD_BYTES:
                        yield result()
                        shard, keys, texts = _Shard(phrases), [], []
            if keys:
                yield result()

        return source.mapInArrow(run, schema)

    picked = docs.select("doc_id", "text")
    if blocks == 1:
        return passed(0, picked, schema).drop("words")
    # more blocks: rows get a key once, and each block's hits of a row are merged
    keyed = common.cut(picked.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "rows")
    keyed_schema = schema.replace(f"doc_id {kind}", f"doc_id struct<doc_id:{kind},row:long>")
    parts = passed(0, keyed, keyed_schema)
    for k in range(1, blocks):
        parts = parts.unionByName(passed(k, keyed, keyed_schema))
    parts = common.cut(parts, "hits")
    found = parts.select("doc_id", F.explode(F.arrays_zip("words", "spans")).alias("z"))
    edge = Window.partitionBy("doc_id").orderBy("z.words.start").rowsBetween(Window.unboundedPreceding, -1)
    opened = found.withColumn("new", (F.coalesce(F.max("z.words.end").over(edge), F.lit(-1)) < F.col("z.words.start")).cast("int"))
    opened = opened.withColumn("run", F.sum("new").over(Window.partitionBy("doc_id").orderBy("z.words.start")))
    merged = opened.groupBy("doc_id", "run").agg(F.max("z.words.end").alias("b"), F.min("z.words.start").alias("a"), F.min("z.spans.start").alias("start"), F.max("z.spans.end").alias("end"))
    spans = merged.groupBy("doc_id").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rest = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = rest.join(spans, "doc_id", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", empty).alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find(docs, benchmark)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))



def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; whole rows pass through each block's index."""
    spark = docs.sparkSession
    common.reachable(spark)
    items, blocks = _blocks(benchmark, block_words)
    at = docs.columns.index("text")

    def passed(source: DataFrame, k: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(_phrases(items, blocks, k, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, shard = [], _Shard(sent.value)

            def clean() -> Iterator[pa.RecordBatch]:
                hit = np.zeros(len(shard.counts), bool)
                hit[shard.hits()[0]] = True
                done = 0
                for b in held:
                    yield b.filter(pa.array(~hit[done : done + b.num_rows]))
                    done += b.num_rows

            for b in batches:
                raw = common.as_bytes(b.column(at))
                start = 0
                while start < len(raw):
                    end, size = start, 0
                    while end < len(raw) and size < 2 << 20:
                        size += len(raw[end])
                        end += 1
                    shard.add(raw[start:end])
                    held.append(b.slice(start, end - start))
                    start = end
                    if shard.size >= SHARD_BYTES:
                        yield from clean()
                        held, shard = [], _Shard(sent.value)
            yield from clean()

        return source.mapInArrow(run, source.schema)

    for k in range(blocks):
        docs = passed(docs, k)
    return docs


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM p),
x AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, l WHERE len(ws) >= n),
o AS (SELECT DISTINCT x.rid, x.i, x.n, p.item FROM x JOIN p ON list_slice(x.ws, x.i, x.i + x.n - 1) = p.win),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
