"""Language-model scores: prediction by partial matching over a byte-context trie, beside a smoothed unigram base.

One pass over the training rows gathers counts of words, of grams (``ORDER`` bytes and the one after them) and of
edges (see below); all else is derived from those. A symbol's probability after a context of up to ``ORDER`` bytes
is that of all it has counted, however seldom, and what escapes goes to the context a byte shorter, with the symbols
already offered excluded. What escapes is estimated from the counts themselves: leave out one occurrence of a context,
and it is new to the context if its symbol was counted once. How often that is among all contexts of a length that then
have about as many occurrences and symbols (a class for each doubling) gives a weight w, and a context of n occurrences
of k symbols escapes with w k / (n + w k). Method C is w = 1; contexts seen once or twice get the weight they deserve.
Contexts of ``ORDER`` bytes count every occurrence, and shorter ones each longer context once (update exclusion), as they
serve what those haven't seen.

Beyond ``ORDER`` bytes the trie is path-compressed: texts are cut into segments after bytes where a hash of the
last gram allows it (``SEGMENT`` bytes apart on average), and an edge leads from a segment to the whole one after
it. An edge grows when the training rows have it a second time. A segment with an edge from the one before it costs
that edge; another one costs the escape there, if any edge leaves, and then its bytes. So text that stands in
the training rows more than once costs next to nothing, and all other text what its bytes cost.

The probabilities of the most frequent grams go to the tasks in a table of at most ``LISTED`` rows, where scoring
is one lookup a byte. All other grams are counted and joined to theirs (``probabilities``), which are computed with
joins over the counts. Both ways give the same figures, so the table's size changes the time only. Likewise the
``FREQUENT`` most frequent words are sent and the others joined. So no hot gram or word is shuffled with its
occurrences; a hot segment is, in rows of a few numbers, and adaptive execution splits its key.

Bounds: 12 bytes for a listed gram; ``HELD`` counts and ``AT_ONCE`` grams in a counting task. All training rows are counted and used, and
all texts scored whole, in pieces of ``PIECE`` bytes. Segments are told apart by 64-bit hashes, edges by two.

Defined cases: a null or empty text has the end alone; very long texts are taken in pieces; without training rows
every word is unknown and bytes are uniform; repeated rows are scored each, and count as often as they stand in the
training rows; ties in frequency between words go to the lesser word; an empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common

ORDER, SEGMENT = 6, 512
LISTED, FREQUENT = 1 << 22, 150_000
HELD, HELD_WORDS, PIECE = 1_500_000, 200_000, 1 << 22
#: Grams that are gathered before they are counted.
AT_ONCE = 3_000_000
#: Levels of contexts this long or longer are made in one shuffle, by the last so many bytes.
SUFFIX = 4
#: Input partitions that one counting task takes, so that more is combined before the shuffle.
TOGETHER = 4
#: Rows of an Arrow batch.
ROWS = 1000
#: The end among the words.
END = b""
#: Upper-case letters don't occur in lowered texts, so two of them mark a text's end and what stands before it.
LAST, BEFORE = 0x41, 0x42
#: The bytes of lowered texts, and the end.
SYMBOLS = 256 - 26 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams.view(np.uint64) * _MIX >> np.uint64(64 - bits)).view(np.int64)


def _pieces(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For texts laid end to end, each within its marks: places of symbols, the gram that ends at each, and whether
    a segment does."""
    a = np.frombuffer(raw, np.uint8)
    for at in range(ORDER, len(a), PIECE):
        stop = min(len(a), at + PIECE)
        gram = a[at - ORDER : stop - ORDER].astype(np.int64)
        for k in range(1, ORDER + 1):
            gram <<= 8
            gram |= a[at - ORDER + k : stop - ORDER + k]
        symbols = np.flatnonzero(a[at:stop] != BEFORE)
        gram = gram[symbols]
        yield symbols + at, gram, (_mixed(gram, SEGMENT.bit_length() - 1) == 0) | (gram & 255 == LAST)


def _laid(texts: list[bytes]) -> bytes:
    before, last = bytes([BEFORE]) * ORDER, bytes([LAST])
    return b"".join(x for t in texts for x in (before, t, last))


def _edges(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments by the places of their last symbols: the hash of the segment before, zero at a text's start, the
    own hash, and whether the text ends."""
    lasts = np.frombuffer(raw, np.uint8)[ends] == LAST
    starts = np.concatenate([[ORDER], ends[:-1] + 1 + ORDER * lasts[:-1]])
    own = np.array([xxhash.xxh64_intdigest(raw[a : b + 1]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64).view(np.int64)
    before = np.concatenate([[0], np.where(lasts[:-1], 0, own[:-1])]).astype(np.int64)
    return before, own, lasts


def _merged(ids: np.ndarray, ns: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams with counts, after more grams."""
    new, n = np.unique(more, return_counts=True)
    both, counts = np.concatenate([ids, new]), np.concatenate([ns, n])
    order = np.argsort(both, kind="stable")  # two sorted runs: one merge
    both, counts = both[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(docs: DataFrame) -> DataFrame:
    """(word, segment, gram, c): counts over all rows of words, of grams, and of edges, as the segment before and, in
    gram, the one after; what doesn't apply is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        ids, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size, pairs = [], 0, []

        def combined() -> Iterator[pa.RecordBatch]:
            both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            both, n = np.unique(both, axis=1, return_counts=True) if both.size else (both, np.zeros(0, np.int64))
            pairs.clear()
            yield from out(n, segment=both[0], gram=both[1])

        def out(counts, **columns) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(counts), 1 << 16):
                c = pa.array(counts[at : at + (1 << 16)], pa.int64())
                some = [pa.array(columns[k][at : at + (1 << 16)], t) if k in columns else pa.nulls(len(c), t) for k, t in (("word", pa.binary()), ("segment", pa.int64()), ("gram", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*some, c], ["word", "segment", "gram", "c"])

        for part in (part for b in batches for part in _parts(b)):
            lows = [t.lower() for t in common.as_bytes(part.column(0))]
            for low in lows:
                words.update(low.split())
            words[END] += len(lows)
            raw, ends = _laid(lows), []
            for places, grams, closes in _pieces(raw):
                ends.append(places[closes])
                held.append(grams)
                size += len(grams)
                if size >= AT_ONCE:
                    ids, ns = _merged(ids, ns, np.concatenate(held))
                    held, size = [], 0
                if len(ids) >= HELD:
                    yield from out(ns, gram=ids)
                    ids, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if ends:
                pairs.append(np.stack(_edges(raw, np.concatenate(ends))[:2]))
            if sum(x.shape[1] for x in pairs) >= HELD_WORDS:
                yield from combined()
            if len(words) >= HELD_WORDS:
                yield from out(list(words.values()), word=list(words.keys()))
                words.clear()
        yield from out(list(words.values()), word=list(words.keys()))
        if held:
            ids, ns = _merged(ids, ns, np.concatenate(held))
        yield from out(ns, gram=ids)
        yield from combined()

    spark = docs.sparkSession
    picked = docs.select("text")
    fewer = max(spark.sparkContext.defaultParallelism, -(-picked.rdd.getNumPartitions() // TOGETHER))
    rows = picked.coalesce(fewer).mapInArrow(run, "word binary, segment long, gram long, c long")
    rows = rows.repartition("word", "segment", "gram")  # a task's rows are combined already: no partial aggregate
    with common.batches_of(spark, ROWS):
        counts = rows.groupBy("word", "segment", "gram").agg(F.sum("c").alias("c"))
        return common.cut(counts, "lm-counts")


@dataclass
class Listed:
    """The most frequent grams and the log10 probability of each one's last byte after the others."""

    grams: np.ndarray
    p: np.ndarray
    slots: tuple[np.ndarray, np.ndarray] | None = None

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are listed, and the probabilities of those."""
        if self.slots is None:
            self.slots = self._placed()
        keys, ps = self.slots
        at = _mixed(grams, len(keys).bit_length() - 1)
        key = keys[at]
        known = key == grams
        left = np.flatnonzero(~known & (key >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(keys) - 1
            key = keys[at[left]]
            known[left] = key == grams[left]
            left = left[(key != grams[left]) & (key >= 0)]
        return known, ps[at[known]]

    def _placed(self) -> tuple[np.ndarray, np.ndarray]:
        """A table at most half full, each gram in the first free slot from its own on."""
        bits = max(4, (2 * len(self.grams) - 1).bit_length())
        keys, ps = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, at = self.grams, _mixed(self.grams, bits)
        p = self.p
        while len(left):
            free = keys[at] < 0
            keys[at[free]] = left[free]
            own = keys[at] == left
            ps[at[own]] = p[own]
            left, p, at = left[~own], p[~own], at[~own] + 1 & (1 << bits) - 1
        self.grams, self.p = keys[:0], ps[:0]  # a worker needs them no more
        return keys, ps


def _levels(counted: DataFrame) -> list[DataFrame]:
    """For contexts of ``ORDER`` bytes down to none: (context, gram, c, n, kinds, ones), the last three being the
    context's sum, its number of grams, and of those that it has once. Levels down to ``SUFFIX`` bytes share one shuffle; the shorter ones are small."""
    out = []
    by = Window.partitionBy("suffix", "context")  # at most 256 rows each

    def level(rows: DataFrame) -> DataFrame:
        return rows.select("size", "context", "gram", "c", F.sum("c").over(by).alias("n"), F.count("*").over(by).alias("kinds"), F.count_if(F.col("c") == 1).over(by).alias("ones"))

    def placed(rows: DataFrame, size: int) -> DataFrame:
        gram = rows.withColumn("gram", F.col("gram").bitwiseAND((1 << 8 * (size + 1)) - 1)) if size < ORDER else rows
        return gram.withColumns({"size": F.lit(size), "context": F.shiftright("gram", 8)})

    def suffixed(rows: DataFrame, size: int) -> DataFrame:
        return rows.select("gram", "c", F.shiftright("gram", 8).bitwiseAND((1 << 8 * size) - 1).alias("suffix"))

    rows = suffixed(counted.where("gram is not null and segment is null"), SUFFIX).repartition("suffix")
    long = level(placed(rows, ORDER))
    for size in range(ORDER - 1, SUFFIX - 1, -1):
        rows = placed(rows, size).groupBy("suffix", "size", "context", "gram").agg(F.count("*").alias("c")).select("gram", "c", "suffix")
        long = long.unionAll(level(placed(rows, size)))
    long = common.cut(long, "lm-levels")
    out = [long.where(F.col("size") == size) for size in range(ORDER, SUFFIX - 1, -1)]
    for size in range(SUFFIX - 1, -1, -1):
        rows = placed(suffixed(out[-1], size), size).groupBy("suffix", "size", "context", "gram").agg(F.count("*").alias("c"))
        out.append(common.cut(level(rows), "lm-level"))
    return out


def _frequency() -> Column:
    return F.floor(F.log2("c") * 8).cast("int")  # at most 512 classes


def _class(n: Column) -> Column:
    return F.floor(F.log2(n) + 1e-9).cast("int")


#: Classes of symbols in a context: 1, 2 to 3, ..., 128 to 255, 256.
KINDS = 9


def _weights(contexts: DataFrame, by: str) -> dict[int, list[float]]:
    """For each value of ``by``, the weights of escapes by classes of occurrences and symbols, of rows (by, n, kinds,
    ones, share), of which a context's add up to a share of one. An occurrence that is left out leaves n - 1, and one
    symbol less if that was counted once."""
    left, once = F.col("n") - 1, F.col("ones")
    new = contexts.where("n > 1 and ones > 0").select(by, left.alias("n"), (F.col("kinds") - 1).alias("kinds"), (once * F.col("share")).alias("times"), F.lit(1).alias("new"))
    old = contexts.where("n > ones").select(by, left.alias("n"), "kinds", ((F.col("n") - once) * F.col("share")).alias("times"), F.lit(0).alias("new"))
    place = _class(F.col("n")) * KINDS + F.least(_class(F.col("kinds")), F.lit(KINDS - 1))
    total = lambda c: F.sum(F.col("times") * c)
    rows = new.unionAll(old).groupBy(by, place.alias("place")).agg(total(F.col("new")).alias("new"), total(F.lit(1)).alias("times"), total(F.col("n")).alias("n"), total(F.col("kinds")).alias("kinds"))
    out: dict[int, list[float]] = {}
    for r in rows.collect():  # at most 63 * KINDS for each value
        rate = (r.new + 0.5) / (r.times + 1)
        out.setdefault(r[by], [1.0] * (64 * KINDS))[r.place] = rate / (1 - rate) * r.n / r.kinds
    return out


def _weight(weights: list[float] | None) -> Column:
    """The weight of a context of n occurrences and so many kinds; one where no context tells."""
    if weights is None:
        return F.lit(1.0)
    return F.get(F.lit(weights), _class(F.col("n")) * KINDS + F.least(_class(F.col("kinds")), F.lit(KINDS - 1)))


def listed(level: DataFrame, weights: list[float] | None = None, most: int | None = None) -> tuple[Listed, DataFrame]:
    """The table of the most frequent grams, the most that equally frequent ones allow up to ``most``, of the
    longest contexts; and the level's other rows."""
    most = LISTED if most is None else most
    at_least, total = 0, 0
    for r in sorted(level.groupBy(_frequency().alias("kind")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.kind):
        total += r.n
        if total > most:
            at_least = r.kind + 1
            break
    taken = _frequency() >= at_least
    rows = level.where(taken).select("gram", F.log10(F.col("c") / (F.col("n") + _weight(weights) * F.col("kinds"))).cast("float").alias("p")).toArrow()
    return Listed(np.array(rows.column("gram"), np.int64), np.array(rows.column("p"), np.float32)), level.where(~taken)


def probabilities(levels: list[DataFrame], weights: list[list[float] | None], wanted: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(gram, p): log10 of the last byte's probability after those before it, for the distinct grams wanted. ``others``,
    if given, are the rows of the first level that a wanted gram can have.

    What longer contexts offered is what the next longer one did, as their symbols are among its own. So a context's
    share under exclusion follows from its count and kinds, less the sum of its counts and the number of the symbols
    that the longer one has. That is looked up only for grams that the context hasn't seen; those that it has are
    done there.
    """
    zero = F.lit(0).cast("long")
    out = wanted.select("gram", F.lit(0.0).alias("escape"), zero.alias("gone_n"), zero.alias("gone_kinds"))
    done = None
    left_n, left_kinds = F.col("n") - F.col("gone_n"), F.col("kinds") - F.col("gone_kinds")
    for k, level in enumerate(levels):
        size = ORDER - k
        weight = _weight(weights[k])
        low = F.col("gram").bitwiseAND((1 << 8 * (size + 1)) - 1)
        rows = (others if others is not None and not k else level).select(F.col("gram").alias("g"), "c", "n", "kinds")
        met = common.cut(out.withColumn("g", low).join(F.broadcast(rows) if size <= 1 else rows, "g", "left"), "lm-met")  # at most 65,536 rows of one byte's contexts
        found = met.where("n is not null").select("gram", (F.col("escape") + F.log10(F.col("c") / (left_n + weight * left_kinds))).alias("p"))
        done = found if done is None else done.unionAll(found)
        new = met.where("n is null").select("gram", "escape", "gone_n", "gone_kinds", F.shiftright("g", 8).alias("context"))
        had = level.join(new.select("context").distinct(), "context", "left_semi")
        if size:
            shorter = levels[k + 1].select(F.col("gram").alias("g"), F.col("c").alias("s"))
            had = had.withColumn("g", F.col("gram").bitwiseAND((1 << 8 * size) - 1)).join(shorter, "g")
        else:
            had = had.withColumn("s", zero)
        contexts = had.groupBy("context").agg(F.max("n").alias("n"), F.max("kinds").alias("kinds"), F.sum("s").alias("under"))
        share = weight * left_kinds / (left_n + weight * left_kinds)
        out = new.join(contexts, "context", "left").select("gram", (F.col("escape") + F.when(left_kinds > 0, F.log10(share)).otherwise(0.0)).alias("escape"), F.coalesce("under", zero).alias("gone_n"), F.coalesce("kinds", zero).alias("gone_kinds"))
    rest = out.select("gram", (F.col("escape") - F.log10(F.greatest(SYMBOLS - F.col("gone_kinds"), F.lit(1)))).alias("p"))
    return done.unionAll(rest)


def _parts(b: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes each, so that memory follows texts and not row counts."""
    rows = max(1, b.num_rows * size // max(1, b.nbytes))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _of_bytes(lows: list[bytes], table: Listed) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text its segments (seg, before, own, s), s being the log10 probability of what is listed, and its
    grams that aren't, (seg, gram, tf)."""
    raw, ends, sums, where, others, base = _laid(lows), [], [], [], [], 0
    for places, grams, closes in _pieces(raw):
        seg = np.cumsum(closes) - closes  # from the piece's first segment, which the piece before may have begun
        known, p = table.find(grams)
        n = int(seg[-1]) + 1 if len(seg) else 0
        s = np.bincount(seg[known], p, n)
        if ends and n and len(sums) > base:
            sums[-1], s = sums[-1] + s[0], s[1:]
        sums.extend(s.tolist())
        ends.append(places[closes])
        where.append(seg[~known] + base)
        others.append(grams[~known])
        base += int(closes.sum())
    before, own, lasts = _edges(raw, np.concatenate(ends))
    stops = np.flatnonzero(lasts) + 1
    firsts = np.concatenate([[0], stops[:-1]])
    doc = np.repeat(np.arange(len(stops)), stops - firsts)
    number = np.arange(len(own)) - firsts[doc]
    fields = [pa.array(number, pa.int32()), pa.array(before), pa.array(own), pa.array(sums, pa.float64())]
    segs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.StructArray.from_arrays(fields, ["seg", "before", "own", "s"]))
    seg, gram = np.concatenate(where), np.concatenate(others)
    order = np.lexsort((gram, seg))
    seg, gram = seg[order], gram[order]
    new = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (gram[1:] != gram[:-1])])) if len(seg) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(seg)))
    seg, gram = seg[new], gram[new]
    fields = [pa.array(number[seg], pa.int32()), pa.array(gram), pa.array(tf, pa.int32())]
    unlisted = pa.ListArray.from_arrays(pa.array(np.searchsorted(seg, np.concatenate([[0], stops])), pa.int32()), pa.StructArray.from_arrays(fields, ["seg", "gram", "tf"]))
    return segs, unlisted


def _first(docs: DataFrame, known: dict[bytes, float], table: Listed) -> DataFrame:
    """What one pass over the texts finds: a row number, token counts, the sums of what the sent tables have, and
    what they haven't: words, and grams by segment."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((known, table))  # FREQUENT words and LISTED grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lp, table = sent.value
        get = lp.get
        row = TaskContext.get().partitionId() << 36
        kind = [pa.field("word", pa.binary()), pa.field("tf", pa.int64())]
        for b in (part for whole_batch in batches for part in _parts(whole_batch)):
            n_tokens, n_known, base = [], [], []
            words, tfs, ends = [], [], [0]
            lows = [t.lower() for t in common.as_bytes(b.column(1))]
            if not lows:
                continue
            for low in lows:
                ws = [*low.split(), END]
                got = list(map(get, ws))
                holes = got.count(None)
                if holes:
                    rest = Counter(w for w, v in zip(ws, got) if v is None)
                    words += rest.keys()
                    tfs += rest.values()
                ends.append(len(words))
                n_tokens.append(len(ws))
                n_known.append(len(ws) - holes)
                base.append(sum(v for v in got if v is not None) if holes else sum(got))
            rows = pa.array(range(row, row + len(lows)), pa.int64())
            row += len(lows)
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(tfs, pa.int64())], fields=kind))
            arrays = [b.column(0), rows, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), rare, *_of_bytes(lows, table)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_tokens", "n_known", "base", "rare", "segs", "grams"])

    picked = docs.select("doc_id", "text")
    kinds = "rare array<struct<word:binary,tf:bigint>>, segs array<struct<seg:int,before:bigint,own:bigint,s:double>>, grams array<struct<seg:int,gram:bigint,tf:int>>"
    with common.batches_of(spark, ROWS):
        out = common.cut(picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, row long, n_tokens long, n_known long, base double, {kinds}"), "lm-scores")
    sent.destroy()  # what it gave is a table now
    return out


def scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    common.reachable(spark)
    counted = _counted(training)
    words = counted.where("word is not null").select("word", "c")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole = totals.n + totals.v + 1
    frequent = words.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    known = dict(zip(frequent.column("word").to_pylist(), (math.log10((c + 1) / whole) for c in frequent.column("c").to_pylist())))
    levels = _levels(counted)
    shares = [x.select(F.lit(ORDER - k).alias("size"), "n", "kinds", "ones", (1 / F.col("kinds")).alias("share")) for k, x in enumerate(levels)]
    found = _weights(reduce(DataFrame.unionAll, shares), "size")
    weights = [found.get(size) for size in range(ORDER, -1, -1)]
    table, others = listed(levels[0], weights[0])
    first = _first(docs, known, table)
    del known, table, frequent

    none = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    c = F.coalesce("c", zero)
    of_words = first.select("row", F.inline("rare")).join(words, "word", "left").select("row", F.lit(-1).alias("seg"), F.lit(0.0).alias("s"), none.alias("edge"), F.lit(0.0).alias("escape"), (F.col("tf") * F.log10((c + 1) / F.lit(float(whole)))).alias("more"), F.when(c > 0, F.col("tf")).otherwise(0).alias("k"))
    grams = first.select("row", F.inline("grams"))
    p = probabilities(levels, weights, grams.select("gram").distinct(), others)
    of_grams = grams.join(p, "gram").select("row", "seg", (F.col("tf") * F.col("p")).alias("s"), none.alias("edge"), F.lit(0.0).alias("escape"), F.lit(0.0).alias("more"), zero.alias("k"))
    edges = counted.where("segment is not null").select(F.col("segment").alias("before"), F.col("gram").alias("own"), "c")
    leaving = edges.groupBy("before").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("ones"))
    leaving = common.cut(leaving.withColumn("start", (F.col("before") == 0).cast("int")), "lm-edges")
    of_edges = _weights(leaving.withColumn("share", F.lit(1.0)), "start")  # texts' starts are a context of their own kind
    kinds = F.when(F.col("start") == 1, _weight(of_edges.get(1))).otherwise(_weight(of_edges.get(0))) * F.col("kinds")
    segs = first.select("row", F.inline("segs")).join(edges, ["before", "own"], "left").join(leaving, "before", "left")
    both = F.col("n") + kinds
    of_segs = segs.select("row", "seg", "s", F.log10(F.col("c") / both).alias("edge"), F.coalesce(F.log10(kinds / both), F.lit(0.0)).alias("escape"), F.lit(0.0).alias("more"), zero.alias("k"))

    all_parts = of_words.unionAll(of_grams).unionAll(of_segs).repartition("row")  # a row's parts serve both groupings
    by_seg = all_parts.groupBy("row", "seg").agg(F.sum("s").alias("s"), F.max("edge").alias("edge"), F.sum("escape").alias("escape"), F.sum("more").alias("more"), F.sum("k").alias("k"))
    counts = by_seg.groupBy("row").agg(F.sum("more").alias("more"), F.sum("k").alias("k"), F.sum(F.coalesce("edge", F.col("escape") + F.col("s"))).alias("score"))
    joined = first.drop("rare", "segs", "grams").join(counts, "row", "left")
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, ...): learned from rows whose crc32(doc_id) mod 7 isn't 2."""
    held = common.remainder("doc_id", 7) == 2
    out = scores(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), *(c for c in out.columns if c != "doc_id"))
