"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: densities of a seed and of a learned lexicon, nearness of their words to the second person,
capitals, exclamation and other punctuation, and obfuscation (letters mixed with signs, and lexicon words
found behind them). A bounded sample of labelled rows is dealt by hash into three parts: the first gives the learned
lexicon, the second fits the trees, the third calibrates. Near copies in the first part count once, so that
a copied text doesn't put its own words into the lexicon. Words are counted and features made on the executors;
the driver sees the lexicon and the sample's features.

Bounds: ``SAMPLE`` labelled rows for each label, of any length, and ``LEXICON`` learned words. Every text is scored whole.

Defined cases: null and wordless texts have no words; an empty text, or one of blanks, gets the score of all-zero
features; very long texts are read whole, in linear time; without labels of both kinds the prior of one half is used
for every text; a document with several labels is toxic if one is; repeated rows get equal scores, and count in the
sample as rows; ties in the lexicon go to the lesser word; an empty table gives an empty one; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common
from spoor.llm.boosting import Trees, boost, isotonic

SAMPLE, LEXICON, PARTS = 3000, 4000, 3
THRESHOLD = 0.7
OPENINGS = (4, 5, 6, 7)
NEAR = 6
SEED = frozenset(
    "idiot idiots stupid moron morons scum trash garbage loser losers pathetic worthless disgusting clown dumb imbecile "
    "dummkopf abschaum versager blödmann trottel idioten connard imbécile ordure minable idiota imbécil basura estúpido escoria".split()
)
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
_WORD = re.compile(r"\w+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!*#.+_\-]+[^\W\d_]+)+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", ".": "", "+": "t", "_": "", "-": ""})
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def _openings(word: str) -> list[str]:
    """What a word begins with, as lexicon entries of their own: inflected and compounded forms share it."""
    return [word[:k] + "~" for k in OPENINGS if len(word) > k]


def features(text: str, learned: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of a text; stems are the learned openings without their mark."""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    seeds = sum(w in SEED for w in words)
    at = [i for i, w in enumerate(words) if w in learned or w[:4] in stems or w[:5] in stems or w[:6] in stems or w[:7] in stems]
    weights = [max(learned.get(w, 0.0), *(stems.get(w[:k], 0.0) for k in OPENINGS)) for w in map(words.__getitem__, at)]
    near = 0
    if at or seeds:
        at_any = sorted({*at, *(i for i, w in enumerate(words) if w in SEED)})
        near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at_any) / len(at_any)
    mixed = [m for m in _MIXED.findall(low)] if len(low) > 2 else []
    hidden = sum((w := m.translate(_LEET)) in learned or w in SEED for m in mixed)
    return [
        seeds,
        seeds / n,
        len(at),
        len(at) / n,
        len({words[i] for i in at}),
        sum(weights),
        max(weights, default=0.0),
        near,
        (len(raw) - len(raw.translate(None, _UPPER))) / size,
        raw.count(b"!") / n,
        (len(raw) - len(raw.translate(None, _MARKS))) / size,
        len(mixed) / n,
        hidden,
        float(np.log1p(len(words))),
    ]


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]
    stems: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), *self.steps)


def _signature(words: list[str]) -> list[int]:
    """Three least hashes of five-word shingles, signed; near copies share one nearly always."""
    grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
    return np.array(sorted(grams)[:3], np.uint64).view(np.int64).tolist()


def sample(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame | None:
    """(h, part, text, toxic): at most so many labelled rows of either label, chosen by a hash of the label's id and
    then of the row's id and text; null without both labels."""
    most = SAMPLE if most is None else most
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    first = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("toxic").orderBy("h"))).where(F.col("k") <= most).drop("k")
    chosen = first(common.some_of(known.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity"))), "toxic", "h", counts, most)).drop("h")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * SAMPLE ids
    rows = rows.select(F.xxhash64("doc_id", "text", F.lit("row")).alias("h"), "text", "toxic")
    return common.cut(first(rows).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")), "toxicity-sample")


def lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Words and openings with their smoothed log odds of standing in toxic documents, where those are high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_WORD.findall(t.lower()) for t in common.texts(b.column(2))]
            entries = [sorted({e for w in set(ws) for e in (w, *_openings(w))}) for ws in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_signature(ws) for ws in words], pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.string()))], ["h", "toxic", "marks", "entries"])

    each = common.cut(rows.select("h", "toxic", "text").mapInArrow(run, "h long, toxic int, marks array<long>, entries array<string>"), "toxicity-words")
    marks = each.select("h", F.explode("marks").alias("mark"))
    copies = marks.join(marks.groupBy("mark").agg(F.min("h").alias("least")), "mark").where("h <> least").select("h").distinct()
    single = each.dropDuplicates(["h"]).join(copies, "h", "left_anti")
    n = {r.toxic: r.n for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    in_toxic, in_other = (F.count_if(F.col("toxic") == y).alias(c) for y, c in ((1, "k"), (0, "other")))
    odds = F.log((F.col("k") + 0.1) / (n.get(1, 0) + 1)) - F.log((F.col("other") + 0.1) / (n.get(0, 0) + 1))
    found = single.select("toxic", F.explode("entries").alias("w")).groupBy("w").agg(in_toxic, in_other)
    found = found.where(F.col("k") >= max(3, 0.008 * n.get(1, 0))).select("w", odds.alias("odds")).where("odds > 2.5")
    return {r.w: r.odds for r in found.orderBy(F.desc("odds"), "w").limit(most).collect()}


def _described(rows: DataFrame, learned: dict[str, float], stems: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast((learned, stems))  # LEXICON words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t, *sent.value) for t in common.texts(b.column(2))], pa.list_(pa.float64()))], ["h", "toxic", "x"])

    got = sorted(rows.select("h", "toxic", "text").mapInArrow(run, "h long, toxic int, x array<double>").collect(), key=lambda r: (r.h, r.toxic, r.x))  # 2 * SAMPLE rows at most
    return np.array([r.x for r in got]), np.array([r.toxic for r in got], float)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on a bounded sample of labelled documents."""
    common.reachable(docs.sparkSession)
    rows = sample(docs, labels)
    if rows is None:
        return None
    there = rows.groupBy("part", "toxic").count().collect()
    if len({r.toxic for r in there}) < 2:
        return None
    whole = sum(r["count"] for r in there) < 30 or len(there) < 2 * PARTS  # too few to deal out: all rows serve for each
    part = lambda k: rows if whole else rows.where(F.col("part") == k)
    found = lexicon(part(0))
    learned, stems = {w: o for w, o in found.items() if w[-1] != "~"}, {w[:-1]: o for w, o in found.items() if w[-1] == "~"}
    fitted, held = (_described(part(k), learned, stems) for k in (1, 2))
    trees = boost(*fitted)
    return Model(learned, trees, isotonic(trees.margin(held[0]), held[1]), stems)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    spark = docs.sparkSession
    common.reachable(spark)
    sent = spark.sparkContext.broadcast(model)  # LEXICON words and 60 small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = common.texts(b.column(1))
            x = np.array([features(t, m.learned, m.stems) for t in texts]) if m and texts else None
            s = np.full(len(texts), 0.5) if x is None else m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels whose crc32(doc_id) mod 3 isn't 1."""
    model = fit(docs, labels.where(common.remainder("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
