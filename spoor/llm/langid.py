"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average embedding of its hashed byte 2- to 4-grams (bytes that are no letters count as word ends).
The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a part held
back sets the softmax temperature by the number of n-grams, and what a prediction needs to be accepted: at that
size, all but ``REFUSED`` of the held-back rows have such a confidence, and are so familiar. Familiarity is the mean
log probability of a text's n-grams among those of the predicted language, so it
tells texts of other languages, code and noise from short ones in a known language, which confidence can't.

Bounds: at most ``PER_LANG`` training rows for each language and about ``IN_ALL`` for all, as hashed n-grams of which a
text has at most ``BUCKETS``. Every language that occurs among the labels is learned. Every text is scored whole.

Defined cases: a null text, or one without a letter (Unicode's category L), is ``und`` with score 0 and rejected;
without any labelled row all texts are; very long texts are read in pieces; ties between languages go to the first
in alphabetical order; repeated rows get equal predictions, and those that share id and text are taken into the
sample or left out together unless their language has few rows; an empty table gives an empty one; other columns,
whatever their names, are not read by ``report`` and pass through ``keep_accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common

BUCKETS, WIDTH = 1 << 14, 16
PER_LANG, IN_ALL = 1000, 40_000
EPOCHS, BATCH, RATE, LEAST_STEPS = 8, 32, 4.0, 500
REFUSED = 0.002
#: Numbers of n-grams at which confidence is calibrated; short texts are simulated by thinning held-back rows.
SIZES = (8, 32, 128, 512, 4096)
#: A letter stands in two or three of a text's n-grams, so a thinned row varies less than a text of its size.
OVERLAP = 3
#: The share of probability that is spread over all buckets when n-grams are held to be a language's.
SPREAD = 0.02
PIECE = 1 << 20
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Lower case for A-Z; everything in ASCII that is no letter is a word end.
_TABLE = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the text's hashed n-grams."""
    out = np.zeros(BUCKETS, np.float32)
    raw = b" " + text.translate(_TABLE) + b" "
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(raw), PIECE):
        a = np.frombuffer(raw[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        code = a
        for n, factor in zip((2, 3, 4), _FACTORS):
            code = (code[:-1] << np.uint32(8)) | a[n - 1 :]
            if len(code):
                out += np.bincount((code[:PIECE] * np.uint32(factor)) >> shift, minlength=BUCKETS)
    return out


def averaged(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Logits are averages @ table + bias; their softmax at the size's temperature is the calibrated confidence."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperatures: np.ndarray
    #: log probability of a bucket in each language, and the least confidence and familiarity by size.
    logs: np.ndarray | None = None
    confident: np.ndarray | None = None
    familiar: np.ndarray | None = None

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, the confidence and the familiarity of each row."""
        t = np.interp(_size(counts), np.log(SIZES), self.temperatures)
        x = averaged(counts)
        p = _softmax((x @ self.table + self.bias) / t[:, None])
        best = p.argmax(axis=1)
        near = (x @ self.logs)[np.arange(len(p)), best] if self.logs is not None else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], near

    def accepts(self, counts: np.ndarray, p: np.ndarray, near: np.ndarray) -> np.ndarray:
        size = _size(counts)
        return (p >= np.interp(size, np.log(SIZES), self.confident)) & (near >= np.interp(size, np.log(SIZES), self.familiar))


def _size(counts: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(counts.sum(axis=1), 1))


class Sparse:
    """Rows of n-gram counts as (buckets, counts); only slices of rows are ever dense."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BUCKETS), np.float32)
        for row, k in zip(out, which):
            at, n = self.rows[k]
            row[at] = n
        return out


def _slices(rows: np.ndarray, size: int = 64) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


def thinned(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Rows as texts of about so many n-grams would have them."""
    out = np.zeros_like(counts)
    there = counts > 0
    out[there] = rng.poisson(averaged(counts)[there] * size)
    return out


def train(counts: Sparse, y: np.ndarray, langs: list[str], seed: int = 0) -> Model:
    """Fit on rows of n-gram counts; every fifth row, after shuffling, is held back for calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    held = np.arange(len(order)) % 5 == 0
    back, rows = (order[held], order[~held]) if len(order) >= 50 else (order, order)
    k = len(langs)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rows = rng.permutation(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            dense = counts[some]
            for x in (averaged(dense), averaged(thinned(dense, 48, rng))):
                hidden = x @ e
                d = _softmax(hidden @ w + b)
                d[np.arange(len(some)), y[some]] -= 1
                d *= rate / len(some)
                # averages are small, so embeddings take longer steps, bounded where a few n-grams hold all weight
                behind = (d @ w.T) * np.minimum(10, 0.1 / np.maximum((x * x).sum(axis=1, keepdims=True), 1e-9))
                w -= hidden.T @ d
                b -= d.sum(axis=0)
                used = np.flatnonzero(x.any(axis=0))
                e[used] -= x[:, used].T @ behind
    model = Model(langs, (e @ w).astype(np.float32), b, np.ones(len(SIZES)))
    target, grid = y[back], np.geomspace(0.005, 8, 60)
    for i, size in enumerate(SIZES):
        z = np.concatenate([averaged(thinned(counts[some], size, rng)) @ model.table + b for some in _slices(back)])
        loss = [-np.log(np.maximum(_softmax(z / g)[np.arange(len(target)), target], 1e-12)).mean() for g in grid]
        model.temperatures[i] = grid[int(np.argmin(loss))]
    model.logs = np.zeros((BUCKETS, k), np.float32)
    for lang in range(k):
        own, total = rows[y[rows] == lang], np.zeros(BUCKETS)
        for some in _slices(own):
            total += averaged(counts[some]).sum(axis=0)
        model.logs[:, lang] = np.log((1 - SPREAD) * total / max(1, len(own)) + SPREAD / BUCKETS)
    least = []
    for size in SIZES:
        got = []
        for some in _slices(back):
            x = thinned(counts[some], max(2, size // OVERLAP), rng)
            best, p, near = model.predict(x)
            got.append(np.stack([p, near])[:, x.any(axis=1)])
        at = np.quantile(np.concatenate(got, axis=1), REFUSED, axis=1, method="lower") if any(g.size for g in got) else np.array([0.0, -np.inf])
        least.append(at)
    model.confident, model.familiar = np.array(least).T
    return model


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> Model | None:
    """Train on a bounded sample of docs' rows with a language; labelled, if given, are the rows to learn from."""
    common.reachable(docs.sparkSession)
    known = (docs if labelled is None else labelled).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(20, min(PER_LANG, IN_ALL // len(counts)))
    taken = common.some_of(known.select(F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"), "text", "lang"), "lang", "h", counts, each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(t) for t in common.as_bytes(b.column(1))]
            hit = [np.flatnonzero(g) for g in got]
            columns = [b.column(0), b.column(2), pa.array([h.astype("<u2").tobytes() for h in hit], pa.binary()), pa.array([g[h].astype("<f4").tobytes() for g, h in zip(got, hit)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "at", "n"])

    counted = taken.mapInArrow(run, "h long, lang string, at binary, n binary")
    by = Window.partitionBy("lang").orderBy("h", "at", "n")
    sample = counted.withColumn("k", F.row_number().over(by)).where(F.col("k") <= each).drop("k").collect()
    langs = sorted({r.lang for r in sample})
    sample = sorted(sample, key=lambda r: (r.h, r.lang, r.at, r.n))
    rows = Sparse([(np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<f4")) for r in sample])
    return train(rows, np.array([langs.index(r.lang) for r in sample]), langs) if sample else None


def _judged(texts: list[str | None], m: Model | None) -> tuple[list[str], list[float], list[bool]]:
    lang, score, accepted = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    known = [i for i, t in enumerate(texts) if m and has_letter(t)]
    for at in range(0, len(known), 64):
        part = known[at : at + 64]
        counts = np.stack([grams(texts[i].encode("utf-8", "surrogatepass")) for i in part])
        best, p, near = m.predict(counts)
        for i, k, q, on in zip(part, best.tolist(), p.tolist(), m.accepts(counts, p, near).tolist()):
            lang[i], score[i], accepted[i] = m.langs[k], min(1.0, q), on
    return lang, score, accepted


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of docs."""
    spark = docs.sparkSession
    common.reachable(spark)
    sent = spark.sparkContext.broadcast(model)  # two floats for each of BUCKETS and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, accepted = _judged(b.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learned from rows whose crc32(doc_id) mod 5 isn't 0."""
    model = fit(docs, docs.where(common.remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows that the classifier rejects, in one pass: all columns travel through it. Without a
    model one is fitted on docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judged(b.column(at).to_pylist(), sent.value)[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
