"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost (seconds a row) and the rows it rejects are estimated on a bounded sample of the whole table; the
verdict is one CASE whose branches stand in the order of rejection per cost, so a row pays for a rule only when no
earlier one has rejected it. Rejection is that of rows which the rules before have left: the order is made one rule
at a time. The base's two rules stand in the cascade like the others, and repeated windows, the dearest measure, are
sought only in rows that no earlier rule has rejected, unless a report wants the measure of every row. The order
changes the cost alone: a row is kept if no rule rejects it.

What the rules here cost follows from the characters and words that they read in the sample (``work``), so the order is
the same whenever the sample is. Rules of other names are timed over the sample repeated ``REPEATS`` times, less the
time of a rule that costs nothing; costs under ``LEAST_COST`` are then held to be equal, as scheduling varies by more.

Measures are per row: no shuffle, and no group to be skewed. Repeated 8-word windows are found by 64-bit
hashes of the windows; only texts with an equal pair sort their windows.

Defined cases: a null or empty text has no words and fails; very long texts are measured whole, and leave the sample
beyond ``SAMPLE_CHARS`` characters; repeated rows are judged each; ties between rules keep their given order; an empty
table gives an empty one and keeps that order too; other columns, whatever their names, pass through keep().
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm import common

SAMPLE_ROWS, SAMPLE_CHARS = 400, 1 << 16
REPEATS, LEAST_COST = 25, 12e-6
SPAN = 8
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def measures(docs: DataFrame, text_col: str = "text", unless: Column | None = None) -> DataFrame:
    """docs as the struct ``row``, and beside it the measures that rules read. Where ``unless``, a condition on the
    other measures, holds, repeated windows aren't sought and count as none."""
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = t.withColumn("words", F.array_remove(F.split("t", f"{_SPACE}+"), ""))
    lines = words.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD)))
    counted = lines.select(
        "row",
        "t",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    keep = [c for c in counted.columns]
    long = F.col("n_words") > SPAN
    starts = F.when(long if unless is None else long & ~F.coalesce(unless, F.lit(False)), F.sequence(F.lit(1), F.col("n_words").cast("int") - (SPAN - 1))).otherwise(F.array().cast("array<int>"))
    hashed = counted.select(*keep, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, SPAN))).alias("h"))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    ordered = hashed.select(*keep, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(none).alias("p"))
    again = F.filter("p", lambda e, k: F.coalesce((k > 0) & (F.get("p", k - 1)["x"] == e["x"]), F.lit(False)) | F.coalesce(F.get("p", k + 1)["x"] == e["x"], F.lit(False)))
    found = ordered.select(*keep, F.array_sort(F.transform(again, lambda e: e["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda q, k: F.least(F.lit(SPAN), F.coalesce(F.get("at", k + 1) - q, F.lit(SPAN)))), F.lit(0), lambda a, x: a + x)
    return found.select(*keep, covered.cast("long").alias("n_repeat_words"))


#: The rule whose measure is made only for rows that reach it.
REPEATED = "repeated_windows"


def base_failed() -> Column:
    named = rules()
    return named["few_words"] | named[REPEATED]


def _only(pattern: str) -> Column:
    return F.length(F.regexp_replace("t", f"[^{pattern}]+", ""))


def rules() -> dict[str, Column]:
    """name -> whether a row is rejected, the base's rules first. Expressions over the text itself cost only rows that
    reach them."""
    return {
        "few_words": F.col("n_words") < 20,
        REPEATED: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "exclamations": 2 * _only("!") > F.col("n_words"),
        "capitals": 2 * _only(r"\p{Lu}") > _only(r"\p{L}"),
        "letterless_words": 10 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < 4 * F.col("n_words"),
    }


def _sampled(docs: DataFrame, text_col: str, rows: int, chars: int) -> DataFrame:
    """Texts of at most ``rows`` rows of the whole table, by a hash of the text, written as a table."""
    n = docs.count()  # for Parquet, from its footers
    some = docs.select(F.col(text_col).alias("text")).sample(min(1.0, 20 * rows / max(1, n)), seed=7).where(F.length("text") <= chars)
    return common.cut(some.orderBy(F.xxhash64("text", F.lit("quality"))).limit(rows).repartition(1), "quality-sample")


def work() -> dict[str, Column]:
    """name -> seconds that a rule takes for a row, from what it has to read: characters, words, or a few numbers. The
    constants are of one core, measured once over long samples; only their proportions matter."""
    chars, words, numbers = F.length("t"), F.col("n_words"), F.lit(1e-7)
    read = {REPEATED: 1.2e-6 * words, "exclamations": 1.3e-8 * chars, "capitals": 5.5e-8 * chars, "letterless_words": 3.7e-7 * words}
    return {k: numbers + read.get(k, F.lit(0.0)) for k in rules()}


def timed(sample: DataFrame, named: dict[str, Column], repeats: int = REPEATS) -> dict[str, float]:
    """Seconds a row that each rule takes, over measured texts; REPEATED's includes making its measure."""
    again = lambda df, times: df.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("again")
    few = max(1, repeats // 8)  # windows take long enough
    plain, whole = again(common.cut(measures(sample).drop("row", "n_repeat_words"), "quality-measures"), repeats), again(sample, few)
    n = max(1, sample.count())

    def seconds(df: DataFrame, c: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            df.agg(F.count_if(c)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle, made = seconds(plain, F.col("n_words") < 0), seconds(measures(whole), F.col("word_chars") + F.col("n_lines") < 0)
    out = {}
    for k, c in named.items():
        took = (seconds(measures(whole), c) - made) / few if k == REPEATED else (seconds(plain, c) - idle) / repeats
        out[k] = max(took / n, LEAST_COST)
    return out


def costs(sample: DataFrame, named: dict[str, Column]) -> dict[str, float]:
    """Seconds a row that each rule takes on the sample: from what it reads there, in one job, if all rules say so
    (``work``); else all are timed."""
    known = work()
    if not all(k in known for k in named):
        return timed(sample, named)
    row = measures(sample).agg(*(F.avg(known[k]).alias(k) for k in named)).first()
    return row.asDict()


def order(docs: DataFrame, named: dict[str, Column], text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Rule names by rejections per cost among the rows that the rules before have left, on a sample."""
    sample = _sampled(docs, text_col, rows, chars)
    flags = [F.coalesce(c, F.lit(False)).alias(f"r{i}") for i, c in enumerate(named.values())]
    seen = [(r[:-1], r[-1]) for r in measures(sample).groupBy(*flags).count().collect()]  # at most a row of the sample each
    if not seen:
        return list(named)
    cost, left, out = costs(sample, named), list(named), []
    while left:
        at = {k: i for i, k in enumerate(named)}
        best = max(left, key=lambda k: (sum(n for f, n in seen if f[at[k]]) / cost[k], -cost[k], -at[k]))
        out.append(best)
        left.remove(best)
        seen = [(f, n) for f, n in seen if not f[at[best]]]
    return out


def cascade(named: dict[str, Column], names: list[str]) -> Column:
    """True if no rule rejects; a later rule is evaluated only where earlier ones haven't rejected."""
    verdict = F
    for k in names:
        verdict = verdict.when(F.coalesce(named[k], F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True)) if names else F.lit(True)


def judge(docs: DataFrame, text_col: str = "text", every: bool = True) -> DataFrame:
    """docs as the struct ``row`` with its measures, base_failed and kept. Unless every row's measures are wanted,
    repeated windows are sought only where the verdict needs them."""
    named = rules()
    names = order(docs, named, text_col)
    before = [F.coalesce(named[k], F.lit(False)) for k in names[: names.index(REPEATED)]]
    unless = reduce(Column.__or__, before) if before and not every else None
    judged = measures(docs, text_col, unless).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", cascade(named, names))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    return judge(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects.

    A filter moves below columns made of its row alone, and would repeat the measures' expressions inside one another
    there, splitting a text once for each of its windows. The task's number isn't of the row, so the filter stays.
    """
    held = judge(docs, text_col, every=False).withColumn("task", F.spark_partition_id())
    return held.where(F.col("kept") & (F.col("task") >= 0)).select("row.*")


SQL = r"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM a),
w AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM b WHERE len(ws) >= 8),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i + 7]) AS n FROM w),
g AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c WHERE n > 1),
r AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM g GROUP BY rid),
m AS (SELECT doc_id, t, ws, len(ls)::BIGINT AS n_lines, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN r USING (rid)),
f AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
            OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
            OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 4 * n_words) AS kept
FROM f
"""
