"""Queries: the four detectors and reports over their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import text
from spoor.operators import correlations, detectors
from spoor.plans import registry
from spoor.plans.registry import query
from spoor.plans.standins import oracle, table

_WORDS = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in detectors.PAYMENT_WORDS)
_STOP = ", ".join(f"'{w}'" for w in text.SCOPE_STOPWORDS)
_STEM = f"regexp_replace(t, '^(.{{3,}}?)(?:{'|'.join(text.SUFFIXES)})$', '\\1')"


def tokens_sql(column: str) -> str:
    """The scope tokens of a column in DuckDB."""
    words = f"list_filter(regexp_extract_all(lower(strip_accents({column})), '[a-z0-9]+'), lambda t: len(t) >= 3 AND t NOT IN ({_STOP}))"
    return f"list_distinct(list_filter(list_transform({words}, lambda t: {_STEM}), lambda t: len(t) >= 3))"


def _in(column: str, words: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


_HIGH, _LOW = _in("t", text.HIGH_STEMS), _in("t", text.LOW_STEMS)
_GAP = "CAST(trunc(date_diff('microsecond', p.ts, e.ts) / 1000000) AS BIGINT)"
_CONTEXTS = """, parts AS (SELECT obra, id, ts, text, unnest(list_zip(regexp_extract_all(text, '(?i)R\\$\\s*(?:\\d{1,3}(?:\\.\\d{3})+(?:,\\d{2})?|\\d+(?:,\\d{2})?)'), range(1, 1 + len(regexp_extract_all(text, '(?i)R\\$\\s*(?:\\d{1,3}(?:\\.\\d{3})+(?:,\\d{2})?|\\d+(?:,\\d{2})?)'))))) AS z FROM happenings),
spots AS (SELECT obra, id, ts, z[1] AS amount, lower(substr(text, greatest(1, strpos(text, z[1]) - 20), least(20, strpos(text, z[1]) - 1) + len(z[1]) + 20)) AS ctx FROM parts),
kinds AS (SELECT DISTINCT obra, id, ts, CAST(round(CAST(replace(replace(regexp_replace(amount, '(?i)R\\$\\s*', ''), '.', ''), ',', '.') AS DECIMAL(18, 4)) * 100) AS BIGINT) AS m,
    CASE WHEN {unit} AND {total} THEN 'ambiguous' WHEN {unit} THEN 'unitary' ELSE 'aggregate' END AS kind FROM spots)
"""


def _marks(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(ctx, '{w}')" for w in words) + ")"


def contexts_sql() -> str:
    from spoor.functions.money import TOTAL_MARKS, UNIT_MARKS

    return _CONTEXTS.replace("{unit}", _marks(UNIT_MARKS)).replace("{total}", _marks(TOTAL_MARKS))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "happenings"), table(spark, sf_dir, "payments")


_EDGE = ("obra", "correlation_type", "primary_event_ref", "related_event_ref", "time_gap_seconds", "confidence")


def _edge(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_EDGE[:-1], F.round("confidence", 9).alias("confidence"), *more)


@query(
    "temporal_by_type",
    oracle(
        f""", pairs AS (SELECT p.obra, least(({_WORDS}) / 3.0e0, 1.0e0) AS confidence FROM payments p JOIN happenings e
        ON p.obra = e.obra AND e.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE WHERE ({_WORDS}) > 0)
        SELECT 'TEMPORAL_PAYMENT_CONTEXT' AS correlation_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.7) AS validated FROM pairs""",
        "payments",
        "happenings",
    ),
)
def temporal_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments and what was said about payment around them, counted by type: one range join and one aggregate."""
    return correlations.by_type(detectors.temporal_payment_context(*_inputs(spark, sf_dir))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "j6_temporal",
    oracle(
        f"""SELECT p.obra, 'TEMPORAL_PAYMENT_CONTEXT' AS correlation_type, concat('fr_', p.id) AS primary_event_ref, concat('c_', e.id) AS related_event_ref, {_GAP} AS time_gap_seconds,
        round(least(({_WORDS}) / 3.0e0, 1.0e0), 9) AS confidence, concat(({_WORDS}), ' keyword(s) de pagamento na janela +-30min (delta=', CASE WHEN {_GAP} < 0 THEN '' ELSE '+' END, {_GAP}, 's)') AS rationale
        FROM payments p JOIN happenings e ON p.obra = e.obra AND e.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE WHERE ({_WORDS}) > 0""",
        "payments",
        "happenings",
    ),
)
def j6_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(detectors.temporal_payment_context(*_inputs(spark, sf_dir)), "rationale")


@query(
    "j7_semantic",
    oracle(
        f""", e AS (SELECT obra, id, ts, {tokens_sql("text")} AS tk FROM happenings), p AS (SELECT obra, id, ts, {tokens_sql("description")} AS tk FROM payments WHERE trim(description) <> ''),
        j AS (SELECT p.obra, p.id AS pid, e.id AS eid, {_GAP} AS gap, list_intersect(p.tk, e.tk) AS s FROM p JOIN e ON p.obra = e.obra AND e.ts BETWEEN p.ts - INTERVAL 3 DAY AND p.ts + INTERVAL 3 DAY WHERE len(p.tk) >= 2)
        SELECT obra, 'SEMANTIC_PAYMENT_SCOPE' AS correlation_type, concat('fr_', pid) AS primary_event_ref, concat('c_', eid) AS related_event_ref, gap AS time_gap_seconds,
        round(least(list_sum(list_transform(s, lambda t: CASE WHEN {_HIGH} THEN 1.5e0 WHEN {_LOW} THEN 0.7e0 ELSE 1.0e0 END)) / 4, 1) * (1 - 0.3e0 * least(abs(gap) / 259200.0e0, 1)), 9) AS confidence,
        array_to_string(list_transform(list_sort(s)[1:5], lambda t: concat(t, CASE WHEN {_HIGH} THEN '*' WHEN {_LOW} THEN '~' ELSE '' END)), ',') AS shared FROM j WHERE len(s) >= 2""",
        "payments",
        "happenings",
    ),
)
def j7_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.semantic_payment_scope(*_inputs(spark, sf_dir))
    shared = F.substring_index(F.substring_index(F.substring_index("rationale", "termo(s): ", -1), " ", 1), ".", 1)
    return _edge(found.withColumn("shared", shared), "shared")


@query(
    "j8_math",
    oracle(
        contexts_sql()
        + f""", j AS (SELECT p.obra, p.id AS pid, k.id AS eid, k.m, k.kind, p.cents, {_GAP.replace("e.ts", "k.ts")} AS gap FROM payments p JOIN kinds k ON p.obra = k.obra AND k.ts BETWEEN p.ts - INTERVAL 48 HOUR AND p.ts + INTERVAL 48 HOUR WHERE k.kind <> 'unitary' AND k.m > 0 AND p.cents > 0),
        r AS (SELECT *, CASE WHEN abs(m - cents) < 100 THEN 1 WHEN abs(m - cents // 2) < 100 OR abs(m - cents * 2) < 100 THEN 2 WHEN m BETWEEN 0.5e0 * cents AND 1.5e0 * cents THEN 3 END AS c FROM j)
        SELECT obra, CASE c WHEN 1 THEN 'MATH_VALUE_MATCH' WHEN 2 THEN 'MATH_INSTALLMENT_MATCH' ELSE 'MATH_VALUE_DIVERGENCE' END AS correlation_type, concat('fr_', pid) AS primary_event_ref, concat('c_', eid) AS related_event_ref, gap AS time_gap_seconds,
        round(CASE c WHEN 1 THEN 1.0e0 WHEN 2 THEN 0.8e0 ELSE 0.6e0 END - CASE WHEN kind = 'ambiguous' THEN 0.2e0 ELSE 0 END, 9) AS confidence FROM r WHERE c IS NOT NULL""",
        "payments",
        "happenings",
    ),
)
def j8_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(detectors.math_relations(*_inputs(spark, sf_dir)))


_RENEGOTIATED = (
    contexts_sql()
    + f""", v AS (SELECT obra, id, ts, max(m) AS v FROM kinds WHERE kind <> 'unitary' AND m > 0 GROUP BY ALL),
        h AS (SELECT v.obra, v.id, v.ts, v.v, list_filter({tokens_sql("text")}, lambda t: {_HIGH}) AS hs FROM v JOIN happenings USING (id)),
        j AS (SELECT a.obra, a.id AS aid, b.id AS bid, CAST(trunc(date_diff('microsecond', a.ts, b.ts) / 1000000) AS BIGINT) AS gap, abs(b.v - a.v) / greatest(a.v, b.v) AS rel, len(list_intersect(a.hs, b.hs)) AS n
              FROM h a JOIN h b ON a.obra = b.obra AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {{days}} DAY)
        SELECT obra, 'CONTRACT_RENEGOTIATION' AS correlation_type, concat('c_', aid) AS primary_event_ref, concat('c_', bid) AS related_event_ref, gap AS time_gap_seconds,
        CASE WHEN n >= 2 AND rel BETWEEN 0.20e0 AND 0.70e0 THEN 0.85e0 ELSE 0.70e0 END AS confidence FROM j WHERE n >= 1 AND rel BETWEEN 0.10e0 AND 0.80e0"""
)


@query("j9_renegotiation", oracle(_RENEGOTIATED.replace("{days}", "30"), "happenings"))
def j9_renegotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(detectors.contract_renegotiation(table(spark, sf_dir, "happenings")))


@query("j9_renegotiation_month", oracle(_RENEGOTIATED.replace("{days}", "31"), "happenings"))
def j9_renegotiation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the longest month for a window."""
    return _edge(detectors.contract_renegotiation(table(spark, sf_dir, "happenings"), window=31 * 86400))


_FOUR = " UNION ALL ".join(f"SELECT correlation_type, confidence FROM ({registry.oracle_sql()[n]})" for n in ("j6_temporal", "j7_semantic", "j8_math", "j9_renegotiation"))


@query("detect_all", f"SELECT correlation_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.7) AS validated FROM ({_FOUR}) GROUP BY 1")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered detector with its own window, counted by type."""
    c, sure = F.col("confidence"), detectors.VALIDATED
    found = detectors.detect_counted(*_inputs(spark, sf_dir)).withColumn("confidence", F.when((c < sure) & (c >= sure - 5e-10), sure).otherwise(c))  # as rounded to nine places
    return correlations.by_type(found, "n").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "k_mentions",
    oracle(contexts_sql() + " SELECT id, m AS cents, kind FROM kinds WHERE m > 0", "happenings"),
)
def k_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoor.functions import money

    return table(spark, sf_dir, "happenings").select("id", F.explode(money.mentions("text")).alias("m")).select("id", "m.cents", "m.kind")


@query("k_scope_tokens", oracle(f"SELECT id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS tokens FROM happenings", "happenings"))
def k_scope_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "happenings").select("id", F.array_join(F.array_sort(text.scope_tokens("text")), " ").alias("tokens"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges")


@query("a5_by_type", oracle("SELECT correlation_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.7) AS validated FROM edges GROUP BY 1", "edges"))
def a5_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.by_type(_edges(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("a8_summary", oracle("SELECT obra, count(*) AS total, count(*) FILTER (WHERE confidence >= 0.7) AS validated FROM edges WHERE confidence >= 0.3 GROUP BY 1", "edges"))
def a8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.summary(_edges(spark, sf_dir), 0.3)


@query("a27_by_detector", oracle("SELECT detected_by, count(*) AS n FROM edges GROUP BY 1", "edges"))
def a27_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.by_detector(_edges(spark, sf_dir))


@query("p13_select", oracle("SELECT * FROM edges WHERE correlation_type = 'MATH_VALUE_MATCH' AND confidence >= 0.5", "edges"))
def p13_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.select(_edges(spark, sf_dir), "MATH_VALUE_MATCH", 0.5)


@query("p14_for_refs", oracle("SELECT * FROM edges WHERE primary_event_ref IN (SELECT concat('fr_', id) FROM payments) OR related_event_ref IN (SELECT concat('fr_', id) FROM payments)", "edges", "payments"))
def p14_for_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.for_refs(_edges(spark, sf_dir), table(spark, sf_dir, "payments").select(F.concat(F.lit("fr_"), "id").alias("ref")))


@query("t2_top_validated", oracle("SELECT id, correlation_type, confidence FROM edges WHERE confidence >= 0.7 ORDER BY confidence DESC, id DESC LIMIT 10", "edges"))
def t2_top_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.top_validated(_edges(spark, sf_dir)).select("id", "correlation_type", "confidence")


@query("t3_top_of_summary", oracle("SELECT id, confidence FROM edges WHERE confidence >= 0.7 ORDER BY confidence DESC, id LIMIT 3", "edges"))
def t3_top_of_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where("confidence >= 0.7").orderBy(F.desc("confidence"), "id").limit(3).select("id", "confidence")


@query(
    "w2_weak_sample",
    oracle(", r AS (SELECT id, correlation_type, confidence, row_number() OVER (PARTITION BY correlation_type ORDER BY confidence DESC, id) AS k FROM edges WHERE confidence >= 0.4 AND confidence < 0.7) SELECT id, correlation_type, confidence FROM r WHERE k <= 5 ORDER BY confidence DESC, id LIMIT 15", "edges"),
)
def w2_weak_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.weak_sample(_edges(spark, sf_dir)).select("id", "correlation_type", "confidence")


@query("f30_shown_type", oracle("SELECT CASE WHEN correlation_type LIKE 'TEMPORAL%' THEN 'TEMPORAL' WHEN correlation_type LIKE 'MATH%' THEN 'MATH' ELSE 'SEMANTIC' END AS shown, count(*) AS n FROM edges GROUP BY 1", "edges"))
def f30_shown_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(correlations.shown_type(F.col("correlation_type")).alias("shown")).agg(F.count("*").alias("n"))
