"""Queries: tables with several writers, replaced in place and migrated, and the digests of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import narratives, reports, state
from spoor.plans.registry import query
from spoor.plans.standins import oracle, raw, table
from spoor.sources import chat, migrations, scratch, tables


@query(
    "s15_append_new",
    oracle(
        ", k AS (SELECT event_type, user_id, min(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) AS batch FROM events GROUP BY ALL), n AS (SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS one, count(*) AS whole FROM events)"
        " SELECT event_type, user_id, CAST(batch AS INT) AS batch, CASE batch WHEN 0 THEN (SELECT one FROM n) ELSE (SELECT whole - one FROM n) END - count(*) OVER (PARTITION BY batch) AS skipped_in_batch FROM k",
        "files",
    ),
)
def s15_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches and a replay of the second into one table by key; what each batch inserted and skipped."""
    e = raw(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    path = scratch.fresh(spark, "append-new")
    skipped = []
    for i, part in enumerate(("event_id % 3 = 0", "event_id % 3 <> 0", "event_id % 3 <> 0")):
        batch = min(i, 1)
        rows = e.where(part).select("event_type", "user_id", F.lit(batch).alias("batch"))
        skipped.append(tables.append_new(path, rows, ["event_type", "user_id"], f"batch-{batch}")[1])
    if skipped[1] != skipped[2]:
        raise ValueError("a replayed epoch has other counts")
    return spark.read.parquet(path).withColumn("skipped_in_batch", F.when(F.col("batch") == 0, skipped[0]).otherwise(skipped[1]).cast("long"))


@query("s18_in_place", oracle(" SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY ALL", "files"))
def s18_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of odd ids replace those of even ones, bucket by bucket, wherever they are later."""
    e = raw(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    path = scratch.fresh(spark, "upsert")
    for rest in (0, 1):
        tables.upsert_into(path, e.where(F.col("event_id") % 2 == rest), ["event_type", "user_id"], "event_id", buckets=16)
    return tables.read_keyed(spark, path)


@query(
    "d17_migrated",
    oracle(" SELECT conv_id, turn, substr(sha256(concat(stamp, '||', coalesce(sender, ''), '||', content)), 1, 16) AS content_hash, CAST('api_calls,forensic_narratives,messages' AS VARCHAR) AS left_tables FROM messages", "messages"),
)
def d17_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as they first were, brought to the present version, twice; messages have their hash, events are gone."""
    base = scratch.fresh(spark, "vault")
    table(spark, sf_dir, "messages").select("conv_id", "turn", "sender", "content", F.col("stamp").alias("timestamp_whatsapp")).write.parquet(f"{base}/messages")
    table(spark, sf_dir, "api_calls").select("id", "endpoint", "cost_usd").write.parquet(f"{base}/api_calls")
    table(spark, sf_dir, "narratives").select("id", "scope").write.parquet(f"{base}/forensic_narratives")
    raw(spark, sf_dir, "events").select("event_id").write.parquet(f"{base}/events")
    done = migrations.migrate(spark, base)
    if migrations.migrate(spark, base) or done != [m.version for m in migrations.MIGRATIONS]:
        raise ValueError(f"migrations were not applied once each: {done}")
    left = ",".join(t for t in ("api_calls", "events", "forensic_narratives", "messages") if tables.exists(spark, f"{base}/{t}"))
    return spark.read.parquet(f"{base}/messages").select("conv_id", "turn", "content_hash", F.lit(left).alias("left_tables"))


@query("s6_census")
def s6_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of each file of the tables; what SQL can't say is tested against hashlib."""
    return chat.census(spark, sf_dir if ":" in sf_dir else f"file://{sf_dir}").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256")



_LABELLED = """SELECT obra, id, ts, CASE source_type WHEN 'view' THEN 'transcription' WHEN 'click' THEN 'text_message' WHEN 'cart' THEN NULL ELSE source_type END AS source_type, text,
    CASE id % 4 WHEN 0 THEN [category] WHEN 1 THEN [category, 'obra'] WHEN 2 THEN [category, 'off_topic', 'obra'] ELSE [] END AS labels, id % 3 = 0 AS reviewed FROM happenings"""
_DAYS = f""", e AS ({_LABELLED}), d AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, id, ts, coalesce(source_type, 'transcription') AS source, labels, reviewed FROM e),
n AS (SELECT obra, day, count(*) AS n, count(*) FILTER (WHERE reviewed) AS r FROM d GROUP BY ALL),
l AS (SELECT obra, day, unnest(labels) AS label, generate_subscripts(labels, 1) AS place FROM d),
p AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, id, cents FROM payments JOIN (SELECT DISTINCT obra AS o, day AS y FROM d) ON o = obra AND y = strftime(ts, '%Y-%m-%d')),
f AS (SELECT obra, day, concat('c_', id) AS ref FROM d UNION ALL SELECT obra, day, concat('fr_', id) FROM p),
t AS (SELECT DISTINCT x.obra, f.day, correlation_type, primary_event_ref, related_event_ref, confidence FROM edges x JOIN f ON f.obra = x.obra AND f.ref IN (primary_event_ref, related_event_ref))
SELECT obra, day, 1 AS section, concat('- Eventos classificados: **', n, '**') AS line FROM n
UNION ALL SELECT obra, day, 1, concat('- Revisados por humano: **', r, '**') FROM n
UNION ALL SELECT obra, day, 1, concat('- Não revisados: **', n - r, '**') FROM n
UNION ALL SELECT obra, day, 2, concat('- ', CASE source WHEN 'transcription' THEN 'áudios transcritos' WHEN 'text_message' THEN 'mensagens de texto' ELSE source END, ': **', count(*), '**') FROM d GROUP BY obra, day, source
UNION ALL SELECT obra, day, 3, concat('- `', label, '`: **', count(*), '**', CASE WHEN count(*) FILTER (WHERE place > 1) > 0 THEN concat(' (+', count(*) FILTER (WHERE place > 1), ' secundária)') ELSE '' END) FROM l GROUP BY obra, day, label
UNION ALL SELECT obra, day, 5, concat(chr(10), '### `', correlation_type, '` (', count(*), ' total, ', count(*) FILTER (WHERE confidence >= 0.7), ' validadas)', chr(10)) FROM t GROUP BY obra, day, correlation_type
UNION ALL SELECT obra, day, 5, concat('- ', CASE WHEN confidence >= 0.7 THEN '✅' ELSE '·' END, ' ', printf('%.2f', confidence), ' `', primary_event_ref, '` ↔ `', related_event_ref, '`') FROM t"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _LABELLED.replace("FROM happenings", "FROM {h}").replace("[category]", "array(category)").replace("[category, 'obra']", "array(category, 'obra')").replace("[category, 'off_topic', 'obra']", "array(category, 'off_topic', 'obra')").replace("ELSE [] END", "ELSE cast(array() as array<string>) END")
    return spark.sql(sql, h=table(spark, sf_dir, "happenings"))


@query("s21_day_lines", oracle(_DAYS, "happenings", "payments", "edges"))
def s21_day_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's report says of counts, sources, labels in first and later place, and correlations."""
    rows = reports.day_lines(_labelled(spark, sf_dir), table(spark, sf_dir, "payments"), table(spark, sf_dir, "edges"))
    return rows.where("section in (1, 2, 3, 5)").select("obra", "day", "section", "line")


@query("s21_reports")
def s21_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts, which a test holds against plain loops."""
    return reports.daily(_labelled(spark, sf_dir), table(spark, sf_dir, "payments"), table(spark, sf_dir, "edges"))


_REPLIES = """SELECT id, id * 2 + k AS call_id, CASE id % 6 WHEN 0 THEN '{"categories": ["pagamento"], "confidence": 0.75, "reasoning": "r"}' WHEN 1 THEN '{"categories": ["pagamento", "material"], "confidence": 2, "reasoning": "r"}'
    WHEN 2 THEN '{"categories": ["nada"], "confidence": 1}' WHEN 3 THEN 'nada' ELSE CASE k WHEN 1 THEN '{"categories": ["cronograma", "material"], "confidence": 0.5, "reasoning": "s"}' ELSE 'nada' END END AS reply, 0.5e0 AS cost_usd FROM happenings"""
_STATES = "SELECT id, obra, CASE id % 5 WHEN 0 THEN 'classified' WHEN 1 THEN 'rejected' ELSE 'pending_classify' END AS semantic_status, CAST(NULL AS STRING) AS reasoning FROM happenings"


@query(
    "d4_classified",
    oracle(
        f", s AS ({_STATES}) SELECT id, CASE WHEN id % 5 > 1 AND id % 6 IN (0, 4, 5) THEN 'classified' ELSE semantic_status END AS semantic_status, CASE WHEN id % 5 <= 1 THEN NULL WHEN id % 6 = 0 THEN '[\"pagamento\"]' WHEN id % 6 > 3 THEN '[\"cronograma\",\"material\"]' END AS categories,"
        " CASE WHEN id % 5 <= 1 THEN NULL WHEN id % 6 = 0 THEN 0.75e0 WHEN id % 6 > 3 THEN 0.5e0 END AS confidence_model, CASE WHEN id % 5 <= 1 THEN NULL WHEN id % 6 = 0 THEN 'r' WHEN id % 6 > 3 THEN 's' END AS reasoning,"
        " CASE WHEN id % 5 > 1 THEN CASE id % 6 WHEN 1 THEN 'confidence_range' WHEN 2 THEN 'unknown_category' WHEN 3 THEN 'categories' END END AS failure, CASE WHEN id % 5 > 1 THEN 0.5e0 ELSE 0 END AS cost_usd FROM s",
        "happenings",
    ),
)
def d4_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls for each row, the later of which counts; some break their contract, some rows are done with."""
    h = table(spark, sf_dir, "happenings")
    calls = h.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    replies = spark.sql(_REPLIES.replace("FROM happenings", "FROM {c}").replace("'{\"", "'{{\"").replace("\"}'", "\"}}'").replace("2, \"reasoning\": \"r\"}}", "2, \"reasoning\": \"r\"}}").replace("1}'", "1}}'"), c=calls)
    rows = spark.sql(_STATES.replace("FROM happenings", "FROM {h}"), h=h)
    return state.classified(rows, replies).select("id", "semantic_status", "categories", "confidence_model", "reasoning", "failure", "cost_usd")


@query(
    "s22_saved",
    oracle(" SELECT obra, CASE WHEN coalesce(scope_ref, '') = '' THEN concat(scope, '.md') ELSE concat(scope, '_', scope_ref, '.md') END AS file, CAST(count(DISTINCT dossier_hash) AS BIGINT) AS kept FROM narratives GROUP BY ALL", "narratives"),
)
def s22_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives saved twice: one row of each key, and a file for each scope and reference."""
    path = scratch.fresh(spark, "narratives")
    n = table(spark, sf_dir, "narratives").select("id", "obra", "scope", "scope_ref", "dossier_hash", "narrative_text")
    saved, _ = narratives.save(n, path)
    again, found = narratives.save(n, path)
    if again or found < saved:
        raise ValueError("a narrative was saved twice")
    files = spark.read.parquet(f"{path}/shown").select("file").distinct()  # recorded once they are there; listing each file's folder is a task
    rows = spark.read.parquet(f"{path}/rows").groupBy("obra", "file").agg(F.count("*").alias("kept")).join(files, "file")
    return rows.select("obra", F.split_part("file", F.lit("/"), F.lit(2)).alias("file"), "kept")


_FILTERS = {"any": {}, "scope": {"scope": "day"}, "scopes": {"scope": ("day", "week"), "prompt_version": "narrator_v2"}, "ref": {"scope": "day", "scope_ref": "1996-01-02"}, "before": {"scope": None, "before": ("day", "1996-01-01")}}
_WHERE = {"any": "true", "scope": "scope = 'day'", "scopes": "scope IN ('day', 'week') AND prompt_version = 'narrator_v2'", "ref": "scope = 'day' AND scope_ref = '1996-01-02'", "before": "day < DATE '1996-01-01'"}


@query("p17_optional", oracle(" " + " UNION ALL ".join(f"SELECT '{k}' AS filters, id, CASE WHEN NOT coalesce(obra = 'obra_1' AND {w}, false) THEN prompt_template_hash END AS prompt_template_hash FROM narratives" for k, w in _WHERE.items()), "narratives"))
def p17_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of narratives' hashes after each of five combinations of filters, given or not."""
    n = table(spark, sf_dir, "narratives")
    made = [state.invalidated(n, "prompt_template_hash", state.given(obra="obra_1", **f)).select(F.lit(k).alias("filters"), "id", "prompt_template_hash") for k, f in _FILTERS.items()]
    return reduce(DataFrame.unionByName, made)
