"""Queries: tasks and states, dossiers, narratives, media, usage, parsing and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions import money, temporal, text
from spoor.operators import correlations, dossier, joins, media, narratives, state, usage
from spoor.plans.detection import tokens_sql
from spoor.plans.registry import query
from spoor.plans.standins import oracle, raw, table
from spoor.sources import chat, records

_ROUND6 = lambda c: F.round(c, 6).alias(c)

# Tasks and states.


@query("a1_task_counts", oracle("SELECT obra, task_type, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM tasks GROUP BY ALL", "tasks"))
def a1_task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.counts(table(spark, sf_dir, "tasks"))


@query("a3_span", oracle("SELECT obra, min(created_at) AS first_created, max(finished_at) FILTER (WHERE status = 'done') AS last_finished FROM tasks GROUP BY 1", "tasks"))
def a3_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.span(table(spark, sf_dir, "tasks"))


@query("a4_pending", oracle("SELECT task_type, count(*) AS pending, count(*) FILTER (WHERE depends_on <> '[]') AS with_dependencies FROM tasks WHERE status = 'pending' GROUP BY 1", "tasks"))
def a4_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_with_dependencies(table(spark, sf_dir, "tasks"))


_BLOCKED = ", waits AS (SELECT id, unnest(CAST(depends_on AS BIGINT[])) AS d FROM tasks WHERE status = 'pending'), blocked AS (SELECT DISTINCT id FROM waits WHERE d NOT IN (SELECT id FROM tasks WHERE status = 'done'))"


@query("j14_runnable", oracle(f"{_BLOCKED} SELECT id, obra, priority FROM tasks WHERE status = 'pending' AND id NOT IN (SELECT id FROM blocked)", "tasks"))
def j14_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.runnable(table(spark, sf_dir, "tasks")).select("id", "obra", "priority")


@query("t1_next_task", oracle(f"{_BLOCKED}, r AS (SELECT *, row_number() OVER (PARTITION BY obra ORDER BY priority DESC, created_at, id) AS k FROM tasks WHERE status = 'pending' AND id NOT IN (SELECT id FROM blocked)) SELECT obra, id FROM r WHERE k = 1", "tasks"))
def t1_next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_task(table(spark, sf_dir, "tasks")).select("obra", "id")


@query("d3_claim_by_type", oracle(", r AS (SELECT *, row_number() OVER (PARTITION BY obra ORDER BY priority DESC, created_at, id) AS k FROM tasks WHERE status = 'pending' AND task_type = 'ocr') SELECT obra, id FROM r WHERE k = 1", "tasks"))
def d3_claim_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_task(table(spark, sf_dir, "tasks"), "ocr").select("obra", "id")


@query("t8_resumable", oracle("SELECT id, obra, started_at FROM tasks WHERE status = 'running' AND finished_at IS NULL", "tasks"))
def t8_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.resumable(table(spark, sf_dir, "tasks")).select("id", "obra", "started_at")


@query("d3_resets", oracle("SELECT id, CASE WHEN (status = 'running' AND finished_at IS NULL) OR status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN (status = 'running' AND finished_at IS NULL) OR status = 'failed' THEN NULL ELSE started_at END AS started_at FROM tasks", "tasks"))
def d3_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reset_failed(state.reset_running(table(spark, sf_dir, "tasks"))).select("id", "status", "started_at")


@query("d1_moved", oracle(", ev AS (SELECT CAST(event_id AS BIGINT) AS id, ts AS moment, CASE WHEN value > 50 THEN 'done' ELSE 'running' END AS status FROM events), l AS (SELECT id, arg_max(status, moment) AS s FROM ev GROUP BY 1) SELECT t.id, coalesce(l.s, t.status) AS status FROM tasks t LEFT JOIN l USING (id)", "tasks"))
def d1_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("value") > 50, "done").otherwise("running").alias("status"))
    return state.moved(table(spark, sf_dir, "tasks"), moves).select("id", "status")


@query("j11_unqueued", oracle("SELECT file_id, file_type FROM files WHERE file_id NOT IN (SELECT payload ->> '$.file_id' FROM tasks WHERE task_type = 'ocr')", "files", "tasks"))
def j11_unqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.unqueued(table(spark, sf_dir, "files"), table(spark, sf_dir, "tasks"), "ocr").select("file_id", "file_type")


@query("j12_videos_without_frames", oracle("SELECT file_id FROM files WHERE file_type = 'video' AND file_id NOT IN (SELECT derived_from FROM files WHERE derivation_method = 'frames' AND derived_from IS NOT NULL)", "files"))
def j12_videos_without_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    frames = f.where("derivation_method = 'frames'").select(F.col("derived_from").alias("file_id"))
    return state.without(f.where("file_type = 'video'"), frames, ["file_id"]).select("file_id")


@query("j10_unclassified", oracle("SELECT count(*) AS n FROM files WHERE file_id NOT IN (SELECT file_id FROM analyses WHERE confidence > 0.5)", "files", "analyses"))
def j10_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.without(table(spark, sf_dir, "files"), table(spark, sf_dir, "analyses").where("confidence > 0.5"), ["file_id"]).agg(F.count("*").alias("n"))


@query("j13_never_archived", oracle("SELECT a.id FROM analyses a JOIN files f USING (file_id) WHERE f.derived_from IS NOT NULL AND a.id NOT IN (SELECT id FROM analyses WHERE superseded_by IS NOT NULL)", "files", "analyses"))
def j13_never_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "analyses")
    archived = a.where("superseded_by is not null")
    alive = table(spark, sf_dir, "files").where("derived_from is not null").select("file_id")
    return state.without(a, archived, ["id"]).join(alive, "file_id").select("id")


@query("j15_of_parent", oracle("SELECT a.id FROM analyses a WHERE a.file_id IN (SELECT file_id FROM files WHERE derived_from IN ('f_10', 'f_12', 'f_15', 'f_160'))", "files", "analyses"))
def j15_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = table(spark, sf_dir, "files").where(F.col("derived_from").isin("f_10", "f_12", "f_15", "f_160")).select("file_id")
    return table(spark, sf_dir, "analyses").join(kids, "file_id", "left_semi").select("id")


@query("j16_ocr_first", oracle("SELECT a.id, f.derivation_method FROM analyses a JOIN files f USING (file_id) WHERE f.derivation_method ILIKE 'ocr_first%'", "files", "analyses"))
def j16_ocr_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").where(F.col("derivation_method").ilike("ocr_first%")).select("file_id", "derivation_method")
    return table(spark, sf_dir, "analyses").join(f, "file_id").select("id", "derivation_method")


@query("j17_archive_diff", oracle(", o AS (SELECT file_id, max(confidence) AS c FROM analyses WHERE superseded_by IS NOT NULL GROUP BY 1), n AS (SELECT file_id, max(confidence) AS c FROM analyses WHERE superseded_by IS NULL GROUP BY 1) SELECT CASE WHEN n.file_id IS NULL THEN 'missing' WHEN n.c = o.c THEN 'same' ELSE 'different' END AS outcome, count(*) AS n FROM o LEFT JOIN n USING (file_id) GROUP BY 1", "analyses"))
def j17_archive_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "analyses")
    old = a.where("superseded_by is not null").groupBy("file_id").agg(F.max("confidence").alias("o"))
    new = a.where("superseded_by is null").groupBy("file_id").agg(F.max("confidence").alias("c"))
    both = old.join(new, "file_id", "left").withColumn("outcome", F.when(F.col("c").isNull(), "missing").when(F.col("c") == F.col("o"), "same").otherwise("different"))
    return state.outcomes(both)


@query("j18_parent_type", oracle("SELECT f.file_id, p.file_type AS parent_type FROM files f LEFT JOIN files p ON p.file_id = f.derived_from", "files"))
def j18_parent_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    parent = f.select(F.col("file_id").alias("derived_from"), F.col("file_type").alias("parent_type"))
    return f.join(parent, "derived_from", "left").select("file_id", "parent_type")


@query("j19_by_path", oracle("SELECT a.id, f.file_name FROM analyses a JOIN files f USING (file_id) WHERE f.file_name LIKE '%WA0001%'", "files", "analyses"))
def j19_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").where(F.col("file_name").contains("WA0001")).select("file_id", "file_name")
    return table(spark, sf_dir, "analyses").join(f, "file_id").select("id", "file_name")


@query(
    "j20_excerpts",
    oracle(
        """, x AS (SELECT id, obra, primary_event_ref AS ref, CASE WHEN id % 7 = 0 THEN NULL WHEN starts_with(primary_event_ref, 'fr_') THEN 'financial_record' ELSE 'classification' END AS source FROM edges),
        t AS (SELECT x.id, coalesce(CASE WHEN p.id IS NOT NULL THEN concat('R$ ', format('{:.2f}', p.cents / 100.0e0), ' · ', strftime(p.ts, '%Y-%m-%d'), CASE WHEN p.description <> '' THEN concat(' · ', p.description) ELSE '' END) ELSE h.text END, concat(x.ref, ' (', coalesce(x.source, '—'), ')')) AS s
              FROM x LEFT JOIN payments p ON x.source = 'financial_record' AND x.ref = concat('fr_', p.id) AND x.obra = p.obra LEFT JOIN happenings h ON x.source = 'classification' AND x.ref = concat('c_', h.id) AND x.obra = h.obra)
        SELECT id, CASE WHEN length(trim(s)) <= 60 THEN trim(s) ELSE concat(regexp_replace(substr(trim(s), 1, 57), ' [^ ]*$', ''), '…') END AS primary_excerpt FROM t""",
        "edges",
        "payments",
        "happenings",
    ),
)
def j20_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 60 characters, so that many are cut; the operator's own measure is 200."""
    source = F.when(F.col("id") % 7 == 0, None).when(F.startswith("primary_event_ref", F.lit("fr_")), "financial_record").otherwise("classification")
    e = table(spark, sf_dir, "edges").withColumn("primary_event_source", source)
    return correlations.excerpts(e, table(spark, sf_dir, "payments"), table(spark, sf_dir, "happenings"), most=60).select("id", "primary_excerpt")


@query("w4_superseded", oracle("SELECT id, file_id, CASE WHEN id < max(id) OVER (PARTITION BY file_id) THEN max(id) OVER (PARTITION BY file_id) END AS superseded_by FROM analyses", "analyses"))
def w4_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.superseded(table(spark, sf_dir, "analyses").drop("superseded_by")).select("id", "file_id", "superseded_by")


@query("p15_active", oracle("SELECT count(*) AS n FROM analyses WHERE superseded_by IS NULL", "analyses"))
def p15_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.active(table(spark, sf_dir, "analyses")).agg(F.count("*").alias("n"))


@query("a22_superseded_groups", oracle(", g AS (SELECT file_id, count(*) AS n FROM analyses GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS to_mark FROM g", "analyses"))
def a22_superseded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.superseded_groups(table(spark, sf_dir, "analyses"))


@query("p16_sentinels", oracle("SELECT id FROM analyses WHERE confidence <= 0.02 OR analysis_json ILIKE '%_sentinel%'", "analyses"))
def p16_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analyses").where((F.col("confidence") <= 0.02) | F.col("analysis_json").ilike("%_sentinel%")).select("id")


@query("k20_visual_text", oracle("SELECT id, CASE WHEN json_valid(analysis_json) THEN array_to_string(list_filter([analysis_json ->> '$.atividade_em_curso', analysis_json ->> '$.elementos_construtivos', analysis_json ->> '$.observacoes_tecnicas'], lambda x: x <> ''), ' | ') ELSE '' END AS body FROM analyses", "analyses"))
def k20_visual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoor.operators.hub import visual_text

    return table(spark, sf_dir, "analyses").select("id", visual_text("analysis_json").alias("body"))


@query("d8_invalidated", oracle("SELECT scope, count(prompt_template_hash) FILTER (WHERE NOT (scope = 'day' AND prompt_version = 'narrator_v2')) AS with_hash FROM narratives GROUP BY 1", "narratives"))
def d8_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.invalidated(table(spark, sf_dir, "narratives"), "prompt_template_hash", F.col("scope") == "day", F.col("prompt_version") == "narrator_v2")
    return out.groupBy("scope").agg(F.count("prompt_template_hash").alias("with_hash"))


_KEYS = ["obra", "scope", "scope_ref", "dossier_hash", "prompt_version"]


@query("d10_lookup", oracle("SELECT obra, scope, scope_ref, dossier_hash, prompt_version, max(id) AS id FROM narratives WHERE dossier_hash IN ('d1', 'd5', 'd8') GROUP BY ALL", "narratives"))
def d10_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "narratives")
    wanted = n.where(F.col("dossier_hash").isin("d1", "d5", "d8")).select(*_KEYS).distinct()
    return state.lookup(n.select("id", *_KEYS), wanted, _KEYS, "scope_ref")


@query("d15_batch_updates", oracle("SELECT t.id, coalesce(CASE WHEN e.value > 50 THEN 'completed' END, t.status) AS status FROM tasks t LEFT JOIN events e ON e.event_id = t.id", "tasks"))
def d15_batch_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, "completed").alias("status"))
    return state.batch_updates(table(spark, sf_dir, "tasks").select("id", "status"), u, "id", ["status"])


@query("s16_insert_new", oracle(", i AS (SELECT event_type, user_id, min(event_id) AS event_id FROM events WHERE event_id % 10 <> 0 GROUP BY ALL) SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 10 = 0 AND x.event_type = i.event_type AND x.user_id = i.user_id)", "files"))
def s16_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return records.insert_new(e.where("event_id % 10 = 0"), e.where("event_id % 10 <> 0"), ["event_type", "user_id"], "event_id")


@query("s18_upsert", oracle(" SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY ALL", "files"))
def s18_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return records.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type", "user_id"], "event_id")


# Dossiers.


@query("a6_statistics", oracle(" SELECT obra, 'source_type' AS dimension, source_type AS value, count(*) AS n FROM happenings GROUP BY ALL UNION ALL SELECT obra, 'category', coalesce(nullif(category, ''), '(sem_categoria)'), count(*) FROM happenings GROUP BY ALL", "happenings"))
def a6_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.statistics(table(spark, sf_dir, "happenings"))


_DAILY = ", c AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, coalesce(nullif(category, ''), '(sem_categoria)') AS topic, count(*) AS k FROM happenings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY obra, day ORDER BY k DESC, topic) AS p FROM c)"


@query("a7_daily", oracle(f"{_DAILY} SELECT obra, day, CAST(sum(k) AS BIGINT) AS n, array_to_string(list(topic ORDER BY p) FILTER (WHERE p <= 3), ',') AS topics FROM r GROUP BY ALL", "happenings"))
def a7_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.daily(table(spark, sf_dir, "happenings")).withColumn("topics", F.array_join("topics", ","))


@query("w3_top_topics", oracle(f"{_DAILY} SELECT obra, day, topic, p AS place FROM r WHERE p <= 3", "happenings"))
def w3_top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.daily(table(spark, sf_dir, "happenings")).select("obra", "day", F.posexplode("topics").alias("p", "topic")).select("obra", "day", "topic", (F.col("p") + 1).cast("long").alias("place"))


@query(
    "t4_overview_sample",
    oracle(", d AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, count(*) AS k FROM happenings GROUP BY ALL), p AS (SELECT obra, day, row_number() OVER (PARTITION BY obra ORDER BY k DESC, day) AS place FROM d), u AS (SELECT obra, id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY obra ORDER BY ts, id) AS up, count(*) OVER (PARTITION BY obra) AS total FROM happenings) SELECT obra, id FROM u JOIN p USING (obra, day) WHERE total <= 50 OR place <= 5 OR up <= 30 OR up > total - 20", "happenings"),
)
def t4_overview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.overview_sample(table(spark, sf_dir, "happenings")).select("obra", "id")


@query(
    "a9_hints",
    oracle(
        ", p AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, bool_or(" + " OR ".join(f"contains(lower(description), '{w}')" for w in dossier.CONTRACT_WORDS) + ") AS c FROM payments GROUP BY ALL), s AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in dossier.RENEGOTIATION_WORDS) + ") AS r FROM happenings GROUP BY ALL) SELECT obra, day, p.c IS NOT NULL AS has_payment, coalesce(c, false) AS has_contract, coalesce(n > 10 AND r, false) AS mentions_renegotiation FROM s FULL JOIN p USING (obra, day)",
        "payments",
        "happenings",
    ),
)
def a9_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.hints(table(spark, sf_dir, "happenings"), table(spark, sf_dir, "payments"))


@query("a10_labels", oracle(", e AS (SELECT obra, unnest([source_type, category, 'obra']) AS label, unnest([0, 1, 2]) AS p FROM happenings) SELECT obra, label, count(*) FILTER (WHERE p = 0) AS \"primary\", count(*) AS total, count(*) - count(*) FILTER (WHERE p = 0) AS delta FROM e GROUP BY ALL", "happenings"))
def a10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.labels(table(spark, sf_dir, "happenings").withColumn("labels", F.array("source_type", "category", F.lit("obra"))))


_BRL = "concat('R$ ', replace(replace(replace(format('{:,.2f}', cents / 100.0e0), ',', '#'), '.', ','), '#', '.'))"


@query("a11_ledger", oracle(f", l AS (SELECT obra, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM payments GROUP BY ALL) SELECT *, {_BRL} AS shown FROM l", "payments"))
def a11_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.ledger(table(spark, sf_dir, "payments"))


_CHRONOLOGY = f""", p AS (SELECT obra, ts, id, 'pagamento' AS kind, CASE WHEN id % 3 = 0 THEN 'Pagador' ELSE concat('p', id % 50) END AS author, concat({_BRL}, ' → ', CASE WHEN id % 4 = 0 THEN 'Recebedor' ELSE concat('r', id % 40) END, CASE WHEN description <> '' THEN concat('. ', description) ELSE '' END) AS content, 0 AS tier, 0 AS a, 0.0e0 AS b, epoch_us(ts) AS c FROM payments),
        w AS (SELECT *, trim(concat(text, CASE WHEN id % 5 = 0 THEN repeat(' e mais palavras', 20) ELSE '' END)) AS said FROM happenings),
        s AS (SELECT obra, ts, id, 'mensagem' AS kind, concat('s', id % 30) AS author, CASE WHEN length(said) <= 300 THEN said ELSE concat(regexp_replace(substr(said, 1, 297), ' [^ ]*$', ''), '…') END AS content, 1 AS tier, -CAST(id % 2 AS INT) AS a, -((id * 7 % 100) / 100.0e0) AS b, 0 AS c FROM w WHERE category <> 'pagamento' AND length(said) >= 20),
        u AS (SELECT *, row_number() OVER (PARTITION BY obra ORDER BY tier, a, b, c, id) AS place FROM (SELECT * FROM p UNION ALL SELECT * FROM s)) SELECT obra, strftime(ts, '%d/%m/%Y') AS date, strftime(ts, '%H:%M') AS time, kind, author, content, place FROM u WHERE place <= {{most}}"""


def _chronology(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    i = F.col("id")
    said = F.concat("text", F.when(i % 5 == 0, F.repeat(F.lit(" e mais palavras"), 20)).otherwise(""))
    e = table(spark, sf_dir, "happenings").withColumns({"reviewed": (i % 2).cast("int"), "confidence": (i * 7 % 100) / 100.0, "sender": F.concat(F.lit("s"), i % 30), "text": said})
    p = table(spark, sf_dir, "payments").withColumns({"payer": F.when(i % 3 != 0, F.concat(F.lit("p"), i % 50)), "payee": F.when(i % 4 != 0, F.concat(F.lit("r"), i % 40)).otherwise("")})
    return dossier.chronology(e, p, most).withColumn("place", F.col("place").cast("long"))


@query("t5_chronology", oracle(_CHRONOLOGY.replace("{most}", "20"), "payments", "happenings"))
def t5_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all payments: the earliest take the room."""
    return _chronology(spark, sf_dir, 20)


@query("t5_chronology_whole", oracle(_CHRONOLOGY.replace("{most}", "1000"), "payments", "happenings"))
def t5_chronology_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more room than a small corpus has payments, which messages fill."""
    return _chronology(spark, sf_dir, 1000)


@query("a17_period", oracle(" SELECT obra, count(*) AS n, strftime(min(ts), '%d/%m/%Y') AS first, strftime(max(ts), '%d/%m/%Y') AS last, CAST(date_diff('day', min(ts), max(ts)) + 1 AS INT) AS days FROM happenings GROUP BY 1", "happenings"))
def a17_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.period(table(spark, sf_dir, "happenings"))


@query("a18_corpus_digest", oracle(" SELECT obra, substr(sha256(string_agg(CAST(id AS VARCHAR), '' ORDER BY CAST(id AS VARCHAR))), 1, 12) AS digest FROM happenings GROUP BY 1", "happenings"))
def a18_corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "happenings").groupBy("obra").agg(text.corpus_digest(F.col("id").cast("string")).alias("digest"))


# Narratives.


def _priority_sql(p: dict[str, int]) -> str:
    return "CASE prompt_version " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in p.items()) + " ELSE 0 END"


@query("w1_best", oracle(f", r AS (SELECT *, row_number() OVER (PARTITION BY obra, scope, scope_ref ORDER BY {_priority_sql(narratives.PRIORITY)} DESC, id DESC) AS k FROM narratives) SELECT id, obra, scope, scope_ref FROM r WHERE k = 1", "narratives"))
def w1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.best(table(spark, sf_dir, "narratives")).select("id", "obra", "scope", "scope_ref")


@query("a16_cache_stats", oracle(" SELECT obra, scope, count(*) AS total, count(prompt_template_hash) AS with_hash, count(*) - count(prompt_template_hash) AS legacy FROM narratives GROUP BY ALL", "narratives"))
def a16_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.cache_stats(table(spark, sf_dir, "narratives"))


@query("a25_scope_refs", oracle(" SELECT DISTINCT obra, scope_ref FROM narratives WHERE scope = 'day' AND scope_ref IS NOT NULL", "narratives"))
def a25_scope_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.scope_refs(table(spark, sf_dir, "narratives"))


_WEEKS = ", w AS (SELECT DISTINCT obra, concat(isoyear(day), '-W', lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0')) AS label, CAST(date_trunc('week', day) AS DATE) AS first, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS last FROM narratives)"


@query("f20_weeks", oracle(f"{_WEEKS} SELECT * FROM w", "narratives"))
def f20_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.buckets(table(spark, sf_dir, "narratives"), "week")


@query("f20_quarters", oracle(" SELECT DISTINCT obra, concat(year(day), '-Q', quarter(day)) AS label, CAST(date_trunc('quarter', day) AS DATE) AS first, CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS last FROM narratives", "narratives"))
def f20_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.buckets(table(spark, sf_dir, "narratives"), "quarter")


@query("f20_months", oracle(" SELECT DISTINCT obra, strftime(day, '%Y-%m') AS label, CAST(date_trunc('month', day) AS DATE) AS first, last_day(day) AS last FROM narratives", "narratives"))
def f20_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives.buckets(table(spark, sf_dir, "narratives"), "month")


@query("j23_children", oracle(f"{_WEEKS} SELECT w.obra, w.label, n.id FROM w JOIN narratives n ON n.obra = w.obra AND n.scope = 'day' AND n.scope_ref BETWEEN CAST(w.first AS VARCHAR) AND CAST(w.last AS VARCHAR)", "narratives"))
def j23_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "narratives")
    return narratives.children(n, narratives.buckets(n, "week"), "day").select("obra", "label", "id")


_CITED = "list_sort(list_distinct(regexp_extract_all(narrative_text, '\\b(?:m|f|c|fr)_[A-Za-z0-9]{4,12}\\b')))"


@query("f21_cited", oracle(f" SELECT id, array_to_string({_CITED}, ' ') AS cited FROM narratives", "narratives"))
def f21_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").select("id", F.array_join(text.cited("narrative_text"), " ").alias("cited"))


@query(
    "f22_composed",
    oracle(
        f"{_WEEKS}, k AS (SELECT w.obra, w.label, n.scope_ref, trim(n.narrative_text) AS t, {_CITED} AS ids FROM w JOIN narratives n ON n.obra = w.obra AND n.scope = 'day' AND n.scope_ref BETWEEN CAST(w.first AS VARCHAR) AND CAST(w.last AS VARCHAR)),"
        " g AS (SELECT obra, label, count(*) AS n, string_agg(concat(chr(10), '## ', scope_ref, chr(10), t, chr(10)), '' ORDER BY scope_ref, t) AS body, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM k GROUP BY ALL)"
        " SELECT obra, label, n, concat('# Período: ', label, ' (week)', chr(10), '# Narrativas filhas (', n, ' de day):', chr(10), body, CASE WHEN len(ids) = 0 THEN '' ELSE concat(chr(10), '# Evidências citadas (file_ids):', chr(10), array_to_string(list_transform(range(0, len(ids), 8), lambda i: array_to_string(ids[i + 1:i + 8], ', ')), chr(10)), chr(10)) END) AS input FROM g",
        "narratives",
    ),
)
def f22_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "narratives")
    return narratives.composed(narratives.children(n, narratives.buckets(n, "week"), "day"), "week")


@query(
    "checklist",
    oracle(
        ", b AS (SELECT id, CASE WHEN id % 2 = 0 THEN narrative_text ELSE concat(narrative_text, repeat(' talvez', 60)) END AS body, prompt_version FROM narratives), t AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE contains(body, concat('m_', 100000 + l_orderkey + l_linenumber - 1))) AS found FROM lineitem JOIN b ON b.id = l_orderkey GROUP BY 1) SELECT b.id, body LIKE '# Narrativa:%' AS opening, contains(body, '---') AS closing, length(body) BETWEEN 300 AND 40000 AS length, coalesce(n, 0) < 5 OR contains(lower(body), 'talvez') AS inference, coalesce(found >= CASE WHEN contains(prompt_version, 'adversarial') THEN 0.3e0 ELSE 0.5e0 END * n, true) AS file_ids, length(body) BETWEEN 300 AND 40000 AS passed FROM b LEFT JOIN t USING (id)",
        "narratives",
    ),
)
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "narratives")
    body = F.when(F.col("id") % 2 == 0, F.col("narrative_text")).otherwise(F.concat("narrative_text", F.repeat(F.lit(" talvez"), F.lit(60))))
    told = n.select("id", body.alias("body"), "prompt_version", F.lit(None).cast("string").alias("assessment"))
    timeline = raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("--:--").alias("hour"), F.concat(F.lit("m_"), F.lit(100000) + F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("file_id"))
    paid = spark.createDataFrame([], "id bigint, cents bigint, payer string, payee string")
    return narratives.checklist(told, paid, timeline).select("id", "opening", "closing", "length", "inference", "file_ids", "passed")


# Media and usage.


_SHOTS = "SELECT file_id, CASE n % 11 WHEN 0 THEN 31457280 WHEN 1 THEN 16777216 WHEN 2 THEN 4096 ELSE size_bytes END AS size, CASE n % 13 WHEN 0 THEN NULL WHEN 1 THEN 9000 WHEN 2 THEN 6000 WHEN 3 THEN 80 ELSE width END AS w, height AS h, CASE n % 7 WHEN 0 THEN NULL ELSE n % 50 END AS sharp FROM files"


def _verdicts(least: int, most: int, px: int, wide: int, sharp: int) -> dict[str, str]:
    return {
        "too_small": f"size < {least}",
        "too_large": f"size > {most}",
        "corrupted": "w IS NULL OR h IS NULL",
        "dimensions_too_small": f"w < {px} OR h < {px}",
        "dimensions_too_large": f"w > {wide} OR h > {wide}",
        "too_blurry": f"sharp < {sharp}",
    }


_STRICT_V, _MILD_V = _verdicts(5120, 15728640, 100, 5000, 30), _verdicts(3072, 26214400, 64, 8192, 10)
_HARD = ("too_small", "corrupted", "dimensions_too_small")
_CASES = lambda v, names: "CASE " + " ".join(f"WHEN {v[k]} THEN '{k}'" for k in names) + " END"
_SOFT = ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _MILD_V.items() if k not in _HARD)


@query("p18_verdict", oracle(f", s AS ({_SHOTS}) SELECT file_id, {_CASES(_STRICT_V, _STRICT_V)} AS strict, {_CASES(_MILD_V, _HARD)} AS mild, CASE WHEN {_CASES(_MILD_V, _HARD)} IS NULL THEN concat_ws(',', {_SOFT}) ELSE '' END AS warnings FROM s", "files"))
def p18_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of both forms, and what the mild one only warns of."""
    shots = spark.sql(_SHOTS.replace("FROM files", "FROM {files}"), files=table(spark, sf_dir, "files"))
    (_, strict, _), (_, mild, warned) = (media.verdict("size", "w", "h", F.col("sharp").cast("double"), strict=x) for x in (True, False))
    return shots.select("file_id", strict.alias("strict"), mild.alias("mild"), F.array_join(warned, ",").alias("warnings"))


@query("p19_route", oracle(" SELECT file_id, CASE WHEN width / greatest(height, 1)::DOUBLE BETWEEN 0.35 AND 0.75 AND width BETWEEN 200 AND 2400 AND height BETWEEN 200 AND 2400 AND n % 3 <> 1 THEN 'financial' WHEN n % 3 = 0 THEN 'document' ELSE 'vision' END AS target FROM files", "files"))
def p19_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = F.when(F.col("n") % 3 == 0, True).when(F.col("n") % 3 == 1, False)
    return table(spark, sf_dir, "files").select("file_id", media.route("width", "height", dense).alias("target"))


@query("p20_ocr_target", oracle(" SELECT file_id, CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'document' WHEN n % 5 = 1 THEN 'financial' WHEN n % 5 = 2 THEN 'document' WHEN n % 2 = 0 THEN 'skip' ELSE 'generic' END AS target FROM files", "files"))
def p20_ocr_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("n") % 5 == 1, "financial").when(F.col("n") % 5 == 2, "document")
    has = F.when(F.col("n") % 2 == 0, False)
    return table(spark, sf_dir, "files").select("file_id", media.ocr_target("file_name", "file_type", hint, has).alias("target"))


@query("s7_file_type", oracle(" SELECT CASE WHEN lower(file_name) LIKE '%.jpg' THEN 'image' WHEN lower(file_name) LIKE '%.mp4' THEN 'video' WHEN lower(file_name) LIKE '%.opus' THEN 'audio' ELSE 'document' END AS kind, count(*) AS n FROM files GROUP BY 1", "files"))
def s7_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").groupBy(chat.file_type("file_name").alias("kind")).agg(F.count("*").alias("n"))


@query("f15_from_filename", oracle(" SELECT file_id, coalesce(try_strptime(CASE WHEN regexp_matches(file_name, '^\\d{5,}-(AUDIO|PHOTO|VIDEO)-') THEN regexp_extract(file_name, '\\d{4}-\\d{2}-\\d{2}-\\d{2}-\\d{2}-\\d{2}') END, '%Y-%m-%d-%H-%M-%S'), try_strptime(CASE WHEN regexp_matches(file_name, '^(IMG|VID|PTT|AUD)-\\d{8}-WA') THEN regexp_extract(file_name, '\\d{8}') END, '%Y%m%d'), try_strptime(CASE WHEN regexp_matches(file_name, '^(IMG|VID)_\\d{8}_') THEN regexp_extract(file_name, '\\d{8}_\\d{6}') END, '%Y%m%d_%H%M%S')) AS stamp FROM files", "files"))
def f15_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("file_id", temporal.from_filename("file_name").alias("stamp"))


@query("a2_spent", oracle(" SELECT endpoint, count(*) AS calls, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM api_calls GROUP BY 1", "api_calls"))
def a2_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.spent(table(spark, sf_dir, "api_calls"), "endpoint").withColumn("cost_usd", F.round("cost_usd", 6))


@query("w7_latest_call", oracle(" SELECT endpoint, arg_max(latency_ms, id) AS latency_ms FROM api_calls GROUP BY 1", "api_calls"))
def w7_latest_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_calls").groupBy("endpoint").agg(F.max_by("latency_ms", "id").alias("latency_ms"))


@query("a14_durations", oracle(" SELECT endpoint, count(*) AS n, min(latency_ms) AS least, list_sort(list(latency_ms))[count(*) // 2 + 1] AS median, max(latency_ms) AS most FROM api_calls GROUP BY 1", "api_calls"))
def a14_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.durations(table(spark, sf_dir, "api_calls"), "endpoint", "latency_ms")


_LOG = ", g AS (SELECT CASE WHEN error_type IS NOT NULL THEN 'stage_failed' WHEN id % 3 = 0 THEN 'cost' ELSE 'stage_done' END AS event_type, endpoint AS api, endpoint AS stage, cost_usd, error_type FROM api_calls)"


@query("a13_log_counts", oracle(f"{_LOG}, u AS (SELECT 'event_type' AS dimension, event_type AS value, 0.0e0 AS c FROM g UNION ALL SELECT 'cost_api', api, coalesce(cost_usd, 0) FROM g WHERE event_type = 'cost' UNION ALL SELECT 'failed_stage', stage, 0 FROM g WHERE event_type = 'stage_failed' UNION ALL SELECT 'error_type', coalesce(error_type, 'unknown'), 0 FROM g WHERE event_type = 'stage_failed') SELECT dimension, value, count(*) AS n, round(sum(c), 6) AS cost FROM u GROUP BY ALL", "api_calls"))
def a13_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "api_calls")
    log = c.select(F.when(F.col("error_type").isNotNull(), "stage_failed").when(F.col("id") % 3 == 0, "cost").otherwise("stage_done").alias("event_type"), F.col("endpoint").alias("api"), F.col("endpoint").alias("stage"), "cost_usd", "error_type")
    return usage.log_counts(log).withColumn("cost", F.round("cost", 6))


@query("quota", oracle(" , s AS (SELECT *, coalesce(sum(coalesce(cost_usd, 0)) OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM api_calls) SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (WHERE b < 5) AS allowed FROM s GROUP BY 1".strip(), "api_calls"))
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.running_cost(table(spark, sf_dir, "api_calls"), 5.0).groupBy(F.to_date("created_at").alias("day")).agg(F.count_if("allowed").alias("allowed"))


@query("breaker")
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold; tests hold it against a plain loop."""
    return usage.breaker(table(spark, sf_dir, "api_calls"), failures=2)


@query("f29_errors", oracle(" SELECT CASE error_type WHEN 'RateLimitError' THEN 'rate_limit' WHEN 'BadRequestError' THEN 'bad_request' WHEN 'APITimeoutError' THEN 'timeout' END AS kind, error_type IN ('RateLimitError', 'APITimeoutError') AS retryable, count(*) AS n FROM api_calls GROUP BY ALL", "api_calls"))
def f29_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_calls").groupBy(usage.error_kind("error_type").alias("kind"), usage.retryable("error_type").alias("retryable")).agg(F.count("*").alias("n"))


@query("f28_costs", oracle(" SELECT id, round(tokens * 0.15e-6 + latency_ms * 0.60e-6, 9) AS tokens_usd, round(latency_ms / 60.0e0 * 0.006e0, 9) AS minutes_usd FROM api_calls", "api_calls"))
def f28_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_calls").select("id", F.round(usage.token_cost(F.lit("gpt-4o-mini"), "tokens", "latency_ms"), 9).alias("tokens_usd"), F.round(usage.minute_cost("latency_ms"), 9).alias("minutes_usd"))


@query("a23_preflight", oracle(" , c AS (SELECT count(*) FILTER (WHERE file_name LIKE '%.opus') AS audio, count(*) FILTER (WHERE lower(file_name) LIKE '%.jpg') AS image, count(*) FILTER (WHERE file_name LIKE '%.mp4') AS video, count(*) FILTER (WHERE file_name LIKE '%.pdf') AS document, count(*) AS members FROM files) SELECT *, round(audio * 0.75e0 * 0.006e0 + 7333 * 5e-5 + image * 0.005e0 + 146 * 0.07e0, 6) AS usd FROM c".strip(), "files"))
def a23_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "files").select(chat.file_type("file_name").alias("file_type"))
    return usage.preflight(c, 10**9, 7333, 10**12).select("audio", "image", "video", "document", "members", F.round("usd", 6).alias("usd"))


# Text, money and time functions; near duplicates; chat parsing.

_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[!?.,;:\"''()\\[\\]{}<>]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f1_cache_normalize", oracle(f" SELECT doc_id, sha256({_NORM}) AS d FROM documents", "files"))
def f1_cache_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cache_normalize("text"), 256).alias("d"))


@query("f2_cache_key", oracle(f" SELECT doc_id, substr(sha256(concat({_NORM}, '||v1')), 1, 16) AS k FROM documents", "files"))
def f2_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", text.cache_key("text", version="v1").alias("k"))


@query("f3_content_hash", oracle(" SELECT conv_id, turn, substr(sha256(concat(stamp, '||', coalesce(sender, ''), '||', content)), 1, 16) AS h FROM messages", "messages"))
def f3_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("conv_id", "turn", text.content_hash("stamp", "sender", "content").alias("h"))


_NEAR = "list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9áéíóúâêôãõàç]+'), lambda t: len(t) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in text.NEAR_STOPWORDS) + ")))"


@query("f6_jaccard", oracle(f", t AS (SELECT conv_id, turn, {_NEAR} AS a, lead({_NEAR}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM messages) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 9) AS similarity FROM t WHERE b IS NOT NULL", "messages"))
def f6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").withColumn("a", text.near_tokens("content"))
    m = m.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return m.select("conv_id", "turn", F.round(text.jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


_NEAR_DOC = _NEAR.replace("content", "text")


@query(
    "j21_near_pool",
    oracle(f", t AS (SELECT doc_id, lang, {_NEAR_DOC} AS a FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM t WHERE len(a) > 0), p AS (SELECT x.lang, x.doc_id AS later, y.doc_id AS earlier, y.r, len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a)))::DOUBLE AS s FROM n x JOIN n y ON x.lang = y.lang AND y.r < x.r AND y.r >= x.r - 500 AND len(y.a) BETWEEN 0.79 * len(x.a) AND len(x.a) / 0.79), b AS (SELECT *, row_number() OVER (PARTITION BY lang, later ORDER BY s DESC, r DESC) AS k FROM p WHERE s >= 0.8) SELECT lang, later, earlier, round(s, 9) AS similarity FROM b WHERE k = 1", "files"),
)
def j21_near_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_pool(raw(spark, sf_dir, "documents"), "lang", "doc_id", "text").withColumn("similarity", F.round("similarity", 9))


_PHASH = "substr(md5(CAST(p_size AS VARCHAR)), 1, 15) || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1)"


@query("j22_near_hashes", oracle(f", h AS (SELECT p_partkey AS id, {_PHASH} AS h FROM part) SELECT a.id AS a_id, b.id AS b_id, CAST(bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) <= 6", "files"))
def j22_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("string"))
    h = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(md5("p_size"), 1, 15), F.substring(md5("p_partkey"), 1, 1)).alias("h"))
    return joins.near_hashes(h, h, "id", "id", "h", "h").where("a_id < b_id").select("a_id", "b_id", "distance")


@query("j22_near_hash_classes", oracle(f", h AS (SELECT p_partkey AS id, {_PHASH} AS h FROM part), c AS (SELECT h, min(id) AS id FROM h GROUP BY 1) SELECT c.id AS a_id, h.id AS b_id, 0 AS distance FROM h JOIN c USING (h) WHERE h.id <> c.id UNION ALL SELECT a.id, b.id, CAST(bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) AS INT) FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) <= 6", "files"))
def j22_near_hash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all of part: equal hashes as classes, near ones as pairs of classes."""
    md5 = lambda c: F.md5(F.col(c).cast("string"))
    h = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(md5("p_size"), 1, 15), F.substring(md5("p_partkey"), 1, 1)).alias("h"))
    return joins.near_hash_classes(h, "id", "h")


_FIRST = f", h AS (SELECT p_partkey AS id, p_partkey % 3 AS obra, ('0x' || {_PHASH})::UBIGINT AS h FROM part)"


@query("j22_first_match", oracle(f"{_FIRST}, m AS (SELECT a.obra, a.id, min((b.id, CAST(bit_count(xor(a.h, b.h)) AS INT))) AS m FROM h a JOIN h b ON a.obra = b.obra AND a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 6 GROUP BY ALL) SELECT obra, id, m[1] AS match, m[2] AS distance FROM m", "files"))
def j22_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's first near one of its corpus, other than itself."""
    h = _hashes(spark, sf_dir)
    return joins.first_near(h, h, "id", "h", "id", ["obra"])


@query("j22_first_earlier", oracle(f"{_FIRST}, m AS (SELECT a.obra, a.id, min((b.id, CAST(bit_count(xor(a.h, b.h)) AS INT))) AS m FROM h a JOIN h b ON a.obra = b.obra AND b.id < a.id AND bit_count(xor(a.h, b.h)) <= 6 GROUP BY ALL) SELECT obra, id, m[1] AS match, m[2] AS distance FROM m", "files"))
def j22_first_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As images come in: the first near one among those before."""
    h = _hashes(spark, sf_dir)
    return joins.first_near(h, h, "id", "h", "id", ["obra"], earlier_only=True)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("string"))
    hashed = F.concat(F.substring(md5("p_size"), 1, 15), F.substring(md5("p_partkey"), 1, 1))
    return raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("obra"), hashed.alias("h"))


@query("f7_hamming", oracle(f", h AS (SELECT p_partkey AS id, {_PHASH} AS h FROM part) SELECT id, CAST(bit_count(xor(('0x' || h)::UBIGINT, 81985529216486895::UBIGINT)) AS INT) AS distance FROM h", "files"))
def f7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("string"))
    h = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(md5("p_size"), 1, 15), F.substring(md5("p_partkey"), 1, 1)).alias("h"))
    return h.select("id", text.hamming_hex("h", F.lit("0123456789abcdef")).alias("distance"))


@query("f10_currency", oracle(" SELECT id, CAST(cents AS BIGINT) AS cents FROM payments", "payments"))
def f10_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading back what F12 writes."""
    return table(spark, sf_dir, "payments").select("id", money.currency_to_cents(money.brl("cents", "R$ ")).alias("cents"))


@query("f12_brl", oracle(f" SELECT id, {_BRL} AS shown FROM payments", "payments"))
def f12_brl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "payments").select("id", money.brl("cents", "R$ ").alias("shown"))


@query(
    "f16_resolve",
    oracle(" , s AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ts END AS a, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) END AS b, CASE WHEN event_id % 5 < 3 THEN ts + INTERVAL 5 HOUR END AS c, ts - INTERVAL 1 MINUTE AS d FROM events), n AS (SELECT *, coalesce(abs(date_diff('day', CAST(a AS DATE), CAST(b AS DATE))) * 86400 > 7200, false) OR coalesce(abs(epoch(a) - epoch(c)) > 7200, false) OR coalesce(abs(date_diff('day', CAST(b AS DATE), CAST(c AS DATE))) * 86400 > 7200, false) OR coalesce(abs(epoch(c) - epoch(d)) > 7200, false) OR coalesce(abs(date_diff('day', CAST(b AS DATE), CAST(d AS DATE))) * 86400 > 7200, false) AS conflict FROM s) SELECT id, coalesce(a, b, c, d) AS resolved, CASE WHEN a IS NOT NULL THEN 'whatsapp_txt' WHEN b IS NOT NULL THEN 'filename' WHEN c IS NOT NULL THEN 'metadata' ELSE 'filesystem' END AS source, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN c IS NOT NULL THEN 'medium' ELSE 'low' END WHEN conflict THEN 'medium' WHEN a IS NOT NULL THEN 'max' ELSE 'high' END AS confidence, conflict FROM n".strip(), "files"),
)
def f16_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ts = raw(spark, sf_dir, "events"), F.col("ts")
    s = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, ts).alias("a"), F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", ts).cast("timestamp_ntz")).alias("b"), F.when(F.col("event_id") % 5 < 3, ts + F.expr("interval 5 hours")).alias("c"), (ts - F.expr("interval 1 minute")).alias("d"))
    r = temporal.resolve("a", "b", "c", "d")
    return s.select("id", *(r[k].alias(k) for k in ("resolved", "source", "confidence", "conflict")))


_LINES = "SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS line, turn, sender, stamp, CASE WHEN turn % 4 = 3 THEN 'segue a linha' ELSE concat(stamp, ' - ', CASE WHEN sender IS NULL THEN '' ELSE concat(sender, ': ') END, CASE turn % 5 WHEN 0 THEN '<Figurinha omitida>' WHEN 1 THEN '<anexado: foto um.jpg>' WHEN 2 THEN 'Ligação de voz' ELSE 'bom dia <Esta mensagem foi editada>' END) END AS value FROM messages"


@query(
    "p5_parse",
    oracle(
        f", l AS ({_LINES}), g AS (SELECT *, sum(CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) AS m FROM l), c AS (SELECT file, m, min(line) AS line_number, count(*) AS n, arg_min(turn, line) AS turn, arg_min_null(sender, line) AS sender, arg_min(stamp, line) AS stamp, string_agg(CASE WHEN turn % 4 = 3 THEN value ELSE regexp_replace(substr(value, length(stamp) + 4), '^[^:]+:\\s*', '') END, chr(10) ORDER BY line) AS said FROM g WHERE m > 0 GROUP BY ALL)"
        " SELECT file, line_number, stamp AS timestamp_raw, strptime(stamp, '%d/%m/%Y %H:%M') AS timestamp, CASE WHEN turn % 5 = 2 THEN NULL WHEN turn % 5 = 1 THEN coalesce(sender, '<anexado') ELSE sender END AS sender,"
        " CASE WHEN turn % 5 = 2 OR sender IS NULL AND turn % 5 <> 1 THEN 'system' WHEN sender IS NULL THEN 'text' WHEN turn % 5 = 0 AND n = 1 THEN 'sticker' WHEN turn % 5 = 1 AND n = 1 THEN 'media_ref' ELSE 'text' END AS message_type,"
        " CASE WHEN sender IS NOT NULL AND turn % 5 = 1 AND n = 1 THEN 'foto um.jpg' END AS media_filename, turn % 5 > 2 AND n = 1 AS edited,"
        " CASE WHEN turn % 5 > 2 AND n = 1 THEN rtrim(replace(said, '<Esta mensagem foi editada>', '')) ELSE said END AS content FROM c",
        "messages",
    ),
)
def p5_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("FROM messages", "FROM {m}"), m=table(spark, sf_dir, "messages"))
    return chat.parse(lines).select("file", "line_number", "timestamp_raw", "timestamp", "sender", "message_type", "media_filename", "edited", "content")


@query("p6_ids", oracle(" SELECT conv_id, turn, concat('m_', substr(sha256(content), 1, 12)) AS synthetic, concat('f_', substr(sha256(content), 1, 12)) AS file_id FROM messages", "messages"))
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("conv_id", "turn", chat.message_file_id("content").alias("synthetic"), chat.file_id(F.sha2("content", 256)).alias("file_id"))


@query("p7_media_map", oracle(" SELECT obra, concat(role, '.jpg') AS media_filename, arg_min(concat(conv_id, '-', turn), conv_id * 1000 + turn) AS message_id, arg_max(stamp, conv_id * 1000 + turn) AS timestamp FROM messages GROUP BY ALL", "messages"))
def p7_media_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").select("obra", F.concat("role", F.lit(".jpg")).alias("media_filename"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("stamp").alias("timestamp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_number"))
    return chat.media_map(m, "obra")


@query("d5_ingest", oracle(" SELECT obra, count(*) AS candidates, count(*) FILTER (WHERE turn % 7 <> 0 AND trim(content) <> '') AS inserted, count(*) FILTER (WHERE turn % 7 = 0 AND trim(content) <> '') AS skipped_existing, count(*) FILTER (WHERE trim(content) = '') AS skipped_empty FROM messages WHERE turn % 5 <> 1 GROUP BY 1", "messages"))
def d5_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").withColumns({"message_id": F.concat_ws("-", "conv_id", "turn"), "is_deleted": F.lit(False), "media_ref": F.when(F.col("turn") % 5 == 1, "foto.jpg")})
    return chat.ingest(m, m.where("turn % 7 = 0").select("obra", F.col("message_id").alias("source_message_id")))[1]


@query("f24_stripped", oracle(" SELECT id, sha256(trim(regexp_replace(concat(narrative_text, chr(10), 'corpo'), '^#\\s+Narrativa:[^\\n]*\\n+', ''))) AS d FROM narratives", "narratives"))
def f24_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").select("id", F.sha2(narratives.stripped(F.concat("narrative_text", F.lit('\ncorpo\n```json\n{"confidence": 1}\n```'))), 256).alias("d"))


@query("f27_frame_times", oracle(" SELECT p_partkey, list_transform([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0], lambda x: round(greatest(0.5, least(p_size * x, p_size - 0.5)), 6)) AS at FROM part", "files"))
def f27_frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select("p_partkey", F.transform(temporal.frame_times(F.col("p_size").cast("double")), lambda x: F.round(x, 6)).alias("at"))


_CUT = len(text.TRUNCATED)


@query(
    "f8_truncate",
    oracle(
        f""", h AS (SELECT doc_id, text, substr(text, 1, {400 - _CUT}) AS head FROM documents),
        c AS (SELECT *, regexp_extract(head, '(?s)^(.+)\\n\\n', 1) AS paragraph, regexp_extract(head, '(?s)^(.*[.!?])(?:\\s|\\z)', 1) AS sentence, regexp_extract(head, '(?s)^(.+) ', 1) AS word FROM h)
        SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE concat(CASE WHEN paragraph <> '' THEN paragraph WHEN sentence <> '' THEN sentence WHEN word <> '' THEN word ELSE head END, chr(10), chr(10), '[truncado por limite]') END AS cut FROM c""",
        "files",
    ),
)
def f8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", text.smart_truncate("text", 400).alias("cut"))


@query("f4_prompt_hash", oracle(" SELECT id, CASE WHEN coalesce(prompt_template_hash, '') = '' THEN '' ELSE sha256(prompt_template_hash) END AS h FROM narratives", "narratives"))
def f4_prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").select("id", text.prompt_hash("prompt_template_hash").alias("h"))


# Unicode's decomposition leaves ß a letter of its own, which parts words here; DuckDB would spell it out.
@query("k4_documents", oracle(f" SELECT doc_id, array_to_string(list_sort({tokens_sql("replace(text, 'ß', '§')")}), ' ') AS tokens FROM documents", "files"))
def k4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.scope_tokens("text")), " ").alias("tokens"))


_PLAIN = "trim(translate(text, concat(chr(10), chr(9), chr(13), '#'), '    '))"
_OVERVIEW = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('# Narrativa: x', chr(10), chr(10), '## Sumário Executivo', chr(10), trim(substr({_PLAIN}, 1, 1000)), chr(10), chr(10), '## fim') ELSE concat('# Narrativa: x', chr(10), chr(10), 'curto', chr(10), chr(10), {_PLAIN}) END AS body, CASE WHEN doc_id % 2 = 0 THEN trim(substr({_PLAIN}, 1, 1000)) ELSE {_PLAIN} END AS para FROM documents"
_SHORT = "CASE WHEN length({c}) <= 800 THEN {c} ELSE concat(regexp_replace(substr({c}, 1, 797), ' [^ ]*$', ''), '…') END"


@query(
    "f24_summary",
    oracle(
        f", o AS ({_OVERVIEW}), p AS (SELECT *, concat('## Sumário Executivo', chr(10), para) AS headed FROM o) SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(para) >= 79 THEN {_SHORT.format(c='para')} WHEN doc_id % 2 = 0 AND length(headed) > 80 THEN headed WHEN doc_id % 2 = 0 THEN concat(headed, chr(10), chr(10), '## fim') WHEN length(para) > 80 THEN {_SHORT.format(c='para')} ELSE trim(concat('curto', chr(10), chr(10), para), concat(' ', chr(10))) END AS summary FROM p",
        "files",
    ),
)
def f24_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph under the summary's heading where it is long enough, else the first substantial one, else the start."""
    made = spark.sql(_OVERVIEW.replace("FROM documents", "FROM {d}"), d=raw(spark, sf_dir, "documents"))
    return made.select("doc_id", narratives.summary("body").alias("summary"))
