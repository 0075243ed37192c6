"""Queries: the hub, contracts, reviews, derivations, samples and the remaining functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions import money, temporal, text
from spoor.operators import contracts, hub, media, narratives, state, usage
from spoor.plans.registry import query
from spoor.plans.standins import TABLES, oracle, raw, table
from spoor.sources import chat, records

TABLES.update(
    {
        "hub_classifications": """SELECT concat('obra_', CAST(user_id % 3 AS STRING)) AS obra, event_id AS id, concat('f_', CAST(user_id AS STRING)) AS source_file_id,
            CASE event_id % 4 WHEN 0 THEN 'TEXT_MESSAGE' WHEN 1 THEN 'visual_analysis' WHEN 2 THEN 'document' ELSE NULL END AS source_type, concat('m_', CAST(event_id % 50 AS STRING)) AS source_message_id,
            CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS reasoning, CASE WHEN event_id % 5 = 0 THEN 'corrigido' ELSE '' END AS human_corrected_text,
            CASE event_id % 3 WHEN 0 THEN 'quebrado' WHEN 1 THEN '["pagamento","material"]' ELSE '[]' END AS categories, CASE WHEN event_id % 6 = 0 THEN 'pending_review' ELSE 'classified' END AS semantic_status FROM events""",
        "hub_files": """SELECT concat('f_', CAST(c_custkey AS STRING)) AS file_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '2026-04-06T11:13:00-03:00' END AS timestamp_resolved,
            concat('f_', CAST(c_custkey + 1 AS STRING)) AS derived_from, concat('m_', CAST(c_custkey % 50 AS STRING)) AS referenced_by_message FROM customer""",
        "hub_messages": """SELECT concat('m_', CAST(p_partkey AS STRING)) AS message_id, p_name AS content, '2026-04-05T09:00:00' AS timestamp_whatsapp FROM part""",
        "hub_spoken": """SELECT concat('obra_', CAST(c_custkey % 3 AS STRING)) AS obra, concat('f_', CAST(c_custkey AS STRING)) AS file_id, c_name AS text FROM customer""",
        "hub_seen": """SELECT concat('obra_', CAST(c_custkey % 3 AS STRING)) AS obra, concat('f_', CAST(c_custkey AS STRING)) AS file_id, concat('{"atividade_em_curso": "', c_mktsegment, '", "materiais_visiveis": ""}') AS analysis_json FROM customer""",
        "replies": """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '{"categories": ["material"], "confidence": 0.8, "reasoning": "x"}' WHEN 1 THEN '{"categories": [], "confidence": 0.8}' WHEN 2 THEN '{"categories": ["banana"], "confidence": 0.8}'
            WHEN 3 THEN '{"categories": ["material", "pagamento"], "confidence": 1.5}' WHEN 4 THEN 'nada' ELSE '{"categories": ["material"], "confidence": "alta"}' END AS body FROM events""",
    }
)

_HUB = ", c AS (SELECT *, lower(coalesce(source_type, 'transcription')) AS st FROM hub_classifications WHERE semantic_status = 'classified'), j AS (SELECT c.*, o.timestamp_resolved AS ts_own, p.timestamp_resolved AS ts_parent, mp.timestamp_whatsapp AS ts_msg, md.content AS direct, md.timestamp_whatsapp AS ts_direct, s.text AS spoken, v.analysis_json FROM c LEFT JOIN hub_files o ON o.file_id = c.source_file_id LEFT JOIN hub_files p ON p.file_id = o.derived_from LEFT JOIN hub_messages mp ON mp.message_id = p.referenced_by_message LEFT JOIN hub_messages md ON md.message_id = c.source_message_id LEFT JOIN hub_spoken s ON s.obra = c.obra AND s.file_id = c.source_file_id LEFT JOIN hub_seen v ON v.obra = c.obra AND v.file_id = c.source_file_id), b AS (SELECT *, CASE st WHEN 'text_message' THEN coalesce(direct, '') WHEN 'visual_analysis' THEN coalesce(analysis_json ->> '$.atividade_em_curso', '') WHEN 'document' THEN coalesce(spoken, '') ELSE coalesce(nullif(human_corrected_text, ''), spoken, '') END AS body, CASE st WHEN 'text_message' THEN ts_direct WHEN 'visual_analysis' THEN ts_parent WHEN 'document' THEN ts_parent ELSE coalesce(ts_parent, ts_own, ts_msg) END AS stamp FROM j) SELECT obra, id, st AS source_type, CAST(substr(stamp, 1, 19) AS TIMESTAMP) AS ts, array_to_string(list_filter([coalesce(reasoning, ''), body, CASE WHEN id % 3 = 1 THEN 'pagamento material' ELSE '' END], lambda x: x <> ''), concat(' ', chr(10), ' ')) AS text FROM b"


@query("j1_hub", oracle(_HUB, "hub_classifications", "hub_files", "hub_messages", "hub_spoken", "hub_seen"))
def j1_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, files, messages, spoken, seen = (table(spark, sf_dir, f"hub_{n}") for n in ("classifications", "files", "messages", "spoken", "seen"))
    return hub.events(c, spoken, files, messages, seen, spoken).select("obra", "id", "source_type", "ts", "text")


_HUB_TABLES = ("hub_classifications", "hub_files", "hub_messages", "hub_spoken", "hub_seen")
_STAMP = "CASE st WHEN 'text_message' THEN ts_direct WHEN 'visual_analysis' THEN ts_parent WHEN 'document' THEN ts_parent ELSE coalesce(ts_parent, ts_own, ts_msg) END"
_HUB_JOINED = _HUB.split(", b AS (SELECT")[0].replace("v.analysis_json FROM c", "v.analysis_json, p.derived_from AS parent_from FROM c")


def _hub_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    c, files, messages, spoken, seen = (table(spark, sf_dir, n) for n in _HUB_TABLES)
    return c, spoken, files, messages, seen, spoken


@query(
    "j2_dossier_events",
    oracle(
        _HUB_JOINED
        + f""", b AS (SELECT *, CASE st WHEN 'text_message' THEN coalesce(direct, '') WHEN 'visual_analysis' THEN coalesce('atividade_em_curso: ' || nullif(analysis_json ->> '$.atividade_em_curso', ''), '(sem conteudo)') WHEN 'document' THEN coalesce(nullif(spoken, ''), '(sem texto extraido)') ELSE coalesce(nullif(human_corrected_text, ''), spoken, '') END AS body FROM j)
        SELECT obra, id, {_STAMP} AS stamp, st AS source_type, CASE WHEN id % 3 = 1 THEN 'pagamento' ELSE '' END AS primary_category, CASE WHEN id % 3 = 1 THEN 'material' ELSE '' END AS secondary, substr(body, 1, 150) AS content_preview, CASE WHEN length(body) <= 500 THEN body END AS content_full FROM b""",
        *_HUB_TABLES,
    ),
)
def j2_dossier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hub.dossier_events(*_hub_tables(spark, sf_dir))
    return e.select("obra", "id", "stamp", "source_type", "primary_category", F.array_join("secondary_categories", " ").alias("secondary"), "content_preview", "content_full")


@query(
    "j3_report_events",
    oracle(
        _HUB_JOINED
        + f""", b AS (SELECT *, nullif(human_corrected_text, '') AS fixed, {_STAMP} AS stamp FROM j)
        SELECT obra, id, stamp, substr(stamp, 1, 10) AS day, CASE st WHEN 'text_message' THEN 'texto' WHEN 'visual_analysis' THEN CASE WHEN parent_from <> '' THEN 'video-frame' ELSE 'imagem' END WHEN 'document' THEN 'pdf' ELSE 'audio' END AS source_kind,
        CASE st WHEN 'text_message' THEN coalesce(fixed, nullif(direct, ''), '(mensagem vazia)') WHEN 'visual_analysis' THEN coalesce(fixed, analysis_json ->> '$.atividade_em_curso', '') WHEN 'document' THEN coalesce(fixed, nullif(spoken, ''), '(planta/doc com ? paginas, texto digital ausente)') ELSE coalesce(fixed, nullif(spoken, ''), '(texto ausente)') END AS text FROM b""",
        *_HUB_TABLES,
    ),
)
def j3_report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub.report_events(*_hub_tables(spark, sf_dir))


@query(
    "j4_chronology_events",
    oracle(
        _HUB_JOINED
        + """ SELECT obra, id, CAST(substr(coalesce(ts_direct, ts_parent, ts_own, ts_msg), 1, 19) AS TIMESTAMP) AS ts, coalesce(nullif(human_corrected_text, ''), nullif(spoken, ''), nullif(direct, ''), reasoning, '') AS text, CASE WHEN id % 3 = 1 THEN 'pagamento' ELSE '' END AS category, CASE WHEN id % 3 = 1 THEN 'pagamento material' ELSE '' END AS tags, CAST(id % 2 AS INT) AS reviewed, CASE WHEN id % 7 = 0 THEN 0 ELSE 0.5e0 END AS confidence, CASE WHEN direct IS NOT NULL THEN 'Ana' END AS sender FROM j""",
        *_HUB_TABLES,
    ),
)
def j4_chronology_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, spoken, files, messages, _, _ = _hub_tables(spark, sf_dir)
    c = c.withColumns({"human_reviewed": (F.col("id") % 2).cast("int"), "confidence_model": F.when(F.col("id") % 7 != 0, 0.5)})
    e = hub.chronology_events(c, spoken, files, messages.withColumn("sender", F.lit("Ana")))
    return e.withColumn("tags", F.array_join("tags", " "))


@query("t9_text_order", oracle(" SELECT conv_id, turn, row_number() OVER (PARTITION BY obra ORDER BY CASE WHEN turn % 5 = 0 THEN '' ELSE stamp END, conv_id * 1000 + turn) AS place FROM messages", "messages"))
def t9_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times sort as they are written, day before month."""
    m = table(spark, sf_dir, "messages").withColumns({"id": F.col("conv_id") * 1000 + F.col("turn"), "stamp": F.when(F.col("turn") % 5 != 0, F.col("stamp"))})
    return m.select("conv_id", "turn", F.row_number().over(Window.partitionBy("obra").orderBy(*hub.by_time_text())).cast("long").alias("place"))


@query("f5_dossier_hash", oracle(""" SELECT id, sha256(concat('{"dossier_hash": "', dossier_hash, '", "id": ', id, ', "obra": "', obra, '", "scope_ref": ', coalesce('"' || scope_ref || '"', 'null'), '}')) AS h FROM narratives""", "narratives"))
def f5_dossier_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").select("id", F.sha2(records.sorted_json(["obra", "scope_ref", "id", "dossier_hash"]), 256).alias("h"))


@query("d11_backfilled", oracle(" SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'old' ELSE substr(sha256(concat(stamp, '||', coalesce(sender, ''), '||', content)), 1, 16) END AS content_hash FROM messages", "messages"))
def d11_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").withColumn("content_hash", F.when(F.col("turn") % 2 == 0, "old").when(F.col("turn") % 3 == 0, ""))
    return records.backfilled(m, "content_hash", text.content_hash("stamp", "sender", "content")).select("conv_id", "turn", "content_hash")


@query("d17_conformed", oracle(" SELECT id, obra, CAST(priority AS BIGINT) AS priority, CAST(NULL AS VARCHAR) AS result_ref FROM tasks", "tasks"))
def d17_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "id bigint, obra string, priority bigint, result_ref string"
    return records.conformed(records.conformed(table(spark, sf_dir, "tasks"), schema), schema)


@query("s24_log_lines", oracle(""" SELECT id, concat('{"event_type":"cost","api":"', endpoint, '"', CASE WHEN error_type IS NULL THEN '' ELSE concat(',"error_type":"', error_type, '"') END, '}') AS value FROM api_calls""", "api_calls"))
def s24_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "api_calls")
    lines = records.log_records(c, "cost", api=F.col("endpoint"), error_type=F.col("error_type"), stage=F.col("id").cast("string"))
    return lines.select(F.get_json_object("value", "$.stage").cast("long").alias("id"), F.regexp_replace("value", '"stage":"[0-9]+",', "").alias("value"))


@query(
    "token_bucket",
    oracle(
        """, a AS (SELECT endpoint, id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY endpoint ORDER BY created_at, id) - 1 AS k FROM api_calls),
        w AS (SELECT *, max(t - k * 20000000.0e0) OVER (PARTITION BY endpoint ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slack FROM a)
        SELECT endpoint, id, round(coalesce(greatest(t, slack + (k - 2) * 20000000.0e0), t) - t, 0) AS waited FROM w""",
        "api_calls",
    ),
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three a minute, so that calls of the densest minutes wait."""
    return usage.token_bucket(table(spark, sf_dir, "api_calls"), per_minute=3).select("endpoint", "id", F.round("waited", 0).alias("waited"))


@query("j5_pending_review", oracle(" SELECT c.id, s.text FROM hub_classifications c LEFT JOIN hub_spoken s ON s.obra = c.obra AND s.file_id = c.source_file_id WHERE c.semantic_status = 'pending_review'", "hub_classifications", "hub_spoken"))
def j5_pending_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "hub_classifications").where("semantic_status = 'pending_review'").withColumnRenamed("source_file_id", "file_id")
    return c.join(table(spark, sf_dir, "hub_spoken"), ["obra", "file_id"], "left").select("id", "text")


@query("p24_reviewed", oracle(" SELECT id, CASE id % 4 WHEN 0 THEN 'pending_classify' WHEN 1 THEN 'pending_classify' WHEN 2 THEN 'rejected' ELSE semantic_status END AS semantic_status, CASE id % 4 WHEN 1 THEN 'novo' ELSE human_corrected_text END AS human_corrected_text, CASE WHEN id % 4 < 3 THEN 1 ELSE 0 END AS human_reviewed FROM hub_classifications", "hub_classifications"))
def p24_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "hub_classifications").withColumn("human_reviewed", F.lit(0))
    action = F.when(F.col("id") % 4 == 0, "accept").when(F.col("id") % 4 == 1, "edit").otherwise("reject")
    d = c.where("id % 4 < 3").select("id", action.alias("action"), F.lit("novo").alias("corrected_text"))
    return state.reviewed(c, d).select("id", "semantic_status", "human_corrected_text", "human_reviewed")


@query("p23_contract", oracle(" SELECT id, CASE id % 6 WHEN 1 THEN 'categories' WHEN 2 THEN 'unknown_category' WHEN 3 THEN 'confidence_range' WHEN 4 THEN 'categories' WHEN 5 THEN 'confidence' END AS fault FROM replies", "replies"))
def p23_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "replies").select("id", contracts.classification_fault("body").alias("fault"))


@query("f11_payment", oracle(" SELECT id, CASE WHEN id % 2 = 0 THEN 'pix' ELSE 'outro' END AS doc_type, cents AS valor_centavos, 'BRL' AS moeda, nullif(trim(description), '') AS descricao, 1.0e0 AS confidence FROM payments", "payments"))
def f11_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "payments")
    said = F.to_json(F.struct(F.when(F.col("id") % 2 == 0, "PIX").otherwise("cheque").alias("doc_type"), F.when(F.col("id") % 3 == 0, F.col("cents").cast("string")).otherwise(money.brl("cents", "R$ ")).alias("valor_centavos"), F.lit(" ").alias("moeda"), F.col("description").alias("descricao"), F.lit("7").alias("confidence")))
    return p.select("id", contracts.payment(said).alias("r")).select("id", "r.doc_type", "r.valor_centavos", "r.moeda", "r.descricao", "r.confidence")


_SEEN = "SELECT doc_id AS id, lang AS version, CASE doc_id % 5 WHEN 0 THEN concat(substr(text, 1, 60), ' Não identificado') WHEN 1 THEN concat(text, ' não há atividade: NÃO APLICÁVEL') WHEN 2 THEN concat(text, ' sem atividade') ELSE text END AS body FROM documents"
_FOLD_BODY = "lower(strip_accents(replace(body, 'ß', '§')))"
_UNHELPFUL = f"list_sum(list_transform([{', '.join(repr(m) for m in contracts.UNHELPFUL)}], lambda m: CASE WHEN contains({_FOLD_BODY}, m) THEN 1 ELSE 0 END))"


@query(
    "a20_accuracy",
    oracle(f", a AS ({_SEEN}), h AS (SELECT version, contains({_FOLD_BODY}, 'onhe') OR contains({_FOLD_BODY}, 'euxa') AS hit, length({_FOLD_BODY}) AS n, {_UNHELPFUL} AS marks FROM a) SELECT version, count(*) AS samples, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE marks >= 2 OR marks >= 1 AND n < 100) AS unhelpful FROM h GROUP BY 1", "files"),
)
def a20_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.sql(_SEEN.replace("FROM documents", "FROM {d}"), d=raw(spark, sf_dir, "documents"))
    return contracts.accuracy(seen, ["Onhe", "êuxa".replace("ê", "e")])


@query(
    "a20_divergent",
    oracle(
        ", t AS (SELECT doc_id // 3 AS item, doc_id AS id, list_distinct(list_filter(string_split_regex(lower(strip_accents(replace(text, 'ß', '§'))), '\\s+'), lambda w: w <> '')) AS words FROM documents), e AS (SELECT item, min(id) AS a, max(id) AS b FROM t GROUP BY 1 HAVING count(*) > 1)"
        " SELECT e.item, e.a AS first, e.b AS last, len(x.words) > 0 AND len(y.words) > 0 AND len(list_intersect(x.words, y.words)) / greatest(len(list_distinct(list_concat(x.words, y.words))), 1)::DOUBLE < 0.3 AS divergent FROM e JOIN t x ON x.id = e.a JOIN t y ON y.id = e.b",
        "files",
    ),
)
def a20_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of several analyses whose first and last have little in common."""
    d = raw(spark, sf_dir, "documents")
    return contracts.divergences(d.select(F.floor(F.col("doc_id") / 3).alias("item"), F.col("doc_id").alias("id"), F.col("text").alias("body")))


@query("a21_reprocessed", oracle(" SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.5) AS confident, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS archived FROM analyses", "analyses"))
def a21_reprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analyses").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.5).alias("confident"), F.count_if(F.col("superseded_by").isNotNull()).alias("archived"))


@query("a15_cache_stats", oracle(" SELECT prompt_version, count(*) AS entries, CAST(sum(id % 7) AS BIGINT) AS hits FROM narratives GROUP BY 1", "narratives"))
def a15_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").groupBy("prompt_version").agg(F.count("*").alias("entries"), F.sum(F.col("id") % 7).alias("hits"))


@query("a19_transcript", oracle(" SELECT id, round(CASE WHEN id % 3 = 0 THEN 0 ELSE (exp(-(id % 10) / 10.0e0) + exp(-0.5e0)) / 2 END, 9) AS confidence FROM tasks", "tasks"))
def a19_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.when(F.col("id") % 3 == 0, "[]").otherwise(F.concat(F.lit('[{"avg_logprob": '), (-(F.col("id") % 10) / 10.0).cast("string"), F.lit('}, {"avg_logprob": -0.5}, {"x": 1}]')))
    return table(spark, sf_dir, "tasks").select("id", F.round(usage.transcript_confidence(segments), 9).alias("confidence"))


@query("d6_insert_payments", oracle(", i AS (SELECT obra, cents, min(id) AS id FROM payments WHERE id % 3 > 0 GROUP BY ALL) SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.id % 3 = 0 AND p.obra = i.obra AND p.cents = i.cents)", "payments"))
def d6_insert_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "payments").select("obra", "cents", "id")
    return records.insert_new(p.where("id % 3 = 0"), p.where("id % 3 > 0"), ["obra", "cents"], "id")


@query("d9_archived", oracle(" SELECT id AS original_id, file_id, 'reprocess' AS archive_reason FROM analyses WHERE superseded_by IS NOT NULL", "analyses"))
def d9_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analyses").where("superseded_by is not null").select(F.col("id").alias("original_id"), "file_id", F.lit("reprocess").alias("archive_reason"))


@query("d12_derived", oracle(" SELECT concat('f_', substr(sha256(file_id), 1, 12)) AS file_id, 'text' AS file_type, file_id AS derived_from, 'whisper' AS derivation_method, referenced_by_message FROM hub_files", "hub_files"))
def d12_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "hub_files").withColumns({"obra": F.lit("o"), "timestamp_source": F.lit("filename")})
    out = state.derive(f, "text", "whisper", F.sha2("file_id", 256), F.lit("2026-01-01"))
    return out.select("file_id", "file_type", "derived_from", "derivation_method", "referenced_by_message")


@query("d13_outcomes", oracle(" SELECT obra, CASE status WHEN 'done' THEN 'processed' WHEN 'failed' THEN 'failed' ELSE 'skipped' END AS outcome, count(*) AS n FROM tasks GROUP BY ALL", "tasks"))
def d13_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tasks").withColumn("outcome", F.when(F.col("status") == "done", "processed").when(F.col("status") == "failed", "failed").otherwise("skipped"))
    return state.outcomes(t, "outcome", "obra")


@query("d16_stamped", oracle(" SELECT id, CASE WHEN id = 4 THEN 'novo' ELSE prompt_template_hash END AS prompt_template_hash FROM narratives", "narratives"))
def d16_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narratives").select("id", F.when(F.col("id") == 4, "novo").otherwise(F.col("prompt_template_hash")).alias("prompt_template_hash"))


@query("s12_request_lines", oracle(""" SELECT id, concat('{"custom_id":"', id, '","method":"POST","url":"/v1/chat/completions","body":{"model":"gpt-4o-mini","messages":[{"role":"user","content":"', task_type, '"}]}}') AS line FROM tasks""", "tasks"))
def s12_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").select("id", records.request_line(F.col("id").cast("string"), "gpt-4o-mini", F.col("task_type")).alias("line"))


@query("s17_enqueued", oracle(" SELECT file_id, CASE file_type WHEN 'image' THEN 'visual_analysis' WHEN 'video' THEN 'extract_audio' END AS task_type FROM files WHERE file_type IN ('image', 'video')", "files"))
def s17_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("file_id", chat.downstream_task("file_type").alias("task_type")).where("task_type is not null")


@query("s22_kept_narratives", oracle(", k AS (SELECT obra, scope, scope_ref, dossier_hash, min(id) AS id FROM narratives GROUP BY ALL) SELECT id FROM k", "narratives"))
def s22_kept_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "narratives").select("id", "obra", "scope", "scope_ref", "dossier_hash")
    return records.insert_new(n.limit(0), n, ["obra", "scope", "scope_ref", "dossier_hash"], "id").select("id")


@query("t6_tail", oracle(" SELECT id FROM api_calls ORDER BY id DESC LIMIT 20", "api_calls"))
def t6_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_calls").orderBy(F.desc("id")).limit(20).select("id")


@query("t7_sample", oracle(" SELECT id FROM edges ORDER BY confidence DESC, id LIMIT 5", "edges"))
def t7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").orderBy(F.desc("confidence"), "id").limit(5).select("id")


@query("t10_targets", oracle(" SELECT file_id FROM files WHERE file_type = 'image' ORDER BY n LIMIT 25", "files"))
def t10_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("file_type = 'image'").orderBy("n").limit(25).select("file_id")


@query("w6_first_seen", oracle(" SELECT category, min(id) AS id FROM happenings GROUP BY 1", "happenings"))
def w6_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "happenings").withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("id")))
    return h.where("k = 1").select("category", "id")


@query("set_refs", oracle(" SELECT obra FROM payments UNION SELECT obra FROM happenings UNION SELECT primary_event_ref FROM edges", "payments", "happenings", "edges"))
def set_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, h, e = (table(spark, sf_dir, n) for n in ("payments", "happenings", "edges"))
    return p.select("obra").union(h.select("obra")).union(e.select(F.col("primary_event_ref").alias("obra"))).distinct()


_TWICE = "concat(text, ' e ', text)"


@query(
    "k13_amounts",
    oracle(
        f""", a AS (SELECT id, unnest(regexp_extract_all({_TWICE}, '(?i)R\\$\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+(?:,\\d{{2}})?|\\d+(?:,\\d{{2}})?)', 1)) AS s FROM happenings),
        c AS (SELECT id, CAST(round(CAST(replace(replace(s, '.', ''), ',', '.') AS DECIMAL(18, 4)) * 100) AS BIGINT) AS cents FROM a)
        SELECT h.id, count(cents) FILTER (WHERE cents > 0) AS n, CAST(coalesce(sum(cents) FILTER (WHERE cents > 0), 0) AS BIGINT) AS cents FROM happenings h LEFT JOIN c USING (id) GROUP BY 1""",
        "happenings",
    ),
)
def k13_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount stands twice, and both count; amounts of zero don't."""
    a = money.amounts(F.expr(_TWICE))
    return table(spark, sf_dir, "happenings").select("id", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).alias("cents"))


@query("k18_naive", oracle(" SELECT event_id AS id, ts AS stamp FROM events", "files"))
def k18_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written with an offset and read back without it."""
    e = raw(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), temporal.naive(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "-03:00").otherwise("Z"))).alias("stamp"))


@query("k19_payment_time", oracle(" SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN date_trunc('second', ts) END AS stamp FROM events", "files"))
def k19_payment_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.date_format("ts", "HH:mm:ss"))
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), temporal.payment_time(F.date_format("ts", "yyyy-MM-dd"), hour).alias("stamp"))


@query("f13_shown_times", oracle(" SELECT event_id AS id, strftime(ts, '%d/%m/%Y') AS d, strftime(ts, '%H:%M') AS c, strftime(ts, '%Y-%m-%d') AS i, ts - INTERVAL 3 HOUR AS local FROM events", "files"))
def f13_shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), temporal.br_date("ts").alias("d"), temporal.clock(iso).alias("c"), temporal.iso_day(iso).alias("i"), temporal.to_zone("ts").alias("local"))


@query("f23_self_assessment", oracle(" SELECT id, CASE WHEN id % 2 = 0 THEN '0.5' END AS confidence FROM narratives", "narratives"))
def f23_self_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.when(F.col("id") % 2 == 0, F.concat("narrative_text", F.lit('\n```json\n{"confidence": 0.5}\n```\n'))).otherwise(F.col("narrative_text"))
    return table(spark, sf_dir, "narratives").select("id", F.get_json_object(narratives.self_assessment(closed), "$.confidence").alias("confidence"))


@query("f31_fold", oracle(" SELECT doc_id, sha256(replace(lower(strip_accents(replace(text, 'ß', '§'))), '§', 'ß')) AS d FROM documents", "files"))
def f31_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ß has no accent to lose and stays; DuckDB takes it for an s, so its SQL holds it aside."""
    return raw(spark, sf_dir, "documents").select("doc_id", F.sha2(text.inclusive_fold("text"), 256).alias("d"))


@query("f32_excerpts", oracle(" SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE concat(regexp_replace(substr(text, 1, 297), ' [^ ]*$', ''), '…') END AS excerpt FROM documents", "files"))
def f32_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", text.excerpt("text", 300).alias("excerpt"))


@query("f9_strip_emoji", oracle(" SELECT id, text, 2 AS n FROM happenings", "happenings"))
def f9_strip_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, n = text.strip_emoji(F.concat(F.lit("😀☀"), "text", F.lit("\U0001f680")))
    return table(spark, sf_dir, "happenings").select("id", clean.alias("text"), n.alias("n"))


@query("p22_status", oracle(" SELECT obra, CASE WHEN id % 2 = 0 THEN 'pending_classify' ELSE 'pending_review' END AS status, count(*) AS n FROM happenings GROUP BY ALL", "happenings"))
def p22_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("id") % 2 == 0, "coerente").otherwise("suspeita")
    return table(spark, sf_dir, "happenings").groupBy("obra", media.status_after(quality).alias("status")).agg(F.count("*").alias("n"))


@query("p21_ocr_first", oracle(" SELECT file_id, CASE WHEN n % 4 = 0 OR n % 5 = 0 OR n % 3 = 0 OR n % 40 < 15 THEN 'visual_analysis' ELSE 'document' END AS target FROM files", "files"))
def p21_ocr_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return table(spark, sf_dir, "files").select("file_id", media.ocr_first(n % 4 == 0, n % 5 == 0, n % 3 != 0, n % 40).alias("target"))


@query("p12_previews", oracle(" SELECT doc_id, substr(text, 1, 150) AS preview, CASE WHEN length(text) <= 500 THEN text END AS content FROM documents", "files"))
def p12_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"), text.short_content("text").alias("content"))
