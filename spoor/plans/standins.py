"""The engine's tables made of the driver's.

Each is one SELECT that Spark and DuckDB read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _cycle(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_SAID = _cycle(
    "event_id % 11",
    [
        "manda a chave pix do sinal da serralheria",
        "instalação do telhado e fechamento da estrutura",
        "serviço de pintura, material da obra",
        "o comprovante do saldo da serralheria",
        "bom dia, tudo bem com vocês",
        "Transferência dos reais para o telhado",
        "alambrado e tesouras cobertas hoje",
        "parcela da instalação, sinal e saldo",
        "subindo a estrutura do telhado amanhã",
        "PIX feito! valor do pix conferido",
        "equipamentos e pessoas trabalhando na obra",
    ],
)
_PAID = _cycle(
    "event_id % 5",
    ["sinal da serralheria e instalação", "saldo do telhado, estrutura e fechamento", "  ", "parcelas do serviço de pintura", "pix do comprovante: alambrados"],
)
_QUALIFIED = _cycle("event_id % 6", [" no total", " por metro", "", " cada, total do pacote", " fechou em tudo", "/kg"])
#: An amount in Brazilian spelling made of an event's value; 2,000 events' values meet often enough to match.
_AMOUNT = "concat('R$ ', CAST(CAST(floor(value) AS BIGINT) AS STRING), ',', CASE event_id % 3 WHEN 0 THEN '00' WHEN 1 THEN '50' ELSE '99' END)"

TABLES: dict[str, str] = {
    "payments": f"""SELECT concat('obra_', CAST(user_id % 3 AS STRING)) AS obra, event_id AS id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
        {_PAID} AS description FROM events WHERE event_type = 'purchase'""",
    "happenings": f"""SELECT concat('obra_', CAST(user_id % 3 AS STRING)) AS obra, event_id AS id, ts, event_type AS source_type,
        concat({_SAID}, CASE WHEN event_id % 4 = 0 THEN concat('; ', {_AMOUNT}, {_QUALIFIED}) ELSE '' END) AS text,
        {_cycle("event_id % 7", ["pagamento", "estrutura", "material", "", "telhado", "pagamento", "visita"])} AS category
        FROM events WHERE event_type <> 'purchase'""",
    "edges": """SELECT event_id AS id, concat('obra_', CAST(user_id % 3 AS STRING)) AS obra,
        CASE event_id % 5 WHEN 0 THEN 'TEMPORAL_PAYMENT_CONTEXT' WHEN 1 THEN 'SEMANTIC_PAYMENT_SCOPE' WHEN 2 THEN 'MATH_VALUE_MATCH' WHEN 3 THEN 'MATH_VALUE_DIVERGENCE' ELSE 'CONTRACT_RENEGOTIATION' END AS correlation_type,
        CASE event_id % 5 WHEN 4 THEN concat('c_', CAST(event_id % 400 AS STRING)) ELSE concat('fr_', CAST(event_id % 400 AS STRING)) END AS primary_event_ref,
        concat('c_', CAST(event_id % 900 AS STRING)) AS related_event_ref,
        (event_id * 37 % 101) / 100.0e0 AS confidence,
        CASE event_id % 4 WHEN 0 THEN 'temporal_v1' WHEN 1 THEN 'semantic_v2' WHEN 2 THEN 'math_v1' ELSE 'contract_renegotiation_v1' END AS detected_by FROM events""",
    "tasks": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'transcribe' WHEN 1 THEN 'ocr' WHEN 2 THEN 'classify' ELSE 'visual' END AS task_type,
        CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'running' END AS status,
        CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN concat('[', CAST(o_orderkey - 1 AS STRING), ']') WHEN 2 THEN concat('[', CAST(o_orderkey - 2 AS STRING), ',', CAST(o_orderkey - 5 AS STRING), ']') WHEN 3 THEN '[999999999]' ELSE concat('[', CAST(o_orderkey - 4 AS STRING), ']') END AS depends_on,
        concat('obra_', CAST(o_custkey % 3 AS STRING)) AS obra, CAST(o_orderkey % 10 AS INT) AS priority, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE NULL END AS finished_at,
        concat('{"file_id": "f_', CAST(o_custkey AS STRING), '"}') AS payload FROM orders""",
    "api_calls": """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'whisper' WHEN 1 THEN 'vision' ELSE 'chat' END AS endpoint,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(value / 1000, 6) END AS cost_usd, CAST(event_id % 4000 AS INT) AS latency_ms, CAST(event_id % 700 AS INT) AS tokens, ts AS created_at,
        CASE event_id % 10 WHEN 1 THEN 'RateLimitError' WHEN 2 THEN 'BadRequestError' WHEN 3 THEN 'APITimeoutError' ELSE NULL END AS error_type FROM events""",
    "narratives": """SELECT o_orderkey AS id, concat('obra_', CAST(o_custkey % 3 AS STRING)) AS obra,
        CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'week' ELSE 'obra_overview' END AS scope,
        CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS scope_ref,
        CASE o_orderkey % 4 WHEN 0 THEN 'narrator_v4_adversarial' WHEN 1 THEN 'narrator_v3_gt' WHEN 2 THEN 'narrator_v2' ELSE 'narrator_v1' END AS prompt_version,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('h', CAST(o_orderkey % 50 AS STRING)) END AS prompt_template_hash, concat('d', CAST(o_orderkey % 40 AS STRING)) AS dossier_hash,
        concat('# Narrativa: ', o_orderpriority, ' m_', CAST(100000 + o_orderkey AS STRING), ' e f_', CAST(200000 + o_custkey AS STRING), ' e m_', CAST(100000 + o_orderkey AS STRING), ' --- fr_12') AS narrative_text,
        CAST(o_orderdate AS DATE) AS day FROM orders""",
    "analyses": """SELECT l_orderkey * 10 + l_linenumber AS id, concat('f_', CAST(l_partkey AS STRING)) AS file_id, l_quantity / 50.0e0 AS confidence,
        CASE WHEN l_linenumber = 7 THEN '{"_sentinel": true}' WHEN l_linenumber = 6 THEN 'broken' ELSE concat('{"atividade_em_curso": "', l_returnflag, '", "elementos_construtivos": "', CASE WHEN l_linenumber = 3 THEN '' ELSE l_linestatus END, '", "observacoes_tecnicas": "ok"}') END AS analysis_json,
        CASE WHEN l_linenumber = 1 THEN 999 ELSE NULL END AS superseded_by, l_shipdate AS created_at FROM lineitem""",
    "files": """SELECT concat('f_', CAST(p_partkey AS STRING)) AS file_id, CASE p_partkey % 6 WHEN 0 THEN 'foto.JPG' WHEN 1 THEN 'IMG-20260404-WA0001.jpg' WHEN 2 THEN 'VID_20260404_114841.mp4' WHEN 3 THEN '00000003-AUDIO-2026-04-04-11-48-41.opus' WHEN 4 THEN 'contrato.pdf' ELSE 'IMG-20261399-WA0001.jpg' END AS file_name,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('f_', CAST(p_partkey - 1 AS STRING)) END AS derived_from,
        CASE WHEN p_partkey % 3 = 0 THEN 'image' WHEN p_partkey % 3 = 1 THEN 'video' ELSE 'text' END AS file_type, CASE p_partkey % 4 WHEN 0 THEN 'ocr_first v1' WHEN 1 THEN 'ocrXfirst' ELSE 'frames' END AS derivation_method,
        CAST(p_size * 1000 AS BIGINT) AS size_bytes, CAST(p_size * 37 % 2600 AS INT) AS width, CAST(p_size * 91 % 2600 AS INT) AS height, p_partkey AS n FROM part""",
    "messages": """SELECT conv_id, turn, role, text AS content, concat('obra_', CAST(conv_id % 3 AS STRING)) AS obra, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Ana' ELSE 'Rui' END AS sender,
        concat(CAST(1 + conv_id % 28 AS STRING), '/', CAST(1 + turn % 12 AS STRING), '/2026 ', CAST(turn % 24 AS STRING), ':05') AS stamp FROM conversations""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame, over the driver's files."""
    sql = TABLES[name]
    source = sql.split(" FROM ")[-1].split()[0]
    escaped = sql.replace("{", "{{").replace("}", "}}").replace(f" FROM {source}", " FROM {source}")
    return spark.sql(escaped, source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(select: str, *names: str) -> str:
    """select with the named stand-ins as common table expressions; it may open with further ones after a comma."""
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in names)
    return f"WITH {ctes}{select if select.startswith(',') else chr(10) + select}"
