"""Detectors on the seeded payment, joins against nested loops, parsing, folds and streams."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spoor.functions import text
from spoor.operators import detectors, hub, joins, media, narratives, state, usage
from spoor.sources import chat, records, tables
from spoor.streaming import live

PAID = dt.datetime(2026, 4, 6, 11)


def seeded(spark):
    payments = spark.createDataFrame([("o", 1, PAID, 350000, "sinal da serralheria")], "obra string, id bigint, ts timestamp_ntz, cents bigint, description string")
    events = spark.createDataFrame(
        [
            ("o", 1, dt.datetime(2026, 4, 6, 10, 45), "manda a chave pix do sinal, R$3.500,00 da serralheria"),
            ("o", 2, dt.datetime(2026, 4, 8, 11), "serralheria pronta, falta o sinal"),
            ("o", 3, dt.datetime(2026, 3, 1, 9), "bom dia"),
            ("p", 4, dt.datetime(2026, 4, 6, 10, 45), "manda a chave pix do sinal, R$3.500,00 da serralheria"),
            ("o", 5, None, "pix do sinal da serralheria"),
        ],
        "obra string, id bigint, ts timestamp_ntz, text string",
    )
    return events, payments


def test_seeded_detection(spark):
    events, payments = seeded(spark)
    got = {(r.correlation_type, r.related_event_ref): r for r in detectors.detect(events, payments).collect()}
    assert set(got) == {("TEMPORAL_PAYMENT_CONTEXT", "c_1"), ("SEMANTIC_PAYMENT_SCOPE", "c_1"), ("MATH_VALUE_MATCH", "c_1"), ("SEMANTIC_PAYMENT_SCOPE", "c_2")}
    t = got["TEMPORAL_PAYMENT_CONTEXT", "c_1"]
    assert (t.time_gap_seconds, t.confidence, t.rationale) == (-900, 1.0, "4 keyword(s) de pagamento na janela +-30min (delta=-900s)")
    s = got["SEMANTIC_PAYMENT_SCOPE", "c_2"]
    assert abs(s.confidence - 0.75 * (1 - 0.3 * 2 / 3)) < 1e-9
    assert s.rationale == "overlap de 2 termo(s): serralheria*,sinal* (delta=+172800s, decay=0.80)"


def test_decays_print_as_their_exact_values(spark):
    """All whole seconds of a window that makes many decays halfway between two texts, and their neighbours."""
    gaps = [*range(0, 2700), *(4320 * k + d for k in range(60) for d in (-1, 0, 1))]
    rows = [(w, g, 1.0 - 0.3 * min(abs(g) / float(w), 1.0)) for w in (2400, 259200) for g in gaps]
    rows += [(0, 0, x) for k in range(70, 101) for x in (k / 100, float(f"{10 * k + 5}e-3") if k < 100 else 1.0)]
    df = spark.createDataFrame(rows, "w int, g int, x double")
    got = df.select("x", detectors.decay_text("x").alias("said")).collect()
    assert [r.said for r in got] == [f"{r.x:.2f}" for r in got]
    held = df.where("w > 0").groupBy("w").agg(F.count_if(detectors.decay(F.col("g"), 259200) == F.col("x")).alias("n")).collect()
    assert {r.w: r.n for r in held}[259200] == len(gaps)


def test_windows_are_monotonous(spark):
    events, payments = seeded(spark)
    sizes = [detectors.detect(events, payments, {k: w for k in detectors.WINDOWS}).count() for w in (0, 60, 86400, 60 * 86400)]
    assert sizes == sorted(sizes) and sizes[0] == 0


def test_renegotiation(spark):
    said = lambda v: f"telhado e serralheria, fechou em R$ {v}"
    rows = [("o", 1, dt.datetime(2026, 4, 4, 10), said("10.000,00")), ("o", 2, dt.datetime(2026, 4, 8, 15), said("7.000,00")), ("o", 3, dt.datetime(2026, 6, 1), said("7.000,00")), ("o", 4, dt.datetime(2026, 4, 5), "pintura por R$ 9.000,00")]
    events = spark.createDataFrame(rows, "obra string, id bigint, ts timestamp_ntz, text string")
    got = detectors.contract_renegotiation(events).collect()
    assert [(r.primary_event_ref, r.related_event_ref, r.time_gap_seconds, r.confidence) for r in got] == [("c_1", "c_2", 363600, 0.85)]
    assert got[0].rationale == "renegociação detectada: R$10.000,00 → R$7.000,00 (variação 30%); 2 stems HIGH, diff sweet-spot"


def test_renegotiation_query_has_the_whole_window(spark, tmp_path):
    """Two events 4.2 days apart, as in the reference's fixture."""
    at = [dt.datetime(2026, 4, 4, 10), dt.datetime(2026, 4, 8, 15)]
    rows = [(12, at[0], 100.0), (56, at[1], 70.0)]
    made = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, value double").selectExpr("event_id", "ts", "1L AS user_id", "'view' AS event_type", "value")
    made.write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["j9_renegotiation_month"](spark, str(tmp_path)).collect()
    assert [(r.primary_event_ref, r.related_event_ref, r.time_gap_seconds) for r in got] == [("c_12", "c_56", 363600)]


def test_chronology_query_takes_all_payments(spark, tmp_path):
    """No id is divisible by 200; obra_1 has more payments than room, obra_2 two and messages that fill the rest."""
    start = dt.datetime(2026, 4, 4)
    rows = [(i, start + dt.timedelta(minutes=500 - i), 10.0, 1, "purchase") for i in range(1, 26)] + [(i, start, 10.0, 2, "purchase") for i in (31, 32)] + [(57, start, 10.0, 2, "view")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, value double, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["t5_chronology"](spark, str(tmp_path)).collect()
    by = lambda obra: [(r.kind, r.time) for r in sorted(got, key=lambda r: r.place) if r.obra == obra]
    assert by("obra_1") == [("pagamento", (start + dt.timedelta(minutes=500 - i)).strftime("%H:%M")) for i in range(25, 5, -1)]
    assert [k for k, _ in by("obra_2")] == ["pagamento", "pagamento", "mensagem"]


def test_near_hash_classes_give_all_pairs(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(4)]
    made = [(i, base[i % 4] ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 2))) % (1 << 64) if i % 3 else base[i % 4]) for i in range(60)]
    rows = spark.createDataFrame([(i, f"{h:016x}") for i, h in made], "id long, h string")
    got = [tuple(r) for r in joins.near_hash_classes(rows, "id", "h").collect()]
    assert sorted(got) == sorted(tuple(r) for r in joins.near_hash_classes(rows, "id", "h", bands=8, together=2).collect())
    least = {i: i for i, _ in made} | {b: a for a, b, d in got if d == 0}
    near = {(a, b): d for a, b, d in got if d}
    apart = lambda i, j: 0 if least[i] == least[j] else near.get(tuple(sorted((least[i], least[j]))))
    for (i, x), (j, y) in itertools.combinations(made, 2):
        d = (x ^ y).bit_count()
        assert apart(i, j) == (d if d <= 6 else None)


@pytest.mark.parametrize("earlier", [False, True])
def test_first_near_is_a_linear_search(spark, earlier):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(9)]
    flip = lambda: sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 0, 1, 3, 5, 7])))
    made = [(rnd.choice("op"), i, f"{rnd.choice(base) ^ flip():016x}", (i * 37) % 200) for i in range(200)]
    rows = spark.createDataFrame([*made, ("o", 900, None, 500)], "obra string, id long, h string, at long")
    got = {(r.obra, r.id): (r.match, r.distance) for r in joins.first_near(rows, rows, "id", "h", "at", ["obra"], earlier_only=earlier).collect()}
    want = {}
    for o, i, h, at in made:
        for p, j, k, then in sorted(made, key=lambda x: x[3]):
            d = (int(h, 16) ^ int(k, 16)).bit_count()
            if p == o and j != i and d <= 6 and (then < at or not earlier):
                want[o, i] = (j, d)
                break
    assert got == want


def test_band_keys_have_twenty_bits_and_miss_nothing(spark):
    rnd = random.Random(9)
    pairs = [(i, x, x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 8)))) for i, x in enumerate(rnd.getrandbits(64) for _ in range(300))]
    rows = spark.createDataFrame([(i, f"{x:016x}", f"{y:016x}", (x ^ y).bit_count()) for i, x, y in pairs], "i int, a string, b string, d int")
    bits = rows.select("d", joins.hash_bits("a").alias("a"), joins.hash_bits("b").alias("b"))
    for distance, count in ((6, 84), (0, 1), (8, 66)):
        keys = bits.select("d", F.size(F.array_intersect(joins.band_keys("a", distance), joins.band_keys("b", distance))).alias("n"), F.size(joins.band_keys("a", distance)).alias("k"), joins.band_keys("a", distance).alias("all"))
        assert keys.where((F.col("d") <= distance) & (F.col("n") == 0)).count() == 0
        assert {r.k for r in keys.select("k").distinct().collect()} == {count} if distance != 8 else True
    assert bits.select(F.countDistinct(joins.band_keys("a", 6)[0])).first()[0] > 295  # of 300, in 2 ** 21


def test_numbered_splits_a_key(spark):
    rnd = random.Random(4)
    rows = [("x" if i % 10 else None if i % 20 else "y", rnd.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o double, i int").repartition(3)
    out = joins.numbered(df, "k", "o")
    want = {i: n for k in "xy" for n, (_, i) in enumerate(sorted((o, i) for c, o, i in rows if c == k))}
    assert {r.i: r.number for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "row_number" not in plan
    assert joins.numbered(df.limit(0), "k", "o").collect() == []


def test_within_is_a_nested_loop(spark):
    rnd = random.Random(3)
    at = lambda: PAID + dt.timedelta(microseconds=rnd.randrange(0, 5_000_000_000))
    a = [("o" if i % 3 else "p", i, at()) for i in range(80)] + [("o", 99, None)]
    b = [("o" if i % 2 else "p", i, at()) for i in range(90)]
    left = spark.createDataFrame(a, "k string, i int, t timestamp_ntz")
    right = spark.createDataFrame(b, "k string, j int, u timestamp_ntz")
    for seconds, ahead in ((0, False), (1, False), (90, False), (600, True)):
        got = sorted((r.i, r.j) for r in joins.within(left, right, ["k"], "t", "u", seconds, ahead).collect())
        limit = dt.timedelta(seconds=seconds)
        want = sorted((i, j) for (k, i, t), (m, j, u) in itertools.product(a, b) if t and k == m and (dt.timedelta(0) < u - t <= limit if ahead else abs(u - t) <= limit))
        assert got == want
        gaps = {(r.i, r.j): r.gap for r in joins.within(left, right, ["k"], "t", "u", seconds, ahead, gap="gap").collect()}
        whole = {(i, j): int((u - t).total_seconds()) for (k, i, t), (m, j, u) in itertools.product(a, b) if t and k == m}
        assert sorted(gaps) == want and all(gaps[p] == whole[p] for p in want)


def test_near_pool_is_the_rolling_pool(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    rows = [(0, i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for i in range(120)]
    got = {r.later: (r.earlier, round(r.similarity, 9)) for r in joins.near_pool(spark.createDataFrame(rows, "k int, i int, x string"), "k", "i", "x", 0.6, 20).collect()}
    pool, want = [], {}
    for _, i, x in rows:
        t = set(x.split())
        best = None
        for j, u in pool:
            s = len(t & u) / len(t | u) if t else 0
            if s >= (best[1] if best else 0.6):
                best = (j, s)
        if best:
            want[i] = (best[0], round(best[1], 9))
        if t:
            pool = (pool + [(i, t)])[-20:]
    assert got == want


CHAT = """orfã
04/04/2026 09:00 - As mensagens e ligações são protegidas
04/04/2026 09:01 - Ana: primeira
segunda linha
terceira
04/04/2026 09:02 - Rui: <Figurinha omitida>
4/4/26 9:03 - Ana: <anexado: foto um.jpg>
04/04/2026 09:04 - Ana: IMG 1.jpg (arquivo anexado)
04/04/2026 09:05 - Rui: Esta mensagem foi apagada
04/04/2026 09:06 - Rui: novo texto <Esta mensagem foi editada>
04/04/2026 09:07 - Rui: Ligação de voz perdida
"""


def test_chat_dialects(spark, tmp_path):
    bracket = "\n".join("[" + x.replace(" - ", "] ", 1).replace(" ", ", ", 1) if " - " in x else x for x in CHAT.split("\n")[1:])
    (tmp_path / "a.txt").write_text(CHAT[len("orfã\n") :])
    (tmp_path / "b.txt").write_text(bracket.replace("Ana:", "‎Ana:"))
    (tmp_path / "c.txt").write_text("nada disso\n")
    got = chat.parse(chat.read_lines(spark, f"file://{tmp_path}/*.txt")).orderBy("file", "line_number").collect()
    by = {f: [tuple(r)[1:] for r in got if r.file.endswith(f)] for f in ("a.txt", "b.txt", "c.txt")}
    shape = [(r[3], r[4], r[5], r[6], r[7]) for r in by["a.txt"]]
    assert shape == [
        (None, "As mensagens e ligações são protegidas", "system", None, False),
        ("Ana", "primeira\nsegunda linha\nterceira", "text", None, False),
        ("Rui", "<Figurinha omitida>", "sticker", None, False),
        ("Ana", "<anexado: foto um.jpg>", "media_ref", "foto um.jpg", False),
        ("Ana", "IMG 1.jpg (arquivo anexado)", "media_ref", "IMG 1.jpg", False),
        ("Rui", "Esta mensagem foi apagada", "deleted", None, False),
        ("Rui", "novo texto", "text", None, True),
        (None, "Ligação de voz perdida", "system", None, False),
    ]
    assert shape == [(r[3], r[4], r[5], r[6], r[7]) for r in by["b.txt"]] and by["c.txt"] == []
    assert by["a.txt"][3][2] == dt.datetime(2026, 4, 4, 9, 3)
    ids = chat.with_ids(chat.parse(chat.read_lines(spark, f"file://{tmp_path}/a.txt")), F.lit("o"))
    assert ids.orderBy("line_number").first().message_id == "msg_o_L0001"


def test_a_chat_parses_in_many_tasks(spark, tmp_path, monkeypatch):
    """Splits of a few hundred bytes and segments of seven lines, so messages run over the edges of both."""
    rnd = random.Random(2)
    said, lines = [], [""]
    for i in range(300):
        body = [f"linha {i} é"] + ["mais " * rnd.randint(0, 9) for _ in range(rnd.choice([0, 0, 1, 30]))]
        said.append((len(lines) + 1, "\n".join(body)))
        lines += [f"04/04/2026 09:{i % 60:02d} - Ana: {body[0]}", *body[1:]]
    (tmp_path / "_chat.txt").write_bytes("\r\n".join(lines).encode("latin-1"))
    (tmp_path / "um.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "vazio.txt").write_text("")
    monkeypatch.setattr(chat, "SEGMENT", 7)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700b")
    try:
        for path, encoding in ((f"file://{tmp_path}/_chat.txt", "latin-1"), (f"file://{tmp_path}/*.txt", "utf-8")):
            read = chat.read_lines(spark, path, encoding)
            assert [r.value for r in read.orderBy("line").collect()] == lines
            got = chat.parse(read).orderBy("line_number")
            assert [(r.line_number, r.content) for r in got.collect()] == said
            assert spark.read.text(f"file://{tmp_path}/um.txt").rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(key, before)


def test_hub_reads_each_source(spark):
    c = spark.createDataFrame([("o", 1, "f1", "transcription", None, "porque", None, '["pagamento"]', "classified"), ("o", 2, None, "text_message", "m1", None, None, "x", "classified"), ("o", 3, "f3", "visual_analysis", None, "", None, "[]", "classified"), ("o", 4, "f1", "transcription", None, None, "corrigido", None, "pending")], "obra string, id bigint, source_file_id string, source_type string, source_message_id string, reasoning string, human_corrected_text string, categories string, semantic_status string")
    files = spark.createDataFrame([("f1", "2026-04-06T10:00:00-03:00", "f0", None), ("f0", None, None, "m2"), ("f3", None, "f9", None), ("f9", "2026-04-07T08:00:00Z", None, None)], "file_id string, timestamp_resolved string, derived_from string, referenced_by_message string")
    messages = spark.createDataFrame([("m1", "oi", "2026-04-05T09:00:00"), ("m2", "x", "2026-04-01T09:00:00")], "message_id string, content string, timestamp_whatsapp string")
    spoken = spark.createDataFrame([("o", "f1", "falado")], "obra string, file_id string, text string")
    seen = spark.createDataFrame([("o", "f3", '{"atividade_em_curso": "solda", "materiais_visiveis": "aço"}')], "obra string, file_id string, analysis_json string")
    none = spark.createDataFrame([], "obra string, file_id string, text string")
    got = {r.id: r for r in hub.events(c, spoken, files, messages, seen, none).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].text, got[1].ts, got[1].primary_category) == ("porque \n falado \n pagamento", dt.datetime(2026, 4, 6, 10), "pagamento")
    assert (got[2].text, got[2].ts) == ("oi", dt.datetime(2026, 4, 5, 9))
    assert (got[3].body, got[3].ts) == ("solda | aço", dt.datetime(2026, 4, 7, 8))


def test_runnable_waits_for_done_and_existing(spark):
    rows = [(1, "done", "[]"), (2, "pending", "[1]"), (3, "pending", "[2]"), (4, "pending", "[99]"), (5, "pending", "[]"), (6, "running", "[]"), (7, "pending", "[1,6]")]
    t = spark.createDataFrame([(i, s, d, "o") for i, s, d in rows], "id bigint, status string, depends_on string, obra string")
    assert sorted(r.id for r in state.runnable(t).collect()) == [2, 5]


def test_breaker_is_an_ordered_fold(spark):
    bad = [1, 1, 0, 1, 1, 0, 0, 1, 0, 0]
    at = [0, 1, 2, 3, 4, 5, 400, 401, 402, 403]
    rows = [("a", i, PAID + dt.timedelta(seconds=s), "E" if b else None) for i, (s, b) in enumerate(zip(at, bad))]
    got = usage.breaker(spark.createDataFrame(rows, "endpoint string, id int, created_at timestamp_ntz, error_type string"), failures=2).orderBy("id").collect()
    assert [(r.state, r.rejected) for r in got] == [("closed", False)] * 2 + [("open", True)] * 4 + [("half_open", False)] + [("closed", False)] * 3


def test_upper_median_and_retries(spark):
    rows = spark.createDataFrame([("s", v) for v in (4, 1, 3, 2)], "stage string, duration_ms int")
    assert tuple(usage.durations(rows).first()) == ("s", 4, 1, 3, 4)


def test_checklist_verdicts(spark):
    good = "# Narrativa: dia\nÀs 11h13 pagou R$ 3.500,00 a Everaldo, o que sugere acordo m_aaaa f_bbbb " + "x" * 300 + "\n---\n"
    n = spark.createDataFrame([(1, good, "v1", '{"confidence": 0.9}'), (2, good.replace("3.500", "3.400"), "v1", None), (3, "curta", "v1", None)], "id bigint, body string, prompt_version string, assessment string")
    paid = spark.createDataFrame([(i, 350000, "Everaldo Silva", None) for i in (1, 2)], "id bigint, cents bigint, payer string, payee string")
    told = spark.createDataFrame([(i, "11:13", f) for i in (1, 2) for f in ("m_aaaa", "f_bbbb", "f_cccc")], "id bigint, hour string, file_id string")
    got = {r.id: r for r in narratives.checklist(n, paid, told).collect()}
    assert got[1].passed and got[1].passed_strict and got[1].file_ids and got[1].times and got[1].names
    assert not got[2].passed and not got[2]["values"] and not got[3].passed


def test_image_verdicts(spark):
    rows = spark.createDataFrame([(1000, 500, 500, 50.0), (10**6, 50, 500, 50.0), (10**6, 500, 500, 5.0), (3 * 10**7, 500, 500, None), (10**6, None, None, None)], "s bigint, w int, h int, v double")
    mild = [r[0] for r in rows.select(media.verdict("s", "w", "h", "v")[1]).collect()]
    strict = [r[0] for r in rows.select(media.verdict("s", "w", "h", "v", True)[1]).collect()]
    assert mild == ["too_small", "dimensions_too_small", None, None, "corrupted"]
    assert strict == ["too_small", "dimensions_too_small", "too_blurry", "too_large", "corrupted"]


def test_sharpness(spark):
    flat, sharp = bytes([9] * 25), bytes([0, 255] * 12 + [0])
    got = media.sharpness(spark.createDataFrame([(5, 5, flat), (5, 5, sharp), (5, 5, b"x")], "width int, height int, content binary")).collect()
    assert got[0].sharpness == 0.0 and got[1].sharpness > 1000 and got[2].sharpness is None


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert tables.append_new(f"file://{tmp_path}/t", rows, ["id"]) == (2, 1)
    assert tables.append_new(f"file://{tmp_path}/t", rows, ["id"]) == (0, 3)


def test_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"event_type": "cost", "api": "x", "cost_usd": 0.5}\nnot json\n{"event_type": "stage_failed", "stage": "s"}\n')
    log = records.read_log(spark, f"file://{tmp_path}/l.jsonl")
    got = {(r.dimension, r.value): (r.n, r.cost) for r in usage.log_counts(log).collect()}
    assert got["cost_api", "x"] == (1, 0.5) and got["error_type", "unknown"] == (1, 0.0) and got["event_type", "cost"] == (1, 0.0)


def test_batch_lines(spark):
    line = '{"custom_id": "a", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "oi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}}}'
    got = records.parse_replies(spark.createDataFrame([(line,), ("{bad",)], "value string")).collect()
    assert [(r.custom_id, r.ok, r.content, r.prompt_tokens) for r in got] == [("a", True, "oi", 3)]


def test_merge_and_prune():
    assert records.merge({"a": [{"id": 1, "x": 1}], "b": {"c": 1}}, {"a": [{"id": 1, "y": 2}, {"id": 2}], "b": {"c": 2}}) == {"a": [{"id": 1, "x": 1}, {"id": 2}], "b": {"c": 2}}
    assert records.last_json('x ```json {"a": 1} ``` y ```{"b": 2}```') == {"b": 2} and records.last_json("so {\"c\": 3} ok") == {"c": 3} and records.last_json("{no}") is None
    assert records.prune({"a": None, "b": {"c": ""}, "d": [None, 1]}) == {"d": [1]}
    assert records.dump_sorted({"b": "ç", "a": 1}) == '{"a": 1, "b": "ç"}'


def test_streams_match_batches(spark, tmp_path):
    events, payments = seeded(spark)
    events.write.parquet(f"{tmp_path}/e")
    payments.write.parquet(f"{tmp_path}/p")
    e = live.read_table(spark, f"{tmp_path}/e", "obra string, id bigint, ts timestamp_ntz, text string")
    p = live.read_table(spark, f"{tmp_path}/p", "obra string, id bigint, ts timestamp_ntz, cents bigint, description string")
    for _ in range(2):
        live.drain(live.append_once(live.payment_context(e, p), f"{tmp_path}/out", ["primary_event_ref", "related_event_ref"], f"{tmp_path}/ck"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.related_event_ref, r.time_gap_seconds, r.confidence) for r in got] == [("c_1", -900, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    from spoor import cli

    (tmp_path / "_chat.txt").write_text(CHAT.split("\n", 1)[1])
    args = ["ingest", "--vault", f"file://{tmp_path}/v", "--corpus", "o", "--chat", f"file://{tmp_path}/_chat.txt"]
    for want in ('{"inserted": 8, "skipped": 0}', '{"inserted": 0, "skipped": 8}'):
        assert cli.main(args) == 0
        assert capsys.readouterr().out.strip().endswith(want)


def test_markdown():
    from spoor.operators import reports

    got = reports.to_html("# Título\n\num **dois** <b>\ntrês\n- a\n- b\n\n---")
    assert got == "<h3>Título</h3>\n<p>um <strong>dois</strong> &lt;b&gt; três</p>\n<ul><li>a</li><li>b</li></ul>\n<hr>"


def test_payment_contract(spark):
    from spoor.operators import contracts

    rows = [('{"doc_type": "PIX", "valor_centavos": "R$ 3.500,00", "confidence": 2, "descricao": " "}',), ('{"doc_type": "x", "valor_centavos": 350000, "moeda": "USD"}',), ("nada",)]
    got = [r.p for r in spark.createDataFrame(rows, "j string").select(contracts.payment("j").alias("p")).collect()]
    assert [(p.doc_type, p.valor_centavos, p.moeda, p.descricao, p.confidence) for p in got] == [("pix", 350000, "BRL", None, 1.0), ("outro", 350000, "USD", None, 0.0), ("outro", None, "BRL", None, 0.0)]


def test_ground_truth(spark):
    import json

    import pytest

    from spoor.sources import truth

    whole = {
        "obra_real": {"nome": "n", "contratada": "c"},
        "canal": {"id": "1", "tipo": "t", "parte_A": {"nome": "a", "papel": "p"}, "parte_B": {"nome": "b", "papel": "p"}},
        "contratos": [{"id": "C1", "escopo": "e", "valor_total": 10}],
        "pagamentos_confirmados": [{"valor": 3, "data": "2026-04-06"}],
    }
    t = truth.tables(spark, truth.loads(json.dumps(whole)))
    assert [t[k].count() for k in ("contracts", "paid", "pending")] == [1, 1, 0] and t["contracts"].first().valor_total == 10.0
    del whole["canal"]["parte_B"]["papel"], whole["contratos"][0]["id"]
    with pytest.raises(ValueError, match=r"canal.parte_B.papel, contratos\[0\].id"):
        truth.validated(whole)


def test_token_bucket_replays_the_loop(spark):
    """Against a bucket that is filled and emptied call by call, over bursts, ties and gaps."""
    rnd = random.Random(5)
    start, rows, at = dt.datetime(2026, 1, 1), [], 0.0
    for i in range(400):
        at += rnd.choice([0, 0, 0.5, 3, 40, 200])
        rows.append((i, rnd.choice(["a", "b"]), start + dt.timedelta(seconds=at)))
    got = {r.id: r.waited / 1e6 for r in usage.token_bucket(spark.createDataFrame(rows, "id long, endpoint string, created_at timestamp_ntz"), per_minute=6).collect()}
    for key in "ab":
        tokens, last, now = 6.0, None, 0.0
        for i, _, stamp in (r for r in rows if r[1] == key):
            arrived = (stamp - start).total_seconds()
            now = max(arrived, now)
            tokens = 6.0 if last is None else min(6.0, tokens + (now - last) * 6 / 60)
            last = now
            if tokens < 1:
                now += (1 - tokens) * 60 / 6
                tokens, last = 1.0, now
            tokens -= 1
            assert abs(got[i] - (now - arrived)) < 1e-3, i
    with pytest.raises(ValueError):
        usage.token_bucket(spark.createDataFrame(rows, "id long, endpoint string, created_at timestamp_ntz"), per_minute=0)


def test_excerpts_follow_the_rule(spark):
    """Three characters less than the measure, back to the last space and to no other white space."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\té.") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.excerpt("t", 20).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: t if len(t) <= 20 else t[:17].rsplit(" ", 1)[0] + "…" for i, t in enumerate(texts)}


def test_encoding_is_read_through_hadoop(spark, tmp_path):
    for name, content, want in (("a.txt", "olá".encode(), "utf-8"), ("b.txt", "olá mundo".encode("latin-1"), "latin-1"), ("c.txt", b"", "utf-8")):
        (tmp_path / name).write_bytes(content)
        assert chat.encoding_of(spark, f"file://{tmp_path}/{name}") == want


def test_a_file_of_neither_dialect_is_an_error_if_strict(spark):
    lines = spark.createDataFrame([("a", 1, "04/04/2026 10:00 - Ana: oi"), ("b", 1, "nada disso")], "file string, line int, value string")
    assert [r.file for r in chat.parse(lines).collect()] == ["a"]
    assert [r.file for r in chat.parse(lines.where("file = 'a'"), strict=True).collect()] == ["a"]
    with pytest.raises(Exception, match="neither dialect opens b"):
        chat.parse(lines, strict=True).collect()


def test_manifests_are_sorted_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/deep/manifest.json"
    for value in ({"b": 1, "a": {"d": "é", "c": []}}, {"z": None, "y": 2}):
        records.write_manifest(spark, path, value)
        written = (tmp_path / "deep" / "manifest.json").read_text()
        assert json.loads(written) == value and list(json.loads(written)) == sorted(value)


def test_log_lines_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("whisper", 0.5), ("vision", None)], "api string, cost double")
    for _ in range(2):
        records.append_log(records.log_records(rows, "cost", api=F.col("api"), cost_usd=F.col("cost")), f"file://{tmp_path}/log")
    (tmp_path / "log" / "bad.txt").write_text("not json\n")
    got = sorted((r.event_type, r.api, r.cost_usd) for r in records.read_log(spark, f"file://{tmp_path}/log").collect())
    assert got == sorted([("cost", "whisper", 0.5), ("cost", "vision", None)] * 2, key=lambda r: r[1])
    with pytest.raises(ValueError):
        records.log_records(rows, "cost", colour=F.col("api"))


def test_a_summary_has_no_line_ends_around_it(spark):
    """A paragraph one short of the least length is found with the line end after it, which isn't part of it."""
    said = ["x" * 79, "x" * 80, "x " * 39 + "y"]
    rows = [(f"# Narrativa: x\n\n## Sumário Executivo\n{p}\n\n## fim",) for p in said] + [(f"# Narrativa: x\n\ncurto\n\n\n{'z' * 90}",)]
    got = spark.createDataFrame(rows, "body string").select(narratives.summary("body").alias("s")).collect()
    assert [r.s for r in got] == [*said, "z" * 90]


@pytest.mark.parametrize("most", [joins.PAIRS_A_PIECE, 100])
def test_near_hashes_meet_as_classes(spark, monkeypatch, most):
    """Copies meet neither on bands nor as a broadcast table; a pair of rows is made once, also in pieces."""
    monkeypatch.setattr(joins, "PAIRS_A_PIECE", most)
    rnd = random.Random(16)
    base = [rnd.getrandbits(64) for _ in range(3)]
    made = [(i, rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 0, 0, 2, 4])))) for i in range(240)]
    rows = spark.createDataFrame([*((i, f"{h:016x}") for i, h in made), (900, None), (0, f"{made[0][1]:016x}")], "id long, h string")
    got = joins.near_hashes(rows, rows, "id", "id", "h", "h")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(transform" not in plan and "band" not in plan and plan.count("SortMergeJoin") >= 1
    want = sorted((i, f"{x:016x}", j, f"{y:016x}", (x ^ y).bit_count()) for i, x in made for j, y in made if (x ^ y).bit_count() <= 6)
    assert sorted(map(tuple, got.collect())) == want


def test_near_pool_rows_meet_in_blocks(spark):
    """Hundreds of copies, large sets, repeated places and rows without key or tokens; and no pair is listed with its tokens."""
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.sample(words, n) for n in (3, 40, 40, 1500)]
    rows = [(rnd.choice("ab"), i, " ".join(w for w in base[i % 7 % 4] if rnd.random() < (0.97 if i % 2 else 2)) + (f" z{i % 5}" if i % 3 else "")) for i in range(300)]
    rows += [(None, 900, "um dois"), ("a", 901, "  "), ("a", 902, None), ("b", 903, "só um texto"), ("b", 903, "só um texto")]
    df = spark.createDataFrame(rows, "k string, i int, x string")
    out = joins.near_pool(df, "k", "i", "x", 0.8, 50)
    got = {(r.k, r.later): (r.earlier, round(r.similarity, 9)) for r in out.collect()}
    want = {("b", 903): (903, 1.0)}
    for k in "ab":
        pool = []
        for _, i, x in sorted((r for r in rows if r[0] == k and r[1] < 900), key=lambda r: r[1]):
            t = {w for w in x.split()}
            near = [(len(t & u) / len(t | u), n, j) for n, (j, u) in enumerate(pool)]
            if near and max(near)[0] >= 0.8:
                want[k, i] = (max(near)[2], round(max(near)[0], 9))
            pool = (pool + [(i, t)])[-50:]
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan


def test_counted_edges_are_those_of_the_detectors(spark):
    """Copies of rows, which meet as one row with their number, count as they would one by one."""
    events, payments = seeded(spark)
    more = [("o", 10 + i, PAID + dt.timedelta(minutes=i % 4 - 1, days=i % 3), f"pix da serralheria e telhas, total de R$ {1000 + 250 * (i % 3)},00; sinal" if i % 2 else "sinal e saldo da serralheria, R$ 3.500,00") for i in range(36)]
    events = events.unionByName(spark.createDataFrame(more, events.schema))
    payments = payments.unionByName(spark.createDataFrame([("o", 50 + i, PAID, 350000, ("sinal da serralheria", "telhas, sinal e pix")[i % 2]) for i in range(9)], payments.schema))
    for name in detectors.DETECTORS:
        want = detectors.detect(events, payments, names=(name,)).groupBy("correlation_type", F.round("confidence", 9).alias("c")).agg(F.count("*").alias("n")).collect()
        rows = detectors.detect_counted(events, payments, names=(name,))
        got = rows.groupBy("correlation_type", F.round("confidence", 9).alias("c")).agg(F.sum("n").alias("n")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
        assert rows.count() < sum(r.n for r in want)  # fewer pairs are made than there are edges
