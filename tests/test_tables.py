"""Tables with several writers, replaced in place and migrated; digests of files; detectors as streams."""

import datetime as dt
import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from spoor.operators import detectors, narratives, reports, state
from spoor.sources import chat, digests, migrations, tables
from spoor.streaming import live


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_two_writers_insert_a_key_once(spark, tmp_path):
    """Eight threads bring overlapping keys at once: each key is there once, and the counters add up."""
    path, counts = f"file://{tmp_path}/t", []

    def write(i):
        rows = spark.range(i * 50, i * 50 + 100).select((F.col("id") % 300).alias("k"), F.lit(i).alias("writer"))
        counts.append(tables.append_new(path, rows, ["k"], f"w{i}"))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = spark.read.parquet(path)
    assert got.count() == got.select("k").distinct().count() == 300
    assert len(counts) == 8 and sum(a for a, _ in counts) == 300 and all(a + b == 100 for a, b in counts)


def test_a_replayed_epoch_writes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert tables.append_new(path, rows, ["k"], "q-0") == (2, 1)
    before = files_of(tmp_path)
    assert tables.append_new(path, rows, ["k"], "q-0") == (2, 1)
    assert files_of(tmp_path) == before
    assert tables.append_new(path, rows.limit(0), ["k"], "q-1") == (0, 0)
    assert tables.append_new(path, rows, ["k"], "q-2") == (0, 3)


def test_a_held_lock_is_named(spark, tmp_path):
    with tables.locked(spark, f"file://{tmp_path}/t"):
        with pytest.raises(TimeoutError, match="_lock is held by"):
            with tables.locked(spark, f"file://{tmp_path}/t", wait=0.3):
                pass
    with tables.locked(spark, f"file://{tmp_path}/t", wait=0.3):
        pass


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = "k long, v string, version int"
    assert tables.upsert_into(path, spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("version")), ["k"], "version", buckets=16) == 16
    before = files_of(tmp_path)
    news = spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (7, "late", 0), (900, "added", 1), (None, "no key", 1)], schema)
    touched = tables.upsert_into(path, news, ["k"], "version", buckets=99)  # the number stays what it was
    assert 0 < touched <= 4
    after = files_of(tmp_path)
    assert len({os.path.dirname(f) for f in before & after}) == 16 - touched and len({os.path.dirname(f) for f in after}) == 16
    got = {r.k: (r.v, r.version) for r in tables.read_keyed(spark, path).collect()}
    assert got == {k: ("old", 1) for k in range(200)} | {3: ("newer", 3), 900: ("added", 1), None: ("no key", 1)}
    assert tables.upsert_into(path, news.limit(0), ["k"], "version") == 0


def test_migrations(spark, tmp_path):
    """Tables of the first version become the present ones; a second time, and after a cut, nothing else happens."""
    base = f"file://{tmp_path}/v"
    spark.createDataFrame([("m1", "2026-04-04T10:00:00", "Ana", "oi"), ("m2", None, None, None)], "message_id string, timestamp_whatsapp string, sender string, content string").write.parquet(f"{base}/messages")
    spark.createDataFrame([(1, "chat")], "id long, endpoint string").write.parquet(f"{base}/api_calls")
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{base}/events")
    spark.createDataFrame([("day", 1)], "scope string, id long").write.parquet(f"{base}/forensic_narratives")
    assert migrations.migrate(spark, base, migrations.MIGRATIONS[:6]) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="scope may not be week"):
        week = spark.createDataFrame([("week", 2), (None, 3)], "scope string, id long")
        migrations.checked(week, migrations.checks("forensic_narratives", 6)).collect()
    assert migrations.migrate(spark, base) == [7, 8, 9, 10] and migrations.migrate(spark, base) == []
    assert migrations.applied(spark, base) == list(range(1, 11))
    assert migrations.checked(week, migrations.checks("forensic_narratives", 10)).count() == 2
    got = {r.message_id: r.content_hash for r in spark.read.parquet(f"{base}/messages").collect()}
    assert got == {"m1": hashlib.sha256("2026-04-04T10:00:00||Ana||oi".encode()).hexdigest()[:16], "m2": hashlib.sha256(b"||||").hexdigest()[:16]}
    assert spark.read.parquet(f"{base}/api_calls").columns == ["id", "endpoint", "latency_ms", "model", "error_type"]
    assert not tables.exists(spark, f"{base}/events") and spark.read.parquet(f"{base}/financial_records").count() == 0
    assert spark.read.parquet(f"{base}/forensic_narratives").columns == ["scope", "id", "prompt_template_hash"]
    os.rename(tmp_path / "v/messages", tmp_path / "v/messages._next")  # as if cut between the old rows and the new
    more = migrations.Migration(11, "messages", migrations.adding(extra="int"))
    assert migrations.migrate(spark, base, [*migrations.MIGRATIONS, more]) == [11]
    assert spark.read.parquet(f"{base}/messages").select("extra").count() == 2


def test_optional_filters(spark):
    rows = spark.createDataFrame([(1, "o", "done", "2026-01-01"), (2, "o", None, "2026-01-03"), (3, "p", "done", "2026-01-02"), (4, "o", "done", "2026-01-03")], "id int, obra string, status string, submitted_at string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(state.batches(rows, "o")) == [4, 2, 1] and ids(state.batches(rows, "o", "done")) == [4, 1]
    assert ids(rows.where(state.given(before=("submitted_at", "2026-01-02"), status=["done"]))) == [1]
    assert len(ids(rows.where(state.given(before=("submitted_at", None), status=None)))) == 4


def test_files_are_digested_in_chunks(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    made = {}
    for name, size in (("a.jpg", 3_000_001), ("b/c.txt", 0), ("b/d.opus", 17), ("_chat.txt", 1 << 20)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        made[name] = rnd.randbytes(size)
        (tmp_path / name).write_bytes(made[name])
    got = {r.path.split(f"{tmp_path.name}/", 1)[1]: r for r in chat.census(spark, f"file://{tmp_path}", tasks=3).collect()}
    assert {n: (r.sha256, r.size_bytes) for n, r in got.items()} == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in made.items()}
    assert got["b/d.opus"].file_type == "audio" and got["a.jpg"].file_id == f"f_{got['a.jpg'].sha256[:12]}"
    assert chat.census(spark, f"file://{tmp_path}/a.jpg").count() == 1
    sizes = [sum(s for _, s in some) for some in digests.dealt([(str(i), i) for i in range(100)], 7)]
    assert len(sizes) == 7 and max(sizes) - min(sizes) < 150 and digests.dealt([], 4) == []


def test_a_digest_holds_one_chunk():
    """A file far larger than what a task may hold: zeros that the stream makes up as it is read."""

    class Zeros:
        left, most = 5 << 30 >> 4, 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def readinto(self, buffer):
            n = min(len(buffer), self.left)
            self.left, self.most = self.left - n, max(self.most, n)
            return n

    class System:
        def open_input_stream(self, path, buffer_size):
            self.stream = Zeros()
            return self.stream

    system = System()
    digests.digest(system, "x", 1 << 20)
    assert system.stream.left == 0 and system.stream.most == 1 << 20


def test_detectors_as_streams_match_batches(spark, tmp_path):
    """Values and renegotiations over files that come in small batches, out of order by less than the lateness."""
    rnd = random.Random(7)
    start = dt.datetime(2026, 4, 1)
    at = lambda i: start + dt.timedelta(minutes=20 * i + rnd.randint(0, 15))
    value = lambda: f"{rnd.choice([900, 1000, 1500, 2000, 5000])},{rnd.choice(['00', '50'])}"
    events = [("o" if i % 3 else "p", i, at(i), f"telhado e {rnd.choice(['serralheria', 'sinal', 'porta'])}, {rnd.choice(['fechou em', 'cada'])} R$ {value()}") for i in range(120)]
    paid = [("o", i, at(2 * i), rnd.choice([90000, 100050, 200000]), "x") for i in range(60)]
    e_schema, p_schema = "obra string, id bigint, ts timestamp_ntz, text string", "obra string, id bigint, ts timestamp_ntz, cents bigint, description string"
    e, p = spark.createDataFrame(events, e_schema), spark.createDataFrame(paid, p_schema)
    for name, rows in (("e", e), ("p", p)):
        rows.orderBy("id").repartitionByRange(4, "id").write.parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: live.read_table(spark, f"{tmp_path}/{name}", schema, per_trigger=2)
    window = 6 * 3600
    streams = {
        "math": (live.math_relations(read("e", e_schema), read("p", p_schema), window, "40 hours"), detectors.math_relations(e, p, window)),
        "renegotiated": (live.contract_renegotiation(read("e", e_schema), read("e", e_schema), window, "40 hours"), detectors.contract_renegotiation(e, window=window)),
    }
    for name, (stream, batch) in streams.items():
        key = ["correlation_type", "primary_event_ref", "related_event_ref"]
        more = ["rationale"]
        live.drain(live.append_once(stream, f"{tmp_path}/{name}-out", [*key, *more], f"{tmp_path}/{name}-ck"))
        got, want = (sorted(map(tuple, rows.select(*key, "time_gap_seconds", "confidence", *more).collect())) for rows in (spark.read.parquet(f"{tmp_path}/{name}-out"), batch))
        assert got == want and len(want) > 10


def test_a_day_as_one_text(spark):
    at = lambda h, m: dt.datetime(2026, 4, 4, h, m)
    events = spark.createDataFrame(
        [
            ("o", 2, at(10, 5), "text_message", "segunda  mensagem\nlonga", ["pagamento", "material"], False),
            ("o", 1, at(9, 0), None, "primeira", ["material"], True),
            ("o", 3, at(11, 0), "document", "x" * 200, [], None),
            ("o", 4, at(12, 0), "visual_analysis", None, ["off_topic"], False),
            ("o", 5, None, "document", "sem data", ["material"], False),
        ],
        "obra string, id bigint, ts timestamp_ntz, source_type string, text string, labels array<string>, reviewed boolean",
    )
    paid = spark.createDataFrame([("o", 7, at(8, 30), 350000, "sinal"), ("o", 8, at(7, 30), 5, " "), ("p", 9, at(8, 0), 1, "x")], "obra string, id bigint, ts timestamp_ntz, cents bigint, description string")
    edges = spark.createDataFrame([("o", "MATH", "fr_7", "c_2", 0.8), ("o", "MATH", "fr_7", "c_99", 0.5), ("o", "SEMANTIC", "fr_70", "c_99", 0.9)], "obra string, correlation_type string, primary_event_ref string, related_event_ref string, confidence double")
    got = reports.daily(events, paid, edges, contractual=True).collect()
    assert [(r.obra, r.day) for r in got] == [("o", "2026-04-04")]
    assert [x for x in got[0].report.split("\n") if x] == [
        "# RDO: o, 2026-04-04",
        "## Resumo do dia",
        "- Eventos classificados: **4**",
        "- Revisados por humano: **1**",
        "- Não revisados: **3**",
        "- documentos extraídos: **1**",
        "- mensagens de texto: **1**",
        "- áudios transcritos: **1**",
        "- imagens/frames analisados: **1**",
        "- `material`: **2** (+1 secundária)",
        "- `off_topic`: **1**",
        "- `pagamento`: **1**",
        "## Comprovantes financeiros (2, total R$ 3.500,05)",
        "| 07:30 | R$ 0,05 | — |",
        "| 08:30 | R$ 3.500,00 | sinal |",
        "### `MATH` (2 total, 1 validadas)",
        "- ✅ 0.80 `fr_7` ↔ `c_2`",
        "- · 0.50 `fr_7` ↔ `c_99`",
        "## material",
        "- 09:00 [ÁUDIO] primeira",
        "- 10:05 [TEXTO] segunda mensagem longa (também em pagamento)",
        "## pagamento",
        "- 10:05 [TEXTO] segunda mensagem longa (também em material)",
    ]


def test_narratives_are_saved_once_with_their_files(spark, tmp_path):
    path, schema = f"file://{tmp_path}/n", "obra string, id long, scope string, scope_ref string, dossier_hash string, narrative_text string"
    first = spark.createDataFrame([("o", 1, "day", "2026-04-04", "h1", "um\ndois"), ("o", 2, "obra_overview", None, "h2", "tudo")], schema)
    assert narratives.save(first, path) == (2, 0) and narratives.save(first, path) == (0, 2)
    text_of = lambda name: "\n".join(r.value for r in spark.read.text(f"{path}/files/obra=o/file={name}").collect())
    assert text_of("day_2026-04-04.md") == "um\ndois" and text_of("obra_overview.md") == "tudo"
    assert narratives.save(spark.createDataFrame([("o", 3, "day", "2026-04-04", "h9", "novo")], schema), path) == (1, 0)
    assert text_of("day_2026-04-04.md") == "novo" and text_of("obra_overview.md") == "tudo"
    forced = f"file://{tmp_path}/f"
    for i, said in ((1, "velho"), (2, "forçado")):
        narratives.save(spark.createDataFrame([("o", i, "day", None, "h", said)], schema), forced, force=True)
    assert [(r.id, r.narrative_text) for r in tables.read_keyed(spark, f"{forced}/rows").collect()] == [(2, "forçado")]


def test_only_narratives_files_that_change_are_written(spark, tmp_path):
    path, schema = f"file://{tmp_path}/n", "obra string, id long, scope string, scope_ref string, dossier_hash string, narrative_text string"
    rows = [("o", i, "day", f"2026-04-{i:02}", "h", f"texto {i}") for i in range(1, 9)]
    narratives.save(spark.createDataFrame(rows, schema), path)
    written = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "n" / "files").rglob("part-*")}
    first = written()
    assert len(first) == 8 and narratives.save(spark.createDataFrame(rows, schema), path) == (0, 8) and written() == first
    narratives.save(spark.createDataFrame([*rows, ("o", 90, "day", "2026-04-03", "g", "novo")], schema), path)
    assert len(written()) == 8 and len(written().items() - first.items()) == 1
    assert [r.value for r in spark.read.text(f"{path}/files/obra=o/file=day_2026-04-03.md").collect()] == ["novo"]
    for i, said in ((5, "a"), (5, "b"), (5, "a")):  # back to what it was
        narratives.save(spark.createDataFrame([("o", i, "day", None, "h", said)], schema), f"{path}-f", force=True)
        assert [r.value for r in spark.read.text(f"{path}-f/files/obra=o/file=day.md").collect()] == [said]


def test_commands_over_a_vault(spark, tmp_path, capsys):
    """The commands that list or report what is to be done, on one small vault."""
    import json

    from spoor import cli

    base = f"file://{tmp_path}"
    make = lambda name, schema, *rows: spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}")
    make("classifications", "obra string, id bigint, source_file_id string, source_type string, source_message_id string, reasoning string, human_corrected_text string, categories string, semantic_status string, human_reviewed int",
         ("o", 1, "f1", "transcription", None, None, "corrigido", '["pagamento","material"]', "classified", 1), ("o", 2, "f2", "transcription", None, None, None, None, "pending_classify", 0))
    make("files", "file_id string, timestamp_resolved string, derived_from string, referenced_by_message string, file_type string, derivation_method string, size_bytes bigint, obra string",
         ("f1", "2026-04-06T10:00:00-03:00", None, None, "audio", "x", 9, "o"), ("f2", None, None, None, "audio", "x", 9, "o"), ("f3", None, None, None, "image", "x", 99, "o"), ("f4", None, None, None, "video", "x", 9, "o"), ("f5", None, "f6", None, "image", "ffmpeg_frame", 9, "o"), ("f6", None, None, None, "video", "x", 9, "o"))
    make("messages", "message_id string, content string, timestamp_whatsapp string", ("m", "c", "2026-04-01T09:00:00"))
    make("transcriptions", "obra string, file_id string, text string", ("o", "f1", "falado"))
    make("visual_analyses", "obra string, file_id string, analysis_json string", ("o", "f5", "{}"))
    make("documents", "obra string, file_id string, text string", ("o", "f9", ""))
    make("financial_records", "obra string, id bigint, valor_centavos bigint, data_transacao string, hora_transacao string, descricao string", ("o", 1, 350000, "2026-04-06", "11:00:00", "sinal"))
    make("correlations", "obra string, correlation_type string, primary_event_ref string, related_event_ref string, confidence double", ("o", "MATH", "fr_1", "c_1", 0.9))
    make("tasks", "id bigint, obra string, status string, depends_on string, priority int, created_at string, task_type string", (1, "o", "pending", "[]", 1, "a", "ocr"), (2, "o", "pending", "[1]", 1, "a", "ocr"))
    make("forensic_narratives", "id bigint, obra string, scope string, scope_ref string, prompt_version string, narrative_text string", (1, "o", "day", "2026-04-06", "narrator_v1", "um m_aaaa"), (2, "o", "day", "2026-04-07", "narrator_v1", "dois"))
    (tmp_path / "r.jsonl").write_text('{"id": 2, "reply": "{\\"categories\\": [\\"pagamento\\"], \\"confidence\\": 1}", "call_id": 5, "cost_usd": 0.25}\n')

    def run(*args):
        assert cli.main([*args, "--vault", base, "--corpus", "o"]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    report = run("generate-rdo", "--day", "2026-04-06", "--to", f"{base}/out")[0]["report"]
    assert "- Revisados por humano: **1**" in report and "✅ 0.90 `fr_1` ↔ `c_1`" in report and "(também em material)" in report
    assert spark.read.text(f"{base}/out").count() == report.count("\n") + 1
    assert [r["id"] for r in run("process")] == [1]
    assert [r["id"] for r in run("classify")] == [2]
    assert {r["semantic_status"]: (r["n"], r["failures"], r["cost_usd"]) for r in run("classify", "--replies", f"{base}/r.jsonl")} == {"classified": (2, 0, 0.25)}
    assert [(r["label"], r["n"]) for r in run("narrate")] == [("2026-W15", 2)]
    assert [r["file_id"] for r in run("transcribe-pending")] == ["f2"]
    assert [(r["file_id"], r["skip"], r["reason"]) for r in run("process-visual")] == [("f3", True, "too_small")]
    assert [r["file_id"] for r in run("process-videos")] == ["f4"]
