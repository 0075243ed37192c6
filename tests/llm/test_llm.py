"""The corpus operators against brute force, round trips and held-out accuracy, and on odd tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spoor.llm import boosting, common, decontamination, langid, lm, packing, pii, quality, simhash, token_counts, token_files, toxicity
from spoor.llm.encoder import IdEncoder, encoder, vocabulary

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the cat sat on the mat and the dog sat on the rug all day long in the sun", "en", "a"),
    (1, "the cat sat on the mat and the dog sat on the rug all day long in the sun", "en", "a"),
    (2, None, None, None),
    (3, "", "en", None),
    (None, "mail a@b.com or call +1 (988) 555-2485 now", "en", "b"),
    (None, "another row without an id, of other words", None, "b"),
    (4, "   \n\t ", "fr", "a"),
    (5, "1234 5678 !!! ???", "en", "a"),
    (6, "x" * 50_000, "en", "a"),
    (7, "palavra " * 30_000, "pt", "a"),
    (8, "日本語 текст <|endoftext|> é\x00\x1c end", "xx", "a"),
]
CLASH = ("row", "fp", "h", "k_id", "words", "t", "score", "spans", "part", "ids", "base", "kept", "digest")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def low(t):
    return (t or "").translate(LOWER)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1


def brute_fingerprint(t):
    w = words(low(t))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    n = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(grams))


def components(fps, distance=2):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == components(fps)


def test_simhash_links_chains(spark, monkeypatch):
    rnd = random.Random(2)
    fps = {}
    for k in range(12):  # chains of steps of two bits or fewer
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps[rnd.randrange(10**6)] = x
            for b in rnd.sample(range(64), rnd.randint(0, 2)):
                x ^= 1 << b
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(i, 0, signed(v)) for i, v in fps.items()], "doc_id long, h long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows.withColumn("text", F.lit(""))).collect()}
    assert got == components(fps)


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [r.doc_id for r in kept.collect()]
    assert rows.count(1) == 1 and 2 in rows and 3 not in rows and rows.count(None) == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


# 2


def brute_spans(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rnd = random.Random(1)
    cases = ["a@b.c@d.e x@y", "@a.b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.4567.8.9.1.2", "0001.2.3.4", "é@b.c ü+49 30 123456-78", "x@y.z@w.q", "+12345678+1234567890"]
    cases += ["".join(rnd.choice("a1.@+- ()4é") for _ in range(rnd.randint(1, 60))) for _ in range(5000)]
    assert all(sorted(pii.base_spans(t)) == sorted(brute_spans(t)) for t in cases)


def test_pii(docs, texts):
    for r in pii.report(docs).collect():
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == pii.digest(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in want) for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_weak_supervision():
    yes, no = "phone|0,1,1,0,1,0,0,1", "phone|0,-1,-1,0,0,-1,0,1"
    counts = {"phone|1,1,1,1,1,0,0,1": 300, yes: 400, "phone|0,0,1,0,1,0,0,1": 60, no: 700, "phone|0,-1,0,0,0,-1,0,1": 300}
    p = pii.reliabilities(counts)
    assert p[yes] > 0.9 > 0.1 > p[no]
    assert pii.reliabilities({}) == {} and pii._likely([(3, 0, 9, [1, 2])], pii.train([])) == []


def planted(n, seed):
    """Texts with personal data that the base patterns miss (want) and with what only looks like it (decoys)."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    say = lambda: " ".join(rnd.choices("the house on hill was sold to our friend with great care and joy".split(), k=rnd.randint(3, 9)))
    name = lambda: rnd.choice(["anna", "j.smith", "rui", "marie", "otto99"])
    host = lambda: rnd.choice(["mail", "post", "example", "corp-x"])
    wants = [
        lambda: ("email", rnd.choice(["write to", "e-mail", "contact"]), f"{name()} [at] {host()} [dot] {rnd.choice(['com', 'org', 'de'])}"),
        lambda: ("email", "send it to", f"{name()} at {host()} dot {rnd.choice(['com', 'net'])}"),
        lambda: ("phone", rnd.choice(["call", "phone", "tel"]), f"({rnd.randint(201, 989)}) {rnd.randint(200, 989)}-{d(4)}"),
        lambda: ("phone", rnd.choice(["reach us, phone", "mobile"]), f"{rnd.randint(201, 989)}-{rnd.randint(200, 989)}-{d(4)}"),
        lambda: ("secret", "token =", '"' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '"'),
    ]
    decoys = [
        lambda: (None, "on", f"20{rnd.randint(10, 24)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}"),
        lambda: (None, "version", f"{rnd.randint(1, 9)}.{rnd.randint(10, 99)}.{rnd.randint(300, 999)}.{d(2)}"),
        lambda: (None, "invoice", d(9)),
        lambda: (None, "ISBN", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
        lambda: (None, "total", f"{rnd.randint(1, 9)},{d(3)},{d(3)}"),
        lambda: (None, rnd.choice(["parts", "records"]), f"{rnd.choice('45')}{d(15)} {rnd.choice('45')}{d(15)}"),
        lambda: (None, "commit", "".join(rnd.choice("0123456789abcdef") for _ in range(40))),
    ]
    rows, want = [], {}
    for i in range(n):
        parts, spans = [], set()
        for make in rnd.choices(wants, k=rnd.randint(0, 2)) + rnd.choices(decoys, k=rnd.randint(0, 2)):
            kind, cue, body = make()
            before = f"{say()} {cue} "
            at = sum(len(x) + 1 for x in parts) + len(before)
            quote = body.startswith('"')
            parts.append(before + body)
            if kind:
                spans.add((kind, at + quote, at + len(body) - quote))
        rows.append((i, " ".join([*parts, say()])))
        want[i] = spans
    return rows, want


def test_pii_finds_what_the_base_misses(spark):
    """Against planted spans, with no label seen: the base finds none of them."""
    rows, want = planted(1500, 3)
    got = {}
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        assert {x for x in r.spans.split(",") if x.startswith("secret")} == set(r.secrets.split(",")) - {""}
        got[r.doc_id] = found - set(brute_spans(rows[r.doc_id][1]))
        assert r.n_spans == len(found)
    hit = sum(len(got[i] & want[i]) for i in want)
    assert hit >= 0.8 * sum(map(len, want.values())) and hit >= 0.9 * sum(map(len, got.values()))
    assert not any(k == "card" for spans in got.values() for k, _, _ in spans)  # numbers in a row, some of which pass the check
    assert not any(set(brute_spans(t)) & want[i] for i, t in rows)


def test_pii_likeliest_of_overlapping_spans():
    theta = np.zeros(pii.BUCKETS)
    theta[:4] = [3, 5, 4, -1]
    assert pii._likely([(3, 0, 10, [0]), (2, 5, 20, [1]), (0, 18, 25, [2]), (1, 30, 40, [3]), (4, 20, 22, [0])], theta) == [(2, 5, 20), (4, 20, 22)]


def test_pii_odd(odd, empty):
    assert pii.report(odd).count() == len(ODD)
    masked = pii.redact(odd)
    assert masked.columns == odd.columns
    r = masked.where("text like 'mail%'").first()
    assert r.text == "mail [EMAIL] or call [PHONE] now" and r.n_chars == len(r.text)
    assert pii.report(empty).count() == 0 and pii.redact(empty).count() == 0


# 3, 5, 10


def test_encoder(ids, texts):
    e = encoder(vocabulary())
    assert isinstance(e, IdEncoder)
    rnd = random.Random(4)
    alphabet = "ab Z09 \n\t.,'’—éß日\x1c\x85\xa0<|endoftext|>'s'll  "
    cases = [t or "" for t in texts.values()] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(3000)] + [t or "" for _, t, _, _ in ODD]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(cases)] == [ids(t) for t in cases]
    small = IdEncoder(vocabulary(), public_tokenizers.PATTERN, memo=50)
    assert small.encode(cases) == e.encode(cases)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, tmp_path, name):
    rows = spark.createDataFrame([(1, "Hello there, General Überfall"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, vocabulary(name), f"file://{tmp_path}/cache").collect()}
    if name.endswith(".json"):
        want = len(Tokenizer.from_file(vocabulary(name)).encode("Hello there, General Überfall", add_special_tokens=False).ids)
    else:
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode("Hello there, General Überfall"))
    assert got == {1: want, 2: 0}


def test_token_counts_fill_the_cache_once(spark, odd, empty, ids, tmp_path):
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_counts.token_counts(odd, vocabulary(), cache).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, *_ in ODD)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in ODD})
    assert token_counts.token_counts(empty, vocabulary(), f"file://{tmp_path}/none").count() == 0


def test_blocks_round_trip():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 63, 511, 512, 513, 5000):
        for high in (1, 2, 255, 50_257, 1 << 32):
            x = rnd.integers(0, high, n, np.uint64).astype("<u4")
            assert (token_files.unpack_ids(token_files.pack_ids(x)) == x).all()
    steep = np.array([7] * 500 + [2**32 - 1] * 12 + [0] * 3, "<u4")
    assert (token_files.unpack_ids(token_files.pack_ids(steep)) == steep).all()


def test_token_files(docs, texts, ids, odd, empty, tmp_path, monkeypatch):
    got = {r.doc_id: r for r in token_files.round_trip(docs, f"file://{tmp_path}/f", vocabulary()).collect()}
    start = 0
    for i in sorted(texts):
        want = ids(texts[i]) + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), crc(want))
        start += len(want)
    rows = token_files.round_trip(odd, f"file://{tmp_path}/o", vocabulary()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert sorted(r.ids_crc32 for r in rows) == sorted(crc(ids(t) + [2]) for _, t, *_ in ODD)
    assert token_files.round_trip(empty, f"file://{tmp_path}/e", vocabulary()).count() == 0


def packed(pieces, want, window=1024):
    """Check pieces (rows) against want, a list of (doc_id, ids); returns padding."""
    sequences, parts = defaultdict(list), Counter()
    for p in pieces:
        sequences[p.sequence_id].append(p)
        parts[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
    for doc, x in want:
        for p in sorted((p for p in parts if p[0] == doc and p[4] == len(x)), key=lambda p: p[1]):
            if crc(x[p[1] : p[1] + p[2]]) == p[3]:
                parts[p] -= 1
    assert not +parts
    return padding


def test_packing(docs, texts, ids, odd, empty):
    got = packing.pack(docs, vocabulary()).collect()
    padding = packed(got, [(i, ids(t) + [0]) for i, t in texts.items()])
    assert padding <= 0.01 * sum(p.length for p in got)
    by = defaultdict(list)
    for p in got:
        by[p.doc_id].append((p.start, p.length))
    for i, t in texts.items():
        at = 0
        for start, n in sorted(by[i]):
            assert start == at
            at += n
        assert at == len(ids(t)) + 1
    packed(packing.pack(odd.coalesce(1), vocabulary()).collect(), [(i, ids(t) + [0]) for i, t, *_ in ODD])
    assert packing.pack(empty, vocabulary()).count() == 0


def test_packing_merges_in_rounds(docs, texts, ids, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    got = packing.pack(docs.repartition(11), vocabulary(), most_open=2, keep_ids=True)
    rows = got.collect()
    packed(rows, [(i, ids(t) + [0]) for i, t in texts.items()])
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in rows)


# 4


def brute_quality(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    hit = {k for v in windows.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality(docs, texts, odd, empty):
    for table, want in ((docs, [(i, t) for i, t in texts.items()]), (odd, [(i, t) for i, t, *_ in ODD])):
        got = sorted((r.doc_id or 0, *r[1:7]) for r in quality.report(table).collect())
        assert got == sorted((i or 0, *brute_quality(t)) for i, t in want)
    assert quality.report(empty).count() == 0
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == []


def test_cascade_order_changes_nothing(docs):
    named = quality.rules()
    m = quality.measures(docs.select("doc_id", "text"))
    orders = [list(named), list(named)[::-1]]
    a, b = ({r.doc_id: r.k for r in m.select("row.doc_id", quality.cascade(named, o).alias("k")).collect()} for o in orders)
    assert a == b and 0 < sum(a.values()) < len(a)
    assert sorted(quality.order(docs, named)) == sorted(named) and quality.order(docs.limit(0), named) == list(named)


def test_cascade_keeps_what_every_rule_lets_pass(docs):
    kept = {r.doc_id for r in quality.report(docs).collect() if r.kept}
    assert {r.doc_id for r in quality.keep(docs).collect()} == kept and kept


def test_order_is_settled_by_what_rules_read(docs):
    named = quality.rules()
    first = quality.order(docs, named)
    assert all(quality.order(docs, named) == first for _ in range(4))
    cost = quality.costs(docs.select("text"), named)
    assert cost[quality.REPEATED] > cost["letterless_words"] > cost["exclamations"] > cost["few_words"] == cost["symbols"] > 0
    seconds = quality.timed(docs.select("text").limit(200), named)
    assert seconds[quality.REPEATED] > seconds["few_words"]


def test_dear_rules_go_back(spark):
    """An expensive rule that stands first and rejects as much as a cheap one goes behind it, time after time."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)], "doc_id long, text string")
    dear = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0), lambda a, x: a + F.length(F.concat("t", x.cast("string"))) % 7) > 180
    named = {"dear": dear, "cheap": F.col("word_chars") % 2 == 0, "none": F.col("n_words") < 0, quality.REPEATED: quality.rules()[quality.REPEATED]}
    for _ in range(5):
        assert quality.order(rows, named)[0] == "cheap"


def test_rejection_is_counted_among_what_is_left(spark):
    rows = spark.createDataFrame([(i, "a " * (30 + i)) for i in range(100)], "doc_id long, text string")
    named = {"most": F.col("n_words") < 120, "same": F.col("n_words") < 110, "few": F.col("n_words") > 125, quality.REPEATED: F.lit(False)}
    got = quality.order(rows, named)
    assert got[0] == "most" and got.index("few") < got.index("same")


def test_cascade_runs_no_python(docs):
    plan = quality.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# 6, 7, 8


def test_langid(docs, odd, empty):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.report(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    got = langid.report(odd).collect()
    assert len(got) == len(ODD) and all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4, 5))
    assert langid.report(empty).count() == 0
    kept = langid.keep_accepted(odd)
    assert kept.columns == odd.columns and not {2, 3, 4, 5} & {r.doc_id for r in kept.collect()}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.report(unlabelled).collect()} == {"und"}


def test_letters():
    assert all(map(langid.has_letter, ["a", "1é", "日", "ﬁ", "ª"])) and not any(map(langid.has_letter, [None, "", "½ ² ① 17", "Ⅷ", "_-!"]))


def brute_grams(text):
    raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text) + b" "
    out = Counter()
    for n, factor in zip((2, 3, 4), langid._FACTORS):
        for i in range(len(raw) - n + 1):
            out[int.from_bytes(raw[i : i + n], "big") * factor % 2**32 >> 18] += 1
    return out


def test_grams():
    rnd = random.Random(1)
    for _ in range(50):
        text = "".join(rnd.choice("aBé ñ9-日") for _ in range(rnd.randint(0, 80))).encode()
        got = langid.grams(text)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(brute_grams(text))


def test_foreign_texts_are_rejected(spark, docs):
    """Other scripts and languages, code and noise; texts of known languages stay, short ones too."""
    rnd = random.Random(2)
    foreign = ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "Příliš žluťoučký kůň úpěl ďábelské ódy a zvíře se dívalo přes řeku", "for (int i = 0; i < n; ++i) { x[i] += buf[(j << 2) ^ 0x7f]; } return xs.map(f)?;", "İstanbul'da yaşayan kişiler genellikle vapurla karşıya geçerler"]
    rows = [(i, " ".join(rnd.sample(t.split(" "), len(t.split(" "))) if " " in t else [t] * 2)) for i, t in enumerate(foreign * 20)]
    rows += [(1000 + i, "".join(rnd.choice("qwxzkjvbghpfy") for _ in range(rnd.randint(60, 200)))) for i in range(100)]
    known = docs.where("length(text) > 40").select("doc_id", F.substring("text", 1, 200).alias("text"))
    model = langid.fit(docs.where(common.remainder("doc_id", 5) != 0))
    odd = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sum(not r.accepted for r in odd) >= 0.9 * len(odd)
    own = langid.predict(known, model).collect()
    assert sum(r.accepted for r in own) >= 0.97 * len(own)


def test_samples_are_bounded(spark):
    """One id a hundred thousand times, and as many rows without an id: neither none nor all of them."""
    for ids in (F.lit(34), F.lit(None).cast("long"), F.col("id")):
        rows = spark.range(100_000).select(ids.alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("lang"))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "PER_LANG", 50)
            seen = []
            m.setattr(langid, "train", lambda counts, y, langs: seen.append((len(counts), Counter(y.tolist()))))
            langid.fit(rows)
            assert seen == [(100, {0: 50, 1: 50})]
        labels = spark.createDataFrame([(34, 1), (35, 0)] if ids is not None else [], "doc_id long, toxic int")
        got = toxicity.sample(rows.withColumn("doc_id", F.lit(34)).union(rows.withColumn("doc_id", F.lit(35)).limit(70)), labels, most=60)
        assert {r.toxic: r["count"] for r in got.groupBy("toxic").count().collect()} == {1: 60, 0: 60}


def test_gram_pieces(monkeypatch):
    text = ("Está é " * 300).encode()
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (langid.grams(text) == whole).all()


def lm_segments(low):
    """The texts between the bytes after which a hash of the last gram is zero; the last one with the end's mark."""
    p, out, start = b"B" * lm.ORDER + low + b"A", [], lm.ORDER
    for k in range(lm.ORDER, len(p)):
        gram = int.from_bytes(p[k - lm.ORDER : k + 1], "big")
        if k == len(p) - 1 or gram * 0x9E3779B97F4A7C15 % 2**64 >> 64 - (lm.SEGMENT.bit_length() - 1) == 0:
            out.append((start, k + 1))
            start = k + 1
    return p, out


def brute_lm(rows):
    """The base, and matching over the same counts without tables, joins or hashes; rows: (id, text)."""
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*words(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    contexts = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    edges = Counter()
    for t in train:
        p, segments = lm_segments(low(t).encode())
        for k in range(lm.ORDER, len(p)):
            contexts[lm.ORDER][p[k - lm.ORDER : k]][p[k]] += 1
        texts = [p[a:b] for a, b in segments]
        edges.update(zip([None, *texts], texts))
    for o in range(lm.ORDER - 1, -1, -1):
        for history, symbols in contexts[o + 1].items():
            contexts[o][history[1:]].update(dict.fromkeys(symbols, 1))
    grown = defaultdict(dict)
    for (before, own), c in edges.items():
        grown[before][own] = c

    place = lambda n, kinds: (n.bit_length(), min(kinds.bit_length(), 9))

    def weights(some):
        """By classes of occurrences and kinds: what leaving out each occurrence in turn says of escapes."""
        seen = defaultdict(lambda: [0, 0, 0, 0])
        for c in some:
            n = sum(c.values())
            for x in c.values():
                if n > 1:
                    kinds = len(c) - (x == 1)
                    at = seen[place(n - 1, kinds)]
                    for i, v in enumerate(((x == 1) * x, x, x * (n - 1), x * kinds)):
                        at[i] += v
        rate = lambda new, times: (new + 0.5) / (times + 1)
        return {k: rate(new, times) / (1 - rate(new, times)) * n / kinds for k, (new, times, n, kinds) in seen.items()}

    of_context = [weights(c.values()) for c in contexts]
    of_edge = {True: weights([grown[None]]), False: weights([c for b, c in grown.items() if b is not None])}
    weight = lambda known, c: known.get(place(sum(c.values()), len(c)), 1.0)

    def log(history, symbol):
        gone, escape = set(), 0.0
        for o in range(lm.ORDER, -1, -1):
            whole = contexts[o][history[lm.ORDER - o :]]
            c = {a: k for a, k in whole.items() if a not in gone}
            if not c:
                continue
            kinds = weight(of_context[o], whole) * len(c)
            total = sum(c.values()) + kinds
            if symbol in c:
                return escape + math.log10(c[symbol] / total)
            escape += math.log10(kinds / total)
            gone |= set(c)
        return escape - math.log10(lm.SYMBOLS - len(gone))

    def score(t):
        p, segments = lm_segments(low(t).encode())
        out, before = 0.0, None
        for a, b in segments:
            leaving, own = grown.get(before, {}), p[a:b]
            kinds = weight(of_edge[before is None], leaving) * len(leaving)
            both = sum(leaving.values()) + kinds
            if own in leaving:
                out += math.log10(leaving[own] / both)
            else:
                out += (math.log10(kinds / both) if leaving else 0) + sum(log(p[k - lm.ORDER : k], p[k]) for k in range(a, b))
            before = own
        return out

    def scored(t):
        w = [*words(low(t)), None]
        return len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), score(t)

    return scored


@pytest.mark.parametrize("most", [40, 0, None])
def test_lm(spark, monkeypatch, most):
    """Whatever the table holds, the scores are those of all contexts and edges."""
    rnd = random.Random(8)
    made = [(i, " ".join(rnd.choices(["alpha", "alphabet", "beta", "Gamma", "delta", "é", "ção", "x"], k=rnd.choice([0, 3, 25, 120])))) for i in range(60)]
    made += [(i + 100, t) for i, t in made[:20]] + [(None, None), (None, "nunca visto"), (70, "nunca visto"), (7, "alpha\0"), (7, "alpha\0"), (7, "alpha"), (80, "x" * 300), (81, "ABAB" * 30)]
    clash = {c: F.lit(1) for c in ("word", "gram", "c", "row", "rare", "segs", "segment", "seg", "s", "n", "kinds")}
    rows = spark.createDataFrame(made, "doc_id long, text string").withColumns(clash)
    for name, value in (("LISTED", most), ("FREQUENT", 3)) if most is not None else ():  # else as registered
        monkeypatch.setattr(lm, name, value)
    scored = brute_lm(made)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.report(rows).collect())
    want = sorted(((-1 if i is None else i), *scored(t)) for i, t in made)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 1e-3, (a, b)


def test_lm_odd(odd, empty):
    scored = brute_lm([(i, t) for i, t, *_ in ODD])
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.score, 2)) for r in lm.report(odd).collect())
    want = sorted((i or 0, *(lambda s: (s[0], s[1], round(s[4], 2)))(scored(t))) for i, t, *_ in ODD)
    assert len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 0.02 + 1e-4 * abs(b[3]) for a, b in zip(got, want))
    assert lm.report(empty).count() == 0
    held = odd.where("doc_id = 7").withColumn("doc_id", F.lit(17))  # crc32 modulo 7 is 2: no training rows at all
    r = lm.report(held).first()
    assert r.held_out and (r.n_known, r.train_tokens) == (0, 0) and abs(r.score + 240_001 * math.log10(lm.SYMBOLS)) < 1


def test_lm_tells_copies_apart(docs, texts):
    """Held-out texts that stand in the training rows, be it once, cost less a byte than nearly all other held-out ones."""
    times = Counter(low(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2)
    a_byte = {r.doc_id: r.score / (len(low(texts[r.doc_id]).encode()) + 1) for r in lm.report(docs).collect() if r.held_out}
    new = sorted(s for i, s in a_byte.items() if not times[low(texts[i])])
    copies = [s for i, s in a_byte.items() if times[low(texts[i])]]
    assert copies and all(s > new[int(0.9 * len(new))] for s in copies)
    assert any(times[low(texts[i])] == 1 for i in a_byte)


def test_pieces_change_nothing(monkeypatch, texts):
    """Texts are scored, counted and cut alike in pieces of any size."""
    lows = [low(t).encode() for t in list(texts.values())[:40]] + [b"", b"", b"x" * 1000]
    grams = np.unique(np.concatenate([g for _, g, _ in lm._pieces(lm._laid(lows))]))
    table = lm.Listed(grams[::2], np.linspace(-3, -0.1, len(grams[::2])).astype(np.float32))
    segs, others = (x.to_pylist() for x in lm._of_bytes(lows, table))
    assert [[len(s) for s in segs]] == [[len(lm_segments(x)[1]) for x in lows]]
    for piece in (50, 333, 4096):
        monkeypatch.setattr(lm, "PIECE", piece)
        again, other = (x.to_pylist() for x in lm._of_bytes(lows, table))
        assert other == others and all(a.pop("s") == pytest.approx(b["s"], abs=1e-6) and a == {k: v for k, v in b.items() if k != "s"} for x, y in zip(again, segs) for a, b in zip(x, y))
        ids, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, g, _ in lm._pieces(lm._laid(lows)):
            ids, ns = lm._merged(ids, ns, g)
        assert (ids == grams).all() and ns.sum() == sum(len(x) + 1 for x in lows)


def test_listed_grams_are_found():
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 1 << 56, 3000))
    want = np.arange(len(grams[::2]), dtype=np.float32)
    known, p = lm.Listed(grams[::2], want).find(grams)
    assert (known == (np.arange(len(grams)) % 2 == 0)).all() and (p == want).all()
    assert not lm.Listed(np.zeros(0, np.int64), np.zeros(0, np.float32)).find(grams)[0].any()


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.boost(x[:400], y[:400])
    m = trees.margin(x[400:])
    assert ((m > 0) == y[400:]).mean() > 0.93
    xs, ys = boosting.isotonic(m, y[400:])
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) > 0).all()
    assert np.allclose(boosting.isotonic(np.array([1.0, 2, 3]), np.array([1.0, 0, 1]))[1][:1], 0.5)


def test_toxicity(spark, odd, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.report(docs, labels).collect()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p for t, p in held if t)
    assert hit >= 0.85 * sum(t for t, _ in held) and hit >= 0.95 * sum(p for _, p in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.score for r in toxicity.report(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.report(empty, labels.limit(0)).count() == 0


def brute_features(text, learned, stems):
    low_text = text.lower()
    ws = re.findall(r"\w+", low_text)
    n = max(1, len(ws))
    weight = lambda w: max([learned.get(w, 0.0)] + [stems.get(w[:k], 0.0) for k in (4, 5, 6, 7)])
    hits = [i for i, w in enumerate(ws) if w in learned or any(w[:k] in stems for k in (4, 5, 6, 7))]
    seeds = [i for i, w in enumerate(ws) if w in toxicity.SEED]
    either = sorted({*hits, *seeds})
    near = [any(w in toxicity.SECOND for w in ws[max(0, i - 6) : i + 7]) for i in either]
    raw = text.encode()
    mixed = re.findall(r"[^\W\d_]+(?:[0-9@$!*#.+_\-]+[^\W\d_]+)+", low_text)
    plain = [m.translate(toxicity._LEET) for m in mixed]
    share = lambda ok: sum(map(ok, raw)) / max(1, len(raw))
    return [len(seeds), len(seeds) / n, len(hits), len(hits) / n, len({ws[i] for i in hits}), sum(weight(ws[i]) for i in hits), max([0.0] + [weight(ws[i]) for i in hits]), sum(near) / max(1, len(near)),
            share(lambda c: 65 <= c <= 90), raw.count(b"!") / n, share(lambda c: 33 <= c <= 126 and not chr(c).isalnum()), len(mixed) / n, sum(m in learned or m in toxicity.SEED for m in plain), math.log1p(len(ws))]


def test_toxicity_features():
    rnd = random.Random(7)
    learned, stems = {"vile": 3.0, "idiot": 2.6}, {"rott": 2.9, "stink": 2.7}
    vocabulary_ = ["you", "idiot", "vile", "rotten", "stinker", "1d10t", "v!le", "HELLO", "tu", "é", "b@d", "fine!", "..."]
    for _ in range(300):
        t = rnd.choice([" ", "\n"]).join(rnd.choices(vocabulary_, k=rnd.randint(0, 25)))
        assert toxicity.features(t, learned, stems) == pytest.approx(brute_features(t, learned, stems))
    assert toxicity.features("", learned, stems) == toxicity.features("", {}, {}) == [0.0] * 14
    assert toxicity.features(" \n\t ", learned, stems) == [0.0] * 14


def test_toxicity_odd_rows_under_a_model(spark, odd):
    d = "/root/testdata/sf0.01"
    model = toxicity.fit(common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))
    got = [(r.doc_id, r.score) for r in toxicity.score(odd.withColumns({"x": F.lit(1), "toxic": F.lit(1), "part": F.lit(0)}), model).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got)
    blank = {s for i, s in got if i in (2, 3, 4)}
    assert blank == {float(model.score(np.zeros((1, 14)))[0])} and len({s for i, s in got if i == 1}) == 1


def test_lexicon_counts_copies_once(spark):
    bad = "you are a gruesome lizardface and everybody here knows it well"
    rows = [(i, 0, bad.replace("gruesome", f"very{i}") + " indeed", 1) for i in range(5)] + [(100 + i, 0, bad, 1) for i in range(40)]
    rows += [(200 + i, 0, f"the calm number {i} sits under tree {i * 7} and reads book {i * 13} at noon", 0) for i in range(60)]
    found = toxicity.lexicon(spark.createDataFrame(rows, "h long, part int, text string, toxic int"))
    assert "gruesome" not in found


# 9


def brute_hits(docs, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    phrases = defaultdict(set)
    for i, t in items:
        ws = w(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            phrases[tuple(ws[k : k + 10])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        ws, hit, found = w(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(ws) - n + 1):
                if p := phrases.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= p
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = brute_hits(texts.items(), items)
    assert sorted(map(tuple, decontamination.report(docs, benchmark).collect()), key=str) == want
    one, many = ({r.doc_id: (r.n_words, r.n_hit, r.spans, r["items"]) for r in decontamination.find(docs, benchmark, block_words=n).collect()} for n in (10**6, 200))
    assert one == many
    clean = decontamination.drop_contaminated(docs, benchmark, block_words=200)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want if not x[5])


def test_decontamination_of_dense_repeats(spark, monkeypatch):
    rnd = random.Random(6)
    made = [(i, " ".join(rnd.choices("abc", k=rnd.randint(0, 60)))) for i in range(60)] + [(None, None), (61, "a, b"), (61, "a, b")]
    items = [(i, " ".join(rnd.choices("abcd", k=rnd.choice([1, 3, 10, 12])))) for i in range(12)] + [(None, "c c"), (3, "!"), (4, None)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1 or t == "!"]
    d, b = spark.createDataFrame(made, "doc_id long, text string").withColumn("spans", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 500)
    assert sorted(map(tuple, decontamination.report(d, b).collect()), key=str) == brute_hits(made, items)
    assert decontamination.report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontamination.report(d, b.limit(0)).collect()} == {0}
    assert decontamination.drop_contaminated(d, b.limit(0)).count() == len(made)


def test_fm_index_finds_all():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 400)
    text[-1] = 0
    index = decontamination.FMIndex(text, 5)
    grid = np.array([[0, 1, 2], [1, 2, 3], [0, 0, 4], [4, 4, 4]])
    live, lo, hi = index.search(grid)
    at = index.locate(lo, hi)
    found = defaultdict(list)
    for k, p in zip(np.repeat(live, hi - lo), at):
        found[int(k)].append(int(p))
    for k, row in enumerate(grid):
        pattern = row[row > 0].tolist()
        want = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
        assert sorted(found[k]) == want


# pipeline


def test_pipeline_stages(spark, docs, ids, odd, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.cut(stage(spark, now, SF), name)
        if name != "packing":
            assert now.columns == docs.columns
        if name == "language_id":
            assert now.count() >= 0.97 * before.count()
        if name == "near_dedup":
            t = {r.doc_id: brute_fingerprint(r.text) for r in before.collect()}
            assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, c in components(t).items() if i == c)
        if name == "decontamination":
            bad = {x[0] for x in brute_hits([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in benchmark.collect()]) if x[5]}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == bad
        if name == "pii":
            assert now.count() == before.count() and not any(brute_spans(r.text) for r in now.collect())
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "packing":
            packed(now.collect(), [(r.doc_id, ids(r.text) + [0]) for r in before.collect()])
    assert corpus_pipeline.run(spark, SF).count() == now.count()
    by_id = lambda rows: sorted((r.doc_id for r in rows), key=lambda i: (i is None, i or 0))
    everything = by_id(odd.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
        rows = stage(spark, odd, SF).collect()
        if name == "language_id":  # null, empty, blank and letterless texts go, whatever is made of the rest
            assert not {r.doc_id for r in rows} & {2, 3, 4, 5} and set(by_id(rows)) <= set(everything)
        if name == "near_dedup":  # the repeated row once; of the wordless ones the least id
            assert by_id(rows) == [1, 2, 5, 6, 7, 8, None, None]
        if name in ("decontamination", "pii"):
            assert by_id(rows) == everything
        if name == "pii":
            assert {r.text for r in rows if r.doc_id in (2, 3)} == {None, ""}
            assert [r.text for r in rows if (r.text or "").startswith("mail")] == ["mail [EMAIL] or call [PHONE] now"]
        if name == "packing":
            assert sum(r.length for r in rows) == sum(len(ids(r.text or "")) + 1 for r in odd.collect()) and set(by_id(rows)) == set(everything)


def test_ranks_file_agrees(ids):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert e.encode_ordinary("the re-done ção 12") == ids("the re-done ção 12")
