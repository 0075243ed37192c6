"""The n-gram join, vector codes and the fill-in-the-middle transformation against brute force, and on odd tables."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import fill_in_middle, ngram_join, vector_codes
from spoor.llm.queries import oracle_sql, queries
from tests.llm.test_llm import CLASH, ODD, low, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit("x") for c in (*CLASH, "n", "key", "prefix", "bit", "id", "of", "seeded", "body", "bounds", "salts", "label", "v")})


# n-gram join


def shingle_set(text, width=3):
    w = words(low(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_linked(rows, percent=90):
    """Sets and components by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def near_texts(n=260, seed=3):
    """Clusters around centres, chains of small steps, a passage that half of all rows share, and copies."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(400)]
    some = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, centre, chain, out = some(40), some(90), some(150), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = list(centre)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
        elif kind == 1:
            chain[r.randrange(len(chain))] = r.choice(vocabulary)
            t = list(chain)
        elif kind == 2:
            t = some(r.randint(1, 30)) + passage + some(r.randint(0, 6))
        elif kind == 3:
            t = passage[: r.randint(36, 40)]
        elif kind == 4:
            t = some(r.randint(0, 3))
        else:
            t = out[r.randrange(len(out))].split() if out else []
        out.append(" ".join(w.upper() if r.random() < 0.1 else w for w in t))
    return out


@pytest.mark.parametrize("percent,ranked", [(90, 1 << 20), (90, 30), (80, 0), (100, 100)])
def test_ngram_join(spark, percent, ranked):
    rows = list(enumerate(near_texts()))
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, ranked=ranked)
    want = brute_linked(rows, percent)
    assert set(map(tuple, got.collect())) == want
    assert 1 < len({c for _, n, c in want if n > 30}) < len({d for d, n, _ in want if n > 30})


def test_ngram_join_odd(spark, odd):
    got = sorted(map(tuple, ngram_join.linked(odd).collect()), key=repr)
    rows = [(r[0], r[1]) for r in ODD]
    assert [(d, n) for d, n, _ in got] == sorted(((d, len(shingle_set(t))) for d, t in rows), key=repr)
    assert all(c == d for d, _, c in got)  # none of these is near another of another id
    assert ngram_join.linked(odd.limit(0)).collect() == []
    same = spark.createDataFrame([(None, "a b c d")] * 3 + [(9, "A B C D"), (7, "a b c d")] + [(None, "x y")] * 2 + [(5, ""), (4, None)], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.linked(same).collect()} == {(None, 2, 7), (9, 2, 7), (7, 2, 7), (None, 1, None), (5, 0, 5), (4, 0, 4)}


def test_ngram_join_makes_a_pair_once(spark):
    """Rows whose prefixes share runs of shingles: each pair of labels is found, and a run makes it once."""
    r = random.Random(4)
    runs = [list(range(16)) for _ in range(2)] + [sorted(r.sample(range(40), 16)) for _ in range(30)]
    at = lambda p, i: p[i] if i >= 0 else None
    rows = [(s, i, g, 150, g, at(p, i - 1), at(p, i - 2), *[0] * 8, 0) for g, p in enumerate(runs) for i, s in enumerate(p)]
    columns = ["shingle", "place", "gid", "n", "label", *ngram_join.EARLIER, *ngram_join.WORDS, "main"]
    told = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'place' else 'long'}" for c in columns))
    got = [tuple(sorted((x.la, x.lb))) for x in ngram_join.crossing(told, 90).collect()]
    may = lambda a, b: any(190 * (150 - max(a.index(s), b.index(s))) >= 90 * 300 for s in set(a) & set(b))
    assert set(got) == {(a, b) for b in range(len(runs)) for a in range(b) if may(runs[a], runs[b])}
    assert got.count((0, 1)) == 1  # by each shingle it would be eight


def test_shingles():
    for text in ("", " \t", "one", "one two", "One two three", "a b c a b c a", "é É x"):
        assert len(ngram_join.shingles(text.encode())) == len(shingle_set(text))
    assert ngram_join.shingles(b"A b\nc")[0] == ngram_join.shingles(b"a  b c")[0]
    order = ngram_join.Order.of(np.array([5, 1, 9], np.uint64), np.array([2, 7, 2]))
    assert order.first(np.array([1, 3, 5, 8, 9], np.uint64), 5).tolist() == [3, 8, 5, 9, 1]
    assert order.first(np.array([1, 3, 5, 8, 9], np.uint64), 2).tolist() == [3, 8]


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    import math

    vectors = {i: [math.floor(scale * x) for x in v] for i, v in rows}
    w = len(next(iter(vectors.values()))) // parts
    cut = {i: [v[p * w : (p + 1) * w] for p in range(parts)] for i, v in vectors.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for c in cut.values():
                held[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for e, m in zip(books[p], held, strict=True)]
    found = {i: [nearest(c[p], books[p]) for p in range(parts)] for i, c in cut.items()}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_nearest_is_exact_and_prunes():
    r = np.random.default_rng(1)
    for width in (1, 3, 8):
        book = r.integers(-300, 300, (16, width)) * r.integers(1, 9, (16, 1))
        book[5], book[9] = book[2], -book[2]  # equal entries and equal norms
        points = np.concatenate([r.integers(-2000, 2000, (400, width)), book, np.zeros((2, width), int)])
        index, distance, evaluated = vector_codes.nearest(points, book)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert len(points) <= evaluated < every.size
    assert vector_codes.nearest(np.array([[3, 4]]), np.array([[0, 0]]))[:2] == ([0], [25])


def test_vector_codes(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(16)], r.choice([None, 1, 2])) for i in range(3, 120)]
    rows += [(500 + i, rows[i][1], 1) for i in range(20)]
    bad = [(0, None, 1), (1, [1.0] * 15 + [None], 1), (2, [float("nan")] + [0.0] * 15, 2), (121, [float("inf")] * 16, None), (122, [1.0] * 8, 1)]
    got = vector_codes.compress(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()
    codes, digest = brute_codes([(i, v) for i, v, _ in rows])
    assert {g.vec_id: (g.code, g.error) for g in got} == codes and {g.codebooks_sha256 for g in got} == {digest}
    label = {i: l for i, _, l in rows}
    sums = {l: sum(codes[i][1] for i in codes if label[i] == l) for l in (None, 1, 2)}
    assert all(g.label_error == sums[label[g.vec_id]] for g in got) and len(got) == len(rows)


def test_vector_codes_odd(spark):
    schema = "vec_id long, embedding array<float>, label string, v string, code string, error long, last string, of string"
    make = lambda rows: spark.createDataFrame([(*r, "x", "y", 0, "z", "w") for r in rows], schema)
    assert vector_codes.compress(make([])).collect() == []
    assert vector_codes.compress(make([(1, None, "a"), (2, [float("nan")], "a")])).collect() == []
    few = vector_codes.compress(make([(2, [1.0, 2.0, 3.0], "a"), (1, [1.0, 2.0, 3.0], None), (None, [9.0, 9.0, 9.0], "a"), (1, [1.0, 2.0, 3.0], None)])).collect()
    assert {(r.vec_id, r.error, r.label_error) for r in few} == {(1, 0, 0), (2, 0, 0), (None, 0, 0)} and len(few) == 4
    assert {r.code[:6] for r in few if r.vec_id} == {"000000"}  # equal entries: the lowest
    assert [tuple(r)[:4] for r in vector_codes.compress(make([(1, [], "a")])).collect()] == [(1, "00" * 8, 0, 0)]
    huge = vector_codes.compress(make([(i, [3e38, -3e38] * 8, "a") for i in range(2)] + [(9, [0.0] * 16, "b")])).collect()
    assert all(r.error >= 0 for r in huge) and len(huge) == 3


def test_codes_decode():
    books = vector_codes.Codebooks(np.arange(8 * 2 * 2).reshape(8, 2, 2), 15)
    assert vector_codes.decode("00" * 7 + "01", books).tolist()[-3:] == [24, 25, 30]


# fill in the middle


@pytest.mark.parametrize("text", ["", "a", "abc", "日本語 текст é", "x" * 1500, "𝔘" * 700 + "a", "é" * 513 + "\x00"])
def test_boundaries(text):
    index = fill_in_middle.Boundaries.from_bytes(fill_in_middle.boundaries(text.encode()).to_bytes())
    assert [index.select(i) for i in range(index.count)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert 8 * (len(index.low) + len(index.high)) <= 4 * index.count + 16


def brute_middle(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (doc_id, n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, p + s + m)


def hot_rows():
    r = random.Random(2)
    texts = ["".join(r.choice("ab <PSM>é日") for _ in range(r.randint(0, 40))) for _ in range(60)]
    return [(i, r.choice(texts) if i % 3 else "a hot text < that a third of all rows have <S") for i in range(400)] + [(i, "twice") for i in range(5)] * 2


@pytest.mark.parametrize("spread", [4096, 8, 1])
def test_fill_in_middle(spark, spread):
    rows = hot_rows()
    got = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), spread=spread).withColumn("again", fill_in_middle.restored("output", "form")).collect()
    assert sorted((tuple(g)[:6] for g in got), key=repr) == sorted((brute_middle(*r) for r in rows), key=repr)
    assert sorted((g.doc_id, g.again) for g in got) == sorted(rows)
    assert all(fill_in_middle.restore(g.output.encode(), g.form).decode() == g.again for g in got)
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_digests_that_clash(spark):
    rows = hot_rows()
    weak = lambda body: F.substring(body, 1, 1).cast("binary")
    got = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_middle(*r) for r in rows), key=repr)


def test_fill_in_middle_odd(odd):
    got = fill_in_middle.transform(odd)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_middle(r[0], r[1]) for r in ODD), key=repr)
    assert fill_in_middle.report(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_fill_in_middle"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(oracle_sql()[name]).fetchall())
    assert got.columns == [d[0] for d in db.description]
