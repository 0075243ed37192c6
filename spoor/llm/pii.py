"""Personal data by weak supervision: base spans by fixed patterns, further spans by a trained span classifier.

Wide patterns propose candidates for each kind, the base spans among them: what may be personal data, and much that
only looks like it (dates, versions, numbers of orders and books, numbers that fail their check, handles, hashes).
Labelers of three sorts vote on a candidate (1 for, -1 against, 0 abstaining): patterns with their checks,
gazetteers, and words of the context. Expectation-maximisation over the counts of all vote patterns in the whole
corpus estimates each labeler's reliability for each kind. The posteriors, as soft labels, train a logistic span
classifier that doesn't see the votes but the text: shape, characters, and the words around, hashed. It adds
candidates with probability of at least ``ACCEPT`` that touch no base span; base spans stay.

Kinds are those of the base and secrets (keys and tokens), which have no base.

Bounds: EM sees counts of at most 5 * 3**8 vote patterns; the classifier learns from at most ``SAMPLE`` candidates
of each kind, base and other, the same number of each wherever there are enough. Every text is searched whole.

Defined cases: a null text is empty and has no spans; very long texts are searched whole, in linear time; spans are
code points, end exclusive; repeated rows are separate rows; of overlapping additions the likeliest stays, on ties
the first to start, then the kind listed first; without candidates nothing is trained or added; an empty table gives
an empty one; other columns, whatever their names, are not read by ``report`` and pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import common

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ACCEPT = 0.9
ROUNDS = 50
AROUND = 32
SAMPLE, BUCKETS, STEPS = 2000, 4096, 150

# The base patterns. Lookbehinds and possessive repeats change no match; they keep long runs linear.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Wider patterns: what is proposed beside the base spans. All repeats are bounded or possessive.
_AT = re.compile(r"(?i)([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})\s?(?:\[|\(|\{)\s?(?:at|@)\s?(?:\]|\)|\})\s?([A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,6})")
_SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}\x20?@\x20?[A-Za-z0-9-]{1,63}(?:\x20?\.\x20?[A-Za-z0-9-]{1,63}){0,4}(?![A-Za-z0-9@-])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:])")
_DOTTED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,5}(?:(?:\.|\x20?[\[({](?:\.|dot)[\])}]\x20?)[0-9]{1,5}){2,5}(?![0-9A-Za-z])")
_LONG = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().,/-]{0,2}[0-9]){6,15}(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,256}={0,2}(?![A-Za-z0-9+/_=-])")
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ](?:1[89]|20)[0-9]{2}")
_GROUPED = re.compile(r"\(?[2-9][0-9]{2}\)?[-.\x20]{1,2}[0-9]{3}[-.\x20][0-9]{4}|00[1-9][0-9][0-9\x20.()-]{6,18}|0[0-9](?:[\x20.-][0-9]{2}){4}|0[0-9]{2,4}[\x20/-][0-9\x20-]{5,9}")
_QUAD = re.compile(r"[0-9]{1,3}(?:\x20?[\[({]?(?:\.|dot)[\])}]?\x20?[0-9]{1,3}){3}")
_PREFIXED = re.compile(r"(?:gh[pousr]_|github_pat_|AKIA|ASIA|sk-|sk_live_|xox[abprs]-|eyJ|AIza|glpat-)")

TLDS = frozenset("com org net edu gov int mil info biz io co ai app dev eu de fr es it nl be ch at uk us ca mx br ar pt pl se no fi dk ie au jp cn in ru".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "2221", "2720", "36", "35")
TRUNKS = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split())
FOR = {
    "email": re.compile(r"(?i)e-?mail|contact|correo|courriel|write|reach|send|kontakt|address"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|node|client|ping|from|login"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment|account"),
    "phone": re.compile(r"(?i)phone|\btel|call|fax|mobile|\bcell|whatsapp|contact|\bruf|appel|llam|reach|number is"),
    "secret": re.compile(r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|bearer|private"),
}
AGAINST = {
    "email": re.compile(r"(?i)git|ssh|version|commit|@media"),
    "ip": re.compile(r"(?i)version|section|chapter|release|\bv$|build|figure|table"),
    "card": re.compile(r"(?i)isbn|order|serial|tracking|invoice|\bid\b|number of|hash|key|token"),
    "phone": re.compile(r"(?i)isbn|version|order|invoice|score|range|pages?\b|\bid\b|\bdate|\bin\b|total|amount|price|eur|usd|[$€£]|serial|tracking|since|until|line|item"),
    "secret": re.compile(r"(?i)commit|sha|md5|hash|checksum|digest|uuid|https?:|path|file|revision|etag|class|import"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that don't overlap, per kind; those that fail their check are dropped."""
    out: list[tuple[str, int, int]] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base spans, for each kind."""
    out: list[tuple[str, int, int]] = []
    if "[" in text or "(" in text or "{" in text:
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if " dot " in text or " DOT " in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if "@" in text:
        out += [("email", *m.span()) for m in _HANDLE.finditer(text)]
    if ":" in text:
        out += [("ip", *m.span()) for m in _COLONS.finditer(text) if m[0].count(":") > 2 or "::" in m[0]]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _DOTTED.finditer(text)]
        out += [("card", *m.span()) for m in _LONG.finditer(text)]
        out += [("phone", *m.span()) for m in _NUMBER.finditer(text) if len(_digits(m[0])) <= 15]
        out += [("secret", *m.span()) for m in _KEY.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit() and len(set(m[0])) > 7]
    return out


LABELERS = ("base", "pattern", "check", "gazetteer", "before_for", "before_against", "after", "boundary")


def _is_address(body: str) -> bool:
    try:
        return bool(ipaddress.ip_address(body))
    except ValueError:
        return False


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """The candidate's vote pattern: its kind and a vote of each labeler."""
    body = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    d = _digits(body)
    pattern = check = gazetteer = 0
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", body.strip("])} "))[-1].lower()
        pattern = 1 if base or re.search(r"(?i)[\])}]|\bdot\b", body) else -1 if not re.search(r"@.*\.", body) else 0
        check = -1 if ".." in body or last.isdigit() else 0
        gazetteer = 1 if last in TLDS else -1
    elif kind == "ip":
        parts = [int(x) for x in re.findall(r"[0-9]+", body)]
        valid = _is_address(body) if ":" in body else len(parts) == 4 and max(parts) <= 255
        pattern = (1 if body.count(":") == 7 else 0) if ":" in body else 1 if valid and _QUAD.fullmatch(body) else -1
        check = 1 if valid else -1
        gazetteer = -1 if not valid or body.startswith(("0.", "255.")) or (":" not in body and parts[0] == 0) else 1 if ":" not in body and max(parts) > 31 else 0
    elif kind == "card":
        row = before.rstrip(" -")[-1:].isdigit() or after.lstrip(" -")[:1].isdigit()
        pattern = 1 if 15 <= len(d) <= 16 and not row and not re.search(r"[./]", body) else -1
        check = 1 if luhn(d) and not row else -1  # of numbers in a row one in ten passes by chance
        gazetteer = 1 if check > 0 and d.startswith(ISSUERS) else -1
    elif kind == "phone":
        pattern = -1 if _DATE.fullmatch(body) or "," in body or body.isdigit() else 1 if base or _GROUPED.fullmatch(body) else 0
        check = -1 if not 8 <= len(d) <= 15 or len(set(d)) < 3 or luhn(d) and len(d) > 12 else 1 if 9 <= len(d) <= 12 else 0
        lead = d[2:] if d.startswith("00") else d if base else ""
        gazetteer = 1 if lead.startswith(tuple(TRUNKS)) else -1 if d.startswith(("978", "979")) and len(d) == 13 else 0
    else:
        kinds = sum(any(c in s for c in body) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
        pattern = 1 if _PREFIXED.match(body) or re.search(r"[=:]\s*[\"']?$", before) else -1 if "/" in body or re.search(r"/$", before) else 0
        check = 1 if kinds == 3 or len(d) * 5 > len(body) and len(set(body)) > 12 else -1
        gazetteer = 1 if _PREFIXED.match(body) else 0
    apart = (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum())
    vote = (1 if base else 0, pattern, check, gazetteer, int(bool(FOR[kind].search(before))), -int(bool(AGAINST[kind].search(before))), int(bool(FOR[kind].search(after))) - int(bool(AGAINST[kind].search(after[:12]))), 1 if apart else -1)
    return f"{kind}|{','.join(map(str, vote))}"


def _expected(v: np.ndarray, n: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (in 0, 1, 2) with counts: each pattern's probability of being personal data, and per
    labeler P(vote) given no and given yes, which start from ``given`` pseudo-counts. Labelers are independent given
    the truth."""
    p = np.clip(0.5 + 0.12 * (v - 1.0).sum(axis=1), 0.05, 0.95)  # majority vote
    columns = np.arange(v.shape[1])
    table = given.copy()
    for _ in range(ROUNDS):
        for c, w in enumerate((n * (1 - p), n * p)):
            table[c] = given[c] + np.stack([np.bincount(v[:, j], w, 3) for j in columns])
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        like = np.log(np.stack([table[c][columns, v].prod(axis=1) for c in (0, 1)]) + 1e-300)
        p = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - prior) - like[1] - np.log(prior), -50, 50)))
    return p, table


def reliabilities(counts: dict[str, int]) -> dict[str, float]:
    """Each vote pattern's posterior. The kinds' common estimate, worth twenty candidates, is where each kind starts;
    a labeler that says for is held to be right somewhat more often than not."""
    if not counts:
        return {}
    keys = sorted(counts)
    v = np.array([[int(x) for x in k.split("|")[1].split(",")] for k in keys]) + 1
    n = np.array([counts[k] for k in keys], float)
    leaning = np.repeat(np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])[:, None, :], v.shape[1], axis=1)
    _, pooled = _expected(v, n, leaning)
    out = {}
    for kind in ALL_KINDS:
        rows = np.array([k.startswith(f"{kind}|") for k in keys])
        if rows.any():
            p, _ = _expected(v[rows], n[rows], 20 * pooled)
            out |= dict(zip((k for k, r in zip(keys, rows) if r), p.tolist()))
    return out


_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{str(k): "9" for k in range(10)}})


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """The hashed text features of a candidate: its shape and ends, its length, what it holds, and its neighbours."""
    body = text[start:end]
    body = body if len(body) <= 48 else body[:24] + body[-24:]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    shape, d = body.translate(_SHAPE), _digits(body)
    found = ["", shape, f"n{(end - start) // 4}", f"d{len(d)}", f"l{luhn(d) if d else ''}", f"b{before[-2:].translate(_SHAPE)}", f"a{after[:2].translate(_SHAPE)}", f"s{d[:2]}", f"e{re.split('[^a-z0-9]+', body.lower())[-1]}"]
    found += [f"r{before.rstrip(' -')[-1:].isdigit() or after.lstrip(' -')[:1].isdigit()}"] if kind == "card" else []
    found += [f"g{shape[i : i + 4]}" for i in range(len(shape) - 3)]
    found += [f"w{w}" for w in re.findall(r"\w+", before.lower())[-4:]] + [f"v{w}" for w in re.findall(r"\w+", after.lower())[:2]]
    return sorted({zlib.crc32(f"{kind}|{x}".encode("utf-8", "surrogatepass")) % BUCKETS for x in found})


def train(rows: list[tuple[list[int], float]]) -> np.ndarray:
    """The span classifier's weights, fitted on (features, posterior) by Adam's steps on the ridged logistic loss."""
    theta = np.zeros(BUCKETS)
    if not rows:
        return theta - 10
    at = np.concatenate([f for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([p for _, p in rows])
    m, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, theta[at], len(rows))))
        g = np.bincount(at, (p - y)[row], BUCKETS) / len(rows) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.2 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


_SPAN = "struct<kind:int,start:int,end:int,votes:string,features:array<int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def _clear(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span touches none of the taken ones, which are sorted and apart."""
    i = bisect_left(taken, (b,))
    return i == 0 or taken[i - 1][1] <= a


def _others(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The proposals that touch no base span."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    return [c for c in proposed(text) if _clear(taken, c[1], c[2])]


def _found(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    row = lambda c, own: {"kind": ALL_KINDS.index(c[0]), "start": c[1], "end": c[2], "votes": votes(text, *c, own), "features": features(text, *c)}
    return [row(c, True) for c in base], [row(c, False) for c in _others(text, base)]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra): arrays of (kind, start, end, votes, features)."""
    common.reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_found(t) for t in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], _SPAN_TYPE), pa.array([x for _, x in found], _SPAN_TYPE)], ["doc_id", "base", "extra"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, base array<{_SPAN}>, extra array<{_SPAN}>")


def classifier(found: DataFrame) -> np.ndarray:
    """Train on the vote patterns of all candidates and a bounded sample of their features."""
    each = found.select(F.explode(F.concat("base", "extra")).alias("c"), F.size("base").alias("own"), F.xxhash64("doc_id", "base.start", "extra.start").alias("h")).select("c.*", "h")
    counts = {r.votes: r.n for r in each.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = reliabilities(counts)
    sort = lambda v: v.split(",")[0]  # noqa: E731  (kind, and whether it is a base span)
    share = F.lit(1 << 20)
    for k in {sort(v) for v in counts}:
        n = sum(c for v, c in counts.items() if sort(v) == k)
        share = F.when(F.split_part("votes", F.lit(","), F.lit(1)) == k, F.lit(int(min(1.0, 4 * SAMPLE / n) * (1 << 20)))).otherwise(share)
    own = F.xxhash64("h", "start", F.lit("pii"))
    some = each.where(F.pmod(own, F.lit(1 << 20)) <= share)  # four times as many as needed, whatever the corpus
    by = Window.partitionBy(F.split_part("votes", F.lit(","), F.lit(1))).orderBy(own, "start", "votes")
    taken = some.withColumn("k", F.row_number().over(by)).where(F.col("k") <= SAMPLE).select("votes", "features").collect()  # 9 * SAMPLE rows at most
    return train(sorted((r.features, posterior[r.votes]) for r in taken))


def _likely(spans: list[tuple[int, int, int, list[int]]], theta: np.ndarray) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, features) those that the classifier accepts; of overlapping ones the likeliest."""
    ranked = sorted((-1 / (1 + np.exp(-theta[f].sum())), a, k, b) for k, a, b, f in spans)
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for p, a, k, b in ranked:
        if -p >= ACCEPT and _clear(taken, a, b):
            out.append((k, a, b))
            insort(taken, (a, b))
    return sorted(out)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans with what the classifier adds; by kind, then start."""
    found = common.cut(candidates(docs), "pii")
    sent = docs.sparkSession.sparkContext.broadcast(classifier(found))  # BUCKETS floats
    span = "array<struct<kind:int,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = sent.value
        for b in batches:
            more = [[{"kind": k, "start": a, "end": e} for k, a, e in _likely([(c["kind"], c["start"], c["end"], c["features"]) for c in x], theta)] if x else [] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "base", "more"])

    place = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    places = found.select("doc_id", F.array_sort(F.transform("base", place)).alias("base"), "extra")
    both = places.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, base {span}, more {span}")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def _joined(spans: Column | str) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secrets, n_spans): the counts and the digest are
    of the base spans; spans are all of them, secrets last, and n_spans counts them; secrets are once more apart."""
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint) as n_{name}") for k, name in enumerate(KINDS)]
    secrets = F.filter("spans", lambda s: s["kind"] >= len(KINDS))
    return detect(docs).select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), _joined(secrets).alias("secrets"), F.size("spans").cast("long").alias("n_spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The base digest of a text's spans, as the report gives it."""
    ordered = sorted((KINDS.index(k), a, b) for k, a, b in spans)
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in ordered).encode()).hexdigest()


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    The classifier is trained on a first pass; the second finds each row's spans again, without the labelers, and
    masks them, so whole rows flow through without a join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier(common.cut(candidates(docs), "pii")))  # BUCKETS floats
    at = docs.columns.index("text")

    def mask(text: str | None, theta: np.ndarray) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        extra = _others(text, base)
        more = _likely([(ALL_KINDS.index(k), a, b, features(text, k, a, b)) for k, a, b in extra], theta) if extra else []
        spans = sorted([(a, b, ALL_KINDS.index(k)) for k, a, b in base] + [(a, b, k) for k, a, b in more])
        parts, end = [], 0
        for a, b, kind in spans:
            if b > end:
                parts += [text[end : max(a, end)], f"[{ALL_KINDS[kind].upper()}]"]
                end = b
        return "".join([*parts, text[end:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pa.array([mask(t, sent.value) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), column)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
