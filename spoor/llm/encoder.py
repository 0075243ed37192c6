"""Byte-level BPE ids exactly as the tokenizers library gives them, with a bounded memo of pre-tokens.

The library spends most of its time on splitting and bookkeeping. Here a text is split by the vocabulary's
published pattern, and each distinct pre-token is encoded by the library once per worker; the memo is emptied
at ``MEMO`` entries, so memory is bounded. Texts with characters beyond Latin, or with an added token's
string, go to the library whole: there its own splitter and its handling of special strings decide.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

MEMO = 600_000
#: The splitter is spelled out for code points below this; their categories are settled.
LATIN = 0x250
#: Lead bytes of all others, and separators on which libraries disagree.
_BEYOND = bytes([*range(0x1C, 0x20), *range(0xC9, 0x100)])


def splitter(pattern: str) -> str:
    """pattern with its character classes spelled out for Latin text, which the standard library matches fast."""
    chars = [chr(i) for i in range(LATIN) if not 0x1C <= i < 0x20]
    kind = {k: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN"}
    space = "".join(re.escape(c) for c in chars if c.isspace())
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{kind['L']}{kind['N']}]"), (r"\p{L}", f"[{kind['L']}]"), (r"\p{N}", f"[{kind['N']}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(old, new)
    return pattern


class IdEncoder:
    """Little-endian unsigned 32-bit ids, as bytes, for texts."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile(splitter(pattern)).findall
        self.limit = memo
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for w, i in self.tokenizer.get_vocab().items() if w.startswith(space)]] = True
        self.memo: dict[str, bytes] = {}

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        """Encode new pre-tokens. Those that open with a space stay apart when joined: an id that opens with a space opens one."""
        apart = [w for w in missing if w[0] == " " and len(w) > 1 and w[1:].isalpha()]
        if len(apart) > 64:
            joined = ["".join(apart[i : i + 512]) for i in range(0, len(apart), 512)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(apart):
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                self.memo.update(zip(apart, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
                known = set(apart)
                missing = [w for w in missing if w not in known]
        if missing:
            self.memo.update(zip(missing, self._library(missing)))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        if len(self.memo) > self.limit:
            self.memo.clear()
        get = self.memo.get
        whole: list[int] = []
        parts: list[tuple[int, list[str], list, list[int]]] = []
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw.translate(None, _BEYOND)) != len(raw) or any(a in t for a in self.added):
                whole.append(i)
                continue
            words = self.split(t)
            got = list(map(get, words))
            holes, at = [], -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                holes.append(at)
            if holes:
                parts.append((i, words, got, holes))
            else:
                out[i] = b"".join(got)
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = ids
        if parts:
            self._learn(list({words[h] for _, words, _, holes in parts for h in holes}))
        for i, words, got, holes in parts:
            for h in holes:
                got[h] = get(words[h])
            out[i] = b"".join(got)
        return out


class Library:
    """Ids from the library itself, for vocabularies that the memo doesn't fit: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(list(texts), num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self._ids(texts)]


def _splits_by_pattern(path: str) -> bool:
    """Whether the file's tokenizer is plain byte-level BPE: nothing but the published pattern before the merges."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding")


_ENCODERS: dict[str, IdEncoder | Library] = {}


def encoder(path: str) -> IdEncoder | Library:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = IdEncoder(path, public_tokenizers.PATTERN) if _splits_by_pattern(path) else Library(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs_of(texts: Sequence[str], chars: int = 1 << 20) -> list[tuple[int, int]]:
    """Slices of a batch with about so many characters each, so that memory follows texts and not row counts."""
    cuts, size, start = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            cuts.append((start, i + 1))
            size, start = 0, i + 1
    return cuts + ([(start, len(texts))] if start < len(texts) else [])
