"""Text functions as columns: normalisation, hashing, tokens, stems, similarity, truncation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def among(c: Column, words: Sequence[str]) -> Column:
    return c.isin(*words)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def truthy(*cs: ColumnOrName) -> Column:
    """The first value that is neither null nor empty, or the empty text."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))


def join_nonempty(sep: str, *cs: ColumnOrName) -> Column:
    """Values joined by sep; nulls and empty texts drop out."""
    return F.array_join(F.filter(F.array(*map(col, cs)), lambda x: x != ""), sep)


# Hashes.


def short_digest(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def cache_normalize(c: ColumnOrName) -> Column:
    """Lower case, trivial punctuation and runs of white space as one space, trimmed; null is empty."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    t = F.regexp_replace(t, r"[!?.,;:\"'()\[\]{}<>]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def cache_key(c: ColumnOrName, prompt_version: ColumnOrName | None = None, version: str = "") -> Column:
    v = col(prompt_version) if prompt_version is not None else F.lit(version)
    return short_digest(F.concat(cache_normalize(c), F.lit("||"), v))


def content_hash(timestamp: ColumnOrName, sender: ColumnOrName, content: ColumnOrName) -> Column:
    """Sixteen hex digits over timestamp, sender and content; nulls are empty."""
    return short_digest(F.concat_ws("||", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in (timestamp, sender, content))))


def prompt_hash(c: ColumnOrName) -> Column:
    return F.when(F.coalesce(col(c), F.lit("")) == "", "").otherwise(F.sha2(col(c), 256))


def corpus_digest(ids: ColumnOrName) -> Column:
    """Twelve hex digits over a group's ids in order: an aggregate."""
    return short_digest(F.array_join(F.array_sort(F.collect_list(col(ids))), ""), 12)


# Accents. The table follows from Unicode's decompositions: a letter of Latin-1 to Latin Extended-B whose
# decomposition is one ASCII letter with marks becomes that letter.
_FOLDED = {chr(i): b for i in range(0xC0, 0x250) if len(b := "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))) == 1 and b.isascii()}


def fold(c: ColumnOrName) -> Column:
    """Accents off Latin letters, composed or as combining marks."""
    return F.regexp_replace(F.translate(col(c), "".join(_FOLDED), "".join(_FOLDED.values())), r"\p{M}+", "")


# Stopwords and suffixes of the scope tokens, and their stems of high and low weight.
SCOPE_STOPWORDS = (
    "a o as os um uma uns umas e ou mas que de do da dos das em no na nos nas para por com sem ao aos pelo pela pelos pelas "
    "eu tu ele ela voces eles elas meu minha seu sua ser ter estar foi era sao esta estao tem tinha ja nao sim so muito mais "
    "menos tudo isso isto aquilo esse essa este aqui ali la agora hoje ontem amanha se aquele aquela como quando onde qual "
    "quanto quantos quantas vai vou vem va fiz faz fazer ficar pode poder entao ainda sempre nunca tao bem mal talvez ate bom "
    "boa otimo tipo coisa pessoa jeito vez hora dia pra pro te me lhe vos"
).split()
SUFFIXES = "mentos mento coes cao dades dade ados adas idos idas ada ado ida ido ando endo indo aram eram iram ar er ir ns s".split()
HIGH_STEMS = "sinal saldo metad pix comprovant parcel serralheria telh alambrad tesoura terca ripament fecha instal sub cobertur estrutur esquelet".split()
LOW_STEMS = "servico trabalh obra material pessoa equip coisa jeit parte situacao negoci".split()
NEAR_STOPWORDS = "a o as os de do da dos das e ou que no na em para com eu tu ele ela voce vc".split()
MIN_TOKEN = 3


def stem(token: Column) -> Column:
    """Off goes the first suffix that leaves at least three characters."""
    return F.regexp_replace(token, f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")


def scope_tokens(c: ColumnOrName) -> Column:
    """The set of folded, stemmed words without stopwords, as an array in order of appearance."""
    raw = F.regexp_extract_all(F.lower(fold(F.coalesce(col(c), F.lit("")))), F.lit("([a-z0-9]+)"), 1)
    kept = F.array_except(F.filter(raw, lambda t: F.length(t) >= MIN_TOKEN), F.array(*map(F.lit, SCOPE_STOPWORDS)))
    return F.array_distinct(F.filter(F.transform(kept, stem), lambda t: F.length(t) >= MIN_TOKEN))


def near_tokens(c: ColumnOrName) -> Column:
    """The set of words of two characters or more, accents kept, without the short stopword list."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9áéíóúâêôãõàç]+)"), 1)
    return F.array_except(F.filter(raw, lambda t: F.length(t) >= 2), F.array(*map(F.lit, NEAR_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; zero if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def stem_weight(token: Column) -> Column:
    return F.when(among(token, HIGH_STEMS), 1.5).when(among(token, LOW_STEMS), 0.7).otherwise(1.0)


def hamming_hex(a: ColumnOrName, b: ColumnOrName, digits: int = 16) -> Column:
    """Differing bits of two hex strings of equal length, digit by digit: 64 bits don't fit one signed cast."""
    nibble = lambda c, i: F.conv(F.substring(col(c), i + 1, 1), 16, 10).cast("int")
    total = F.lit(0)
    for i in range(digits):
        total = total + F.bit_count(nibble(a, i).bitwiseXOR(nibble(b, i)))
    return total


# Fixed value: what a truncated text ends with.
TRUNCATED = "\n\n[truncado por limite]"


def smart_truncate(c: ColumnOrName, most: int) -> Column:
    """Cut at the last paragraph, else sentence, else word that fits, and say so."""
    if most <= len(TRUNCATED):
        raise ValueError(f"at most {most} characters leave no room for the marker")
    text = col(c)
    head = F.substring(text, 1, most - len(TRUNCATED))
    paragraph = F.regexp_extract(head, r"(?s)^(.+)\n\n", 1)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?=\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    cut = F.when(paragraph != "", paragraph).when(sentence != "", sentence).when(word != "", word).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(TRUNCATED)))


# Code point ranges of emoji and decorative symbols.
EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE0F}\x{200D}]+"
)


def strip_emoji(c: ColumnOrName) -> tuple[Column, Column]:
    """The text without emoji, and how many runs of them there were."""
    return F.regexp_replace(col(c), EMOJI, ""), F.regexp_count(col(c), F.lit(EMOJI))


def excerpt(c: ColumnOrName, most: int) -> Column:
    """Texts of more than so many characters: three less, cut at the last space where there is one, with an ellipsis."""
    text = col(c)
    cut = F.regexp_replace(F.substring(text, 1, most - 3), " [^ ]*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def preview(c: ColumnOrName, most: int = 150) -> Column:
    return F.substring(col(c), 1, most)


def short_content(c: ColumnOrName, most: int = 500) -> Column:
    return F.when(F.length(col(c)) <= most, col(c))


# Fixed value: the form of citations of evidence: message, file, classification and payment ids.
CITATION = r"\b((?:m|f|c|fr)_[A-Za-z0-9]{4,12})\b"


def cited(c: ColumnOrName) -> Column:
    """The distinct ids a narrative cites, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(CITATION), 1)))


def wrapped_ids(ids: Column, per_line: int = 8) -> Column:
    """Ids joined by commas, so many a line."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(per_line))
    return F.when(F.size(ids) == 0, "").otherwise(F.array_join(F.transform(starts, lambda s: F.array_join(F.slice(ids, s + 1, per_line), ", ")), "\n"))


def inclusive_fold(c: ColumnOrName) -> Column:
    """Lower case without accents, for keyword measures."""
    return F.lower(fold(c))
