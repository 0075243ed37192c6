"""Checks and coercion of what models return, as columns: a reason where it breaks its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import money, text
from spoor.functions.text import ColumnOrName, col

# Document types, categories, required fields and markers of unhelpful analyses.
DOC_TYPES = ("pix", "ted", "doc", "boleto", "nota_fiscal", "recibo", "outro")
CATEGORIES = ("negociacao_comercial", "pagamento", "cronograma", "especificacao_tecnica", "solicitacao_servico", "material", "reporte_execucao", "off_topic", "ilegivel")
OCR_FIELDS = ("text", "word_count", "char_count", "is_document", "doc_type_hint", "confidence")
UNHELPFUL = ("nao identificado", "nao aplicavel", "nao ha atividade", "sem atividade", "nao e possivel identificar", "not identified")
RECORD = "doc_type string, valor_centavos string, moeda string, data_transacao string, hora_transacao string, pagador_nome string, recebedor_nome string, descricao string, confidence string"


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def payment(c: ColumnOrName) -> Column:
    """A model's payment JSON as a struct: unknown types are other, amounts are read as cents if whole and as
    text else, confidence is held to [0, 1], blanks are null and money is BRL by default."""
    r = F.from_json(col(c), RECORD)
    kind = F.lower(F.coalesce(r["doc_type"], F.lit("outro")))
    amount = r["valor_centavos"]
    cents = F.when(amount.rlike(r"^-?\d+$"), amount.try_cast("bigint")).when(amount.rlike(r"^-?\d+\.\d{3,}$"), F.round(amount.try_cast("double")).cast("bigint")).otherwise(money.currency_to_cents(amount))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0))))
    rest = [blank(r[f]).alias(f) for f in ("data_transacao", "hora_transacao", "pagador_nome", "recebedor_nome", "descricao")]
    return F.struct(F.when(kind.isin(*DOC_TYPES), kind).otherwise("outro").alias("doc_type"), cents.alias("valor_centavos"), F.coalesce(blank(r["moeda"]), F.lit("BRL")).alias("moeda"), *rest, sure.alias("confidence"))


def classification_fault(c: ColumnOrName, valid: tuple[str, ...] = CATEGORIES) -> Column:
    """Why a classifier's JSON is refused: its categories, one of them, or its confidence; null if it holds."""
    r = F.from_json(col(c), "categories array<string>, confidence string, reasoning string")
    n = F.size(r["categories"])
    sure = r["confidence"].try_cast("double")
    unknown = F.exists(r["categories"], lambda x: F.coalesce(~x.isin(*valid), F.lit(True)))
    return F.when(r["categories"].isNull() | ~n.between(1, 2), "categories").when(unknown, "unknown_category").when(sure.isNull(), "confidence").when(~sure.between(0, 1), "confidence_range")


def missing_fields(c: ColumnOrName, fields: tuple[str, ...] = OCR_FIELDS) -> Column:
    """The fields a model's JSON object lacks; all of them where it is no object."""
    keys = F.coalesce(F.json_object_keys(col(c)), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, fields)), keys)


def unhelpful(c: ColumnOrName) -> Column:
    t = text.inclusive_fold(c)
    hits = F.lit(0)
    for m in UNHELPFUL:
        hits = hits + t.contains(m).cast("int")
    return (hits >= 2) | ((F.length(t) < 100) & (hits >= 1))


def keyword_hits(c: ColumnOrName, words: list[str]) -> Column:
    t = text.inclusive_fold(c)
    hits = F.lit(0)
    for w in words:
        hits = hits + t.contains(text.inclusive_fold(F.lit(w))).cast("int")
    return hits


def accuracy(analyses: DataFrame, words: list[str], body: str = "body") -> DataFrame:
    """Per prompt version: samples, those that name a keyword, unhelpful ones."""
    return analyses.groupBy("version").agg(F.count("*").alias("samples"), F.count_if(keyword_hits(body, words) > 0).alias("matched"), F.count_if(unhelpful(body)).alias("unhelpful"))


def divergent(a: ColumnOrName, b: ColumnOrName, below: float = 0.3) -> Column:
    """Whether two texts, each with words, share fewer of all their folded words than that."""
    words = lambda c: F.array_distinct(F.filter(F.split(text.inclusive_fold(c), r"\s+"), lambda w: w != ""))
    one, two = words(a), words(b)
    return (F.size(one) > 0) & (F.size(two) > 0) & (text.jaccard(one, two) < below)


def divergences(analyses: DataFrame) -> DataFrame:
    """(item, first, last, divergent) of items with two analyses (item, id, body) or more: the first against the last."""
    ends = analyses.groupBy("item").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("body", "id").alias("_a"), F.max_by("body", "id").alias("_b"))
    return ends.where("first <> last").select("item", "first", "last", divergent("_a", "_b").alias("divergent"))
