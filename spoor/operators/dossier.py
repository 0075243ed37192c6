"""Day and corpus dossiers: statistics, samples, hints and chronologies over events and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import money, temporal, text

NO_CATEGORY, NO_DATE = "(sem_categoria)", "(sem_data)"

# Words of contracts and of renegotiation, and what categories become in a chronology.
CONTRACT_WORDS = ("sinal", "contrato", "50%", "metade", "fechar")
RENEGOTIATION_WORDS = ("renegociar", "renegociacao", "renegociação", "mudanca", "mudança", "reajuste")
PAYER, PAYEE = "Pagador", "Recebedor"
CHRONOLOGY_KINDS = {"pagamento": "pagamento", "contrato": "decisao", "cronograma": "decisao", "material": "mensagem", "servico": "mensagem"}


def category(c: text.ColumnOrName = "category") -> Column:
    return F.coalesce(F.nullif(text.col(c), F.lit("")), F.lit(NO_CATEGORY))


def statistics(events: DataFrame) -> DataFrame:
    """(obra, dimension, value, n): events by source type and by primary category, in one aggregate."""
    both = F.array(F.struct(F.lit("source_type").alias("dimension"), F.col("source_type").alias("value")), F.struct(F.lit("category").alias("dimension"), category().alias("value")))
    return events.select("obra", F.inline(both)).groupBy("obra", "dimension", "value").agg(F.count("*").alias("n"))


def daily(events: DataFrame, topics: int = 3) -> DataFrame:
    """(obra, day, n, topics): each day's events and its most frequent categories."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DATE))
    per = events.groupBy("obra", day.alias("day"), category().alias("topic")).agg(F.count("*").alias("k"))
    order = Window.partitionBy("obra", "day").orderBy(F.desc("k"), "topic")
    ranked = per.withColumn("place", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("place") <= topics, F.struct("place", "topic"))))
    return ranked.groupBy("obra", "day").agg(F.sum("k").alias("n"), F.transform(top, lambda x: x["topic"]).alias("topics"))


def overview_sample(events: DataFrame, first: int = 30, last: int = 20, days: int = 5) -> DataFrame:
    """All events of a small corpus; of a large one the first, the last, and all of its densest days."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DATE))
    dated = events.withColumn("day", day)
    sizes = dated.groupBy("obra", "day").agg(F.count("*").alias("k"))
    per = Window.partitionBy("obra")
    dense = sizes.withColumn("place", F.row_number().over(per.orderBy(F.desc("k"), "day"))).withColumn("total", F.sum("k").over(per))
    key = F.struct("ts", "id")  # rows without a time come first
    keyed = dated.withColumn("_k", key)
    edge = lambda order, n, pick: keyed.select("obra", "_k").withColumn("_r", F.row_number().over(per.orderBy(order))).where(F.col("_r") <= n).groupBy("obra").agg(pick)
    low, high = edge(F.col("_k"), first, F.max("_k").alias("_low")), edge(F.desc("_k"), last, F.min("_k").alias("_high"))  # ranks are cut before the shuffle
    joined = keyed.join(dense.select("obra", "day", "place", "total"), ["obra", "day"]).join(low, "obra", "left").join(high, "obra", "left")
    keep = (F.col("total") <= first + last) | (F.col("place") <= days) | (F.col("_k") <= F.col("_low")) | (F.col("_k") >= F.col("_high"))
    return joined.where(F.coalesce(keep, F.lit(False))).select(*events.columns, "day")


def hints(events: DataFrame, payments: DataFrame) -> DataFrame:
    """Per corpus and day: any payment, any talk of a contract in one, any of renegotiation if the day is busy."""
    paid = payments.groupBy("obra", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.lit(True).alias("p"), F.bool_or(text.contains_any(F.lower("description"), CONTRACT_WORDS)).alias("c"))
    said = events.groupBy("obra", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.bool_or(text.contains_any(F.lower("text"), RENEGOTIATION_WORDS)).alias("r"))
    both = said.join(paid, ["obra", "day"], "full")
    no = F.lit(False)
    return both.select("obra", "day", F.coalesce("p", no).alias("has_payment"), F.coalesce("c", no).alias("has_contract"), F.coalesce((F.col("n") > 10) & F.col("r"), no).alias("mentions_renegotiation"))


def labels(events: DataFrame, column: str = "labels") -> DataFrame:
    """(obra, label, primary, total, delta): counts of a label in first place and in any."""
    each = events.select("obra", F.posexplode(column).alias("place", "label"))
    out = each.groupBy("obra", "label").agg(F.count_if(F.col("place") == 0).alias("primary"), F.count("*").alias("total"))
    return out.withColumn("delta", F.col("total") - F.col("primary"))


def ledger(payments: DataFrame) -> DataFrame:
    """(obra, day, n, cents, shown) of payments by day."""
    out = payments.groupBy("obra", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return out.withColumn("shown", money.brl("cents", "R$ "))


def chronology(events: DataFrame, payments: DataFrame, most: int = 20) -> DataFrame:
    """Payments first take the room, then events by review and confidence; shown in order of time.

    events have reviewed, confidence, text, category, ts and, it may be, sender; payments may have payer and payee. Of
    more payments than there is room, the earliest.
    """
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    amount = F.concat(money.brl(F.coalesce("cents", F.lit(0)), "R$ "), F.lit(" → "), text.truthy(has(payments, "payee"), F.lit(PAYEE)))
    content = F.concat(amount, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(". "), "description")).otherwise(""))
    paid = payments.select("obra", "ts", F.lit("pagamento").alias("kind"), text.truthy(has(payments, "payer"), F.lit(PAYER)).alias("author"), content.alias("content"), F.lit(0).alias("tier"), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"), F.unix_micros(F.col("ts").cast("timestamp")).alias("c"), F.col("id").alias("d")).alias("rank"))
    kind = F.lit("mensagem")
    for name, shown in CHRONOLOGY_KINDS.items():
        kind = F.when(F.col("category") == name, shown).otherwise(kind)
    said = events.withColumn("kind", kind).where((F.col("kind") != "pagamento") & (F.length(F.trim("text")) >= 20) & F.col("ts").isNotNull())
    said = said.select("obra", "ts", "kind", F.coalesce(has(events, "sender"), F.lit("")).alias("author"), text.excerpt(F.trim("text"), 300).alias("content"), F.lit(1).alias("tier"), F.struct((-F.col("reviewed")).cast("int").alias("a"), (-F.col("confidence")).alias("b"), F.lit(0).cast("bigint").alias("c"), F.col("id").alias("d")).alias("rank"))
    placed = paid.unionByName(said).withColumn("place", F.row_number().over(Window.partitionBy("obra").orderBy("tier", "rank")))
    return placed.where(F.col("place") <= most).select("obra", temporal.br_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("time"), "kind", "author", "content", "place")


def period(events: DataFrame) -> DataFrame:
    """(obra, n, first, last, days): counts and the calendar span, both ends included."""
    out = events.groupBy("obra").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return out.select("obra", "n", temporal.br_date("lo").alias("first"), temporal.br_date("hi").alias("last"), (F.datediff("hi", "lo") + 1).alias("days"))
