"""Narratives: which to show, what they cite, how they nest in time, and whether they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import money, temporal, text
from spoor.sources import scratch, tables

# Preference among prompt versions, markers of inference, and limits of a narrative.
PRIORITY = {"narrator_v3_1_anchoring": 100, "narrator_v3_gt": 90, "narrator_v4_adversarial": 85, "narrator_v2_1_anchoring": 70, "narrator_v2_correlations": 60, "narrator_v1": 50}
ADVERSARIAL_PRIORITY = {"narrator_v4_adversarial": 100, "narrator_v3_1_anchoring": 80, "narrator_v3_gt": 70, "narrator_v2_1_anchoring": 60, "narrator_v2_correlations": 50, "narrator_v1": 40}
MARKERS = ("sugere que", "sugere ", "possivelmente", "pode indicar", "aparenta", "ao que parece", "pode ter", "talvez")
LEAST_CHARS, MOST_CHARS = 300, 40_000
CRITICAL = ("values", "times", "opening", "length")
WARNING = ("file_ids", "names", "inference", "self_assessment")


def priority(version: text.ColumnOrName, adversarial: bool = False) -> Column:
    out = F
    for name, score in (ADVERSARIAL_PRIORITY if adversarial else PRIORITY).items():
        out = out.when(text.col(version) == name, score)
    return out.otherwise(0)


def best(narratives: DataFrame, adversarial: bool = False) -> DataFrame:
    """One narrative for each scope and reference: by prompt version, then the newest."""
    order = Window.partitionBy("obra", "scope", "scope_ref").orderBy(priority("prompt_version", adversarial).desc(), F.desc("id"))
    return narratives.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def scope_refs(narratives: DataFrame, scope: str = "day") -> DataFrame:
    return narratives.where((F.col("scope") == scope) & F.col("scope_ref").isNotNull()).select("obra", "scope_ref").distinct()


def buckets(days: DataFrame, scope: str, column: str = "day") -> DataFrame:
    """(obra, label, first, last) of the periods that hold the days."""
    label, first, last = temporal.bucket(scope, column)
    return days.select("obra", label.alias("label"), first.alias("first"), last.alias("last")).distinct()


def children(narratives: DataFrame, periods: DataFrame, child_scope: str) -> DataFrame:
    """Narratives of a scope under each period. Only days are held to the period; a period of any other
    children gets them all, as in the hierarchy it feeds."""
    c = narratives.where((F.col("scope") == child_scope) & F.col("scope_ref").isNotNull())
    if child_scope != "day":
        return periods.join(c, "obra")
    # a period's days are listed, so days meet their periods by equality
    listed = periods.withColumn("scope_ref", F.explode(F.transform(F.sequence("first", "last"), lambda d: F.date_format(d, "yyyy-MM-dd"))))
    return listed.join(c, ["obra", "scope_ref"])


def composed(kids: DataFrame, parent_scope: str) -> DataFrame:
    """(obra, label, n, input): the children of each period as the next level's input, with all they cite."""
    parts = F.array_sort(F.collect_list(F.struct("scope_ref", F.trim("narrative_text").alias("t"))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(text.cited("narrative_text")))))
    g = kids.groupBy("obra", "label").agg(F.count("*").alias("n"), parts.alias("parts"), ids.alias("ids"), F.first("scope").alias("child"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n## "), p["scope_ref"], F.lit("\n"), p["t"], F.lit("\n"))), "")
    head = F.concat(F.lit("# Período: "), F.col("label"), F.lit(f" ({parent_scope})\n# Narrativas filhas ("), F.col("n"), F.lit(" de "), F.col("child"), F.lit("):\n"))
    tail = F.when(F.size("ids") > 0, F.concat(F.lit("\n# Evidências citadas (file_ids):\n"), text.wrapped_ids(F.col("ids")), F.lit("\n"))).otherwise("")
    return g.select("obra", "label", "n", F.concat(head, body, tail).alias("input"))


# A narrative's title, closing JSON block, rule and executive summary.
TITLE = r"^#\s+Narrativa:[^\n]*\n+"
CLOSING = r"\n```json\s*\{[\s\S]*?\}\s*```\s*$"
ASSESSMENT = r"(?s)```json\s*(\{.*\})\s*```\s*$"
RULE = r"\n---\s*$"
EXECUTIVE = r"(?is)##\s*Sum[áa]rio\s+Executivo\s*\n+([^#]{80,1500}?)(?:\n\n|\n##|\z)"


def stripped(c: text.ColumnOrName) -> Column:
    """A narrative without its title, closing JSON block and rule."""
    t = F.regexp_replace(text.col(c), TITLE, "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+$", ""), CLOSING, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+$", ""), RULE, ""))


def summary(c: text.ColumnOrName, most: int = 800) -> Column:
    """The paragraph under the executive summary's heading, else the first substantial one; line ends around it go."""
    trimmed = lambda p: F.btrim(p, F.lit(" \t\r\n"))
    under = trimmed(F.regexp_extract(text.col(c), EXECUTIVE, 1))
    body = stripped(c)
    first = F.get(F.filter(F.transform(F.split(body, "\n\n"), trimmed), lambda p: F.length(p) > 80), 0)
    return F.coalesce(text.excerpt(F.nullif(under, F.lit("")), most), text.excerpt(first, most), F.substring(body, 1, most))


def self_assessment(c: text.ColumnOrName) -> Column:
    """The closing JSON block as text; null if there is none."""
    return F.nullif(F.regexp_extract(text.col(c), ASSESSMENT, 1), F.lit(""))


def checklist(narratives: DataFrame, payments: DataFrame, timeline: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Nine checks per narrative (id, body, prompt_version, assessment) against its dossier's payments
    (id, cents, payer, payee) and timeline (id, hour, file_id), and the two verdicts."""
    body = narratives.select("id", "body")
    p = payments.join(body, "id")
    has = lambda form: F.col("body").contains(form)
    forms = money.brl_forms("cents")
    paid = F.coalesce(F.exists(forms, has), F.lit(True))
    named = lambda c: F.coalesce((F.length(c) <= 4) | has(F.col(c)) | has(F.get(F.split(F.trim(c), r"\s+"), 0)), F.lit(True))
    money_side = p.groupBy("id").agg(F.bool_and(paid).alias("values"), F.bool_and(named("payer") & named("payee")).alias("names"))
    t = timeline.join(body, "id")
    hour = F.nullif(F.col("hour"), F.lit("--:--"))
    seen = F.regexp_like(F.col("body"), F.concat(F.lit(r"\b"), F.substring(hour, 1, 2), F.lit("[:h]"), F.substring(hour, 4, 2), F.lit(r"(?::\d{2}|min)?\b")))
    time_side = t.groupBy("id").agg(F.coalesce(F.bool_or(seen), F.lit(True)).alias("times"), F.count("*").alias("events"), F.count("file_id").alias("ids"), F.count_if(has(F.col("file_id"))).alias("found"))
    joined = narratives.join(money_side, "id", "left").join(time_side, "id", "left")
    yes, zero = F.lit(True), F.lit(0)
    share = F.when(F.coalesce(F.col("prompt_version"), F.lit("")).contains("adversarial"), 0.3).otherwise(0.5)
    checks = {
        "values": F.coalesce("values", yes),
        "times": F.coalesce("times", yes),
        "names": F.coalesce("names", yes),
        "file_ids": F.coalesce(F.col("found") >= share * F.col("ids"), yes),
        "inference": (F.coalesce("events", zero) < 5) | text.contains_any(F.lower("body"), markers),
        "length": F.length("body").between(LEAST_CHARS, MOST_CHARS),
        "opening": F.trim("body").startswith("# Narrativa:"),
        "closing": F.col("body").contains("---"),
        "self_assessment": F.coalesce(F.get_json_object("assessment", "$.confidence").isNotNull(), F.lit(False)),
    }
    out = joined.select("id", *(c.alias(k) for k, c in checks.items()))
    passed = F.lit(True)
    for k in CRITICAL:
        passed = passed & F.col(k)
    strict = passed
    for k in WARNING:
        strict = strict & F.col(k)
    return out.withColumn("passed", passed).withColumn("passed_strict", strict)


def cache_stats(narratives: DataFrame) -> DataFrame:
    h = F.col("prompt_template_hash")
    return narratives.groupBy("obra", "scope").agg(F.count("*").alias("total"), F.count_if(h.isNotNull()).alias("with_hash"), F.count_if(h.isNull()).alias("legacy"))


def file_name(scope: text.ColumnOrName, ref: text.ColumnOrName) -> Column:
    """The file of a narrative's text: by scope and, where it has one, reference."""
    s, r = text.col(scope), text.col(ref)
    return F.concat(s, F.when(F.coalesce(r, F.lit("")) != "", F.concat(F.lit("_"), F.regexp_replace(r, r"[^A-Za-z0-9_-]+", "-"))).otherwise(""), F.lit(".md"))


CACHE_KEYS = ["obra", "scope", "scope_key", "dossier_hash"]


def save(rows: DataFrame, path: str, force: bool = False) -> tuple[int, int]:
    """Keep narratives (obra, id, scope, scope_ref, dossier_hash, narrative_text, ...) as rows with their checks' file, and as
    files; (saved, found), the latter being those of an obra, scope, reference and dossier that were there already.

    A narrative that is there stays, with its file, unless force says that a newer id of its key takes its place. A file
    has the latest text that was saved of its scope and reference, in a folder of its own under ``files``. What each file
    shows is recorded under ``shown`` once it is there, and only files that should show something else are written;
    a writer that was lost before that writes them when it comes again. Making a file takes its time however small
    it is, so they are dealt over a stated number of tasks.
    """
    named = rows.withColumns({"file": F.concat_ws("/", "obra", file_name("scope", "scope_ref")), "scope_key": F.coalesce("scope_ref", F.lit(""))})  # no reference is one, too
    spark, table, shown = rows.sparkSession, f"{path}/rows", f"{path}/shown"
    if force:
        total = named.count()
        tables.upsert_into(table, named, CACHE_KEYS, "id")
        counts = (total, 0)
    else:
        counts = tables.append_new(table, named, CACHE_KEYS)
    with tables.locked(spark, f"{path}/files"):
        kept = tables.read_keyed(spark, table) if force else spark.read.parquet(table)
        mine = kept.join(named.select("file").distinct(), "file", "left_semi")
        texts = mine.groupBy("file").agg(F.max_by("narrative_text", "id").alias("value")).withColumn("digest", F.sha2("value", 256))
        turn = 0
        if tables.has_rows(spark, shown):
            before = spark.read.parquet(shown)
            turn = before.agg(F.max("turn")).first()[0] + 1
            texts = texts.join(before.groupBy("file").agg(F.max_by("digest", "turn").alias("digest")), ["file", "digest"], "left_anti")
        texts = scratch.cut(texts, "texts")
        if not texts.isEmpty():
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
            written = texts.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("obra"), F.split_part("file", F.lit("/"), F.lit(2)).alias("file"), "value").repartition(parts, "obra", "file")
            written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obra", "file").text(f"{path}/files")
            texts.select("file", "digest", F.lit(turn).alias("turn")).write.mode("append").parquet(shown)
    return counts
