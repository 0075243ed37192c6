"""Reports as text: markdown of every day, made by Spark for all days at once, and markdown to HTML."""

from __future__ import annotations

import html
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import money, text
from spoor.operators.detectors import VALIDATED

_INLINE = ((re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), r"<em>\1</em>"), (re.compile(r"`([^`]+)`"), r"<code>\1</code>"))


def inline_html(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, to in _INLINE:
        out = pattern.sub(to, out)
    return out


def to_html(markdown: str, shift: int = 2) -> str:
    """Headings (moved down by shift, to h6 at most), lists, rules and paragraphs."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", markdown.strip()):
        lines = block.split("\n")
        while lines:
            line = lines[0]
            if m := re.match(r"(#{1,6})\s+(.*)", line):
                level = min(6, len(m[1]) + shift)
                out.append(f"<h{level}>{inline_html(m[2])}</h{level}>")
                lines = lines[1:]
            elif re.fullmatch(r"-{3,}\s*", line):
                out.append("<hr>")
                lines = lines[1:]
            else:
                items = re.match(r"[-*]\s+", line) is not None
                same = [x for x in lines[: next((i for i, x in enumerate(lines) if (re.match(r"[-*]\s+", x) is not None) != items or x.startswith("#")), len(lines))]]
                lines = lines[len(same) :]
                if items:
                    out.append("<ul>" + "".join(f"<li>{inline_html(re.sub(r'^[-*]\s+', '', x))}</li>" for x in same) + "</ul>")
                elif any(x.strip() for x in same):
                    out.append(f"<p>{inline_html(' '.join(same))}</p>")
    return "\n".join(out)


def table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a markdown table."""
    rows = df.limit(limit).collect()
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


# How sources are named in a day's report and tagged in its lists.
SOURCES = {"transcription": "áudios transcritos", "text_message": "mensagens de texto", "visual_analysis": "imagens/frames analisados", "document": "documentos extraídos"}
TAGS = {"transcription": "ÁUDIO", "text_message": "TEXTO", "visual_analysis": "IMAGEM", "document": "PDF"}
OFF_TOPIC = ("off_topic",)
ITEM = 160


def _named(c: str, names: dict[str, str]) -> Column:
    out = F
    for k, v in names.items():
        out = out.when(F.col(c) == k, v)
    return out.otherwise(F.col(c))


def day_lines(events: DataFrame, payments: DataFrame, edges: DataFrame, contractual: bool = False) -> DataFrame:
    """(obra, day, section, at, line): the lines of every corpus' report of each day that has events, in the order of section and at.

    events have obra, id, ts, source_type, text, labels (the first is primary) and reviewed; payments obra, id, ts, cents and
    description; edges their two refs, type, confidence and rationale. Sections: 0 title, 1 counts, 2 sources, 3 labels with
    what stands in second place and later, 4 payments, 5 correlations that touch the day, grouped by type with how many are
    validated, 6 events under each of their labels. contractual leaves labels off topic out of the last.
    """
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    e = events.where("ts is not null").select("obra", day, "id", "ts", F.coalesce("source_type", F.lit("transcription")).alias("source"), "text", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    p = payments.where("ts is not null").select("obra", day, "id", "ts", "cents", "description").join(e.select("obra", "day").distinct(), ["obra", "day"], "left_semi")

    def lines(rows: DataFrame, section: int, at: Column | str, line: Column) -> DataFrame:
        return rows.select("obra", "day", F.lit(section).alias("section"), (F.col(at) if isinstance(at, str) else at).alias("at"), line.alias("line"))

    text_of = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    counts = e.groupBy("obra", "day").agg(F.count("*").alias("n"), F.count_if("reviewed").alias("r"))
    out = [lines(counts, 0, F.lit(""), text_of("# RDO: ", F.col("obra"), ", ", F.col("day"), "\n\n## Resumo do dia\n"))]
    for at, (name, c) in enumerate((("Eventos classificados", F.col("n")), ("Revisados por humano", F.col("r")), ("Não revisados", F.col("n") - F.col("r")))):
        out.append(lines(counts, 1, F.lit(str(at)), text_of(f"- {name}: **", c, "**")))

    sources = e.groupBy("obra", "day", "source").agg(F.count("*").alias("n"))
    most_first = F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0")
    out.append(lines(sources, 2, text_of(most_first, F.col("source")), text_of("- ", _named("source", SOURCES), ": **", F.col("n"), "**")))

    each = e.select("obra", "day", "id", "ts", "source", "text", "labels", F.posexplode("labels").alias("place", "label"))
    labels = each.groupBy("obra", "day", "label").agg(F.count("*").alias("n"), F.count_if(F.col("place") > 0).alias("delta"))
    out.append(lines(labels, 3, "label", text_of("- `", F.col("label"), "`: **", F.col("n"), "**", F.when(F.col("delta") > 0, text_of(" (+", F.col("delta"), " secundária)")).otherwise(""))))

    paid = F.concat(F.date_format("ts", "HH:mm"), F.lit(" | "), money.brl("cents", "R$ "), F.lit(" | "), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("—")))
    out.append(lines(p, 4, text_of(F.date_format("ts", "HH:mm:ss.SSSSSS"), "|", F.lpad(F.col("id").cast("string"), 20, "0")), text_of("| ", paid, " |")))
    ledger = p.groupBy("obra", "day").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    out.append(lines(ledger, 4, F.lit(""), text_of("\n## Comprovantes financeiros (", F.col("n"), ", total ", money.brl("cents", "R$ "), ")\n")))

    refs = e.select("obra", "day", text_of("c_", F.col("id")).alias("ref")).union(p.select("obra", "day", text_of("fr_", F.col("id")).alias("ref")))
    ends = edges.select("obra", "correlation_type", "primary_event_ref", "related_event_ref", "confidence", F.explode(F.array("primary_event_ref", "related_event_ref")).alias("ref"))
    touched = ends.join(refs, ["obra", "ref"]).drop("ref").distinct()
    groups = touched.groupBy("obra", "day", "correlation_type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= VALIDATED).alias("v"))
    out.append(lines(groups, 5, "correlation_type", text_of("\n### `", F.col("correlation_type"), "` (", F.col("n"), " total, ", F.col("v"), " validadas)\n")))
    badge = F.when(F.col("confidence") >= VALIDATED, "✅").otherwise("·")
    strongest = F.format_string("%s|%09d|%s|%s", F.col("correlation_type"), (1_000_000 * (1 - F.coalesce("confidence", F.lit(0.0)))).cast("long"), F.col("primary_event_ref"), F.col("related_event_ref"))
    out.append(lines(touched, 5, strongest, text_of("- ", badge, " ", F.coalesce(F.format_string("%.2f", F.col("confidence")), F.lit("n/a")), " `", F.col("primary_event_ref"), "` ↔ `", F.col("related_event_ref"), "`")))

    shown = each.where(~F.col("label").isin(*OFF_TOPIC)) if contractual else each
    heads = shown.select("obra", "day", "label").distinct()
    out.append(lines(heads, 6, "label", text_of("\n## ", F.col("label"), "\n")))
    others = F.array_join(F.filter("labels", lambda x: x != F.col("label")), ", ")
    also = F.when(others != "", text_of(" (também em ", others, ")")).otherwise("")
    item = text_of("- ", F.date_format("ts", "HH:mm"), " [", _named("source", TAGS), "] ", text.excerpt(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), ITEM), also)
    in_time = F.format_string("%s|%s|%020d", F.col("label"), F.date_format("ts", "HH:mm:ss.SSSSSS"), F.col("id"))
    out.append(lines(shown, 6, in_time, item))
    return reduce(DataFrame.unionByName, out)


def daily(events: DataFrame, payments: DataFrame, edges: DataFrame, contractual: bool = False) -> DataFrame:
    """(obra, day, report): the lines of each day as one text, for all days at once."""
    rows = day_lines(events, payments, edges, contractual).groupBy("obra", "day").agg(F.array_sort(F.collect_list(F.struct("section", "at", "line"))).alias("lines"))
    return rows.select("obra", "day", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))


def write_daily(reports: DataFrame, path: str) -> None:
    """One folder a corpus and day, each with the report's text; days that are written again are replaced."""
    rows = reports.select("obra", "day", F.col("report").alias("value")).repartition("obra", "day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obra", "day").text(path)
