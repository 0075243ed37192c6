"""Commands over a folder of Parquet tables (a vault): python -m spoor.cli COMMAND --vault PATH ...

What calls an outside service or a person (transcription, vision, narration, interviews, PDF rendering) isn't
here; its tables, states and reports are.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import temporal
from spoor.operators import correlations, detectors, hub, media, narratives, reports, state, usage
from spoor.sources import chat, records, tables


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Vault:
    """Tables by name under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")


def ingest(v: Vault, a: argparse.Namespace) -> dict:
    """Parse a chat export's text into messages; what is there already is skipped."""
    lines = chat.read_lines(v.spark, a.chat, chat.encoding_of(v.spark, a.chat))
    messages = chat.with_ids(chat.parse(lines, strict=True), F.lit(a.corpus)).withColumn("obra", F.lit(a.corpus))
    inserted, skipped = tables.append_new(f"{v.path}/messages", messages, ["obra", "content_hash"])
    return {"inserted": inserted, "skipped": skipped}


def correlate(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Detect correlations of a corpus anew and report them by type."""
    mine = lambda n: v.read(n).where(F.col("obra") == a.corpus)
    events = hub.events(mine("classifications"), mine("transcriptions"), v.read("files"), v.read("messages"), mine("visual_analyses"), mine("documents"))
    edges = detectors.detect(events, hub.payments(mine("financial_records")))
    v.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    edges.write.mode("overwrite").partitionBy("obra").parquet(f"{v.path}/correlations")  # this corpus's partition only
    return correlations.by_type(v.read("correlations").where(F.col("obra") == a.corpus))


def status(v: Vault, a: argparse.Namespace) -> DataFrame:
    return state.counts(v.read("tasks").where(F.col("obra") == a.corpus))


def pipeline_status(v: Vault, a: argparse.Namespace) -> DataFrame:
    return state.resumable(v.read("tasks").where(F.col("obra") == a.corpus))


def pipeline_reset(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Tasks as a reset would leave them; --to names the table to write them to."""
    out = state.reset_failed(v.read("tasks")) if a.failed else state.reset_running(v.read("tasks"))
    if a.to:
        v.write(a.to, out, "errorifexists")
    return out.groupBy("status").count()


def stats(v: Vault, a: argparse.Namespace) -> DataFrame:
    return usage.log_counts(records.read_log(v.spark, a.log))


def watch(v: Vault, a: argparse.Namespace) -> DataFrame:
    return records.read_log(v.spark, a.log).orderBy(F.desc("ts")).limit(a.n)


def estimate(v: Vault, a: argparse.Namespace) -> DataFrame:
    import os
    import shutil

    return usage.preflight(chat.members(v.spark, a.zip), os.path.getsize(a.zip), a.messages, shutil.disk_usage(os.path.dirname(os.path.abspath(a.zip))).free)


def review(v: Vault, a: argparse.Namespace) -> DataFrame:
    return v.read("classifications").where((F.col("obra") == a.corpus) & (F.col("semantic_status") == "pending_review"))


def detect_quality(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Transcriptions without a classification yet."""
    return state.without(v.read("transcriptions"), v.read("classifications").select("obra", F.col("source_file_id").alias("file_id")), ["obra", "file_id"])


def ocr_images(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Images without an OCR task."""
    return state.unqueued(v.read("files").where("file_type = 'image'"), v.read("tasks"), "ocr_first")


def export_report(v: Vault, a: argparse.Namespace) -> DataFrame:
    return correlations.top_validated(v.read("correlations").where(F.col("obra") == a.corpus).withColumn("id", F.xxhash64("primary_event_ref", "related_event_ref", "correlation_type")))  # stored edges have no id; equal edges share one


def generate_rdo(v: Vault, a: argparse.Namespace) -> DataFrame:
    """The reports of a corpus' days, or of one day; --to names a folder for their texts."""
    mine = lambda n: v.read(n).where(F.col("obra") == a.corpus)
    c = mine("classifications")
    labels = c.select("obra", "id", F.from_json("categories", "array<string>").alias("labels"), (F.coalesce(F.col("human_reviewed").cast("int"), F.lit(0)) == 1 if "human_reviewed" in c.columns else F.lit(False)).alias("reviewed"))
    events = hub.events(c, mine("transcriptions"), v.read("files"), v.read("messages"), mine("visual_analyses"), mine("documents")).join(labels, ["obra", "id"], "left")
    made = reports.daily(events, hub.payments(mine("financial_records")), mine("correlations"), a.contractual)
    made = made.where(F.col("day") == a.day) if a.day else made
    if a.to:
        reports.write_daily(made, a.to)
    return made


def process(v: Vault, a: argparse.Namespace) -> DataFrame:
    """The tasks of a corpus that may run now."""
    return state.runnable(v.read("tasks").where(F.col("obra") == a.corpus)).orderBy(F.desc("priority"), "created_at", "id")


def classify(v: Vault, a: argparse.Namespace) -> DataFrame | dict:
    """What waits to be classified; with --replies, a file of (id, reply, call_id, cost_usd) as JSON lines, the rows as those
    leave them, written to the table that --to names."""
    rows = v.read("classifications").where(F.col("obra") == a.corpus)
    if not a.replies:
        return rows.where(~F.col("semantic_status").isin(state.CLASSIFIED, state.REJECTED))
    out = state.classified(rows, v.spark.read.schema("id bigint, reply string, call_id bigint, cost_usd double").json(a.replies))
    if a.to:
        v.write(a.to, out, "errorifexists")
    return out.groupBy("semantic_status").agg(F.count("*").alias("n"), F.count("failure").alias("failures"), F.sum("cost_usd").alias("cost_usd"))


def narrate(v: Vault, a: argparse.Namespace) -> DataFrame:
    """The inputs of a scope's narratives: the days' under their periods, composed."""
    n = v.read("forensic_narratives").where(F.col("obra") == a.corpus)
    days = n.where("scope = 'day'").select("obra", F.col("scope_ref").cast("date").alias("day"))
    return narratives.composed(narratives.children(narratives.best(n), narratives.buckets(days, a.scope), "day"), a.scope)


def transcribe_pending(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Audio files without a transcription."""
    return state.without(v.read("files").where("file_type = 'audio'"), v.read("transcriptions"), ["file_id"])


def process_visual(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Images without an analysis, each with its verdict and where it goes."""
    f = state.without(v.read("files").where("file_type = 'image'"), v.read("visual_analyses"), ["file_id"])
    has = lambda c, kind: (F.col(c) if c in f.columns else F.lit(None)).cast(kind)
    skip, reason, _ = media.verdict("size_bytes", has("width", "int"), has("height", "int"), has("sharpness", "double"))
    return f.select("file_id", skip.alias("skip"), reason.alias("reason"), media.route(has("width", "int"), has("height", "int"), has("text_dense", "boolean")).alias("target"))


def process_videos(v: Vault, a: argparse.Namespace) -> DataFrame:
    """Videos without frames, each with the times at which frames are to be taken, where its duration is known."""
    f = v.read("files")
    frames = f.where("derivation_method like '%frame%'").select(F.col("derived_from").alias("file_id"))
    left = state.without(f.where("file_type = 'video'"), frames, ["file_id"])
    return left.select("file_id", temporal.frame_times(F.col("duration_s").cast("double") if "duration_s" in f.columns else F.lit(None).cast("double")).alias("at"))


COMMANDS = {f.__name__.replace("_", "-"): f for f in (ingest, correlate, status, pipeline_status, pipeline_reset, stats, watch, estimate, review, detect_quality, ocr_images, export_report, generate_rdo, process, classify, narrate, transcribe_pending, process_visual, process_videos)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spoor", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--vault", default=".")
    for name in ("corpus", "chat", "log", "zip", "to", "day", "replies"):
        p.add_argument(f"--{name}")
    p.add_argument("--scope", default="week", choices=("week", "month", "quarter"))
    p.add_argument("--failed", action="store_true")
    p.add_argument("--contractual", action="store_true")
    p.add_argument("--messages", type=int, default=0)
    p.add_argument("-n", type=int, default=20)
    a = p.parse_args(argv)
    out = COMMANDS[a.command](Vault(session(), a.vault), a)
    if isinstance(out, DataFrame):
        for line in out.toJSON().toLocalIterator():
            print(line)
    else:
        print(json.dumps(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
