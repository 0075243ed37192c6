"""Line-delimited JSON, tables with keys, and ground truth files."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = "event_type string, corpus_id string, stage string, api string, cost_usd double, duration_ms long, error_type string, ts string, _corrupt_record string"
REPLY_SCHEMA = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:long,completion_tokens:long>>>, error struct<message:string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records; lines that aren't JSON objects are skipped."""
    rows = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def parse_replies(lines: DataFrame, column: str = "value") -> DataFrame:
    """(custom_id, ok, content, prompt_tokens, completion_tokens, error) of a batch's output lines; bad lines drop out."""
    r = lines.select(F.from_json(column, REPLY_SCHEMA).alias("r")).where("r.custom_id is not null")
    return r.select(
        "r.custom_id",
        ((F.col("r.response.status_code") == 200) & F.col("r.error").isNull()).alias("ok"),
        F.get(F.col("r.response.body.choices"), 0)["message"]["content"].alias("content"),
        F.col("r.response.body.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("r.response.body.usage.completion_tokens").alias("completion_tokens"),
        F.col("r.error.message").alias("error"),
    )


def request_line(custom_id: Column, model: str, prompt: Column) -> Column:
    """One batch request as JSON."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def _all(rows: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in rows.columns))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows whose key isn't there yet, one for each key: the first in order. First write wins."""
    if order is None:
        one = incoming.dropDuplicates(keys)
    else:
        one = incoming.groupBy(*keys).agg(F.min_by(_all(incoming), F.struct(order)).alias("_row")).select("_row.*")
    return one.join(existing.select(*keys).distinct(), keys, "left_anti")


def latest(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both, with the greatest version of each key; of equal versions the incoming row, and of those the one whose
    values are the greatest, so the result doesn't depend on how rows are dealt. Rows combine before they are shuffled."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(existing.columns))))
    best = F.max_by(_all(existing), F.struct(F.col(version), "_new", row))
    return both.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


upsert = latest


def prune(value: Any) -> Any:
    """A nested value without nulls, empty texts, lists and maps."""
    if isinstance(value, dict):
        kept = {k: prune(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if v not in (None, "", [], {})}
    if isinstance(value, list):
        return [x for x in map(prune, value) if x not in (None, "", [], {})]
    return value


def merge(old: Any, new: Any) -> Any:
    """Deep merge: maps by key, lists joined, where an item whose id is there already is left out; else new wins."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: merge(old[k], v) if k in old else v for k, v in new.items()}
    if isinstance(old, list) and isinstance(new, list):
        known = {x["id"] for x in old if isinstance(x, dict) and "id" in x}
        return old + [x for x in new if not (isinstance(x, dict) and x.get("id") in known)]
    return new


def last_json(text: str) -> dict | None:
    """The last fenced JSON object of a text, else what stands between its outermost braces."""
    fenced = re.findall(r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", text)
    for candidate in [*fenced[-1:], text[text.find("{") : text.rfind("}") + 1]]:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def dump_sorted(value: Any) -> str:
    """JSON with sorted keys, non-ASCII kept: the form that dossiers are hashed in."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def require(value: dict, keys: list[str], where: str = "") -> dict:
    """The map, or an error that names the keys it lacks."""
    missing = [k for k in keys if value.get(k) in (None, "")]
    if missing:
        raise ValueError(f"{where or 'record'} lacks {', '.join(missing)}")
    return value


def dossier_hash(dossier: dict) -> str:
    """SHA-256 of a dossier's sorted form: equal dossiers share it, whatever the order of their keys."""
    return hashlib.sha256(dump_sorted(dossier).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A manifest's sorted form as one file, replaced whole, on any file system Hadoop knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def sorted_json(columns: list[str]) -> Column:
    """The sorted form of a flat map of a row's columns, as ``dump_sorted`` writes it: texts, whole numbers, nulls."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")
    parts = [F.concat(F.lit(f"{json.dumps(c, ensure_ascii=False)}: "), F.coalesce(quoted(F.col(c)), F.lit("null"))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def backfilled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """rows with a column's nulls and empty texts filled in; what is there stays."""
    return rows.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), value))


def conformed(rows: DataFrame, schema: str) -> DataFrame:
    """rows under a declared schema: lacking columns are null, others go, types are cast. Applying it again changes
    nothing, so tables written under any earlier schema read as the present one."""
    fields = T.StructType.fromDDL(schema)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def log_records(rows: DataFrame, event: str, **fields: Column) -> DataFrame:
    """Log lines (value) for rows: one event type, the given fields, nulls left out, in the log's order of fields."""
    known = [f.name for f in T.StructType.fromDDL(LOG_SCHEMA) if f.name != "_corrupt_record"]
    unknown = set(fields) - set(known)
    if unknown:
        raise ValueError(f"the log has no {', '.join(sorted(unknown))}")
    given = {"event_type": F.lit(event), **fields}
    return rows.select(F.to_json(F.struct(*(given[k].alias(k) for k in known if k in given))).alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    """Add log lines to a log folder."""
    rows.select("value").write.mode("append").text(path)
