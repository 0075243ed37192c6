"""Calls, logs, costs and estimates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions.text import ColumnOrName, col

# Prices in dollars and speeds in seconds, and classes of errors worth retrying.
RATES = {
    "audio_usd_per_minute": 0.006, "audio_seconds_per_minute": 30.0, "classify_usd": 5e-5, "classify_seconds": 0.3, "vision_usd": 0.005,
    "vision_seconds": 1.5, "narrate_usd_per_day": 0.07, "narrate_seconds_per_day": 25.0, "ingest_seconds_per_message": 0.005,
    "ingest_seconds_per_mb": 0.1, "disk_factor": 3.0, "audio_seconds_each": 45.0, "messages_per_day": 50,
}
PRICES = {"gpt-4o-mini": (0.15e-6, 0.60e-6), "gpt-4o": (2.50e-6, 10.00e-6)}
ERROR_KINDS = {"APIConnectionError": "connection", "RateLimitError": "rate_limit", "APITimeoutError": "timeout", "AuthenticationError": "auth_error", "NotFoundError": "not_found", "BadRequestError": "bad_request"}
RETRYABLE = ("APIConnectionError", "RateLimitError", "APITimeoutError")


def error_kind(error: ColumnOrName) -> Column:
    """A short name for an error's class; null stays null, unknown classes are api_error."""
    out = F.when(col(error).isNull(), None)
    for name, kind in ERROR_KINDS.items():
        out = out.when(col(error) == name, kind)
    return out.otherwise("api_error")


def retryable(error: ColumnOrName) -> Column:
    return F.when(col(error).isNull(), None).otherwise(col(error).isin(*RETRYABLE))


def token_cost(model: ColumnOrName, prompt: ColumnOrName, completion: ColumnOrName) -> Column:
    out = F
    for name, (i, o) in PRICES.items():
        out = out.when(col(model) == name, col(prompt) * i + col(completion) * o)
    return out.otherwise(0.0)


def minute_cost(seconds: ColumnOrName) -> Column:
    return col(seconds) / 60 * RATES["audio_usd_per_minute"]


def spent(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def durations(log: DataFrame, key: str = "stage", value: str = "duration_ms") -> DataFrame:
    """(key, n, least, median, most) without gathering a group: the middle is picked by rank.

    Values are counted first, so a group of millions of durations is a short list of (value, count) rows.
    """
    counted = log.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(key)
    placed = counted.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("total", F.sum("k").over(w))
    middle = (F.floor(F.col("total") / 2) < F.col("upto")) & (F.floor(F.col("total") / 2) >= F.col("upto") - F.col("k"))
    return placed.groupBy(key).agg(F.max("total").alias("n"), F.min(value).alias("least"), F.max(F.when(middle, F.col(value))).alias("median"), F.max(value).alias("most"))


def log_counts(log: DataFrame) -> DataFrame:
    """(dimension, value, n, cost): events by type, costs by api, failures by stage and by error, in one pass."""
    e = F.col("event_type")
    row = lambda d, v, on: F.when(on, F.struct(F.lit(d).alias("dimension"), F.coalesce(v, F.lit("unknown")).alias("value")))
    rows = F.filter(F.array(row("event_type", e, F.lit(True)), row("cost_api", F.col("api"), e == "cost"), row("failed_stage", F.col("stage"), e == "stage_failed"), row("error_type", F.col("error_type"), e == "stage_failed")), lambda x: x.isNotNull())
    each = log.select("cost_usd", F.explode(rows).alias("r"))
    return each.groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r.dimension") == "cost_api", F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)).alias("cost"))


def running_cost(calls: DataFrame, limit: float) -> DataFrame:
    """Each call with its day's cost so far, and whether a daily quota would have let it pass."""
    day = F.to_date("created_at")
    w = Window.partitionBy(day).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0))).over(w), F.lit(0.0))
    return calls.withColumn("spent_before", before).withColumn("allowed", F.col("spent_before") < limit)


def token_bucket(calls: DataFrame, key: str = "endpoint", per_minute: int = 60) -> DataFrame:
    """Replays a token bucket over each key's calls: (key, id, start, waited), in microseconds.

    A bucket of so many tokens that fills at so many a minute lets a call start when the time at which it would be
    full again, if calls came evenly, is at most a full bucket ahead. That time is the running greatest of arrival
    less place times the interval, so a window has it, and no call waits for another's row.
    """
    if per_minute <= 0:
        raise ValueError("a bucket needs a rate above zero")
    gap = 60_000_000 / per_minute
    order = Window.partitionBy(key).orderBy("at", "id")
    placed = calls.select(key, "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).withColumn("place", F.row_number().over(order) - 1)
    slack = F.max(F.col("at") - F.col("place") * gap).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.col("at").cast("double"), slack + (F.col("place") - (per_minute - 1)) * gap)
    return placed.select(key, "id", F.coalesce(start, F.col("at").cast("double")).alias("start"), (F.coalesce(start, F.col("at").cast("double")) - F.col("at")).alias("waited"))


def breaker(calls: DataFrame, key: str = "endpoint", failures: int = 5, rest_seconds: int = 300) -> DataFrame:
    """Replays a circuit breaker over each key's calls: (key, id, state before the call, rejected).

    An ordered fold, the one thing here without a relational form: closed until so many failures in a row, then
    open for a while, then one trial call decides. Arrow batches carry a key's calls in order.
    """
    fields = calls.schema
    schema = f"{key} {fields[key].dataType.simpleString()}, id {fields['id'].dataType.simpleString()}, state string, rejected boolean"
    ordered = calls.select(key, "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("error_type").isNotNull().alias("bad"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "id"], kind="stable")
        state, run, opened, out = "closed", 0, 0, []
        for at, bad in zip(group["at"].tolist(), group["bad"].tolist()):
            if state == "open" and at - opened > rest_seconds * 1_000_000:
                state = "half_open"
            out.append((state, state == "open"))
            if state == "open":
                continue
            run = run + 1 if bad else 0
            if bad and (state == "half_open" or run >= failures):
                state, opened = "open", at
            elif not bad:
                state = "closed"
        return pd.DataFrame({key: group[key].to_numpy(), "id": group["id"].to_numpy(), "state": [s for s, _ in out], "rejected": [r for _, r in out]})

    return ordered.groupBy(key).applyInPandas(fold, schema)


def preflight(census: DataFrame, zip_bytes: int, messages: int, disk_free: int, rates: dict[str, float] = RATES) -> DataFrame:
    """One row of counts, costs, times and warnings for an export's members (file_type)."""
    n = lambda kind: F.count_if(F.col("file_type") == kind)
    counts = census.agg(n("audio").alias("audio"), n("image").alias("image"), n("video").alias("video"), n("document").alias("document"), F.count("*").alias("members"))
    minutes = F.col("audio") * rates["audio_seconds_each"] / 60
    days = max(1, messages // int(rates["messages_per_day"]))
    usd = minutes * rates["audio_usd_per_minute"] + messages * rates["classify_usd"] + F.col("image") * rates["vision_usd"] + days * rates["narrate_usd_per_day"]
    seconds = messages * rates["ingest_seconds_per_message"] + zip_bytes / 1048576 * rates["ingest_seconds_per_mb"] + minutes * rates["audio_seconds_per_minute"] + messages * rates["classify_seconds"] + F.col("image") * rates["vision_seconds"] + days * rates["narrate_seconds_per_day"]
    need = int(zip_bytes * rates["disk_factor"])
    warnings = F.filter(F.array(F.when(F.lit(disk_free < need), "disk"), F.when(F.col("usd") > 50, "cost"), F.when(F.col("seconds") > 86400, "time")), lambda x: x.isNotNull())
    out = counts.withColumns({"usd": usd, "seconds": seconds}).withColumns({"usd_low": F.col("usd") * 0.5, "usd_high": F.col("usd") * 1.5, "disk_bytes": F.lit(need).cast("bigint")})
    return out.withColumn("warnings", warnings)


def transcript_confidence(segments: ColumnOrName) -> Column:
    """The mean of exp(avg_logprob) over a transcript's JSON segments; zero without any."""
    s = F.from_json(col(segments), "array<struct<avg_logprob:double>>")
    p = F.transform(F.filter(s, lambda x: x["avg_logprob"].isNotNull()), lambda x: F.exp(x["avg_logprob"]))
    return F.coalesce(F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)), F.lit(0.0))
