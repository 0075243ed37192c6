"""Structured Streaming forms: chats and payments as streams, sinks that write each row once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spoor.operators import detectors
from spoor.functions import money, temporal
from spoor.sources.tables import append_new


def read_table(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """New files of a folder of Parquet, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def payment_context(events: DataFrame, payments: DataFrame, window: int = detectors.WINDOWS["temporal"], late: str = "1 hour") -> DataFrame:
    """The temporal detector over two streams with a time column ``ts``.

    A stream-stream join needs bounds on both sides' state: watermarks, and a window in the join condition.
    """
    e = events.withColumn("e_ts", F.col("ts").cast("timestamp")).withWatermark("e_ts", late)
    e = e.select(F.col("obra").alias("e_obra"), F.col("id").alias("e_id"), "e_ts", detectors.payment_words(F.col("text")).alias("n")).where("n > 0")
    p = payments.withColumn("p_ts", F.col("ts").cast("timestamp")).withWatermark("p_ts", late).select("obra", F.col("id").alias("p_id"), "p_ts")
    near = F.expr(f"e_obra = obra AND e_ts BETWEEN p_ts - INTERVAL {window} SECONDS AND p_ts + INTERVAL {window} SECONDS")
    gap = (F.unix_micros("e_ts") - F.unix_micros("p_ts")) / 1_000_000
    return p.join(e, near).select("obra", F.concat(F.lit("fr_"), "p_id").alias("primary_event_ref"), F.concat(F.lit("c_"), "e_id").alias("related_event_ref"), gap.cast("bigint").alias("time_gap_seconds"), F.least(F.col("n") / 3.0, F.lit(1.0)).alias("confidence"))


def math_relations(events: DataFrame, payments: DataFrame, window: int = detectors.WINDOWS["math"], late: str = "1 hour") -> DataFrame:
    """The value detector over two streams: payments and amounts join on value band and time, so that a new row is
    compared with those of its own order only; what is older than the window and the watermark leaves the state."""
    e = detectors.said_amounts(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    e = e.select(F.col("obra").alias("e_obra"), "e_id", "e_ts", "m", F.col("band").alias("e_band"))
    p = detectors.paid_amounts(payments.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    near = F.expr(f"e_obra = obra AND e_band = band AND e_ts BETWEEN p_ts - INTERVAL {window} SECONDS AND p_ts + INTERVAL {window} SECONDS")
    pairs = p.join(e, near).withColumn("gap", temporal.seconds_between(F.col("e_ts"), F.col("p_ts")))
    return detectors.related_amounts(pairs)


def contract_renegotiation(earlier: DataFrame, later: DataFrame, window: int = detectors.WINDOWS["contract_renegotiation"], late: str = "1 hour") -> DataFrame:
    """The renegotiation detector over a stream joined with itself (two readers of one source), on specific stem, value
    band and time; a row stays in the state for the window and the watermark."""
    timed = lambda rows: rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    first, second = detectors.named_totals(timed(earlier), "p", around=1), detectors.named_totals(timed(later), "e")
    second = second.withColumnsRenamed({"obra": "e_obra", "stem": "e_stem", "band": "e_band"})
    ahead = F.expr(f"e_obra = obra AND e_stem = stem AND e_band = band AND e_ts > p_ts AND e_ts <= p_ts + INTERVAL {window} SECONDS")
    return detectors.renegotiated(first.join(second, ahead))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by corpus, day and source type; a day is final when its watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day"), "obra", "source_type").agg(F.count("*").alias("n")).select("obra", F.to_date("window.start").alias("day"), "source_type", "n")


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """A sink that inserts what isn't under path yet, beside other writers of it. A batch that is replayed after a failure
    is known by its epoch, under ``name`` (the checkpoint's place by default), and writes nothing."""
    known = hashlib.sha256((name or checkpoint).encode()).hexdigest()[:16]

    def put(batch: DataFrame, epoch: int) -> None:
        append_new(path, batch, keys, f"{known}-{epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def drain(writer: DataStreamWriter, timeout: int = 300) -> None:
    """Run a stream until what is there has been read."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream had more than {timeout} s of work")


