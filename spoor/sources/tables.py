"""Tables that several writers change: rows by key, inserted once or replaced in place, one writer at a time.

A writer holds a table's lock while it looks up keys and writes. The lock is a file that can be made only once: by the
operating system on a local disk, by the file system's exclusive create elsewhere (HDFS has one; an object store without
one needs another lock). Names that open with an underscore aren't read as data.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoor.sources.records import insert_new, latest

BUCKET = "key_bucket"


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written: a file or folder there that counts as data."""
    fs, place = _hadoop(spark, path)
    return fs.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(place))


def _create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file that isn't there; False if it is."""
    fs, place = _hadoop(spark, path)
    fs.mkdirs(place.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    fs, place = _hadoop(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 600) -> Iterator[None]:
    """Hold a table's lock; TimeoutError, naming its holder, if another writer has it for so many seconds."""
    lock, began = f"{path}/_lock", time.monotonic()
    while not _create_once(spark, lock, f"{socket.gethostname()}, application {spark.sparkContext.applicationId}"):
        if time.monotonic() - began > wait:
            raise TimeoutError(f"{lock} is held by {_read(spark, lock)}; remove it if that writer is gone")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs, place = _hadoop(spark, lock)
        fs.delete(place, False)


def _observed(rows: Observation) -> int | None:
    """What was counted; None where the plan was found to have no result as it ran, and its counting went with it."""
    try:
        return rows.get["n"]
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return None


def append_new(path: str, incoming: DataFrame, keys: list[str], epoch: str | None = None) -> tuple[int, int]:
    """Append what is new under path; (inserted, skipped), counted in the rows as they are written.

    Writers take turns, so a key that two of them bring is inserted once. An epoch that has been recorded is a replay:
    nothing is read or written, and its counts are those of the first time. A writer that was lost after its rows were
    there but before its epoch was recorded finds them all when it comes again, and skips them.
    """
    spark = incoming.sparkSession
    with locked(spark, path):
        done = f"{path}/_epochs/{epoch}"
        if epoch is not None and exists(spark, done):
            return tuple(json.loads(_read(spark, done)))
        existing = spark.read.parquet(path) if has_rows(spark, path) else incoming.limit(0)
        came, went = Observation(), Observation()
        fresh = insert_new(existing, incoming.observe(came, F.count(F.lit(1)).alias("n")), keys)
        fresh.observe(went, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        inserted = _observed(went) or 0
        all_rows = _observed(came)
        counts = (inserted, (incoming.count() if all_rows is None else all_rows) - inserted)
        if epoch is not None:
            _create_once(spark, done, json.dumps(counts))
        return counts


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert_into(path: str, incoming: DataFrame, keys: list[str], version: str, buckets: int = 64) -> int:
    """Replace or add rows under path by key, the greatest version of each; how many buckets of keys were rewritten.

    The table is partitioned by a hash of its keys. Only buckets that incoming rows fall into are read and written, by
    dynamic partition overwrite; the files of all others stay as they are. How many there are is set with the first
    rows. Take so many that a bucket's rows are well under what a task writes.
    """
    spark = incoming.sparkSession
    with locked(spark, path):
        if not _create_once(spark, f"{path}/_buckets", str(buckets)):
            buckets = int(_read(spark, f"{path}/_buckets"))
        coming = incoming.withColumn(BUCKET, _bucket(keys, buckets))
        touched = sorted(r[0] for r in coming.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
        if not touched:
            return 0
        there = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)) if has_rows(spark, path) else coming.limit(0)
        rows = latest(there.select(coming.columns), coming, [BUCKET, *keys], version)
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        return len(touched)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)
