"""Helpers that the corpus operators share: scratch tables, split rules, Arrow access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own sys.path only."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one made here for a session that runs
    in this process alone, as in tests; on a cluster that is an error, as a folder of one machine serves no other."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spoor-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, within this application's own part of it."""
    return f"{shared_dir(spark)}/spoor/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application: for when no DataFrame made by these operators is used any more."""
    remove(spark, f"{shared_dir(spark)}/spoor/{spark.sparkContext.applicationId}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; texts make batches of the usual size large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's own file system, wherever the shared folder is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def some_of(rows: DataFrame, label: str, h: str, counts: dict, most: int) -> DataFrame:
    """Of rows with a hash in column h, for each label about half as many again as ``most``, or all where there are no
    more than four times as many: what an exact choice of ``most`` can then be made from at little cost."""
    share = F.lit(1 << 20)
    for value, n in counts.items():
        if n > 4 * most:
            share = F.when(F.col(label) == F.lit(value), F.lit(int(1.5 * most / n * (1 << 20)) + 1)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(h), F.lit(1 << 20)) < share)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes without decoding; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
