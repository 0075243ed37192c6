"""Token counts through a digest cache.

A count belongs to (digest of the text, digest of the tokenizer file). Rows are joined with the stored counts
by digest, one row of each digest that isn't stored is encoded, and the new counts are appended. The content
is normalised no further than null to the empty text: anything more would change the counts.

Defined cases: null and empty texts have no tokens; copies are encoded once, save rows that repeat in id and
text, whose counts are stored once all the same; rows
that share an id are separate rows; very long texts are encoded whole; of stored counts for one digest, which are
equal, any serves; an empty table gives an empty one and appends nothing; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import common
from spoor.llm.encoder import encoder, runs_of

LIMIT = 1024
STORED = "digest binary, n_tokens long, version string"


def version(vocab: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(vocab, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _stored(spark: SparkSession, cache: str, tag: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(STORED).parquet(cache).where(F.col("version") == tag).select("digest", "n_tokens").dropDuplicates(["digest"])


def token_counts(docs: DataFrame, vocab: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for all docs; ``cache`` is the folder of stored counts."""
    spark = docs.sparkSession
    common.reachable(spark)
    tag = version(vocab)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = common.cut(docs.select("doc_id", digest.alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "digests")
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(_stored(spark, cache, tag), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            texts, counts = common.texts(b.column(1)), []
            for start, end in runs_of(texts):
                counts += [len(x) // 4 for x in enc.encode(texts[start:end])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    left = docs.select("doc_id", "text", digest.alias("digest")).alias("l")
    right = misses.alias("r").hint("shuffle_hash")  # a row of 40 bytes for each miss, against whole texts
    todo = left.join(right, (F.col("l.digest") == F.col("r.digest")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi")
    fresh = todo.select("l.digest", "l.text").mapInArrow(run, "digest binary, n_tokens long").dropDuplicates(["digest"])
    fresh.withColumn("version", F.lit(tag)).write.mode("append").parquet(cache)
    out = keyed.join(_stored(spark, cache, tag), "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
