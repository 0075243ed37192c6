"""Ordered, versioned changes to a folder of tables, and a log of those applied.

A change is a function of a table's rows, or a drop. Each is applied once, in order: the new rows are written beside the
table, which then gives way to them, and the log gets a line. A change that was cut short is made again; all changes here
give the same on what they have changed already. Checks on values are data of the same versions: a later version may
relax one, and rows are checked against those in force.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import text
from spoor.sources import records, tables

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Migration:
    """change: None drops the table. allowed: for columns, the values they may have from this version on; an empty set
    lifts a check. schema: that of the table if there is none yet."""

    version: int
    table: str
    change: Change | None = lambda rows: rows
    schema: str | None = None
    allowed: dict[str, frozenset[str]] | None = None


def adding(**columns: str) -> Change:
    """Null columns of the given types, where they aren't there."""

    def change(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})

    return change


def filling(column: str, kind: str, value: Callable[[], Column]) -> Change:
    """A column, added where it isn't there, with nulls and empty texts filled in."""
    return lambda rows: records.backfilled(adding(**{column: kind})(rows), column, value())


def _hash() -> Column:
    return text.content_hash("timestamp_whatsapp", "sender", "content")


# The scopes that narratives may have, before and after more were let in.
SCOPES = frozenset({"day", "obra_overview"})
MORE_SCOPES = SCOPES | {"week", "month", "quarter"}

MIGRATIONS: tuple[Migration, ...] = (
    Migration(1, "api_calls", adding(latency_ms="bigint", model="string", error_type="string")),
    Migration(2, "classifications", adding(source_message_id="string")),
    Migration(3, "financial_records", schema="obra string, source_file_id string, doc_type string, valor_centavos bigint, moeda string, data_transacao string, hora_transacao string, descricao string, confidence double"),
    Migration(4, "visual_analyses_archive", schema="id bigint, obra string, original_id bigint, file_id string, analysis_json string, archive_reason string"),
    Migration(5, "visual_analyses", adding(superseded_by="bigint", superseded_at="string")),
    Migration(6, "forensic_narratives", allowed={"scope": SCOPES}),
    Migration(7, "messages", filling("content_hash", "string", _hash)),
    Migration(8, "events", None),
    Migration(9, "forensic_narratives", adding(prompt_template_hash="string")),
    Migration(10, "forensic_narratives", allowed={"scope": MORE_SCOPES}),
)


def applied(spark: SparkSession, base: str) -> list[int]:
    """The versions that the log has."""
    log = f"{base}/_migrations"
    return sorted(r.version for r in spark.read.schema("version int, table string").json(log).collect()) if tables.exists(spark, log) else []


def _replace(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """A table's rows give way to new ones, which are whole before the old ones go."""
    beside = f"{path}._next"
    rows.write.mode("overwrite").parquet(beside)
    _move(spark, beside, path)


def _move(spark: SparkSession, beside: str, path: str) -> None:
    fs, old = tables._hadoop(spark, path)
    new = tables._hadoop(spark, beside)[1]
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} couldn't take the place of {path}")


def migrate(spark: SparkSession, base: str, migrations: Sequence[Migration] = MIGRATIONS) -> list[int]:
    """Apply what the log of ``base`` doesn't have; the versions applied now."""
    made = []
    with tables.locked(spark, base):
        done = set(applied(spark, base))
        for m in sorted(migrations, key=lambda m: m.version):
            if m.version in done:
                continue
            path = f"{base}/{m.table}"
            fs, place = tables._hadoop(spark, path)
            beside = f"{path}._next"
            if not fs.exists(place) and tables.exists(spark, f"{beside}/_SUCCESS"):
                _move(spark, beside, path)  # a change that was cut short between the old rows and the new
            if m.change is None:
                fs.delete(place, True)
            elif fs.exists(place):
                rows = spark.read.parquet(path)
                changed = m.change(rows)
                if changed.schema != rows.schema or changed is not rows:
                    _replace(spark, path, changed)
            elif m.schema:
                spark.createDataFrame([], m.schema).write.parquet(path)
            line = spark.createDataFrame([(json.dumps({"version": m.version, "table": m.table}),)], "value string")
            line.coalesce(1).write.mode("append").text(f"{base}/_migrations")
            made.append(m.version)
    return made


def checks(table: str, version: int, migrations: Sequence[Migration] = MIGRATIONS) -> dict[str, frozenset[str]]:
    """The values that a table's columns may have at a version."""
    out: dict[str, frozenset[str]] = {}
    for m in sorted(migrations, key=lambda m: m.version):
        if m.table == table and m.version <= version:
            out |= m.allowed or {}
    return {c: v for c, v in out.items() if v}


def checked(rows: DataFrame, allowed: dict[str, frozenset[str]]) -> DataFrame:
    """rows, or an error that names the first value that isn't allowed; null is no value."""
    for column, values in allowed.items():
        c = F.col(column)
        bad = F.raise_error(F.concat(F.lit(f"{column} may not be "), c)).cast(rows.schema[column].dataType)
        rows = rows.withColumn(column, F.when(c.isNull() | c.isin(*sorted(values)), c).otherwise(bad))
    return rows
