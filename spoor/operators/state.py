"""Tasks, caches and derivations as tables: what may run, what is missing, and how states change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.operators import contracts


def counts(tasks: DataFrame) -> DataFrame:
    """Tasks by type with a column for each status, and a total."""
    statuses = ("pending", "running", "done", "failed")
    return tasks.groupBy("obra", "task_type").agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count("*").alias("total"))


def runnable(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are done; one that doesn't exist blocks."""
    waits = tasks.where("status = 'pending'").select("id", "obra", F.explode(F.from_json("depends_on", "array<bigint>")).alias("on"))
    done = tasks.where("status = 'done'").select(F.col("id").alias("on"))
    blocked = waits.join(done, "on", "left_anti").select("id").distinct()
    return tasks.where("status = 'pending'").join(blocked, "id", "left_anti")


def next_task(tasks: DataFrame, kind: str | None = None) -> DataFrame:
    """The task to run next of each corpus. By type, dependencies don't count."""
    pool = runnable(tasks) if kind is None else tasks.where((F.col("status") == "pending") & (F.col("task_type") == kind))
    order = Window.partitionBy("obra").orderBy(F.desc("priority"), "created_at", "id")
    return pool.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def resumable(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'running' and finished_at is null").orderBy("started_at", "id")


def reset_running(tasks: DataFrame) -> DataFrame:
    stuck = (F.col("status") == "running") & F.col("finished_at").isNull()
    return tasks.withColumns({"status": F.when(stuck, "pending").otherwise(F.col("status")), "started_at": F.when(~stuck, F.col("started_at"))})


def reset_failed(tasks: DataFrame, kind: str | None = None) -> DataFrame:
    back = F.col("status") == "failed"
    if kind is not None:
        back = back & (F.col("task_type") == kind)
    return tasks.withColumns({"status": F.when(back, "pending").otherwise(F.col("status"))} | {c: F.when(~back, F.col(c)) for c in ("started_at", "finished_at")})


def moved(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks in their latest state: events are (id, at, status), the last one of a task counts."""
    last = events.groupBy("id").agg(F.max_by("status", "at").alias("_s"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("_b"), F.max(F.when(F.col("status").isin("done", "failed"), F.col("at"))).alias("_e"))
    out = tasks.join(last, "id", "left")
    return out.withColumns({"status": F.coalesce("_s", "status"), "started_at": F.coalesce("_b", "started_at"), "finished_at": F.coalesce("_e", "finished_at")}).drop("_s", "_b", "_e")


def span(tasks: DataFrame) -> DataFrame:
    """Per corpus: when its first task was made and its last finished."""
    return tasks.groupBy("obra").agg(F.min("created_at").alias("first_created"), F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("last_finished"))


def pending_with_dependencies(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending'").groupBy("task_type").agg(F.count("*").alias("pending"), F.count_if(F.col("depends_on") != "[]").alias("with_dependencies"))


def payload(c: str = "payload", key: str = "file_id") -> Column:
    return F.get_json_object(c, f"$.{key}")


def unqueued(files: DataFrame, tasks: DataFrame, kind: str) -> DataFrame:
    """Files for which no task of the kind exists, by the file in its payload."""
    queued = tasks.where(F.col("task_type") == kind).select(payload().alias("file_id")).distinct()
    return files.join(queued, "file_id", "left_anti")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left with no partner in right: transcriptions never classified, videos without frames, and the like."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def superseded(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows with the newest id of their key; older rows point to it, the newest to none."""
    newest = F.max("id").over(Window.partitionBy(key))
    return rows.withColumn("newest", newest).withColumn("superseded_by", F.when(F.col("id") < F.col("newest"), F.col("newest"))).drop("newest")


def active(rows: DataFrame) -> DataFrame:
    return rows.where("superseded_by is null")


def superseded_groups(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """How many keys have several rows, and how many of those rows would be marked."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("to_mark"))


def given(before: tuple[str, object] | None = None, **equal: object) -> Column:
    """The conditions of those filters that are given: columns equal to a value, or to one of several, and a column before a
    bound. Without any, every row meets them."""
    out = F.lit(True)
    for column, value in equal.items():
        if value is not None:
            out = out & (F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    if before is not None and before[1] is not None:
        out = out & (F.col(before[0]) < F.lit(before[1]))
    return out


def batches(rows: DataFrame, corpus: str, status: str | None = None) -> DataFrame:
    """A corpus' batches, of one status if given, the latest first."""
    return rows.where(given(obra=corpus, status=status)).orderBy(F.desc("submitted_at"), F.desc("id"))


def invalidated(rows: DataFrame, hash_column: str, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions lose their hash."""
    hit = F.lit(True)
    for c in conditions:
        hit = hit & c
    return rows.withColumn(hash_column, F.when(~F.coalesce(hit, F.lit(False)), F.col(hash_column)))


def lookup(cache: DataFrame, wanted: DataFrame, keys: list[str], nullable: str) -> DataFrame:
    """The latest cached row for each wanted key; ``nullable`` may be null on both sides and then matches."""
    a, b = wanted.alias("w"), cache.alias("c")
    on = F.lit(True)
    for k in keys:
        same = F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) if k == nullable else F.col(f"w.{k}") == F.col(f"c.{k}")
        on = on & same
    return a.join(b, on).groupBy(*(F.col(f"w.{k}").alias(k) for k in keys)).agg(F.max("c.id").alias("id"))


def derive(sources: DataFrame, kind: str, method: str, sha256: Column, now: Column) -> DataFrame:
    """Derived file rows that inherit message and time from their source."""
    from spoor.sources.chat import file_id

    return sources.select(file_id(sha256).alias("file_id"), "obra", F.lit(kind).alias("file_type"), sha256.alias("sha256"), F.col("file_id").alias("derived_from"), F.lit(method).alias("derivation_method"), "referenced_by_message", "timestamp_resolved", "timestamp_source", F.lit("awaiting_classification").alias("semantic_status"), now.alias("created_at")).dropDuplicates(["file_id"])


def derivations(derived: DataFrame) -> DataFrame:
    """The edges of derived rows, each once."""
    return derived.select("obra", F.col("derived_from").alias("source_file_id"), F.col("file_id").alias("derived_file_id"), "derivation_method").distinct()


def reviewed(classifications: DataFrame, decisions: DataFrame) -> DataFrame:
    """Classifications after decisions (id, action, corrected_text): accept, edit or reject; edits carry text."""
    d = decisions.select("id", "action", "corrected_text")
    out = classifications.join(d, "id", "left")
    return out.withColumns(
        {
            "human_reviewed": F.when(F.col("action").isNotNull(), F.lit(1)).otherwise(F.col("human_reviewed")),
            "human_corrected_text": F.when(F.col("action") == "edit", F.col("corrected_text")).otherwise(F.col("human_corrected_text")),
            "semantic_status": F.when(F.col("action").isin("accept", "edit"), "pending_classify").when(F.col("action") == "reject", "rejected").otherwise(F.col("semantic_status")),
        }
    ).drop("action", "corrected_text")


def batch_updates(batches: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are any, the old ones else."""
    u = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = batches.join(u, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def outcomes(rows: DataFrame, column: str = "outcome", *keys: str) -> DataFrame:
    """What a draining loop would count."""
    return rows.groupBy(*keys, column).agg(F.count("*").alias("n"))


# The states in which a classification is done with.
CLASSIFIED, REJECTED = "classified", "rejected"


def classified(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Classifications (id, semantic_status, ...) with a model's replies (id, reply, call_id, cost_usd) put in.

    A reply that keeps its contract gives categories, confidence and reasoning and makes the row classified; one that
    doesn't leaves it as it is, with the reason in ``failure``. Of several replies to a row that of the latest call
    counts. Rows that are classified or rejected already, and rows without a reply, stay as they are.
    """
    last = replies.groupBy("id").agg(F.max_by(F.struct("reply", "call_id", "cost_usd"), "call_id").alias("_r")).select("id", "_r.*")
    joined = rows.join(last, "id", "left")
    waits = ~F.col("semantic_status").isin(CLASSIFIED, REJECTED) & F.col("reply").isNotNull()
    why = contracts.classification_fault("reply")
    fine = waits & why.isNull()
    put = lambda name, value: F.when(fine, value).otherwise(F.col(name) if name in rows.columns else F.lit(None)).alias(name)
    new = {
        "semantic_status": F.lit(CLASSIFIED),
        "categories": F.get_json_object("reply", "$.categories"),
        "confidence_model": F.get_json_object("reply", "$.confidence").cast("double"),
        "reasoning": F.get_json_object("reply", "$.reasoning"),
        "classifier_api_call_id": F.col("call_id"),
    }
    others = [F.col(c) for c in rows.columns if c not in new]
    return joined.select(*others, *(put(k, v) for k, v in new.items()), F.when(waits, why).alias("failure"), F.when(waits, F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0).alias("cost_usd"))
