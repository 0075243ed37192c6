"""Chat exports: text files to typed messages, media maps and ids.

Lines are numbered by their file's splits, and messages are put together in segments of a file, with what is open
carried over the edges: files of any number and size parse in one job.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions import temporal, text
from spoor.sources import digests, scratch

# Header forms, markers and file types of chat exports.
DASH = r"^(\d{1,2}/\d{1,2}/\d{2,4})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*-\s*(?:([^:]+):\s*)?(.*)$"
BRACKET = r"^\[(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?)\]\s*(?:([^:]+):\s*)?(.*)$"
EDITED = "<Esta mensagem foi editada>"
STICKER = "<Figurinha omitida>"
DELETED = ("Esta mensagem foi apagada", "Você apagou esta mensagem")
SYSTEM_STARTS = ("Ligação de voz", "Ligação de vídeo", "Videochamada", "As mensagens e ligações são protegidas", "As mensagens e as chamadas são protegidas", "Chamada perdida")
ATTACHED = r"^<anexado:\s*(.+?)>$"
FILE_ATTACHED = r"^(.+?\.\w+)\s+\(arquivo anexado\)$"
NOISE = ("As mensagens e ligações são protegidas", "Ligação de voz", "Chamada perdida", "Esta mensagem foi apagada")
FILE_TYPES = {
    "image": ("jpg", "jpeg", "png", "webp", "heic", "tiff", "tif"),
    "video": ("mp4", "mov", "3gp", "mkv"),
    "audio": ("opus", "m4a", "mp3", "wav"),
    "text": ("txt",),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "odt"),
}
TASKS = {"audio": "transcribe", "video": "extract_audio", "image": "visual_analysis", "document": "extract_document"}
LRM = "\u200e"
#: Lines that one task takes of a file when messages are put together.
SEGMENT = 100_000


def encoding_of(spark: SparkSession, path: str, probe: int = 65536) -> str:
    """utf-8, or latin-1 where the file's first bytes aren't; read through Hadoop's file systems, so from anywhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        head = bytes(stream.readNBytes(probe))
    finally:
        stream.close()
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "latin-1" if e.reason != "unexpected end of data" else "utf-8"
    return "utf-8"


def _copied(spark: SparkSession, path: str, name: str) -> str:
    """A copy of a file under a name that Spark reads, in this application's part of the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{scratch.fresh(spark, 'chat')}/{name}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf)
    return dst.toString()


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, line, value): lines numbered from one within each file, in the file's order.

    Files are read in splits, so one file of any size is many tasks. A line stands at its split's first byte and its
    place in the split; how many lines each split has is a small table, whose running totals number the lines.
    Spark passes over names that open with an underscore, which chats have; such a file is read from a copy.
    """
    name = path.rsplit("/", 1)[-1]
    if name.startswith(("_", ".")):
        return read_lines(spark, _copied(spark, path, name.lstrip("_.")), encoding).withColumn("file", F.lit(path))
    charset = {"latin-1": "iso-8859-1"}.get(encoding, encoding)
    plain = F.decode(F.col("value").cast("binary"), charset)  # the reader takes bytes as they are
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("at"), plain.alias("value"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def dialect(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, dialect) by each file's first line that isn't blank: dash, bracket, or null if it is neither."""
    first = lines.where(F.trim("value") != "").groupBy(key).agg(F.min_by("value", "line").alias("v"))
    v = F.replace(F.col("v"), F.lit(LRM), F.lit(""))
    return first.select(key, F.when(v.rlike(DASH), "dash").when(v.rlike(BRACKET), "bracket").alias("dialect"))


def _typed(content: Column, sender: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(content, sender, type, media file, edited): rules apply in this order."""
    bare = F.regexp_replace(content, r"(?U)\s+$", "")
    edited = bare.endswith(EDITED)
    body = F.when(edited, F.regexp_replace(F.substring(bare, F.lit(1), F.length(bare) - len(EDITED)), r"(?U)\s+$", "")).otherwise(content)
    system = F.lit(False)
    for s in SYSTEM_STARTS:
        system = system | body.startswith(s)
    who = F.when(sender.isNotNull() & ~system, sender)
    named = F.coalesce(F.nullif(F.regexp_extract(body, ATTACHED, 1), F.lit("")), F.nullif(F.regexp_extract(body, FILE_ATTACHED, 1), F.lit("")))
    kind = F.when(who.isNull(), "system").when(body == STICKER, "sticker").when(body.isin(*DELETED), "deleted").when(named.isNotNull(), "media_ref").otherwise("text")
    return body, who, kind, F.when(kind == "media_ref", F.trim(named)), edited


def parse(lines: DataFrame, key: str = "file", strict: bool = False) -> DataFrame:
    """(key, line_number, timestamp_raw, timestamp, sender, content, message_type, media_filename, edited).

    lines has key, line and value. Lines that don't open a message continue the one before; those before the
    first message are dropped, and so are files of neither dialect, which are an error if strict.

    A file is scanned in segments of so many lines. The last message that a segment opens is carried into the next
    ones (a small table, a row a segment), so a message runs on over any edge and no task needs a whole file.
    """
    clean = lines.withColumn("value", F.replace(F.col("value"), F.lit(LRM), F.lit("")))
    spoken = dialect(lines, key)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("neither dialect opens "), F.col(key).cast("string"))).cast("string")
        spoken = spoken.withColumn("dialect", F.coalesce("dialect", unknown))
    known = clean.join(spoken.where("dialect is not null"), key)
    header = F.when(F.col("dialect") == "dash", F.col("value").rlike(DASH)).otherwise(F.col("value").rlike(BRACKET))
    flagged = known.withColumn("head", header)
    opened = F.when(F.col("head"), F.col("line"))
    flagged = flagged.withColumn("segment", F.floor((F.col("line") - 1) / SEGMENT))
    earlier = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = flagged.groupBy(key, "segment").agg(F.max(opened).alias("last")).select(key, "segment", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy(key, "segment").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.join(carried, [key, "segment"]).withColumn("message", F.coalesce(F.max(opened).over(within), F.col("carried"))).where("message is not null")
    part = lambda g: F.when(F.col("dialect") == "dash", F.regexp_extract("value", DASH, g)).otherwise(F.regexp_extract("value", BRACKET, g))
    pieces = numbered.select(key, "message", "line", "head", part(1).alias("d"), part(2).alias("t"), part(3).alias("s"), F.when(F.col("head"), part(4)).otherwise(F.col("value")).alias("v"))
    first = lambda c: F.max(F.when(F.col("head"), F.col(c)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]), "\n")
    whole = pieces.groupBy(key, "message").agg(F.min("line").alias("line_number"), first("d").alias("d"), first("t").alias("t"), F.nullif(F.trim(first("s")), F.lit("")).alias("s"), texts.alias("c"))
    raw = F.concat_ws(" ", "d", "t")
    body, who, kind, media, edited = _typed(F.col("c"), F.col("s"))
    return whole.select(key, "line_number", raw.alias("timestamp_raw"), temporal.day_first(raw).alias("timestamp"), who.alias("sender"), body.alias("content"), kind.alias("message_type"), media.alias("media_filename"), edited.alias("edited"))


def with_ids(messages: DataFrame, corpus: text.ColumnOrName) -> DataFrame:
    """Adds message_id and content_hash."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return messages.withColumn("message_id", F.format_string("msg_%s_L%04d", text.col(corpus), F.col("line_number"))).withColumn("content_hash", text.content_hash(stamp, "sender", "content"))


def file_id(sha256: text.ColumnOrName) -> Column:
    return F.concat(F.lit("f_"), F.substring(text.col(sha256), 1, 12))


def message_file_id(message_id: text.ColumnOrName) -> Column:
    """The id of the synthetic file a text message stands for."""
    return F.concat(F.lit("m_"), text.short_digest(text.col(message_id), 12))


def media_map(messages: DataFrame, *keys: str) -> DataFrame:
    """Per media file, the first message that names it and the timestamp of the last one."""
    named = messages.where("media_filename is not null")
    return named.groupBy(*keys, "media_filename").agg(F.min_by("message_id", "line_number").alias("message_id"), F.max_by("timestamp", "line_number").alias("timestamp"))


def file_type(name: text.ColumnOrName) -> Column:
    ext = F.lower(F.regexp_extract(text.col(name), r"\.([^.]+)$", 1))
    out = F
    for kind, exts in FILE_TYPES.items():
        out = out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


def downstream_task(kind: text.ColumnOrName) -> Column:
    """The task a file of a type calls for; null for none."""
    out = F
    for name, task in TASKS.items():
        out = out.when(text.col(kind) == name, task)
    return out.otherwise(None)


def census(spark: SparkSession, path: str, tasks: int = 200) -> DataFrame:
    """(path, file_id, sha256, size_bytes, file_type) of all files under path, or of one file. Files are digested as
    streams, where Python reaches their file system; elsewhere each is read as one row, of 2 GB at most."""
    if path.split(":", 1)[0] in digests.SCHEMES:
        spark.dataSource.register(digests.FileDigests)
        rows = spark.read.format("file_digests").option("path", path).option("tasks", tasks).load()
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.select("path", file_id("sha256").alias("file_id"), "sha256", "size_bytes", file_type("path").alias("file_type"))


def members(spark: SparkSession, zip_path: str) -> DataFrame:
    """(name, size_bytes, file_type) of an export's members; its root must hold a text file."""
    with zipfile.ZipFile(zip_path) as z:
        found = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
    if not any("/" not in n and n.lower().endswith(".txt") for n, _ in found):
        raise ValueError(f"{Path(zip_path).name} has no text file at its root")
    return spark.createDataFrame(found, "name string, size_bytes long").withColumn("file_type", file_type("name"))


def without_noise(messages: DataFrame) -> DataFrame:
    """Messages that may be classified: with content, not deleted, without media, and no known notice."""
    keep = (F.coalesce(F.col("is_deleted"), F.lit(False)) == False) & (F.coalesce(F.col("media_ref"), F.lit("")) == "") & F.col("content").isNotNull()  # noqa: E712
    for p in NOISE:
        keep = keep & ~F.col("content").ilike(f"%{p}%")
    return messages.where(keep)


def ingest(messages: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New classification candidates, and the four counts per corpus.

    existing: (obra, source_message_id) of what has been ingested.
    """
    candidates = without_noise(messages).withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    seen = existing.select("obra", F.col("source_message_id").alias("message_id")).distinct().withColumn("seen", F.lit(True))
    marked = candidates.join(seen, ["obra", "message_id"], "left").withColumn("outcome", F.when(F.col("content") == "", "skipped_empty").when(F.col("seen"), "skipped_existing").otherwise("inserted"))
    new = marked.where("outcome = 'inserted'").select("obra", message_file_id("message_id").alias("source_file_id"), F.lit("text_message").alias("source_type"), F.col("message_id").alias("source_message_id"), F.sha2("content", 256).alias("source_sha256"), F.lit("pending_classify").alias("semantic_status"))
    counts = marked.groupBy("obra").agg(F.count("*").alias("candidates"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "skipped_existing", "skipped_empty")))
    return new, counts
