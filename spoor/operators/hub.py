"""The event hub: classifications with the text and the time that their source gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import temporal, text

# Keys of a visual analysis that carry text, in the order they are read.
VISUAL_KEYS = ("atividade_em_curso", "elementos_construtivos", "observacoes_tecnicas", "materiais_visiveis")


def categories(c: text.ColumnOrName) -> Column:
    """A JSON list of labels; anything else is no labels."""
    return F.coalesce(F.from_json(text.col(c), "array<string>"), F.array().cast("array<string>"))


def visual_text(c: text.ColumnOrName, keys: tuple[str, ...] = VISUAL_KEYS, labelled: bool = False) -> Column:
    """The values of a visual analysis joined by bars, with their keys if labelled."""
    values = [F.get_json_object(text.col(c), f"$.{k}") for k in keys]
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v) if labelled else v) for k, v in zip(keys, values)]
    return F.concat_ws(" | ", *parts)


def _joined(classifications: DataFrame, transcriptions: DataFrame, files: DataFrame, messages: DataFrame, visual: DataFrame, documents: DataFrame) -> DataFrame:
    """Classified rows with all that their sources may give them.

    The file of a classification and its parent serve transcription, image and document alike, so files are
    joined twice and not six times. All joins are equi-joins on ids and keep every classification.
    """
    c = classifications.where("semantic_status = 'classified'").withColumn("source_type", F.lower(F.coalesce("source_type", F.lit("transcription"))))
    own = files.select(F.col("file_id").alias("source_file_id"), F.col("timestamp_resolved").alias("ts_own"), F.col("derived_from").alias("parent_id"))
    parent = files.select(F.col("file_id").alias("parent_id"), F.col("timestamp_resolved").alias("ts_parent"), F.col("referenced_by_message").alias("parent_message"), F.col("derived_from").alias("parent_from"))
    said = messages.select(F.col("message_id").alias("parent_message"), F.col("timestamp_whatsapp").alias("ts_message"))
    direct = messages.select(F.col("message_id").alias("source_message_id"), F.col("content").alias("direct_content"), F.col("timestamp_whatsapp").alias("ts_direct"))
    spoken = transcriptions.select("obra", F.col("file_id").alias("source_file_id"), F.col("text").alias("spoken"))
    seen = visual.select("obra", F.col("file_id").alias("source_file_id"), "analysis_json")
    pages = F.col("page_count") if "page_count" in documents.columns else F.lit(None).cast("int")
    read = documents.select("obra", F.col("file_id").alias("source_file_id"), F.col("text").alias("read_text"), pages.alias("pages"))
    joined = c.join(own, "source_file_id", "left").join(parent, "parent_id", "left").join(said, "parent_message", "left").join(direct, "source_message_id", "left")
    return joined.join(spoken, ["obra", "source_file_id"], "left").join(seen, ["obra", "source_file_id"], "left").join(read, ["obra", "source_file_id"], "left")


def _by_source(message: Column, image: Column, document: Column, other: Column) -> Column:
    kind = F.col("source_type")
    return F.when(kind == "text_message", message).when(kind == "visual_analysis", image).when(kind == "document", document).otherwise(other)


def _stamp() -> Column:
    """The time that a source gives, as text."""
    spoken = F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in ("ts_parent", "ts_own", "ts_message")))
    return _by_source(F.col("ts_direct"), F.col("ts_parent"), F.col("ts_parent"), spoken)


def events(classifications: DataFrame, transcriptions: DataFrame, files: DataFrame, messages: DataFrame, visual: DataFrame, documents: DataFrame) -> DataFrame:
    """(obra, id, source_type, ts, body, text, primary_category) for every classified row, as detectors read it."""
    joined = _joined(classifications, transcriptions, files, messages, visual, documents)
    body = _by_source(text.truthy("direct_content"), visual_text("analysis_json"), text.truthy("read_text"), text.truthy("human_corrected_text", "spoken"))
    labels = categories("categories")
    concept = text.join_nonempty(" \n ", F.coalesce("reasoning", F.lit("")), body, F.array_join(labels, " "))
    return joined.select("obra", "id", "source_type", temporal.naive(_stamp()).alias("ts"), body.alias("body"), concept.alias("text"), F.get(labels, 0).alias("primary_category"))


def dossier_events(classifications: DataFrame, transcriptions: DataFrame, files: DataFrame, messages: DataFrame, visual: DataFrame, documents: DataFrame) -> DataFrame:
    """(obra, id, stamp, source_type, primary_category, secondary_categories, content_preview, content_full) as a
    dossier shows a classified row: images with their keys, and words for what has no content."""
    joined = _joined(classifications, transcriptions, files, messages, visual, documents)
    image = text.truthy(visual_text("analysis_json", VISUAL_KEYS[:3], labelled=True), F.lit("(sem conteudo)"))
    body = _by_source(text.truthy("direct_content"), image, text.truthy("read_text", F.lit("(sem texto extraido)")), text.truthy("human_corrected_text", "spoken"))
    labels = categories("categories")
    second = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    return joined.select("obra", "id", _stamp().alias("stamp"), "source_type", F.coalesce(F.get(labels, 0), F.lit("")).alias("primary_category"), second.alias("secondary_categories"), text.preview(body).alias("content_preview"), text.short_content(body).alias("content_full"))


def report_events(classifications: DataFrame, transcriptions: DataFrame, files: DataFrame, messages: DataFrame, visual: DataFrame, documents: DataFrame) -> DataFrame:
    """(obra, id, stamp, day, source_kind, text) as a daily report shows a classified row: a correction stands for
    any source, and a picture cut from a video is told from others by its file's own parent."""
    joined = _joined(classifications, transcriptions, files, messages, visual, documents)
    corrected = F.col("human_corrected_text")
    lacking = F.concat(F.lit("(planta/doc com "), F.coalesce(F.nullif("pages", F.lit(0)).cast("string"), F.lit("?")), F.lit(" paginas, texto digital ausente)"))
    shown = _by_source(
        text.truthy(corrected, "direct_content", F.lit("(mensagem vazia)")),
        text.truthy(corrected, visual_text("analysis_json")),
        text.truthy(corrected, "read_text", lacking),
        text.truthy(corrected, "spoken", F.lit("(texto ausente)")),
    )
    picture = F.when(F.coalesce("parent_from", F.lit("")) != "", "video-frame").otherwise("imagem")
    kind = _by_source(F.lit("texto"), picture, F.lit("pdf"), F.lit("audio"))
    return joined.select("obra", "id", _stamp().alias("stamp"), F.substring(_stamp(), 1, 10).alias("day"), kind.alias("source_kind"), shown.alias("text"))


def chronology_events(classifications: DataFrame, transcriptions: DataFrame, files: DataFrame, messages: DataFrame) -> DataFrame:
    """(obra, id, ts, text, category, tags, reviewed, confidence, sender) as a chronology takes a classified row: a
    correction, what was said or written, else the classifier's reasons; the message's own time first."""
    nothing = transcriptions.limit(0)
    joined = _joined(classifications, transcriptions, files, messages.select("message_id", "content", "timestamp_whatsapp"), nothing.select("obra", "file_id", F.lit(None).cast("string").alias("analysis_json")), nothing.select("obra", "file_id", "text"))
    by = messages.select(F.col("message_id").alias("source_message_id"), "sender")
    stamp = F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in ("ts_direct", "ts_parent", "ts_own", "ts_message")))
    labels = categories("categories")
    said = text.truthy("human_corrected_text", "spoken", "direct_content", "reasoning")
    return joined.join(by, "source_message_id", "left").select("obra", "id", temporal.naive(stamp).alias("ts"), said.alias("text"), F.coalesce(F.get(labels, 0), F.lit("")).alias("category"), F.slice(labels, 1, 2).alias("tags"), F.coalesce("human_reviewed", F.lit(0)).cast("int").alias("reviewed"), F.coalesce("confidence_model", F.lit(0.0)).alias("confidence"), "sender")


def by_time_text(stamp: str = "stamp") -> list[Column]:
    """What a dossier sorts by: the time as it is written, the rows without one first, then ids."""
    return [F.coalesce(F.col(stamp), F.lit("")), F.col("id")]


def payments(records: DataFrame) -> DataFrame:
    """(obra, id, ts, cents, description) of financial records."""
    return records.select("obra", "id", temporal.payment_time("data_transacao", "hora_transacao").alias("ts"), F.col("valor_centavos").alias("cents"), F.col("descricao").alias("description"))
