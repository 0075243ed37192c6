"""Images and documents: what to skip, where to send, and how results change states."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.text import ColumnOrName, col

# Limits of the image filter, in its mild and its strict form, and the shape of receipts.
MILD = {"least_bytes": 3 * 1024, "most_bytes": 25 * 1024 * 1024, "least_px": 64, "most_px": 8192, "least_sharpness": 10}
STRICT = {"least_bytes": 5 * 1024, "most_bytes": 15 * 1024 * 1024, "least_px": 100, "most_px": 5000, "least_sharpness": 30}
RECEIPT_ASPECT, RECEIPT_PX = (0.35, 0.75), (200, 2400)
DOCUMENT_WORDS = 15


def verdict(size: ColumnOrName, width: ColumnOrName, height: ColumnOrName, sharpness: ColumnOrName, strict: bool = False) -> tuple[Column, Column, Column]:
    """(skip, reason, warnings). The strict form skips what the mild one only warns of; a null width is corrupt."""
    t = STRICT if strict else MILD
    s, w, h, v = (col(c) for c in (size, width, height, sharpness))
    hard = [("too_small", s < t["least_bytes"]), ("corrupted", w.isNull() | h.isNull()), ("dimensions_too_small", (w < t["least_px"]) | (h < t["least_px"]))]
    soft = [("too_large", s > t["most_bytes"]), ("dimensions_too_large", (w > t["most_px"]) | (h > t["most_px"])), ("too_blurry", v < t["least_sharpness"])]
    order = [hard[0], soft[0], hard[1], hard[2], soft[1], soft[2]] if strict else hard
    reason = F
    for name, c in order:
        reason = reason.when(c, name)
    reason = reason.otherwise(None)
    warnings = F.array().cast("array<string>") if strict else F.when(reason.isNotNull(), F.array().cast("array<string>")).otherwise(F.filter(F.array(*(F.when(c, n) for n, c in soft)), lambda x: x.isNotNull()))
    return reason.isNotNull(), reason, warnings


def route(width: ColumnOrName, height: ColumnOrName, text_dense: ColumnOrName) -> Column:
    """financial, document or vision. Unknown text density lets a receipt's shape decide."""
    w, h, dense = col(width), col(height), col(text_dense)
    shape = (w / F.greatest(h, F.lit(1))).between(*RECEIPT_ASPECT) & w.between(*RECEIPT_PX) & h.between(*RECEIPT_PX)
    return F.when(w.isNull() | h.isNull(), "vision").when(shape & F.coalesce(dense, F.lit(True)), "financial").when(dense, "document").otherwise("vision")


def ocr_target(path: ColumnOrName, file_type: ColumnOrName, hint: ColumnOrName, has_text: ColumnOrName) -> Column:
    return F.when(F.lower(col(path)).endswith(".pdf") | (col(file_type) == "document"), "document").when(col(hint) == "financial", "financial").when(col(hint) == "document", "document").when(col(has_text) == F.lit(False), "skip").otherwise("generic")


def ocr_first(is_frame: ColumnOrName, malformed: ColumnOrName, is_document: ColumnOrName, words: ColumnOrName) -> Column:
    """Where an image goes after OCR: frames, failures and photos to visual analysis, the rest is a document."""
    photo = ~(F.coalesce(col(is_document), F.lit(False)) & (F.coalesce(col(words), F.lit(0)) >= DOCUMENT_WORDS))
    return F.when(col(is_frame) | F.coalesce(col(malformed), F.lit(True)) | photo, "visual_analysis").otherwise("document")


def status_after(quality: ColumnOrName) -> Column:
    """Coherent transcripts go on to classification, others wait for a person."""
    return F.when(col(quality) == "coerente", "pending_classify").otherwise("pending_review")


def sharpness(images: DataFrame, column: str = "content") -> DataFrame:
    """Adds the variance of the Laplacian of an 8-bit grey raster: (width, height, content) rows of raw bytes."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, w, h in zip(b.column(column).to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist()):
                if raw is None or not w or not h or w < 3 or h < 3 or len(raw) != w * h:
                    out.append(None)
                    continue
                g = np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float64)
                lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
                out.append(float(lap.var()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "sharpness"])

    from pyspark.sql import types as T

    schema = T.StructType([*images.schema.fields, T.StructField("sharpness", T.DoubleType())])
    return images.mapInArrow(run, schema)
