"""Timestamps: parsing, resolution among sources, drift, conflicts and calendar buckets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor.functions.text import ColumnOrName, col

SOURCES = ("whatsapp_txt", "filename", "metadata", "filesystem")
CONFIDENCES = ("max", "high", "medium", "low")
CONFLICT_SECONDS = 2 * 3600


def naive(c: ColumnOrName) -> Column:
    """ISO text as a timestamp without zone; an offset is dropped, not applied."""
    return col(c).try_cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, truncated towards zero."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return ((micros(later) - micros(earlier)) / 1_000_000).cast("bigint")


def payment_time(day: ColumnOrName, hour: ColumnOrName) -> Column:
    """A payment has a time only when both its date and its hour are known."""
    d, h = F.nullif(col(day), F.lit("")), F.nullif(col(hour), F.lit(""))
    return F.when(d.isNotNull() & h.isNotNull(), naive(F.concat(d, F.lit("T"), h)))


def window_label(seconds: int) -> str:
    for size, unit in ((86400, "d"), (3600, "h")):
        if seconds >= size and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds // 60}min"


def from_filename(c: ColumnOrName) -> Column:
    """The time a media file's name carries: a full stamp, or a day, which is midnight; null if none."""
    name = col(c)
    stamp = lambda pattern, to, form: F.try_to_timestamp(F.when(name.rlike(pattern), F.regexp_replace(name, pattern, to)), F.lit(form)).cast("timestamp_ntz")
    return F.coalesce(
        stamp(r"^\d{5,}-(?:AUDIO|PHOTO|VIDEO)-(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})\.[A-Za-z0-9]+$", "$1$2$3$4$5$6", "yyyyMMddHHmmss"),
        stamp(r"^(?:IMG|VID|PTT|AUD)-(\d{8})-WA\d+\.[A-Za-z0-9]+$", "$1", "yyyyMMdd"),
        stamp(r"^(?:IMG|VID)_(\d{8})_(\d{6})\.[A-Za-z0-9]+$", "$1$2", "yyyyMMddHHmmss"),
    )


def day_first(c: ColumnOrName) -> Column:
    """Day-first date and time; two-digit years are of this century."""
    forms = ("d/M/yy H:mm", "d/M/y H:mm", "d/M/yy H:mm:ss", "d/M/y H:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)).cast("timestamp_ntz") for f in forms))


def date_only(c: Column) -> Column:
    return c == F.date_trunc("day", c).cast("timestamp_ntz")


def drift(a: Column, b: Column) -> Column:
    """Seconds apart; where either side carries only a day, whole days apart."""
    days = F.abs(F.datediff(a.cast("date"), b.cast("date"))) * 86400.0
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(date_only(a) | date_only(b), days).otherwise(F.abs(micros(a) - micros(b)) / 1_000_000.0)


def resolve(*sources: ColumnOrName) -> dict[str, Column]:
    """The first known of the four sources, with its confidence, conflicts among all pairs, and their notes."""
    cs = [col(s) for s in sources]
    pick = lambda values: F.coalesce(*(F.when(c.isNotNull(), v) for c, v in zip(cs, values)))
    notes = F.array(*(F.when(drift(a, b) > CONFLICT_SECONDS, F.format_string(f"{x} vs {y}: %.1fh drift", drift(a, b) / 3600)) for (x, a), (y, b) in combinations(zip(SOURCES, cs), 2)))
    notes = F.filter(notes, lambda n: n.isNotNull())
    conflict = F.size(notes) > 0
    confidence = pick(CONFIDENCES)
    return {
        "resolved": F.coalesce(*cs),
        "source": pick(SOURCES),
        "confidence": F.when(conflict & confidence.isin("max", "high"), "medium").otherwise(confidence),
        "conflict": conflict,
        "notes": notes,
    }


def to_zone(c: ColumnOrName, zone: str = "America/Sao_Paulo", source: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(source), F.lit(zone), col(c))


def iso_day(c: ColumnOrName) -> Column:
    return F.coalesce(F.date_format(naive(c), "yyyy-MM-dd"), F.lit(""))


def clock(c: ColumnOrName) -> Column:
    return F.coalesce(F.date_format(naive(c), "HH:mm"), F.lit("--:--"))


def br_date(c: ColumnOrName) -> Column:
    return F.date_format(col(c), "dd/MM/yyyy")


def bucket(scope: str, day: ColumnOrName) -> tuple[Column, Column, Column]:
    """(label, first day, last day) of the ISO week, month or quarter of a day; a day is its own."""
    d = col(day).cast("date")
    year, month = F.year(d), F.month(d)
    if scope == "day":
        return F.date_format(d, "yyyy-MM-dd"), d, d
    if scope == "week":
        monday = F.date_trunc("week", d).cast("date")
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)), monday, F.date_add(monday, 6)
    if scope == "month":
        return F.format_string("%04d-%02d", year, month), F.trunc(d, "month"), F.last_day(d)
    if scope == "quarter":
        first = F.trunc(d, "quarter")
        return F.format_string("%04d-Q%d", year, F.quarter(d)), first, F.last_day(F.add_months(first, 2))
    raise ValueError(f"no buckets of scope {scope}")


def label_date(scope: ColumnOrName, label: ColumnOrName) -> Column:
    """The first day a label stands for, by its scope."""
    s, r = col(scope), col(label)
    year = F.regexp_extract(r, r"^(\d{4})", 1).try_cast("int")
    week = F.regexp_extract(r, r"-W(\d{1,2})$", 1).try_cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    quarter = F.regexp_extract(r, r"-Q([1-4])$", 1).try_cast("int")
    return (
        F.when(s == "day", r.try_cast("date"))
        .when(s == "week", F.date_add(F.date_trunc("week", jan4).cast("date"), (week - 1) * 7))
        .when(s == "month", F.concat(r, F.lit("-01")).try_cast("date"))
        .when(s == "quarter", F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1)))
    )


def frame_times(duration: ColumnOrName) -> Column:
    """Seconds at 5, 25, 50, 75 and 95 per cent of a video, kept half a second from both ends."""
    d = col(duration)
    return F.array(*(F.greatest(F.lit(0.5), F.least(d * p, d - 0.5)) for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
