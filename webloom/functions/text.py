"""Small text functions of reports, progress lines and stored cells, as column expressions."""

from __future__ import annotations

import http

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(text: Column) -> Column:
    """White space (of Unicode) collapsed and stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def duration(seconds: Column) -> Column:
    """45s, 2m 05s, 1h 02m; halves round to even."""
    s = F.bround(seconds.cast("double")).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def short_duration(seconds: Column) -> Column:
    """As reports show it: 340 ms, 2.5 s, then duration()."""
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).when(seconds < 60, F.format_string("%.1f s", seconds)).otherwise(duration(seconds))


def progress_bar(percent: Column, width: int = 20) -> Column:
    """[####----]  20%, rounded down."""
    filled = F.floor(percent * width / 100).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.format_string("] %3d%%", F.floor(percent)))


def byte_size(size: Column) -> Column:
    """512 B, 1.5 KB, 2.0 MB; halves round to even."""
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1 << 20, F.format_string("%.1f KB", F.bround(size / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(size / (1 << 20), 1)))


def shortened(label: Column, longest: int = 48) -> Column:
    return F.when(F.length(label) <= longest, label).otherwise(F.concat(F.substring(label, 1, longest - 1), F.lit("…")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def share(part: Column, whole: Column) -> Column:
    """Percent to one decimal; a dash where there is nothing to share."""
    return F.when(whole == 0, "–").otherwise(F.format_string("%.1f%%", 100.0 * part / F.nullif(whole, F.lit(0))))


def status_name(code: Column) -> Column:
    """404 Not Found; the bare number if no standard names it."""
    phrases = F.create_map(*[F.lit(x) for s in http.HTTPStatus for x in (int(s), s.phrase)])
    return F.concat_ws(" ", code.cast("string"), F.try_element_at(phrases, code.cast("int")))


def utc_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def iso_time(ts: Column) -> Column:
    """ISO 8601 with microseconds, for stores without a timestamp type."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def escaped_formula(cell: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r']"), F.concat(F.lit("'"), cell)).otherwise(cell)


def unescaped_formula(cell: Column) -> Column:
    return F.when(cell.rlike(r"^'[=+\-@\t\r']"), F.substr(cell, F.lit(2))).otherwise(cell)


def progress_line(p: dict[str, Column]) -> Column:
    """One line of a crawl's progress from columns done, total, failed, percent, pages_per_second, eta, finished, active, in_flight, queued, elapsed."""
    left = F.when(p["finished"], "done").when(p["eta"].isNull(), "ETA --").otherwise(F.concat(F.lit("ETA "), duration(p["eta"])))
    parts = [
        progress_bar(p["percent"]),
        F.format_string("%d/%d pages, %d failed", p["done"], p["total"], p["failed"]),
        F.format_string("%.1f pages/s", p["pages_per_second"]),
        left,
        F.format_string("active %d (%d in flight)", p["active"], p["in_flight"]),
        F.format_string("queued %d", p["queued"]),
        duration(p["elapsed"]),
    ]
    return F.concat_ws(" | ", *parts)


def job_line(p: dict[str, Column]) -> Column:
    """One line of a job's progress from columns state, done, total (or null), failed, percent, speed, eta, in_progress, queued, workers, lost, elapsed."""
    left = F.when(p["state"] == "seeding", "seeding").when(p["state"] == "finished", "done").when(p["eta"].isNull(), "ETA --").otherwise(F.concat(F.lit("ETA "), duration(p["eta"])))
    bounded = F.concat_ws(" | ", progress_bar(p["percent"]), F.format_string("%d/%d pages", p["done"], p["total"]))
    pages = F.when(p["total"].isNull(), F.format_string("%d pages", p["done"])).otherwise(bounded)
    workers = F.concat(F.format_string("workers %d", p["workers"]), F.when(p["lost"] > 0, F.format_string(" (%d lost)", p["lost"])).otherwise(""))
    return F.concat_ws(
        " | ", F.concat(pages, F.format_string(", %d failed", p["failed"])), F.format_string("%.1f pages/s", p["speed"]), left, workers,
        F.format_string("in progress %d", p["in_progress"]), F.format_string("queued %d", p["queued"]), duration(p["elapsed"]),
    )
