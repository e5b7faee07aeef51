"""Statistics of a crawl as JSON and as one HTML file with its charts inside."""

from __future__ import annotations

import csv
import html
import http
import json
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import stats as S

_STYLE = "body{font:15px/1.5 system-ui;max-width:52rem;margin:2rem auto;padding:0 1rem;color:#222}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:.2rem .6rem;border-bottom:1px solid #ddd}td.n{text-align:right}svg{width:100%}"


def crawl_stats(pages: DataFrame, elapsed: float, top_domains: int = S.TOP_DOMAINS) -> dict[str, Any]:
    """The report's numbers: a few rows, whatever the number of pages. pages has host, status, elapsed, error, skipped."""
    row = S.outcomes(pages, elapsed).first().asDict()
    named = {
        "status_codes": S.by_status(pages).limit(1000),
        "errors": S.largest_first(pages, "error", 1000),
        "top_domains": S.largest_first(pages.withColumn("host", F.coalesce("host", F.lit("unknown"))), "host", top_domains),
    }
    return row | {"elapsed_seconds": elapsed} | {k: {str(r[0]): r[1] for r in df.collect()} for k, df in named.items()}


def render_json(stats: Mapping[str, Any]) -> str:
    return json.dumps(stats, indent=2, ensure_ascii=False, default=str) + "\n"


def _bars(counts: Mapping[str, int]) -> str:
    if not counts:
        return "<p>None.</p>"
    top = max(counts.values()) or 1
    rows = []
    for i, (label, n) in enumerate(counts.items()):
        shown = label if len(label) <= 48 else label[:47] + "…"
        rows.append(f'<text x="0" y="{i * 24 + 16}" font-size="12">{html.escape(shown)}</text><rect x="330" y="{i * 24 + 4}" width="{max(1, 300 * n // top)}" height="16" fill="#4a7ab5"/><text x="{340 + 300 * n // top}" y="{i * 24 + 16}" font-size="12">{n:,}</text>')
    return f'<svg viewBox="0 0 720 {24 * len(counts)}" role="img">{"".join(rows)}</svg>'


def _table(counts: Mapping[str, int], total: int, head: str) -> str:
    share = lambda n: f"{n / total:.1%}" if total else "–"
    rows = "".join(f'<tr><td>{html.escape(k)}</td><td class="n">{n:,}</td><td class="n">{share(n)}</td></tr>' for k, n in counts.items())
    return f"<table><tr><th>{head}</th><th>Pages</th><th>Share</th></tr>{rows}</table>"


def _status(code: str) -> str:
    try:
        return f"{code} {http.HTTPStatus(int(code)).phrase}"
    except ValueError:
        return code


def render_html(stats: Mapping[str, Any], title: str = "Crawl report") -> str:
    total = stats["total_pages"]
    outcomes = {k.capitalize(): stats[k] for k in ("successful", "failed", "skipped")}
    named = {_status(k): v for k, v in stats["status_codes"].items()}
    summary = f"<p>{total:,} pages in {stats['elapsed_seconds']:.1f} s, {stats['pages_per_second']:.1f} pages/s, {stats['avg_response_time'] * 1000:.0f} ms a response.</p>"
    parts = [("Outcomes", outcomes, "Outcome"), ("Status codes", named, "Status"), ("Errors", stats["errors"], "Error"), ("Largest hosts", stats["top_domains"], "Host")]
    body = "".join(f"<h2>{h}</h2>{_bars(c)}{_table(c, total, head) if c else ''}" for h, c, head in parts)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{summary}{body}</body></html>\n'


def export(stats: Mapping[str, Any], stats_json: str | None = None, html_path: str | None = None, title: str = "Crawl report") -> list[str]:
    """Write what is asked for; returns the paths."""
    out = []
    for path, text in ((stats_json, render_json(stats)), (html_path, render_html(stats, title))):
        if path:
            Path(path).write_text(text, encoding="utf-8")
            out.append(path)
    return out


def unsaved_csv(rows: Iterable[Any], path: str) -> None:
    """url, outcome, reason, status, error of pages that weren't saved, safe to open in a spreadsheet."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(("url", "outcome", "reason", "status", "error"))
        for row in rows:
            out.writerow([f"'{v}" if isinstance(v, str) and v[:1] in "=+-@\t\r'" and v else "" if v is None else v for v in row])
