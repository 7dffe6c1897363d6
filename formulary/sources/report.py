"""Small results as one JSON document, a Markdown table or a page. Rows are few by construction (sums by split, samples): a bound is checked."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def _few(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds at most {MOST_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def document(df: DataFrame, by: str | None = None) -> str:
    """All rows as a JSON list; with a column, as an object by its values."""
    rows = _few(df)
    whole = rows if by is None else {str(r[by]): {k: v for k, v in r.items() if k != by} for r in rows}
    return json.dumps(whole, indent=1, ensure_ascii=False, default=str)


def _cell(v) -> str:
    return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame) -> str:
    rows = _few(df)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([_cell(r[c]) for c in df.columns]) for r in rows)])


def page(df: DataFrame, title: str) -> str:
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values) + "</tr>"
    body = "\n".join(cells("td", [_cell(r[c]) for c in df.columns]) for r in _few(df))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>\n<table>\n{cells('th', df.columns)}\n{body}\n</table>\n"
