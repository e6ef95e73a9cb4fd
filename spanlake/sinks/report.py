"""Static reports. A report shows a bounded number of rows; the tables behind it stay whole on storage."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_LIMIT = 500
CELL_LIMIT = 1000
CARD_LIMIT = 24


def script_safe(value: Column) -> Column:
    """JSON text that cannot close the script element it is embedded in."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def embedded_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str).replace("</", "<\\/")


def shown_rows(df: DataFrame, limit: int = ROW_LIMIT) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.limit(limit).collect()]


def _cell(value) -> str:
    if value is None:
        return ""
    text = json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else str(value)
    return html.escape(text if len(text) <= CELL_LIMIT else text[:CELL_LIMIT] + "…")


def table_html(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def cards_html(summary: dict) -> str:
    plain = [(k, v) for k, v in summary.items() if not isinstance(v, (dict, list))][:CARD_LIMIT]
    return "".join(f'<div class="card"><b>{html.escape(str(v))}</b><span>{html.escape(k)}</span></div>' for k, v in plain)


_STYLE = """
body{font-family:system-ui,sans-serif;margin:2rem;color:#222}
table{border-collapse:collapse;font-size:.85rem}td,th{border:1px solid #ccc;padding:.3rem .5rem;vertical-align:top}
.card{display:inline-block;border:1px solid #ccc;border-radius:6px;padding:.6rem 1rem;margin:.3rem}
.card span{display:block;font-size:.75rem;color:#666}nav button{margin-right:.4rem}section{display:none}section.on{display:block}
"""
_SCRIPT = """
const show=id=>document.querySelectorAll('section').forEach(s=>s.classList.toggle('on',s.id===id));
const filter=(box)=>{const n=box.value.toLowerCase();box.closest('section').querySelectorAll('tbody tr').forEach(
 r=>r.style.display=r.textContent.toLowerCase().includes(n)?'':'none')};
show(document.querySelector('section').id);
"""


def write_report(path: str, title: str, summary: dict, tables: dict[str, DataFrame], limit: int = ROW_LIMIT) -> str:
    """One page with a tab per table, a text filter in each tab, and the summary as cards and as JSON."""
    tabs, sections = [], []
    for number, (name, df) in enumerate({**tables}.items()):
        rows = shown_rows(df, limit)
        tabs.append(f"<button onclick=\"show('t{number}')\">{html.escape(name)}</button>")
        sections.append(
            f'<section id="t{number}"><h2>{html.escape(name)}</h2><input placeholder="filter" oninput="filter(this)">'
            f"{table_html(rows, df.columns)}</section>"
        )
    page = (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head>"
        f"<body><h1>{html.escape(title)}</h1>{cards_html(summary)}<nav>{''.join(tabs)}</nav>{''.join(sections)}"
        f"<script type='application/json' id='summary'>{embedded_json(summary)}</script><script>{_SCRIPT}</script></body></html>"
    )
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(page, encoding="utf-8")
    return str(target)


def console_table(rows: list[dict], columns: list[str], digits: int = 2) -> str:
    """Fixed-width text table; missing values print as n/a."""

    def show(value) -> str:
        return "n/a" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)

    cells = [columns] + [[show(r.get(c)) for c in columns] for r in rows]
    widths = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in cells)
