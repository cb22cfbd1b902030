"""Report sinks: Markdown in the plan, LaTeX and SVG from the few rows of a finished table."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_lines(*columns: str) -> Column:
    """A Markdown table row; pipes and newlines are escaped, null is a dash."""
    cells = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def few_rows(df: DataFrame, most: int) -> list:
    """The rows of a table small enough to draw; a larger one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to draw")
    return rows


def markdown_table(df: DataFrame, most: int = 500) -> str:
    rows = few_rows(df.select(markdown_lines(*df.columns).alias("line")), most)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *[r["line"] for r in rows]]) + "\n"


def latex_table(panels: dict[str, DataFrame], most: int = 50) -> str:
    """A tabular with one panel a table; all have the same columns."""
    clean = lambda v: "--" if v is None else str(v).translate({ord(c): f"\\{c}" for c in "&%$#_{}"})
    columns = next(iter(panels.values())).columns
    out = ["\\begin{tabular}{" + "l" + "r" * (len(columns) - 1) + "}", " & ".join(map(clean, columns)) + " \\\\", "\\hline"]
    for title, df in panels.items():
        out.append(f"\\multicolumn{{{len(columns)}}}{{l}}{{{clean(title)}}} \\\\")
        out += [" & ".join(clean(v) for v in r) + " \\\\" for r in few_rows(df, most)]
    return "\n".join([*out, "\\end{tabular}", ""])


def _svg(width: int, height: int, body: list[str]) -> str:
    text = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(body) + "</svg>"
    ET.fromstring(text)  # well-formed or an error
    return text


def _text(x: float, y: float, s: object) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="11">{escape(str(s))}</text>'


def heatmap_svg(df: DataFrame, row: str, column: str, value: str, most: int = 2000, cell: int = 44, marker: str | None = None) -> str:
    """Rows by columns, shaded by value; an absent or null cell is grey. Cells whose boolean marker column holds get a dot, such as the topics
    of a city with enough votes."""
    kept = few_rows(df.select(row, column, value, *([marker] if marker else [])), most)
    found = {(r[row], r[column]): r[value] for r in kept}
    marked = {(r[row], r[column]) for r in kept if marker and r[marker]}
    rows, columns = sorted({k[0] for k in found}, key=str), sorted({k[1] for k in found}, key=str)
    known = [v for v in found.values() if v is not None] or [0.0]
    low, span = min(known), (max(known) - min(known)) or 1.0
    body = [_text(120 + j * cell, 14, c) for j, c in enumerate(columns)]
    for i, r in enumerate(rows):
        body.append(_text(4, 40 + i * cell, r))
        for j, c in enumerate(columns):
            v = found.get((r, c))
            shade = "#bbbbbb" if v is None else f"rgb({int(245 - 200 * (v - low) / span)},{int(250 - 120 * (v - low) / span)},255)"
            body.append(f'<rect x="{120 + j * cell}" y="{20 + i * cell}" width="{cell - 2}" height="{cell - 2}" fill="{shade}"/>')
            body.append(_text(124 + j * cell, 44 + i * cell, "NA" if v is None else f"{v:.2f}"))
            if (r, c) in marked:
                body.append(f'<circle cx="{112 + (j + 1) * cell}" cy="{28 + i * cell}" r="3" fill="#aa2222"/>')
    return _svg(140 + cell * len(columns), 40 + cell * len(rows), body)


def bars_svg(df: DataFrame, label: str, value: str, most: int = 200) -> str:
    rows = few_rows(df.select(label, value), most)
    top = max([abs(r[value] or 0) for r in rows], default=0) or 1
    body = []
    for i, r in enumerate(rows):
        body += [_text(4, 18 + 20 * i, r[label]), f'<rect x="160" y="{6 + 20 * i}" width="{260 * abs(r[value] or 0) / top:.1f}" height="14" fill="#5577aa"/>', _text(430, 18 + 20 * i, r[value])]
    return _svg(520, 20 + 20 * len(rows), body)


def band_svg(df: DataFrame, x: str, mid: str, low: str, high: str, most: int = 2000) -> str:
    """A line with a band, such as a median with its quartiles by epoch, or a metric with its range by setting."""
    rows = sorted(few_rows(df.select(x, mid, low, high), most), key=lambda r: r[x])
    if not rows:
        return _svg(520, 260, [])
    x0, x1 = rows[0][x], rows[-1][x]
    y0, y1 = min(r[low] for r in rows), max(r[high] for r in rows)
    px = lambda v: 40 + 460 * (v - x0) / ((x1 - x0) or 1)
    py = lambda v: 230 - 210 * (v - y0) / ((y1 - y0) or 1)
    line = lambda c: " ".join(f"{px(r[x]):.1f},{py(r[c]):.1f}" for r in rows)
    back = " ".join(f"{px(r[x]):.1f},{py(r[low]):.1f}" for r in reversed(rows))
    return _svg(520, 260, [f'<polygon points="{line(high)} {back}" fill="#cdd9ee"/>', f'<polyline points="{line(mid)}" fill="none" stroke="#224488"/>', _text(40, 250, x0), _text(470, 250, x1)])


def whisker_panels_svg(panels: list[tuple[str, DataFrame]], x: str, mid: str, low: str, high: str, most: int = 200) -> str:
    """Panels side by side, each with a metric by setting: a dot at mid and a whisker from low to high. Null values leave their place empty."""
    body, tall = [], 200
    for k, (title, df) in enumerate(panels):
        rows = sorted(few_rows(df.select(x, mid, low, high), most), key=lambda r: (r[x] is None, r[x]))
        known = [r for r in rows if None not in (r[mid], r[low], r[high])]
        left = 20 + 260 * k
        body.append(_text(left, 16, title))
        if not known:
            continue
        y0, span = min(r[low] for r in known), (max(r[high] for r in known) - min(r[low] for r in known)) or 1.0
        at = lambda v: 30 + (tall - 60) * (1 - (v - y0) / span)
        for i, r in enumerate(rows):
            px = left + 20 + 210 * i / max(len(rows) - 1, 1)
            body.append(_text(px - 6, tall - 8, r[x]))
            if r in known:
                body.append(f'<path d="M{px:.1f} {at(r[low]):.1f} V{at(r[high]):.1f} m-4 0 h8 M{px - 4:.1f} {at(r[low]):.1f} h8" stroke="#224488" fill="none"/>')
                body.append(f'<circle cx="{px:.1f}" cy="{at(r[mid]):.1f}" r="3" fill="#224488"/>')
    return _svg(40 + 260 * len(panels), tall, body)


def chain_svg(panels: list[tuple[str, str]]) -> str:
    """Titled boxes from left to right, such as post, words, requirement and action."""
    body = []
    for i, (title, text) in enumerate(panels):
        body += [f'<rect x="{10 + 210 * i}" y="10" width="190" height="120" fill="#eef2f8" stroke="#446"/>', _text(18 + 210 * i, 30, title)]
        body += [_text(18 + 210 * i, 50 + 15 * k, text[28 * k : 28 * k + 28]) for k in range(min(5, -(-len(text) // 28)))]
        if i:
            body.append(f'<path d="M{210 * i - 8} 70 l16 0" stroke="#446"/>')
    return _svg(20 + 210 * len(panels), 140, body)
