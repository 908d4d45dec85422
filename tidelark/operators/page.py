"""Pictures and pages of results: the rows behind each picture, files of gates, and a page that holds its data.

The rows are queries; drawing them needs a plotting library and is left out where there is none.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.sources.tables import GROUP, where_group


def ladder_points(lad: DataFrame, **group: object) -> DataFrame:
    """Mean and interval by regime and horizon of one group, in order of the horizon."""
    return where_group(lad, **group).select("regime", "h", "mean", "ci_lo", "ci_hi", "episodes").orderBy("regime", "h")


def increment_bars(inc: DataFrame, **group: object) -> DataFrame:
    """Earn a day between horizons by regime of one group."""
    return where_group(inc, **group).select("regime", "bucket", "h_from", "h_to", "earn_per_day").orderBy("regime", "h_from")


def tenor_curve(lad: DataFrame, h: int, **group: object) -> DataFrame:
    """Mean at one horizon by tenor and regime."""
    return where_group(lad, **group).where(F.col("h") == h).select(*GROUP, "regime", "mean", "ci_lo", "ci_hi").orderBy("regime", "tenor_days")


def draw(points: DataFrame, path: str, x: str, y: str, by: str = "regime", lo: str | None = None, hi: str | None = None) -> bool:
    """Draw lines of a small result to a picture; False where no plotting library is installed."""
    try:
        from matplotlib.figure import Figure
    except ModuleNotFoundError:
        return False
    rows = points.collect()
    fig = Figure(figsize=(8, 5))
    ax = fig.subplots()
    for name in sorted({r[by] for r in rows}):
        own = [r for r in rows if r[by] == name]
        ax.plot([r[x] for r in own], [r[y] for r in own], marker="o", label=str(name))
        if lo and hi:
            ax.fill_between([r[x] for r in own], [r[lo] for r in own], [r[hi] for r in own], alpha=0.15)
    ax.axhline(0, lw=0.8, color="grey")
    ax.set_xlabel(x)
    ax.set_ylabel(y)
    ax.legend()
    fig.savefig(path, dpi=120)
    return True


def write_gates(gates: dict[str, DataFrame], path: str) -> dict:
    """One row of each gate as JSON, with whether all pass; returns what was written."""
    told = {name: df.first().asDict() for name, df in gates.items()}
    told["all_pass"] = all(bool(g.get("pass")) for g in told.values())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(told, indent=2, sort_keys=True, default=str))
    return told


_SCRIPT = """
const data = JSON.parse(document.getElementById('data').textContent);
const pick = document.getElementById('pick'), view = document.getElementById('view');
const all = Object.entries(data).flatMap(([p, t]) => Object.keys(t).map(n => [p, n]));
all.forEach(([p, n], i) => pick.add(new Option(p + ' / ' + n, i)));
function show() {
  const [p, n] = all[pick.value], cols = data[p][n].columns, names = Object.keys(cols), rows = names.length ? cols[names[0]].length : 0;
  const table = document.createElement('table'), line = (kind, cells) => { const tr = table.insertRow(); cells.forEach(c => { const e = document.createElement(kind); e.textContent = c === null ? '' : c; tr.append(e); }); };
  line('th', names);
  for (let i = 0; i < rows; i++) line('td', names.map(c => cols[c][i]));
  view.replaceChildren(table);
}
pick.onchange = show;
show();
"""


def page(payload: str, title: str) -> str:
    """A page that shows each table of a payload (see report.payload); it holds all its data and loads nothing."""
    safe = payload.replace("<", "\\u003c")
    head = f"<meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif}}td,th{{padding:2px 8px;text-align:right}}</style>"
    return f"<!doctype html><html><head>{head}</head><body><h1>{html.escape(title)}</h1><select id='pick'></select><div id='view'></div><script id='data' type='application/json'>{safe}</script><script>{_SCRIPT}</script></body></html>"
