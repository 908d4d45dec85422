"""Result tables as text and files: Markdown, cards, folders of artefacts, a JSON payload.

Only results go through the driver, whole; a limit of rows or characters is a choice of the caller, and a text that meets it says so.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.sources import tables as tb


def _rows(df: DataFrame, most: int | None) -> tuple[list, bool]:
    rows = (df if most is None else df.limit(most + 1)).collect()
    return rows[:most], most is not None and len(rows) > most


def _text(v: object) -> str:
    return "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, most: int | None = None) -> str:
    """A table in Markdown, with a note where rows are left out."""
    rows, more = _rows(df, most)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(_text, r)) + " |" for r in rows)]
    return "\n".join(lines) + (f"\n(first {most} rows)" if more else "") + "\n"


def card(lad: DataFrame, inc: DataFrame, pair: str, archetype: str, regime: str) -> str:
    """The ladder of one cell, its worst stretch, and a warning where it rests on fewer than ten episodes."""
    own = (F.col("pair") == pair) & (F.col("archetype") == archetype) & (F.col("regime") == regime)
    table = lad.where(own).orderBy("h").select("h", "n", "n_eff", "episodes", "mean", "ci_lo", "ci_hi", "p_profit", "q05", "es05")
    few = lad.where(own).agg(F.min("episodes")).first()[0]
    worst = inc.where(own).orderBy("earn_per_day", "h_from").first()
    note = f"Thin evidence: {few} episodes.\n" if few is not None and few < 10 else ""
    stretch = f"Worst stretch: {worst['bucket']} at {worst['earn_per_day']:.4g} a day.\n" if worst else ""
    return f"## {pair} {archetype}, entered in {regime}\n\n{note}{stretch}\n{markdown(table)}"


def packet(title: str, parts: dict[str, DataFrame], config: dict | None = None, most_characters: int | None = None) -> str:
    """A packet of tables for review, headed by a hash of the configuration. With a limit whole tables are left out, and named."""
    mark = hashlib.sha256(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()[:10]
    text, left = f"# {title}\n\nconfiguration {mark}\n\n", []
    for n, df in parts.items():
        part = f"## {n}\n\n{markdown(df)}\n"
        if most_characters is not None and len(text) + len(part) > most_characters - 200:
            left.append(n)
        else:
            text += part
    return text + (f"\nLeft out for the packet's size: {', '.join(left)}\n" if left else "")


def dump(parts: dict[str, tuple[DataFrame, str]], folder: str, kind: str = "csv") -> DataFrame:
    """Write each table (with what it is) under the folder, and the manifest of all; returns the manifest."""
    for name, (df, _) in parts.items():
        tb.write(df, f"{folder}/{name}.{kind}")
    spark = next(iter(parts.values()))[0].sparkSession
    manifest = spark.createDataFrame([(f"{n}.{kind}", what) for n, (_, what) in parts.items()], "name string, what string")
    tb.write(manifest.coalesce(1), f"{folder}/manifest.{kind}")
    return manifest


def _clean(v: object) -> object:
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    return v.isoformat() if isinstance(v, dt.date) else v


def payload(pairs: dict[str, dict[str, DataFrame]]) -> str:
    """Whole tables of each pair as JSON, column by column, by date where they have one; what is missing is null.

    No pair, or one without a table, is refused.
    """
    if not pairs or not all(pairs.values()):
        raise ValueError("a page needs a pair, and each pair a table")
    out: dict[str, dict] = {}
    for pair, tables in pairs.items():
        out[pair] = {}
        for name, df in tables.items():
            rows = (df.orderBy("date", *(c for c in df.columns if c != "date")) if "date" in df.columns else df).collect()
            out[pair][name] = {"columns": {c: [_clean(r[c]) for r in rows] for c in df.columns}, "complete": True}
    return json.dumps(out, sort_keys=True)
