"""Units of vega and weighted combinations of legs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.sources.tables import GROUP, component_columns

# The base legs and the standard combinations, as weights of vega.
BASE_LEGS = ["straddle_atm", "put_25d", "call_25d", "put_10d", "call_10d"]
COMBINATIONS = {
    "rr_25d": {"call_25d": 1.0, "put_25d": -1.0},
    "fly_25d": {"call_25d": 0.5, "put_25d": 0.5, "straddle_atm": -1.0},
    "rr_10d": {"call_10d": 1.0, "put_10d": -1.0},
    "fly_10d": {"call_10d": 0.5, "put_10d": 0.5, "straddle_atm": -1.0},
}
KEY = ["pair", "tenor_days", "entry_date", "age", "date"]


def to_vega_units(td: DataFrame, legs: list[str] = BASE_LEGS, vega: str = "vega") -> DataFrame:
    """P&L of base legs per unit of their vega at age 1; legs without one go, packages stay as they are."""
    if vega not in td.columns:
        raise ValueError("units of vega need the column " + vega)
    v0 = F.max(F.when(F.col("age") == 1, F.abs(vega))).over(Window.partitionBy(*GROUP, "trade_id"))
    own = td.withColumn("_v0", F.when(F.col("archetype").isin(legs), F.nullif(v0, F.lit(0.0))).otherwise(1.0)).where("_v0 is not null")
    return own.withColumns({c: F.col(c) / F.col("_v0") for c in ["pnl", *component_columns(td)]}).drop("_v0")


def unconverted(td: DataFrame, legs: list[str] = BASE_LEGS, vega: str = "vega") -> DataFrame:
    """How many trades of base legs have no vega at age 1, or one of zero: to_vega_units leaves them out."""
    own = td.where(F.col("archetype").isin(legs)).groupBy(*GROUP, "trade_id").agg(F.max(F.when(F.col("age") == 1, F.abs(vega))).alias("_v"))
    return own.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(F.coalesce("_v", F.lit(0.0)) == 0, 1)).alias("dropped"))


def reconcile(td: DataFrame, package: str, weights: dict[str, float]) -> DataFrame:
    """Least squares of a package's daily P&L on its legs, without intercept: a row for each leg with its coefficient.

    Legs are laid side by side by one grouping; all that the fit needs are sums of products, a
    few numbers, solved by the driver. r2 is against the package's mean; corr is that with the
    standard weights.
    """
    legs = list(weights)
    wide = td.where(F.col("archetype").isin([package, *legs])).groupBy("pair", "tenor_days", "entry_date", "age").agg(*(F.avg(F.when(F.col("archetype") == a, F.col("pnl"))).alias(f"_{i}") for i, a in enumerate([package, *legs]))).dropna()
    std = sum((F.col(f"_{i + 1}") * w for i, w in enumerate(weights.values())), F.lit(0.0))
    names = [f"_{i}" for i in range(len(legs) + 1)]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    r = wide.withColumn("_s", std).agg(F.count(F.lit(1)).alias("n"), F.sum("_0").alias("y"), F.corr("_0", "_s").alias("corr"), *sums).first()
    if not r["n"]:
        return td.sparkSession.createDataFrame([], "package string, leg string, coefficient double, r2 double, corr double, n long")
    g = lambda i, j: r[f"_{min(i, j)}_{max(i, j)}"]
    k = range(1, len(legs) + 1)
    beta = np.linalg.lstsq(np.array([[g(i, j) for j in k] for i in k]), np.array([g(0, i) for i in k]), rcond=None)[0]
    left = g(0, 0) - 2 * sum(b * g(0, i) for b, i in zip(beta, k, strict=True)) + sum(beta[i - 1] * beta[j - 1] * g(i, j) for i in k for j in k)
    total = g(0, 0) - r["y"] ** 2 / r["n"]
    rows = [(package, a, float(b), float(1 - left / total) if total > 0 else None, r["corr"], r["n"]) for a, b in zip(legs, beta, strict=True)]
    return td.sparkSession.createDataFrame(rows, "package string, leg string, coefficient double, r2 double, corr double, n long")


def combine(td: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """The weighted sum of legs where every leg has a row that day: one grouping instead of a join for each leg.

    A leg that is nowhere in the table is refused at once; two rows of one leg under one key fail
    the query when it runs, since they would count twice.
    """
    missing = set(weights) - {r[0] for r in td.where(F.col("archetype").isin(list(weights))).select("archetype").distinct().collect()}
    if missing:
        raise ValueError(f"{name} needs legs that are not in the table: {', '.join(sorted(missing))}")
    w = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("archetype"))
    cols = ["pnl", *component_columns(td)]
    legs = td.where(F.col("archetype").isin(list(weights)))
    mask = F.element_at(F.create_map(*(F.lit(x) for i, a in enumerate(weights) for x in (a, 1 << i))), F.col("archetype"))
    out = legs.groupBy(*KEY).agg(F.bit_or(mask).alias("_legs"), F.count(F.lit(1)).alias("_rows"), *(F.sum(w * F.col(c)).alias(c) for c in cols))
    twice = F.raise_error(F.concat(F.lit(f"{name}: a leg has two rows on "), F.col("date").cast("string"))).cast("boolean")
    out = out.where(F.when(F.col("_rows") > F.bit_count("_legs"), twice).otherwise(F.col("_legs") == (1 << len(weights)) - 1))
    tid = F.concat_ws("-", "pair", F.lit(name), F.date_format("entry_date", "yyyy-MM-dd"), F.col("tenor_days").cast("string"))
    return out.select(tid.alias("trade_id"), "pair", F.lit(name).alias("archetype"), "tenor_days", "entry_date", "date", "age", (F.col("tenor_days") - F.col("age")).alias("remaining"), *cols)


def ev_linear(lad: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Mean of a combination from the means of its legs; n and episodes are the first leg's."""
    w = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("archetype"))
    first = lambda c: F.max(F.when(F.col("archetype") == next(iter(weights)), F.col(c))).alias(c)
    legs = lad.where(F.col("archetype").isin(list(weights)))
    out = legs.groupBy("pair", "tenor_days", "regime", "h").agg(F.count_distinct("archetype").alias("_n"), first("to_expiry"), first("n"), F.sum(w * F.col("mean")).alias("mean"), first("episodes")).where(F.col("_n") == len(weights))
    return out.select("pair", F.lit(name).alias("archetype"), "tenor_days", "regime", "h", "to_expiry", "n", "mean", "episodes")


def screen(lad: DataFrame, candidates: dict[str, dict[str, float]], regime: str, h: int) -> DataFrame:
    """Combinations of one regime and horizon with their linear mean, in descending order of it."""
    cell = lad.where((F.col("regime") == regime) & (F.col("h") == h))
    parts = [ev_linear(cell, w, name) for name, w in candidates.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("archetype").alias("combination"), "pair", "tenor_days", F.col("mean").alias("ev_linear"), "episodes").orderBy(F.col("ev_linear").desc(), "combination", "pair")
