"""The entry-conditional ladder: what a fresh unit earns over h days, by regime on the entry date."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelark.functions.kernels import block_bootstrap, cluster_bootstrap
from tidelark.functions.series import business_days, with_runs
from tidelark.sources.tables import GROUP

HORIZONS = (1, 3, 5, 10, 20)
Z90 = 1.6448536
CELL = [*GROUP, "regime", "h"]


def cumulative(td: DataFrame, horizons: Iterable[int] = HORIZONS, expiry: bool = True) -> DataFrame:
    """P&L of each trade up to the horizons and to expiry."""
    w = Window.partitionBy(*GROUP, "trade_id").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    keep = F.col("age").isin(list(horizons))
    at_end = F.col("age") == F.col("tenor_days")
    run = td.select(*GROUP, "trade_id", "entry_date", F.col("age").alias("h"), F.round(F.sum("pnl").over(w), 9).alias("cum_pnl"), at_end.alias("to_expiry"), keep.alias("_k"))
    return run.where(F.col("_k") | F.col("to_expiry") if expiry else F.col("_k")).drop("_k")


def attach_entry_labels(cum: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose entry date has a label; unlabelled_counts tells how many have none."""
    return cum.join(labels.withColumnRenamed("date", "entry_date"), ["pair", "entry_date"])


def unlabelled_counts(cum: DataFrame, labels: DataFrame) -> DataFrame:
    bare = cum.join(labels.withColumnRenamed("date", "entry_date"), ["pair", "entry_date"], "left_anti")
    return bare.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pair", "entry_date").alias("entries"))


def episode_ids(labels: DataFrame) -> DataFrame:
    return with_runs(labels, "regime", "episode")


def count_episodes(labels: DataFrame) -> DataFrame:
    """Runs of each regime of each pair, and of all (regime ALL)."""
    runs = episode_ids(labels).select("pair", "regime", "episode").distinct()
    return runs.withColumn("regime", F.explode(F.array(F.lit("ALL"), "regime"))).groupBy("pair", "regime").agg(F.count(F.lit(1)).alias("episodes"))


def entry_spacing(cum: DataFrame) -> DataFrame:
    """Median business days between entry dates of each group; 1 with fewer than two."""
    w = Window.partitionBy(*GROUP).orderBy("entry_date")
    dates = cum.select(*GROUP, "entry_date").distinct()
    gaps = dates.withColumn("gap", business_days("entry_date") - F.lag(business_days("entry_date")).over(w))
    return gaps.groupBy(*GROUP).agg(F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(1.0)).alias("spacing"))


def with_all(df: DataFrame) -> DataFrame:
    """Each row twice, once under the regime ALL."""
    return df.withColumn("regime", F.explode(F.array(F.lit("ALL"), "regime")))


def newey_west(cum_lab: DataFrame) -> DataFrame:
    """Newey-West standard errors of the cells' means: Bartlett weights up to lag L = min(h, n - 1), whatever h is.

    The weighted autocovariances add up to the sum of squares of all sums of L + 1 neighbouring
    residuals (none beyond the ends), over L + 1. The sum that ends at place t is S(t) - S(t - L - 1),
    S the running sum; so each row goes to place t and to place t + L + 1, and no lag is enumerated.
    """
    order = Window.partitionBy(*CELL).orderBy("entry_date", "trade_id")
    whole, upto = Window.partitionBy(*CELL), order.rowsBetween(Window.unboundedPreceding, 0)
    e = with_all(cum_lab).select(*CELL, "entry_date", "trade_id", F.count(F.lit(1)).over(whole).alias("_n"), (F.col("cum_pnl") - F.avg("cum_pnl").over(whole)).alias("_e"))
    s = e.select(*CELL, "_n", F.row_number().over(order).alias("_k"), F.sum("_e").over(upto).alias("_s"), F.least(F.col("h").cast("long"), F.col("_n") - 1).alias("_l"))
    here, there = F.struct(F.col("_k").cast("long").alias("k"), F.col("_s").alias("s")), F.struct((F.col("_k") + F.col("_l") + 1).alias("k"), (-F.col("_s")).alias("s"))
    sums = s.withColumn("t", F.explode(F.array(here, there))).groupBy(*CELL, "t.k").agg(F.sum("t.s").alias("_w"), F.max("_n").alias("_n"), F.max("_l").alias("_l"))
    n, lags = F.max("_n"), F.max("_l")
    return sums.groupBy(*CELL).agg(F.when(n >= 2, F.sqrt(F.sum(F.col("_w") * F.col("_w")) / (lags + 1) / n / n)).alias("se"))


def ladder(cum_lab: DataFrame, labels: DataFrame, se: DataFrame | None = None, z: float = Z90) -> DataFrame:
    """A row for each group, regime (and ALL) and horizon. se: standard errors of cells, by default Newey-West with bandwidth h.

    Means and quantiles are aggregations, which combine before they are exchanged; the tail is
    read against the quantile of its cell. cum_lab is read more than once: give a stored table.
    """
    x = F.col("cum_pnl")
    cells = with_all(cum_lab)
    stats = cells.groupBy(*CELL).agg(
        F.first("to_expiry").alias("to_expiry"), F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("p_profit"),
        F.percentile(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"),
    )
    stats = stats.select("*", *(F.col("_q")[i].alias(a) for i, a in enumerate(("q05", "q50", "q95")))).drop("_q")
    tail = cells.join(stats.select(*CELL, "q05"), CELL).where(F.round(x, 9) <= F.round("q05", 9)).groupBy(*CELL).agg(F.avg(x).alias("es05"))
    out = stats.join(newey_west(cum_lab) if se is None else se, CELL, "left").join(tail, CELL, "left")
    out = out.join(entry_spacing(cum_lab), GROUP).join(count_episodes(labels), ["pair", "regime"], "left")
    n_eff = F.rint(10 * (F.col("n") * F.least(F.lit(1.0), F.col("spacing") / F.col("h")))) / 10
    return out.select(
        *CELL, "to_expiry", "n", n_eff.alias("n_eff"), "mean", "se", (F.col("mean") - z * F.col("se")).alias("ci_lo"), (F.col("mean") + z * F.col("se")).alias("ci_hi"),
        "p_profit", "q05", "q50", "q95", "es05", F.coalesce("episodes", F.lit(0)).alias("episodes"),
    )


def boot_se(cum_lab: DataFrame, labels: DataFrame, n_boot: int = 1000, alpha: float = 0.1, seed: int = 0, z: float = Z90) -> DataFrame:
    """Half-width of the wider of block and cluster bootstrap, as standard errors of cells.

    Draws depend on the cell and the seed alone, not on partitions.
    """
    cells = with_all(cum_lab.join(episode_ids(labels).select("pair", F.col("date").alias("entry_date"), "episode"), ["pair", "entry_date"], "left"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["entry_date", "trade_id"])
        x, cell = g["cum_pnl"].to_numpy(), tuple(map(str, key))
        lo, hi = block_bootstrap(x, 2 * int(key[-1]), n_boot, alpha, seed, cell)
        half = (hi - lo) / 2
        if key[-2] != "ALL" and g["episode"].notna().all():
            lo, hi = cluster_bootstrap(x, g["episode"].to_numpy(), n_boot, alpha, seed, cell)
            half = np.nanmax([half, (hi - lo) / 2])
        return pd.DataFrame([[*key, half / z]], columns=[*CELL, "se"])

    kinds = {f.name: f for f in cells.schema.fields}
    return cells.groupBy(*CELL).applyInPandas(run, T.StructType([*(kinds[c] for c in CELL), T.StructField("se", T.DoubleType())]))


def increments(lad: DataFrame) -> DataFrame:
    """Earn per day between neighbouring horizons."""
    w = Window.partitionBy(*GROUP, "regime").orderBy("h")
    h0, m0 = F.lag("h", 1, 0).over(w), F.lag("mean", 1, 0.0).over(w)
    return lad.select(*GROUP, "regime", F.concat(F.lit("d"), (h0 + 1).cast("string"), F.lit("-"), F.col("h").cast("string")).alias("bucket"), (h0 + 1).alias("h_from"), F.col("h").alias("h_to"), ((F.col("mean") - m0) / (F.col("h") - h0)).alias("earn_per_day"))


def shrink(lad: DataFrame, kappa: float = 20.0) -> DataFrame:
    """Means drawn to the unconditional one of the same horizon."""
    m = F.max(F.when(F.col("regime") == "ALL", F.col("mean"))).over(Window.partitionBy(*GROUP, "h"))
    w = F.when(F.col("regime") == "ALL", 1.0).otherwise(F.col("n_eff") / (F.col("n_eff") + kappa))
    return lad.withColumn("w_shrink", w).withColumn("mean_shrunk", F.col("w_shrink") * F.col("mean") + (1 - F.col("w_shrink")) * m)


def persistence_split(td: DataFrame, labels: DataFrame, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """Earn where the entry regime still holds at h and where it has broken; a day without label counts as broken."""
    day = td.join(labels.withColumnRenamed("regime", "_day"), ["pair", "date"], "left")
    both = day.join(labels.select("pair", F.col("date").alias("entry_date"), "regime"), ["pair", "entry_date"])
    w = Window.partitionBy(*GROUP, "trade_id").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    left = F.max(F.when(F.col("_day").eqNullSafe(F.col("regime")), 0).otherwise(1)).over(w)
    run = both.select(*GROUP, "regime", F.col("age").alias("h"), F.sum("pnl").over(w).alias("c"), left.alias("b")).where(F.col("h").isin(list(horizons)) | (F.col("h") == F.col("tenor_days")))
    run = run.select(*CELL, "c", "b")
    return run.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("q_broke"), F.avg(F.when(F.col("b") == 0, F.col("c"))).alias("ev_stayed"), F.avg(F.when(F.col("b") == 1, F.col("c"))).alias("ev_broke"), F.avg("c").alias("ev"))
