"""Integrity checks, walk-forward evaluation, gates, and the tables of the packets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.functions import kernels as kn
from tidelark.functions.series import series, business_days
from tidelark.operators.states import HIGH, spearman
from tidelark.sources.tables import GROUP, REQUIRED, component_columns, component_sets

TRADE = [*GROUP, "trade_id"]


def check_trade_days(td: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Checks of a trade-day table: check, passed, bad (how many rows or trades). Those named info_ never fail.

    All come from one window over each trade and one aggregation over the trades.
    """
    missing = [c for c in REQUIRED if c not in td.columns]
    spark = td.sparkSession
    if missing:
        return spark.createDataFrame([("required_columns", False, len(missing))], "check string, passed boolean, bad long")
    w = Window.partitionBy(*TRADE).orderBy("age", "date")
    sets = {k: v for k, v in component_sets(td).items() if k != "other"}
    off = {k: (F.abs(F.col("pnl") - sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))) > tolerance).cast("long") for k, cols in sets.items()}
    rows = td.select(*TRADE, "age", "date", "entry_date", "pnl", *(v.alias(f"_off_{k}") for k, v in off.items()), (F.col("age") - F.lag("age").over(w)).alias("_step"), (F.col("date") <= F.lag("date").over(w)).alias("_back"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    trades = rows.groupBy(*TRADE).agg(
        F.min("age").alias("first"), F.max("age").alias("last"), n(F.col("_step") != 1).alias("gaps"), n(F.col("_back")).alias("back"), n(F.col("pnl").isNull()).alias("nulls"),
        n(F.col("age") > F.col("tenor_days")).alias("over"), n(F.col("date") <= F.col("entry_date")).alias("early"), (F.count(F.lit(1)) - F.count_distinct("date")).alias("dups"), *(F.sum(f"_off_{k}").alias(f"off_{k}") for k in off),
    )
    told = {
        "no_duplicate_trade_date": F.sum("dups"), "no_nan_pnl": F.sum("nulls"), "ages_consecutive_from_1": n(F.col("first") != 1) + n(F.col("gaps") > 0), "age_within_tenor": F.sum("over"),
        "dates_increase_with_age": n(F.col("back") > 0), "date_after_entry": F.sum("early"), "info_trades_not_yet_expired": n(F.col("last") < F.col("tenor_days")), "required_columns": F.lit(0),
    } | {f"components_sum_to_pnl_{k}": F.sum(f"off_{k}") for k in off}
    one = trades.agg(*(F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in told.items()))
    long = one.unpivot([], list(told), "check", "bad")
    return long.select("check", (F.col("check").startswith("info_") | (F.col("bad") == 0)).alias("passed"), "bad")


def label_coverage(entries: DataFrame, labels: DataFrame) -> DataFrame:
    e = entries.select("pair", "entry_date").distinct().join(labels.select("pair", F.col("date").alias("entry_date"), "regime"), ["pair", "entry_date"], "left")
    return e.agg(F.count(F.lit(1)).alias("entry_dates"), F.sum(F.col("regime").isNull().cast("long")).alias("unlabelled"))


def assert_clean(report: DataFrame) -> None:
    if bad := report.where(~F.col("passed")).collect():
        raise AssertionError("integrity checks failed: " + "; ".join(f"{r['check']}: {r['bad']}" for r in bad))


def walk_forward(cum_lab: DataFrame, splits: int = 4, first: float = 0.4, kappa: float = 0.0, least: int = 20) -> DataFrame:
    """State means against the overall mean, out of sample; what is trained on was known h business days before the test."""
    keys = [*GROUP, "h"]
    dates = cum_lab.select(*keys, "entry_date").distinct().withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy("entry_date")) - 1, "u": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    a = F.floor(first * F.col("u"))
    cuts = [F.floor(a + (F.col("u") - 1 - a) * (k / splits)) for k in range(splits + 1)]
    marks = dates.withColumn("k", F.explode(F.filter(F.array(*(F.when(F.col("i") == c, F.lit(k)) for k, c in enumerate(cuts))), lambda x: x.isNotNull())))
    marks = marks.select(*keys, "k", F.col("entry_date").alias("t"))
    folds = marks.withColumnRenamed("t", "t0").join(marks.select(*keys, (F.col("k") - 1).alias("k"), F.col("t").alias("t1")), [*keys, "k"])
    x = cum_lab.select(*keys, "entry_date", "regime", "cum_pnl").join(folds, keys)
    x = x.withColumns({"train": business_days("entry_date") < business_days("t0") - F.col("h"), "test": (F.col("entry_date") >= F.col("t0")) & (F.col("entry_date") < F.col("t1"))})
    x = x.where(F.col("train") | F.col("test"))
    y = F.when(F.col("train"), F.col("cum_pnl"))
    fold, state = Window.partitionBy(*keys, "k"), Window.partitionBy(*keys, "k", "regime")
    n_eff = F.count(y).over(state) / F.greatest(F.lit(1.0), F.col("h").cast("double"))
    weight = n_eff / (n_eff + kappa) if kappa > 0 else F.lit(1.0)
    m_u = F.avg(y).over(fold)
    x = x.withColumns({"n_train": F.count(y).over(fold), "m_u": m_u, "m_r": F.coalesce(weight * F.avg(y).over(state) + (1 - weight) * m_u, m_u)})
    t = x.where(F.col("test") & (F.col("n_train") >= least)).select(*keys, F.col("cum_pnl").alias("y"), "m_u", F.round("m_r", 9).alias("m_r"))
    out = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.pow(F.col("y") - F.col("m_u"), 2)).alias("mse_uncond"), F.avg(F.pow(F.col("y") - F.col("m_r"), 2)).alias("mse_regime"), F.regr_slope("y", "m_r").alias("calib_slope"))
    ic = spearman(t.withColumn("y", F.round("y", 9)), "m_r", "y", keys).select(*keys, F.col("rho").alias("rank_ic"))
    return out.join(ic, keys, "left").select(*keys, "n_test", "mse_uncond", "mse_regime", (1 - F.col("mse_regime") / F.col("mse_uncond")).alias("improvement"), "rank_ic", "calib_slope")


def gate_separation(lad: DataFrame, max_h: int = 10, spread_se: float = 2.0, least: float = 0.75) -> DataFrame:
    """Whether, in enough cells, the best and the worst state lie apart by more than their errors."""
    g = lad.where((F.col("regime") != "ALL") & (F.col("h") <= max_h) & F.col("mean").isNotNull() & F.col("se").isNotNull())
    c = g.groupBy(*GROUP, "h").agg(F.count(F.lit(1)).alias("k"), (F.max("mean") - F.min("mean")).alias("spread"), F.greatest(F.max_by("se", "mean"), F.min_by("se", "mean")).alias("worst")).where("k >= 2")
    share = F.coalesce(F.avg((F.col("spread") > spread_se * F.col("worst")).cast("double")), F.lit(0.0))
    return c.agg(F.count(F.lit(1)).alias("cells"), share.alias("fraction_separated")).withColumn("pass", F.col("fraction_separated") >= least)


def gate_out_of_sample(wf: DataFrame, max_h: int = 10, improvement: float = 0.0, ic: float = 0.0, slope: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """Whether state means beat the overall mean out of sample; a missing figure fails."""
    t = wf.where(F.col("h") <= max_h).agg(F.min("improvement").alias("improvement_min"), F.min("rank_ic").alias("rank_ic_min"), F.min("calib_slope").alias("slope_min"), F.max("calib_slope").alias("slope_max"))
    ok = (F.col("improvement_min") > improvement) & (F.col("rank_ic_min") > ic) & (F.col("slope_min") >= slope[0]) & (F.col("slope_max") <= slope[1])
    return t.withColumn("pass", F.coalesce(ok, F.lit(False)))


def gate_integrity(report: DataFrame, golden: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    out = report.agg(F.min("passed").alias("integrity_all_pass"))
    if golden is not None:
        out = out.crossJoin(golden.agg(F.coalesce(F.min(F.col("abs_error") <= tolerance), F.lit(True)).alias("golden_trades_match")))
        return out.withColumn("pass", F.col("integrity_all_pass") & F.col("golden_trades_match"))
    return out.withColumn("pass", F.col("integrity_all_pass"))


def coverage(lad: DataFrame, truth: DataFrame, least_n_eff: float = 20.0) -> DataFrame:
    """How often the intervals of a ladder hold the true mean, and the median error in standard errors; truth: archetype, regime, h, true_ev."""
    keys = [c for c in ("pair", "archetype", "regime", "h") if c in truth.columns]
    x = lad.where((F.col("regime") != "ALL") & (F.col("n_eff") >= least_n_eff)).join(truth, keys)
    inside = F.col("true_ev").between(F.col("ci_lo"), F.col("ci_hi")).cast("double")
    off = F.try_divide(F.abs(F.col("mean") - F.col("true_ev")), F.col("se"))
    by = ["world"] if "world" in lad.columns else []
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.avg(inside).alias("coverage"), F.percentile(off, F.lit(0.5)).alias("median_error"))


def lift(t: DataFrame, feature: str, horizon: int = 20, quantile: float = 0.9, window: int = 504) -> DataFrame:
    """How much likelier a move into the high band is after days of a high feature; t: pair, date, regime and the feature, both known."""
    d = _signals(t, feature, horizon, quantile, window)
    d = d.withColumn("first", F.col("sig") & ~F.coalesce(F.lag("sig").over(series()), F.lit(False)))
    fut = F.col("fut").cast("double")
    out = d.groupBy("pair").agg(F.avg(F.when(F.col("sig"), fut)).alias("p_event_signal"), F.avg(F.when(F.col("elig"), fut)).alias("p_event_all"), F.count(F.when(F.col("sig"), 1)).alias("n_signal"), F.count(F.when(F.col("first"), 1)).alias("n_signal_runs"))
    return out.withColumn("lift", F.try_divide("p_event_signal", "p_event_all"))


def _signals(t: DataFrame, feature: str, horizon: int, quantile: float, window: int) -> DataFrame:
    """Days with elig (not in the high band, with all of the horizon ahead), sig (a high feature) and fut (the band is entered)."""
    d = t.where(F.col(feature).isNotNull() & F.col("regime").isNotNull()).select("pair", "date", "regime", F.round(feature, 9).alias("f"))
    before = series().rowsBetween(-window, -1)
    hi = F.col("regime").isin(HIGH)
    d = d.withColumns(
        {
            "thr": F.when(F.count("f").over(before) >= max(120, window // 4), F.percentile("f", F.lit(quantile)).over(before)),
            "fut": F.coalesce(F.max(hi).over(series().rowsBetween(1, horizon)), F.lit(False)),
            "whole": F.count(F.lit(1)).over(series().rowsBetween(1, horizon)) == horizon,
        }
    )
    return d.withColumn("elig", ~hi & F.col("whole")).withColumn("sig", F.coalesce(F.col("f") >= F.round("thr", 9), F.lit(False)) & F.col("elig"))


def lift_interval(t: DataFrame, feature: str, horizon: int = 20, quantile: float = 0.9, window: int = 504, block: int = 21, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """The lift with an interval of 90 % by a bootstrap of blocks of eligible days; a series is a group."""
    marked = _signals(t, feature, horizon, quantile, window).where("elig").select("pair", "date", "sig", "fut")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        lo, hi = kn.ratio_bootstrap(g["sig"].to_numpy(bool), g["fut"].to_numpy(bool), block, n_boot, seed, (g["pair"].iloc[0], feature))
        return pd.DataFrame([[g["pair"].iloc[0], lo, hi]], columns=["pair", "lift_lo", "lift_hi"])

    spans = marked.groupBy("pair").applyInPandas(run, "pair string, lift_lo double, lift_hi double")
    return lift(t, feature, horizon, quantile, window).join(spans.select("pair", *(F.nanvl(c, F.lit(None)).alias(c) for c in ("lift_lo", "lift_hi"))), "pair", "left")


# tables of the packets


def trade_coverage(td: DataFrame) -> DataFrame:
    """Trades, rows, entry dates and the greatest age of each group."""
    return td.groupBy(*GROUP).agg(F.count_distinct("trade_id").alias("trades"), F.count(F.lit(1)).alias("rows"), F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"), F.max("age").alias("max_age"))


def pooled_cumulative(cum: DataFrame) -> DataFrame:
    """P&L from entry over all entries of an archetype, by tenor and horizon."""
    x = F.col("cum_pnl")
    return cum.groupBy("archetype", "tenor_days", "h", "to_expiry").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lowest"), F.max(x).alias("highest"))


def largest_market_days(td: DataFrame, top: int = 20) -> DataFrame:
    """The days on which the live trades of a leg moved most on average."""
    day = td.groupBy("date", "pair", "archetype").agg(F.avg("pnl").alias("mean_pnl"), F.count(F.lit(1)).alias("live_trades"))
    return day.orderBy(F.round(F.abs("mean_pnl"), 9).desc(), "date", "pair", "archetype").limit(top)


def vega_at_entry(td: DataFrame, vega: str = "vega") -> DataFrame:
    """Vega at age 1: median, range, and how many are not positive."""
    v = F.col(vega)
    return td.where("age = 1").groupBy("archetype", "tenor_days").agg(F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.count(F.when(v <= 0, 1)).alias("not_positive"))


def market_summary(m: DataFrame) -> DataFrame:
    """Count, mean and range of each number of the market."""
    cols = [f.name for f in m.schema.fields if f.dataType.simpleString() == "double"]
    long = m.unpivot(["pair", "date"], cols, "series", "value")
    return long.groupBy("pair", "series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def target_by_state(t: DataFrame, state: str, target: str) -> DataFrame:
    """The target's mean in each state, with an error for five-day overlap."""
    x = F.col(target)
    return t.where(x.isNotNull()).groupBy("pair", F.col(state).alias("state")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x)) * 5**0.5).alias("se"))


def largest_days(td: DataFrame, top: int = 20) -> DataFrame:
    return td.select("trade_id", "date", "age", "pnl").orderBy(F.abs("pnl").desc(), "trade_id", "date", "age").limit(top)


def component_variance(td: DataFrame) -> DataFrame:
    cols = component_columns(td)
    v = td.groupBy("archetype").agg(F.var_samp("pnl").alias("_v"), *(F.var_samp(c).alias(c) for c in cols))
    return v.unpivot(["archetype", "_v"], cols, "component", "variance").select("archetype", "component", F.try_divide("variance", "_v").alias("ratio"))


def decile_bins(t: DataFrame, score: str, target: str) -> DataFrame:
    """Ten bins of a score from 0 to 100, closed at the right, with the target's mean and an error for five-day overlap."""
    b = F.greatest(F.lit(1), F.ceil(F.round(score, 9) / 10)).cast("long")
    x = F.col(target)
    return t.where(F.col(score).isNotNull() & x.isNotNull()).groupBy("pair", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(F.lit(1))) * 5**0.5).alias("se"))


def yearly_share(labels: DataFrame) -> DataFrame:
    c = labels.groupBy("pair", F.year("date").alias("year"), "regime").agg(F.count(F.lit(1)).alias("days"))
    return c.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy("pair", "year")))


def label_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total variation between the yearly shares of two labellings."""
    x = yearly_share(a).select("pair", "year", "regime", F.col("share").alias("p")).join(yearly_share(b).select("pair", "year", "regime", F.col("share").alias("q")), ["pair", "year", "regime"], "full")
    return x.groupBy("pair", "year").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def sign_change_cells(lad: DataFrame) -> DataFrame:
    """Groups and regimes whose mean changes sign over the horizons."""
    return lad.groupBy(*GROUP, "regime").agg(F.count_distinct(F.signum("mean")).alias("signs"), F.min("mean").alias("lowest"), F.max("mean").alias("highest")).where("signs > 1")


def thin_cells(lad: DataFrame, episodes: int = 5, n_eff: float = 30.0) -> DataFrame:
    return lad.where((F.col("episodes") < episodes) | (F.col("n_eff") < n_eff))


def month_gaps(td: DataFrame) -> DataFrame:
    """Months between the first and the last entry of a pair in which nothing was entered."""
    m = F.trunc("entry_date", "month")
    span = td.groupBy("pair").agg(F.explode(F.sequence(F.min(m), F.max(m), F.expr("interval 1 month"))).alias("month"))
    return span.join(td.select("pair", m.alias("month")).distinct(), ["pair", "month"], "left_anti")


def missing_market_dates(td: DataFrame, m: DataFrame) -> DataFrame:
    return td.select("pair", "date").distinct().join(m, ["pair", "date"], "left_anti")


def pnl_summary(td: DataFrame) -> DataFrame:
    return td.groupBy(*GROUP).agg(F.count_distinct("trade_id").alias("trades"), F.count(F.lit(1)).alias("rows"), F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"), *(F.percentile("pnl", F.lit(q)).alias(a) for q, a in ((0.01, "q01"), (0.5, "q50"), (0.99, "q99"))))
