"""Point-in-time features of a market. Every builder adds a column and uses rows up to the day alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.functions.series import series, lagged_z, rolling, rolling2, rolling_percentile

RANK = 756
Builder = Callable[..., DataFrame]
FEATURES: dict[str, Builder] = {}
LEADING: dict[str, Builder] = {}


def feature(registry: dict[str, Builder]) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        registry[f.__name__] = f
        return f

    return add


def ranked(m: DataFrame, x: F.Column, out: str, window: int = RANK) -> DataFrame:
    """The trailing percentile rank of x, rounded to 9 digits so that ties do not hang on the last bit."""
    return m.withColumn("_x", F.round(x, 9)).withColumn(out, rolling_percentile("_x", window)).drop("_x")


def log_return(c: str = "spot") -> F.Column:
    return F.log(F.col(c)) - F.log(F.lag(c).over(series()))


def change(c: str, n: int = 1) -> F.Column:
    return F.col(c) - F.lag(c, n).over(series())


def with_changes(m: DataFrame) -> DataFrame:
    return m.withColumns({"_r": log_return(), "_dv": change("atm_1m")})


@feature(FEATURES)
def vol_pct(m: DataFrame, window: int = RANK) -> DataFrame:
    return ranked(m, F.col("atm_1m"), "vol_pct", window)


@feature(FEATURES)
def term_slope_pct(m: DataFrame, window: int = RANK) -> DataFrame:
    return ranked(m, F.col("atm_1m") - F.col("atm_1y"), "term_slope_pct", window)


@feature(FEATURES)
def rr_stress_pct(m: DataFrame, window: int = 252) -> DataFrame:
    z = F.try_divide(F.col("rr25_1m") - rolling(F.avg, "rr25_1m", window, 60), rolling(F.stddev_samp, "rr25_1m", window, 60))
    return ranked(m, -z, "rr_stress_pct", window)


@feature(FEATURES)
def vrp_stress_pct(m: DataFrame, window: int = RANK) -> DataFrame:
    return ranked(m, F.col("rv_1m") - F.col("atm_1m"), "vrp_stress_pct", window)


@feature(FEATURES)
def spotvol_beta_pct(m: DataFrame, window: int = 63, rank_window: int = RANK) -> DataFrame:
    t = with_changes(m).withColumn("_r", 100 * F.col("_r"))
    beta = F.try_divide(rolling2(F.covar_samp, "_dv", "_r", window, 30), rolling(F.var_samp, "_r", window, 30))
    return ranked(t, F.abs(beta), "spotvol_beta_pct", rank_window).drop("_r", "_dv")


@feature(FEATURES)
def rv_term_pct(m: DataFrame, window: int = RANK) -> DataFrame:
    return ranked(m, F.try_divide("rv_1w", "rv_3m"), "rv_term_pct", window)


def gap(n: int = 120) -> F.Column:
    """Distance of log spot from its mean over the n rows before, in the move that implied vol allows over half of them."""
    ls = F.log("spot")
    return (ls - rolling(F.avg, ls, n, n // 2, 1)) / (F.col("atm_1m") / 100 * (n / 2 / 252) ** 0.5)


@feature(LEADING)
def gap_z_signed(m: DataFrame, window: int = 120) -> DataFrame:
    return m.withColumn("gap_z_signed", gap(window))


@feature(LEADING)
def gap_pct(m: DataFrame, window: int = RANK) -> DataFrame:
    return ranked(m, F.abs(gap()), "gap_pct", window)


@feature(LEADING)
def drift_t(m: DataFrame, window: int = 60) -> DataFrame:
    t = m.withColumn("_r", log_return())
    return t.withColumn("drift_t", F.try_divide(rolling(F.avg, "_r", window), rolling(F.stddev_samp, "_r", window)) * window**0.5).drop("_r")


@feature(LEADING)
def complacency(m: DataFrame, window: int = RANK, vov: int = 21) -> DataFrame:
    t = ranked(m.withColumn("_dv", change("atm_1m")), -F.try_divide("rv_1m", "atm_1m"), "_a", window)
    t = ranked(ranked(t, -rolling(F.stddev_samp, "_dv", vov), "_b", window), F.col("atm_1y") - F.col("atm_1m"), "_c", window)
    return t.withColumn("complacency", (F.col("_a") + F.col("_b") + F.col("_c")) / 3).drop("_dv", "_a", "_b", "_c")


@feature(LEADING)
def stored_energy(m: DataFrame, window: int = RANK) -> DataFrame:
    t = m
    for name, f in (("gap_pct", gap_pct), ("complacency", complacency)):
        t = t if name in m.columns else f(t, window)
    return t.withColumn("stored_energy", F.col("gap_pct") * F.col("complacency") / 100).select(*m.columns, "stored_energy")


def surprise() -> F.Column:
    """The day's log return in units of yesterday's implied daily move."""
    return log_return() / (F.lag("atm_1m").over(series()) / 100 / 252**0.5)


@feature(LEADING)
def jump_cluster_pct(m: DataFrame, window: int = 21, k: float = 2.0, rank_window: int = RANK) -> DataFrame:
    t = m.withColumn("_j", F.coalesce(F.abs(surprise()) > k, F.lit(False)).cast("double"))
    return ranked(t, rolling(F.avg, "_j", window), "jump_cluster_pct", rank_window).drop("_j")


@feature(LEADING)
def coupling_shift_pct(m: DataFrame, short: int = 21, long: int = 126, rank_window: int = RANK) -> DataFrame:
    c = F.abs(rolling2(F.corr, "_r", "_dv", short) - rolling2(F.corr, "_r", "_dv", long))
    return ranked(with_changes(m), c, "coupling_shift_pct", rank_window).drop("_r", "_dv")


def mean_pair_corr(m: DataFrame, cols: list[str], window: int, out: str) -> DataFrame:
    """Mean correlation over the window of all pairs of the series' log returns; null where any is missing."""
    t = m.withColumns({f"_g{k}": log_return(c) for k, c in enumerate(cols)})
    full = sum((F.col(f"_g{k}").isNull().cast("int") for k in range(len(cols))), F.lit(0)) == 0
    t = t.withColumn("_full", F.when(full, 1.0))
    pairs = [rolling2(F.corr, f"_g{a}", f"_g{b}", window) for a in range(len(cols)) for b in range(a)]
    mean = sum(pairs[1:], pairs[0]) / len(pairs)
    keep = F.count("_full").over(series().rowsBetween(1 - window, 0)) == window
    return t.withColumn(out, F.when(keep, mean)).drop("_full", *(f"_g{k}" for k in range(len(cols))))


@feature(LEADING)
def coherence_pct(m: DataFrame, window: int = 21, rank_window: int = RANK) -> DataFrame:
    cols = [c for c in m.columns if c.startswith("g10_")]
    if len(cols) < 2:
        return m.withColumn("coherence_pct", F.lit(None).cast("double"))
    return ranked(mean_pair_corr(m, cols, window, "_coh"), F.col("_coh"), "coherence_pct", rank_window).drop("_coh")


def build(m: DataFrame, names: list[str] | None = None, registry: dict[str, Builder] = FEATURES, asof: str | None = None) -> DataFrame:
    """Features by name; asof cuts the market before any window sees it."""
    t = m if asof is None else m.where(F.col("date") <= F.lit(asof).cast("date"))
    names = list(registry) if names is None else names
    for n in names:
        t = registry[n](t)
    return t.select("pair", "date", *names)


def build_leading(m: DataFrame, events: DataFrame | None = None, names: list[str] | None = None, asof: str | None = None) -> DataFrame:
    """Leading features, and with a calendar the nearness of its events from 0 to 100."""
    out = build(m, names, LEADING, asof)
    if events is None:
        return out
    from tidelark.operators.states import event_proximity

    cut = m if asof is None else m.where(F.col("date") <= F.lit(asof).cast("date"))
    return out.join(event_proximity(cut, events).withColumn("event_proximity", 100 * F.col("event_proximity")), ["pair", "date"])


def truncation_gaps(f: Callable[[DataFrame], DataFrame], m: DataFrame, cut: str, digits: int = 9) -> DataFrame:
    """Rows on which f of the market cut at a date differs from f of the whole market; none if f looks at the past alone."""
    early = F.col("date") <= F.lit(cut).cast("date")
    a, b = f(m).where(early), f(m.where(early))
    names = [c for c in a.columns if c not in ("pair", "date")]
    both = a.select("pair", "date", *(F.round(c, digits).alias(c) for c in names)).join(b.select("pair", "date", *(F.round(c, digits).alias(f"{c}_cut") for c in names)), ["pair", "date"], "full")
    differ = F.lit(False)
    for c in names:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"{c}_cut"))
    return both.where(differ)


def pressure(t: DataFrame, weights: dict[str, float], centre: float = 50.0, scale: float = 25.0, zscore_window: int | None = None) -> DataFrame:
    """Weighted mean of leading features, null where any is; centred, or of trailing z-scores."""
    total = sum(weights.values())
    part = {c: lagged_z(c, zscore_window) if zscore_window else F.col(c) for c in weights}
    mean = sum((part[c] * (w / total) for c, w in weights.items()), F.lit(0.0))
    return t.withColumn("pressure", mean if zscore_window else (mean - centre) / scale)


def composite(t: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of features, weights to sum 1 and missing ones as 0; null where all are missing; and its five-day slope."""
    total = sum(weights.values())
    some = F.coalesce(*(F.col(c) for c in weights)).isNotNull()
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0))
    t = t.withColumn("composite", F.when(some, score))
    return t.withColumn("direction_score", change("composite", 5) / 5)
