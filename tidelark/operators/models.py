"""Fitted models: each series, candidate, feature or state is a group, and a kernel runs on each group."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.functions import kernels as kn
from tidelark.functions.series import series, with_runs
from tidelark.operators.features import surprise
from tidelark.operators.ladder import cumulative, newey_west
from tidelark.operators.states import RANK, unpivoted
from tidelark.sources.tables import GROUP


def har_forecast(m: DataFrame, ridge: float = 0.5) -> DataFrame:
    """Forecast of the month's realised vol from those of week, month and quarter."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        return pd.DataFrame({"pair": g["pair"], "date": g["date"], "forecast": kn.har_series(g[["rv_1w", "rv_1m", "rv_3m"]].to_numpy(float), ridge=ridge)})

    return m.select("pair", "date", "rv_1w", "rv_1m", "rv_3m").groupBy("pair").applyInPandas(run, "pair string, date date, forecast double").withColumn("forecast", F.nanvl("forecast", F.lit(None)))


def shock_score(m: DataFrame, k: float = 0.3, arl: float = 1000.0, hazard: float = 0.01, short: int = 10) -> DataFrame:
    """CUSUM share of its threshold, probability of a young regime, size of surprises, and their mean of 100; null until all are known."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        z = g["z"].to_numpy(float)
        first = z[np.isfinite(z)][:252]
        h = kn.cusum_threshold(k, arl, first**2) if len(first) >= 60 else 10.0
        c = np.minimum(kn.cusum(z**2, k, h) / h, 1.0)
        young, mode = kn.change_points(z, hazard, short)
        size = pd.Series(kn.ewma(np.abs(z), 3.0))
        q = size.rolling(252, min_periods=63).quantile(0.95).shift(1)
        part = (size / q).clip(upper=1.0).to_numpy()
        return pd.DataFrame({"pair": g["pair"].to_numpy(), "date": g["date"].to_numpy(), "cusum": c, "p_young": young, "run": mode, "score": 100 * (c + young + part) / 3})

    z = m.select("pair", "date", surprise().alias("z"))
    out = z.groupBy("pair").applyInPandas(run, "pair string, date date, cusum double, p_young double, run double, score double")
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("cusum", "p_young", "run", "score")})


HALFLIVES, DELTAS, TURNS = (2.0, 3.0, 5.0), (0.0, 2.0, 3.0, 5.0), (0.5, 0.75, 1.0)
SPEC = "halflife double, delta double, dir_k double, lower double, upper double, top double, d_up double, delta_d double, extreme_merged boolean, extreme_episodes int, extreme_days int"
_SPEC_NAMES = [c.split()[0] for c in SPEC.split(", ")]


def _candidates(halflives: tuple, deltas: tuple, turns: tuple) -> list[list[tuple]]:
    """Settings (number, halflife, delta, k, extreme) in blocks of one halflife and delta, which a worker tries together."""
    kinds = [(None, False), *((k, x) for k in turns for x in (False, True))]
    blocks = [(h, d) for h in halflives for d in deltas]
    return [[(i * len(kinds) + j, h, d, k, x) for j, (k, x) in enumerate(kinds)] for i, (h, d) in enumerate(blocks)]


def finder(
    t: DataFrame, budget: float = 30.0, least_episodes: int = 5, tolerance: float = 0.015, halflives: tuple = HALFLIVES, deltas: tuple = DELTAS, turns: tuple = TURNS
) -> DataFrame:
    """All candidates of the labeller with their figures, their spec and the choice; t: pair, date, score, target, level_target.

    Blocks of candidates are rows, so they spread over the cluster; a series goes once to each
    block. Within a partition the fewest switches within ``tolerance`` of the best R2 win,
    overall the best R2.
    """
    blocks = _candidates(halflives, deltas, turns)
    arr = t.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("date", "score", "target", "level_target"))).alias("s"))
    cand = arr.withColumn("block", F.explode(F.array(*map(F.lit, range(len(blocks)))))).repartition("pair", "block")
    names = ["pair", "candidate", "partition", "days", "r2", "switches", "min_episodes", *_SPEC_NAMES]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for r in b.itertuples():
                cols = [np.array([np.nan if x[c] is None else x[c] for x in r.s], float) for c in ("score", "target", "level_target")]
                for i, h, d, k, x in blocks[r.block]:
                    got = kn.label_candidate(*cols, h, d, k, x, least_episodes)
                    if got:
                        part = "3" if k is None else "6x" if x else "6"
                        rows.append({"pair": r.pair, "candidate": i, "partition": part, "days": len(cols[0]), "halflife": h, "delta": d, "dir_k": k or 0.0, **got[1]})
            yield pd.DataFrame(rows, columns=names)

    found = cand.mapInPandas(run, f"pair string, candidate int, partition string, days int, r2 double, switches int, min_episodes int, {SPEC}")
    enough = F.col("min_episodes") >= least_episodes
    within = F.col("switches") <= budget * F.col("days") / 252
    any_within = F.max((enough & within).cast("int")).over(Window.partitionBy("pair")) == 1
    ok = enough & (within | ~any_within)
    w = Window.partitionBy("pair", "partition")
    t2 = found.withColumn("feasible", ok).withColumn("_best", F.max(F.when(F.col("feasible"), F.col("r2"))).over(w))
    near = F.col("feasible") & (F.col("r2") >= F.col("_best") - tolerance)
    order = Window.partitionBy("pair", "partition").orderBy(F.when(near, 0).otherwise(1), "switches", F.col("r2").desc(), "candidate")
    t3 = t2.withColumn("chosen", near & (F.row_number().over(order) == 1))
    top = Window.partitionBy("pair").orderBy(F.when(F.col("chosen"), 0).otherwise(1), F.col("r2").desc(), "candidate")
    return t3.withColumn("winner", F.col("chosen") & (F.row_number().over(top) == 1)).drop("_best")


def top_candidates(report: DataFrame, top: int = 5) -> DataFrame:
    """The best candidates of each partition by R2."""
    w = Window.partitionBy("pair", "partition").orderBy(F.col("r2").desc_nulls_last(), "candidate")
    return report.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def specs(report: DataFrame, partition: str = "auto") -> DataFrame:
    """A spec for each pair, to be kept and applied to later days: of the partition asked for, else the winner's (fell_back)."""
    own = F.col("chosen") & (F.col("partition") == partition)
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.when(own, 0).when(F.col("winner"), 1).otherwise(2), F.col("r2").desc_nulls_last(), "candidate"))
    pick = report.where("chosen or winner").withColumn("_k", rank).where("_k = 1")
    fell = F.lit(False) if partition == "auto" else F.col("partition") != partition
    return pick.select("pair", "partition", "r2", "switches", "days", "min_episodes", *_SPEC_NAMES, fell.alias("fell_back"))


def fixed_specs(t: DataFrame, halflife: float, bounds: tuple[float, ...], delta: float, dir_k: float = 0.75, partition: str = "6") -> DataFrame:
    """Specs of given parameters, without a search; the direction threshold is dir_k deviations of the score's slope. t: pair, date, score."""
    top = float(bounds[2]) if len(bounds) > 2 else None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        turn = dir_k * float(np.nanstd(kn.slope(kn.ewma(g.sort_values("date")["score"].to_numpy(float), halflife)), ddof=1))
        return pd.DataFrame([[g["pair"].iloc[0], partition, halflife, delta, dir_k, bounds[0], bounds[1], top, turn, 0.2 * turn, False]])

    return t.select("pair", "date", "score").groupBy("pair").applyInPandas(run, "pair string, partition string, " + ", ".join(SPEC.split(", ")[:9]))


def apply_spec(t: DataFrame, spec: DataFrame) -> DataFrame:
    """Labels of each day under the spec of its pair, without a new fit; warm marks days before the score is known. t: pair, date, score."""
    names = ["partition", "halflife", "delta", "lower", "upper", "top", "d_up", "delta_d", "extreme_merged"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        r, score = g.iloc[0], g["score"].to_numpy(float)
        bounds = (r["lower"], r["upper"]) if pd.isna(r["top"]) else (r["lower"], r["upper"], r["top"])
        lab = kn.spec_labels(score, {**{n: r[n] for n in names}, "bounds": bounds})
        known = np.maximum.accumulate(np.isfinite(score)) if len(score) else np.zeros(0, bool)
        return pd.DataFrame({"pair": g["pair"], "date": g["date"], "regime": lab, "warm": ~known})

    return t.select("pair", "date", "score").join(spec.select("pair", *names), "pair").groupBy("pair").applyInPandas(run, "pair string, date date, regime string, warm boolean")


def make_labels(t: DataFrame, report: DataFrame, partition: str = "auto") -> DataFrame:
    """Labels by the chosen candidate of each pair: of one partition, or the winner where it has none."""
    return apply_spec(t, specs(report, partition))


def tilt_fits(t: DataFrame, features: list[str], k: int = 1, base: str | None = None) -> DataFrame:
    """Sensitivity of transitions to each feature, beyond a base if one is named, and the out-of-sample gain of the tilt; features are groups."""
    own = [base] if base else []
    long, stress = t.select("pair", "date", "regime", *own, *(c for c in features if c != base)).unpivot(["pair", "date", "regime", *own], [c for c in features if c != base], "feature", "x"), dict(RANK)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        s, rank = kn.ranked_states(g["regime"].tolist(), stress)
        x = kn.standard(g["x"].to_numpy(float))
        z = kn.standard(g[base].to_numpy(float)) if base else None
        fit = kn.tilt_fits([(s, x, z)], rank, k)
        gain = kn.tilt_gain(s, g["x"].to_numpy(float), rank, k=k, base=g[base].to_numpy(float) if base else None)
        return pd.DataFrame([[*key, len(s), fit["gamma"], fit["beta"], *gain.values()]])

    return long.groupBy("pair", "feature").applyInPandas(run, "pair string, feature string, n int, gamma double, beta double, gain double, folds_up int")


def pooled_tilt(t: DataFrame, features: list[str], k: int = 1, base: str | None = None) -> DataFrame:
    """One gamma and one beta for all pairs together: log-likelihoods add, each pair has its own matrix. Features are groups."""
    own, stress = [base] if base else [], dict(RANK)
    long = t.select("pair", "date", "regime", *own, *features).unpivot(["pair", "date", "regime", *own], features, "feature", "x")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["regime"]))
        rank = np.array([stress.get(n, 0.0) for n in names])
        seqs = []
        for _, p in g.sort_values(["pair", "date"]).groupby("pair"):
            s = np.array([names.index(x) for x in p["regime"]])
            seqs.append((s, kn.standard(p["x"].to_numpy(float)), kn.standard(p[base].to_numpy(float)) if base else None))
        fit = kn.tilt_fits(seqs, rank, k)
        return pd.DataFrame([[*key, len(seqs), sum(len(s) for s, _, _ in seqs), fit["gamma"], fit["beta"], fit["loglik"], fit["loglik0"]]])

    return long.groupBy("feature").applyInPandas(run, "feature string, pairs int, n int, gamma double, beta double, loglik double, loglik0 double")


def pressure_gain(t: DataFrame, pressure: str = "pressure", base: str = "score", k: int = 5) -> DataFrame:
    """Out-of-sample gain of a pressure index over the state score, for transitions k days on; t: pair, date, regime and both columns."""
    return tilt_fits(t, [pressure], k, base).select("pair", "n", "gain", "folds_up")


def fold_dates(t: DataFrame, folds: int = 4, first: float = 0.4) -> DataFrame:
    """Bounds of folds as dates of the union of all series: fold i tests from its date up to, not including, the next one."""
    dates = t.select("date").distinct()
    n = dates.agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")).first()
    a = int(first * n["n"])
    at = [int(a + (n["n"] - a) * i / folds) for i in range(folds + 1)]
    found = {r["k"]: r["date"] for r in _numbered_dates(dates, [k for k in at if k < n["n"]]).collect()}  # folds + 1 rows
    rows = [(i, found[k] if k < n["n"] else n["last"] + dt.timedelta(days=1)) for i, k in enumerate(at)] if n["n"] else []
    return t.sparkSession.createDataFrame(rows, "cut int, date date")


def _numbered_dates(dates: DataFrame, places: list[int]) -> DataFrame:
    """The dates at some places of their order: years number themselves, so that no task sorts them all."""
    y = F.year("date")
    before = dates.groupBy(y.alias("_y")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.row_number().over(Window.partitionBy("_y").orderBy("date")) - 1
    return dates.withColumn("_y", y).withColumn("_k", k).join(before, "_y").select("date", (F.col("_k") + F.col("_b")).alias("k")).where(F.col("k").isin(places))


LOW = ("carry", "settling", "rising")
_SCREEN = "n int, delta_r2 double, folds_up int, gain double, gain_folds_up int, p_perm double, delta_r2_low double"


def leading_screen(
    t: DataFrame, features: list[str], permutations: int = 100, least_r2: float = 0.005, least_gain: float = 0.002, folds: int = 3, p_max: float = 0.05, top: int = 3,
    k: int = 5, ks: tuple[int, ...] = (10, 21), lag: int = 0, holdout: float = 0.2, targets: dict[str, str] | None = None, diagnosis: str | None = None,
) -> DataFrame:
    """What each feature adds, and whether it is retained; t: pair, date, regime, score, y, the features, and outcomes that ``targets`` names.

    Pairs and features are groups. A feature is judged on the outcome that targets gives it,
    else on y. Features are developed on the dates before the last ``holdout`` of the span:
    there they must help both outcome and transitions (k rows on, beyond the score), in enough
    folds, beyond chance. The ``top`` of those by R2 are tested on the rest, trained on all before
    it, and stay retained unless it contradicts them; all others are not retained. Reported
    only: transitions ks rows on, the part in the low band, and a second outcome (diagnosis).
    """
    span = t.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    cut = span["a"] + dt.timedelta(days=int((span["b"] - span["a"]).days * (1 - holdout))) if span["a"] else None
    targets, stress = targets or {}, dict(RANK)
    outcomes = sorted({"y", *targets.values(), *([diagnosis] if diagnosis else [])})
    long = t.select("pair", "date", "regime", "score", *outcomes, *features).unpivot(["pair", "date", "regime", "score", *outcomes], features, "feature", "x")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        s, rank = kn.ranked_states(g["regime"].tolist(), stress)
        low = np.isin(sorted(set(g["regime"])), LOW).astype(float)
        target = targets.get(key[1], "y")
        x, score, y = (g[c].to_numpy(float) for c in ("x", "score", target))
        dev = (g["date"] <= cut).to_numpy()
        got = kn.incremental_value(x[dev], score[dev], s[dev], y[dev], rank, permutations, key="/".join(map(str, key)), k=k, ks=ks, lag=lag, low=low)
        held = kn.incremental_value(x, score, s, y, rank, 0, k=k, folds=1, first=1 - holdout, lag=lag)
        diag = kn.incremental_value(x[dev], score[dev], s[dev], g[diagnosis].to_numpy(float)[dev], rank, 0, k=k, lag=lag)["delta_r2"] if diagnosis else np.nan
        return pd.DataFrame([[*key, target, *got.values(), diag, held["delta_r2"], held["gain"]]])

    gains = "".join(f", gain_k{x} double" for x in ks)
    out = long.groupBy("pair", "feature").applyInPandas(run, f"pair string, feature string, target string, {_SCREEN}{gains}, delta_r2_diag double, delta_r2_holdout double, gain_holdout double")
    doubles = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    out = out.withColumns({c: F.nanvl(c, F.lit(None)) for c in doubles})
    known = lambda c: F.coalesce(F.col(c), F.lit(float("-inf")))
    rules = (("delta_r2", known("delta_r2") >= least_r2), ("gain", known("gain") >= least_gain), ("folds", F.col("folds_up") >= folds), ("gain_folds", F.col("gain_folds_up") >= folds), ("p_perm", F.coalesce(F.col("p_perm") <= p_max, F.lit(False))))
    failed = F.concat_ws(",", *(F.when(~ok, F.lit(n)) for n, ok in rules))
    place = F.row_number().over(Window.partitionBy("pair").orderBy((failed == "").desc(), known("delta_r2").desc(), "feature"))
    out = out.withColumns({"_failed": failed, "place": place}).withColumn("for_holdout", (F.col("_failed") == "") & (F.col("place") <= top))
    reason = (
        F.when(F.col("_failed") != "", F.col("_failed")).when(~F.col("for_holdout"), "not_in_holdout_top")
        .when(known("delta_r2_holdout") <= 0, "holdout_delta_r2").when(known("gain_holdout") <= 0, "holdout_gain").otherwise("")
    )
    only = {c: F.when(F.col("for_holdout"), F.col(c)) for c in ("delta_r2_holdout", "gain_holdout")}
    return out.withColumn("fail_reason", reason).withColumn("retain", F.col("fail_reason") == "").withColumns(only).drop("_failed")


def outcomes(td: DataFrame, m: DataFrame, archetypes: list[str], h: int = 5) -> DataFrame:
    """Named forward outcomes of each day: the mean P&L of each archetype's entries over h days, and realised less implied vol a month on."""
    cum = cumulative(td.where(F.col("archetype").isin(archetypes)), (h,), expiry=False)
    earn = cum.groupBy("pair", F.col("entry_date").alias("date")).agg(*(F.avg(F.when(F.col("archetype") == a, F.col("cum_pnl"))).alias(a) for a in archetypes))
    surface = m.select("pair", "date", (F.lead("rv_1m", 21).over(series()) - F.col("atm_1m")).alias("realised_minus_implied"))
    return surface.join(earn, ["pair", "date"], "left")


def gate_leading(screen: DataFrame, gain: DataFrame, least_gain: float = 0.002, folds: int = 3) -> DataFrame:
    """Whether a feature is retained and the pressure index improves the transitions out of sample; gain: of pressure_gain."""
    r = screen.agg(F.sum(F.col("retain").cast("long")).alias("retained"))
    g = gain.agg((F.sum(F.col("gain") * F.col("n")) / F.sum("n")).alias("pressure_gain"), F.min("folds_up").alias("folds_up"))
    both = r.join(g)  # one row each
    ok = (F.col("retained") > 0) & (F.col("pressure_gain") >= least_gain) & (F.col("folds_up") >= folds)
    return both.select(F.coalesce("retained", F.lit(0)).alias("retained"), "pressure_gain", "folds_up", F.coalesce(ok, F.lit(False)).alias("pass"))


def discover(chars: DataFrame, labels: DataFrame, k_max: int = 4) -> DataFrame:
    """Whether the days of each state fall into parts: each k with its criterion, stability and verdict."""
    names = [c for c in chars.columns if c not in ("pair", "date")]
    t = with_runs(labels, "regime", "episode").join(chars.dropna(subset=names), ["pair", "date"])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        got = kn.sub_states(g[names].to_numpy(float), g["episode"].to_numpy(), k_max, key="/".join(map(str, key)))
        return pd.DataFrame([[*key, *r.values()] for r in got], columns=["pair", "regime", "k", "bic", "min_runs", "stability", "accepted"])

    return t.groupBy("pair", "regime").applyInPandas(run, "pair string, regime string, k int, bic double, min_runs int, stability double, accepted boolean")


def assign(chars: DataFrame, centres: DataFrame) -> DataFrame:
    """The nearest centre of each day; centres: pair, part, characteristic, mu, sd, centre."""
    t = unpivoted(chars).join(centres, ["pair", "characteristic"])
    d = t.groupBy("pair", "date", "part").agg(F.sum(F.pow((F.col("value") - F.col("mu")) / F.col("sd") - F.col("centre"), 2)).alias("d"))
    return d.groupBy("pair", "date").agg(F.min_by("part", "d").alias("part"))


def factor_share(m: DataFrame, cols: list[str], window: int = 20) -> DataFrame:
    """Share of the largest eigenvalue of the window's correlations; the windows are JVM frames, the eigenvalue a kernel."""
    r = m.select("pair", "date", *(F.log(F.col(c) / F.lag(c).over(series())).alias(c) for c in cols))
    w = series().rowsBetween(1 - window, 0)
    pairs = [(a, b) for a in range(len(cols)) for b in range(a)]
    full = F.count(F.when(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0, 1)).over(w) == window
    t = r.select("pair", "date", F.when(full, F.array(*(F.corr(cols[a], cols[b]).over(w) for a, b in pairs))).alias("c"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for c in b["c"]:
                ok = c is not None and np.isfinite(np.asarray(c, float)).all()
                m = np.eye(len(cols))
                if ok:
                    for (i, j), v in zip(pairs, c, strict=True):
                        m[i, j] = m[j, i] = v
                out.append(kn.largest_share(m) if ok else None)
            yield pd.DataFrame({"pair": b["pair"], "date": b["date"], "share": out})

    return t.mapInPandas(run, "pair string, date date, share double")


#: Variants of the labeller that a sweep compares: settings of the finder, the partition asked for, and the column of the score.
VARIANTS: dict[str, dict] = {
    "base": {},
    "six": {"partition": "6"},
    "six_extreme": {"partition": "6x"},
    "three": {"partition": "3"},
    "few_switches": {"budget": 15.0},
    "slow": {"halflives": (5.0, 8.0, 12.0)},
    "fast": {"halflives": (1.0, 2.0, 3.0)},
    "wide_bands": {"deltas": (3.0, 5.0, 8.0)},
    "other_score": {"score": "score2"},
}


def sweep(t: DataFrame, cum: DataFrame, variants: dict[str, dict] | None = None, confirm: float = 0.3, archetype: str = "straddle_atm") -> DataFrame:
    """Variants of the labeller, each fitted on the first part of the dates and judged on both parts.

    t: pair, date, score (and others that a variant names), target, level_target; cum: cumulative
    P&L of entries. A row for each variant and pair: the spec, whether the partition asked for
    was there (fell_back), whether the spec lies at the edge of its grid, the share of cells
    that Gate 2 separates on entries up to the cut and after it (which the finder never saw), how
    far the high band out-earns carry at five days, and the share of days that agree with the
    first variant's labels.
    """
    variants = VARIANTS if variants is None else variants
    n = F.count(F.lit(1)).over(Window.partitionBy("pair"))
    dated = t.withColumns({"_i": F.row_number().over(series()), "_n": n})
    cuts = dated.where(F.col("_i") == F.floor((1 - confirm) * F.col("_n"))).select("pair", F.col("date").alias("cut"))
    found, scored = [], []
    for name, kw in variants.items():
        kw = dict(kw)
        own = t.select("pair", "date", F.col(kw.pop("score", "score")).alias("score"), "target", "level_target")
        part, h, d = kw.pop("partition", "auto"), kw.get("halflives", HALFLIVES), kw.get("deltas", DELTAS)
        edge = F.col("halflife").isin(min(h), max(h)) | (F.col("delta") == max(d))
        found.append(specs(finder(own.join(cuts, "pair").where("date <= cut").drop("cut"), **kw), part).withColumns({"variant": F.lit(name), "on_grid_edge": edge}))
        scored.append(own.select("pair", "date", "score").withColumn("variant", F.lit(name)))
    both = lambda parts: reduce(DataFrame.unionByName, parts)
    spec = both(found).persist()  # a row for each variant and pair, read by all that follows
    key = F.concat_ws("|", "variant", "pair")
    lab = apply_spec(both(scored).withColumn("pair", key), spec.withColumn("pair", key)).select(F.split("pair", "[|]", 2)[0].alias("variant"), F.split("pair", "[|]", 2)[1].alias("pair"), "date", "regime").persist()

    cl = cum.join(lab.withColumnRenamed("date", "entry_date"), ["pair", "entry_date"]).join(cuts, "pair").withColumn("part", F.when(F.col("entry_date") <= F.col("cut"), "fit").otherwise("confirm"))
    gates = _separated(cl.withColumn("pair", F.concat_ws("|", "variant", "part", "pair"))).select(*(F.split("pair", "[|]", 3)[i].alias(c) for i, c in enumerate(("variant", "part", "pair"))), "fraction")
    gates = gates.groupBy("variant", "pair").agg(*(F.max(F.when(F.col("part") == p, F.col("fraction"))).alias(f"gate2_{p}") for p in ("fit", "confirm")))
    mean = lambda states: F.avg(F.when(F.col("regime").isin(*states), F.col("cum_pnl")))
    five = cl.where((F.col("archetype") == archetype) & (F.col("h") == 5)).groupBy("variant", "pair").agg((mean(("stressed", "crisis")) - mean(("carry",))).alias("high_minus_carry"))
    first = lab.where(F.col("variant") == next(iter(variants))).select("pair", "date", F.col("regime").alias("_first"))
    agree = lab.join(first, ["pair", "date"]).groupBy("variant", "pair").agg(F.avg((F.col("regime") == F.col("_first")).cast("double")).alias("agreement"))
    out = spec
    for more in (gates, five, agree):
        out = out.join(more, ["variant", "pair"], "left")
    return out


def _separated(cum_lab: DataFrame, max_h: int = 10, spread_se: float = 2.0) -> DataFrame:
    """Of each pair the share of cells in which the best and the worst state lie apart by more than their errors."""
    own = cum_lab.where(F.col("h") <= max_h)
    means = own.groupBy(*GROUP, "regime", "h").agg(F.avg("cum_pnl").alias("mean"))
    cells = means.join(newey_west(own), [*GROUP, "regime", "h"]).where("se is not null")
    c = cells.groupBy(*GROUP, "h").agg(F.count(F.lit(1)).alias("k"), (F.max("mean") - F.min("mean")).alias("spread"), F.greatest(F.max_by("se", "mean"), F.min_by("se", "mean")).alias("worst")).where("k >= 2")
    return c.groupBy("pair").agg(F.avg((F.col("spread") > spread_se * F.col("worst")).cast("double")).alias("fraction"))
