"""The headline figures by pandas and NumPy in one thread: what the engine's times are held against."""

from __future__ import annotations

import statistics
import time
from bisect import bisect_left, insort

import numpy as np
import pandas as pd

GROUP = ["pair", "archetype", "tenor_days"]
HORIZONS = (1, 3, 5, 10, 20)


def labels(m: pd.DataFrame) -> pd.DataFrame:
    regime = np.where(m["atm_1m"] < 9.5, "carry", np.where(m["atm_1m"] < 10.5, "agitated", "stressed"))
    return pd.DataFrame({"pair": m["pair"], "date": m["date"], "regime": regime})


def cumulative(td: pd.DataFrame) -> pd.DataFrame:
    t = td.sort_values([*GROUP, "trade_id", "age"])
    t = t.assign(cum_pnl=t.groupby([*GROUP, "trade_id"])["pnl"].cumsum().round(9), h=t["age"])
    return t[t["h"].isin(HORIZONS) | (t["h"] == t["tenor_days"])]


def labelled(m: pd.DataFrame, td: pd.DataFrame) -> pd.DataFrame:
    return cumulative(td).merge(labels(m).rename(columns={"date": "entry_date"}), on=["pair", "entry_date"])


def hac(x: np.ndarray, band: int) -> float:
    n = len(x)
    if n < 2:
        return np.nan
    e, most = x - x.mean(), min(band, n - 1)
    v = e @ e + 2 * sum((1 - k / (most + 1)) * (e[k:] @ e[:-k]) for k in range(1, most + 1))
    return float(np.sqrt(max(v / n, 0) / n))


def cells(cl: pd.DataFrame):
    both = pd.concat([cl, cl.assign(regime="ALL")])
    return both.sort_values(["entry_date", "trade_id"]).groupby([*GROUP, "regime", "h"])


def ladder_core(m, td):
    g = cells(labelled(m, td))["cum_pnl"]
    return g.agg(["count", "mean"]).join(g.quantile([0.05, 0.5, 0.95]).unstack())


def ladder_hac(m, td):
    rows = {}
    for key, g in cells(labelled(m, td)):
        x = g["cum_pnl"].to_numpy()
        q = np.quantile(x, [0.05, 0.5, 0.95])
        rows[key] = (len(x), x.mean(), hac(x, int(key[-1])), (x > 0).mean(), *q, x[x.round(9) <= q[0].round(9)].mean())
    return pd.DataFrame(rows).T


def entries(m, td):
    t = td.sort_values([*GROUP, "trade_id", "age"])
    cols = [c for c in t.columns if c.startswith("pnl")]
    g = t.groupby([*GROUP, "trade_id"])
    run = g[cols].cumsum().div(g["vega"].transform("first").abs(), axis=0)
    run[[*GROUP, "entry_date", "h"]] = t[[*GROUP, "entry_date", "age"]]
    run = run[run["h"].isin(HORIZONS) | (run["h"] == run["tenor_days"])]
    return run.groupby([*GROUP, "entry_date", "h"])[cols].mean()


def combine_rr(m, td):
    w = td["archetype"].map({"call_25d": 1.0, "put_25d": -1.0})
    legs = td[w.notna()].assign(w=w)
    cols = [c for c in td.columns if c.startswith("pnl")]
    key = ["pair", "tenor_days", "entry_date", "age", "date"]
    out = legs[cols].mul(legs["w"], axis=0).join(legs[key]).groupby(key)[cols].agg("sum")
    return out[legs.groupby(key)["archetype"].nunique().eq(2)]


def percentile(x: np.ndarray, n: int) -> np.ndarray:
    """Trailing percentile by an ordered window."""
    held, out = [], np.full(len(x), np.nan)
    for t, v in enumerate(x):
        if t >= n and x[t - n] == x[t - n]:
            held.pop(bisect_left(held, x[t - n]))
        if v == v:
            below = bisect_left(held, v)
            insort(held, v)
            if len(held) >= max(20, n // 4):
                out[t] = 100 * below / (min(t + 1, n) - 1)
    return out


def rolling_percentile(m, td):
    return m.sort_values("date").groupby("pair")["atm_1m"].transform(lambda s: percentile(s.to_numpy().round(9), 756))


def complacency(m, td):
    out = []
    for _, p in m.sort_values("date").groupby("pair"):
        parts = [-(p["rv_1m"] / p["atm_1m"]), -p["atm_1m"].diff().rolling(21).std(), p["atm_1y"] - p["atm_1m"]]
        out.append(sum(percentile(x.to_numpy(float).round(9), 756) for x in parts) / 3)
    return np.concatenate(out)


def characteristics(m, td):
    out = []
    for _, p in m.sort_values("date").groupby("pair"):
        r, dv = np.log(p["spot"]).diff(), p["atm_1m"].diff()
        jump = (r.abs() > 2.5 * r.rolling(63).std().shift(1)).astype(float).rolling(20).mean()
        cols = {"beta": dv.rolling(20).cov(r) / r.rolling(20).var(), "corr": dv.rolling(20).corr(r), "vrp": p["atm_1m"] - p["rv_1m"], "slope": p["atm_1m"] - p["atm_1y"], "vol": dv.rolling(20).std(), "jump": jump}
        out.append(pd.DataFrame(cols | {"pair": p["pair"], "date": p["date"]}))
    return pd.concat(out)


def state_profile(m, td):
    t = characteristics(m, td).merge(labels(m), on=["pair", "date"])
    cols = ["beta", "corr", "vrp", "slope", "vol", "jump"]
    every = t.groupby("pair")[cols].agg(["mean", "std"])
    return t.groupby(["pair", "regime"])[cols].mean(), every


def two_axis_states(m, td):
    from tidelark.functions import kernels as kn

    out = []
    for _, p in m.sort_values("date").groupby("pair"):
        x = p["atm_1m"].to_numpy(float)
        out.append(kn.walk(kn.levels(x, (9.5, 10.5), 0.2), kn.directions(kn.slope(x), -0.20137, 0.20137, 0.05)))
    return np.concatenate(out)


def walk_forward(m, td):
    rows = {}
    for key, g in labelled(m, td).groupby([*GROUP, "h"]):
        u = np.sort(g["entry_date"].unique())
        at = np.linspace(int(0.4 * len(u)), len(u) - 1, 5).astype(int)
        y, p, q = [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            last = np.busday_offset(np.datetime64(u[a], "D"), -int(key[-1]), roll="backward")
            train, test = g[g["entry_date"] < pd.Timestamp(last).date()], g[(g["entry_date"] >= u[a]) & (g["entry_date"] < u[b])]
            if len(train) < 20:
                continue
            mean = train["cum_pnl"].mean()
            y.append(test["cum_pnl"])
            p.append(test["regime"].map(train.groupby("regime")["cum_pnl"].mean()).fillna(mean))
            q.append(pd.Series(mean, test.index))
        y, p, q = (pd.concat(v) for v in (y, p, q))
        rows[key] = (len(y), ((y - q) ** 2).mean(), ((y - p) ** 2).mean(), y.rank().corr(p.rank()), np.polyfit(p, y, 1)[0])
    return pd.DataFrame(rows).T


def cond_on_off(m, td):
    e = entries(m, td).reset_index()
    on = m.assign(on=m["atm_1m"] > 10.2)[["pair", "date", "on"]].rename(columns={"date": "entry_date"})
    return e.merge(on, on=["pair", "entry_date"]).groupby([*GROUP, "h", "on"])["pnl"].agg(["count", "mean", "var"])


def persistence_split(m, td):
    lab = labels(m)
    t = td.merge(lab, on=["pair", "date"], how="left").merge(lab.rename(columns={"date": "entry_date", "regime": "entry"}), on=["pair", "entry_date"])
    t = t.sort_values([*GROUP, "trade_id", "age"]).assign(broke=lambda d: (d["regime"] != d["entry"]).astype(int))
    g = t.groupby([*GROUP, "trade_id"])
    t = t.assign(c=g["pnl"].cumsum(), b=g["broke"].cummax())
    t = t[t["age"].isin(HORIZONS) | (t["age"] == t["tenor_days"])]
    return t.groupby([*GROUP, "entry", "age", "b"])["c"].agg(["count", "mean"])


def fan_21(m, td):
    out = []
    for _, p in labels(m).sort_values("date").groupby("pair"):
        from tidelark.functions import kernels as kn

        names, s = np.unique(p["regime"], return_inverse=True)
        mat, pi = kn.count_matrix(s, len(names)), np.eye(len(names))[0]
        for _ in range(21):
            pi = pi @ mat
            out.append(pi)
    return out


PLAIN = [ladder_core, ladder_hac, persistence_split, entries, combine_rr, rolling_percentile, complacency, two_axis_states, walk_forward, characteristics, state_profile, cond_on_off, fan_21]


def seconds(m: pd.DataFrame, td: pd.DataFrame, runs: int = 3) -> dict[str, float]:
    """Median seconds of each figure."""
    out = {}
    for f in PLAIN:
        each = []
        for _ in range(runs):
            t = time.time()
            f(m, td)
            each.append(time.time() - t)
        out[f.__name__] = round(statistics.median(each), 3)
    return out
