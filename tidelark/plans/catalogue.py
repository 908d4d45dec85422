"""The catalogue: each query on the driver's tables, and the SQL that answers it as well.

A query is a function of a ``World`` (market, trade days, labels), the columns of its answer
with their kinds (i whole, f rounded to six digits, d date, b boolean, else string), and SQL
over the parts in oracles.py.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.functions import kernels as kn
from tidelark.functions import scans
from tidelark.functions.series import rolling_percentile, runs_of_days, series
from tidelark.operators import combine as cmb
from tidelark.operators import evaluate as ev
from tidelark.operators import explore as ex
from tidelark.operators import features as ft
from tidelark.operators import ladder as ld
from tidelark.operators import models as md
from tidelark.operators import states as st
from tidelark.plans.oracles import CELL, G, W, bday, ranked, roll, roll2, win, with_parts, z
from tidelark.sources import synthetic as syn
from tidelark.sources import tables as tb

TENORS = (5, 21, 63)
EVENTS = ["1996-03-09", "1997-06-18", "1999-11-03", "2001-11-01", "2030-01-01"]


class World:
    """What the queries start from, each made at most once for a query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._held = spark, sf_dir, []

    def _kept(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._held[-1]

    def release(self) -> None:
        for df in self._held:
            df.unpersist()

    @cached_property
    def market(self) -> DataFrame:
        return self._kept(tb.market(self.spark, self.sf_dir))

    @cached_property
    def td(self) -> DataFrame:
        return self._kept(tb.trade_days(self.spark, self.sf_dir, m=self.market))

    @cached_property
    def terms(self) -> DataFrame:
        """Trade days of several tenors."""
        return self._kept(tb.trade_days(self.spark, self.sf_dir, tenors=TENORS, m=self.market))

    @cached_property
    def labels(self) -> DataFrame:
        return tb.cut_labels(self.market)

    @cached_property
    def cumulative(self) -> DataFrame:
        return self._kept(ld.cumulative(self.td))

    @cached_property
    def cum_lab(self) -> DataFrame:
        return self._kept(ld.attach_entry_labels(self.cumulative, self.labels))

    @cached_property
    def cum_terms(self) -> DataFrame:
        return self._kept(ld.attach_entry_labels(ld.cumulative(self.terms), self.labels))

    @cached_property
    def ladder(self) -> DataFrame:
        return ld.ladder(self.cum_lab, self.labels)

    @cached_property
    def entries(self) -> DataFrame:
        return ex.entries(self.td)

    @cached_property
    def mask(self) -> DataFrame:
        return self.market.select("pair", "date", F.coalesce(F.col("atm_1m") > 10.2, F.lit(False)).alias("on"))

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.createDataFrame([(dt.date.fromisoformat(e),) for e in EVENTS], "date date")


Query = tuple[Callable[[World], DataFrame], str, "str | None"]
CATALOGUE: dict[str, Query] = {}
_SPARK = {"i": "long", "d": "date", "b": "boolean", "s": "string"}
_DUCK = {"i": "BIGINT", "d": "DATE", "b": "BOOLEAN", "s": "VARCHAR"}


_WORLD: dict[str, object] = {}


def world(spark: SparkSession, sf_dir: str) -> World:
    """The tables that the queries start from; the market, the trade days and the labelled entries are kept by the session that made them.

    They stand for tables that a user has on disk. Partitions that are lost with an executor are
    made again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if _WORLD.get("key") != key:
        if isinstance(old := _WORLD.get("world"), World) and _WORLD["key"][0] == key[0]:
            old.release()
        _WORLD.update(key=key, world=World(spark, sf_dir))
    return _WORLD["world"]


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2] or "s") for c in spec.split()]


def add(name: str, spec: str, sql: str | None, recursive: bool = False, more: dict[str, str] | None = None) -> Callable:
    def keep(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        full = None
        if sql is not None:
            cols = ", ".join(f'round("{c}" + 2.3e-9, 6) + 0.0 AS "{c}"' if k == "f" else f'CAST("{c}" AS {_DUCK[k]}) AS "{c}"' for c, k in _columns(spec))
            full = with_parts(f"SELECT {cols} FROM ({sql})", recursive, more)
        CATALOGUE[name] = (f, spec, full)
        return f

    return keep


def answer(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    f, spec, _ = CATALOGUE[name]
    return f(world(spark, sf_dir)).select(*((tb.six(F.col(c).cast("double")) + F.lit(0.0)).alias(c) if k == "f" else F.col(c).cast(_SPARK[k]).alias(c) for c, k in _columns(spec)))


GS = "pair archetype tenor_days:i"
CS = f"{GS} regime h:i"

# the ladder
add("ladder_core", f"{CS} to_expiry:b n:i mean:f p_profit:f q05:f q50:f q95:f", "SELECT * FROM stat")(lambda w: ld.ladder(w.cum_lab, w.labels))
add("ladder_hac", f"{CS} to_expiry:b n:i n_eff:f mean:f se:f ci_lo:f ci_hi:f p_profit:f q05:f q50:f q95:f es05:f episodes:i", "SELECT * FROM lad")(lambda w: w.ladder)
add("neff_spacing", f"{GS} spacing:f", "SELECT * FROM spacing")(lambda w: ld.entry_spacing(ld.cumulative(w.td)))
add("episodes_runs", "pair regime episodes:i", "SELECT * FROM eps")(lambda w: ld.count_episodes(w.labels))
add("increments", f"{GS} regime bucket h_from:i h_to:i earn_per_day:f", f"""SELECT {G}, regime, 'd' || (lag(h, 1, 0) OVER q + 1) || '-' || h AS bucket, lag(h, 1, 0) OVER q + 1 AS h_from, h AS h_to, (mean - lag(mean, 1, 0) OVER q) / (h - lag(h, 1, 0) OVER q) AS earn_per_day FROM stat WINDOW q AS (PARTITION BY {G}, regime ORDER BY h)""")(lambda w: ld.increments(w.ladder))
add("shrink", f"{CS} w_shrink:f mean_shrunk:f", f"""SELECT *, w_shrink * mean + (1 - w_shrink) * max(CASE WHEN regime = 'ALL' THEN mean END) OVER (PARTITION BY {G}, h) AS mean_shrunk FROM (SELECT *, CASE WHEN regime = 'ALL' THEN 1.0 ELSE n_eff / (n_eff + 20.0) END AS w_shrink FROM lad)""")(lambda w: ld.shrink(w.ladder))
add("persistence_split", f"{CS} n:i q_broke:f ev_stayed:f ev_broke:f ev:f", f"""SELECT {CELL}, count(*) AS n, avg(b) AS q_broke, avg(CASE WHEN b = 0 THEN c END) AS ev_stayed, avg(CASE WHEN b = 1 THEN c END) AS ev_broke, avg(c) AS ev
    FROM (SELECT t.pair, archetype, tenor_days, e.regime, age AS h, sum(pnl) OVER q AS c, max(CASE WHEN l.regime = e.regime THEN 0 ELSE 1 END) OVER q AS b FROM td t LEFT JOIN lab l ON l.pair = t.pair AND l.date = t.date JOIN lab e ON e.pair = t.pair AND e.date = t.entry_date
    WINDOW q AS (PARTITION BY t.pair, archetype, tenor_days, trade_id ORDER BY age)) WHERE h IN (1, 3, 5, 10, 20) OR h = tenor_days GROUP BY ALL""")(lambda w: ld.persistence_split(w.td, w.labels))
add("ladder_boot", f"{CS} n:i mean:f se:f ci_lo:f ci_hi:f", None)(lambda w: ld.ladder(w.cum_lab, w.labels, ld.boot_se(w.cum_lab, w.labels)))
add("unlabelled_entries", "rows:i entries:i", "SELECT count(*) AS rows, count(DISTINCT pair || entry_date) AS entries FROM cum c WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.pair = c.pair AND l.date = c.entry_date AND l.regime <> 'carry')")(lambda w: ld.unlabelled_counts(ld.cumulative(w.td), w.labels.where("regime <> 'carry'")))

# combinations
add("vega_units", f"{GS} trade_id age:i pnl:f pnl_vol:f", f"SELECT {G}, trade_id, age, pnl / v AS pnl, pnl_vol / v AS pnl_vol FROM (SELECT *, max(CASE WHEN age = 1 THEN abs(vega) END) OVER (PARTITION BY {G}, trade_id) AS v FROM td) WHERE v <> 0")(lambda w: cmb.to_vega_units(w.td))
add("combine_rr", "trade_id pair archetype tenor_days:i entry_date:d date:d age:i remaining:i pnl:f", "SELECT *, concat_ws('-', pair, 'rr_25d', strftime(entry_date, '%Y-%m-%d'), tenor_days) AS trade_id, 'rr_25d' AS archetype, tenor_days - age AS remaining FROM cmb")(lambda w: cmb.combine(w.td, cmb.COMBINATIONS["rr_25d"], "rr_25d"))
_FLY = "CASE archetype WHEN 'straddle_atm' THEN -1.0 ELSE 0.5 END"
add("combine_fly", "trade_id age:i pnl:f pnl_fly:f", f"SELECT concat_ws('-', pair, 'fly_25d', strftime(entry_date, '%Y-%m-%d'), tenor_days) AS trade_id, age, sum({_FLY} * pnl) AS pnl, sum({_FLY} * pnl_fly) AS pnl_fly FROM td GROUP BY pair, tenor_days, entry_date, age, date HAVING count(DISTINCT archetype) = 3")(lambda w: cmb.combine(w.td, cmb.COMBINATIONS["fly_25d"], "fly_25d"))
_EVL = "SELECT pair, tenor_days, regime, h, max(CASE archetype WHEN 'call_25d' THEN n END) AS n, sum(CASE archetype WHEN 'call_25d' THEN mean ELSE -mean END) AS mean FROM stat WHERE archetype IN ('call_25d', 'put_25d') GROUP BY ALL HAVING count(DISTINCT archetype) = 2"
add("ev_linear", "pair tenor_days:i regime h:i n:i mean:f", _EVL)(lambda w: cmb.ev_linear(w.ladder, cmb.COMBINATIONS["rr_25d"], "rr_25d"))
add("combo_screen", "combination pair tenor_days:i ev_linear:f episodes:i", f"""SELECT name AS combination, s.pair, tenor_days, sum(wt * mean) AS ev_linear, max(x.episodes) AS episodes FROM stat s JOIN (VALUES ('rr_25d', 'call_25d', 1.0), ('rr_25d', 'put_25d', -1.0), ('fly_25d', 'call_25d', 0.5), ('fly_25d', 'put_25d', 0.5), ('fly_25d', 'straddle_atm', -1.0)) c(name, archetype, wt) USING (archetype)
    JOIN eps x ON x.pair = s.pair AND x.regime = s.regime WHERE s.regime = 'carry' AND h = 5 GROUP BY ALL""")(lambda w: cmb.screen(w.ladder, cmb.COMBINATIONS, "carry", 5))

# entries and conditions
add("entries", f"{GS} entry_date:d h:i to_expiry:b earn:f earn_vol:f earn_theta:f n_trades:i vega0:f", "SELECT * FROM ent")(lambda w: w.entries)
add("trailing_earn", "pair archetype date:d earn_mean:f earn_z:f", f"""SELECT pair, archetype, date, m AS earn_mean, (m - CASE WHEN count(m) OVER p >= 126 THEN avg(m) OVER p END) / nullif(CASE WHEN count(m) OVER p >= 126 THEN stddev_samp(m) OVER p END, 0) AS earn_z FROM
    (SELECT *, CASE WHEN count(earn) OVER q >= 10 THEN avg(earn) OVER q END AS m FROM (SELECT m.pair, a.archetype, m.date, k.earn FROM market m CROSS JOIN (SELECT DISTINCT archetype FROM ent) a
    LEFT JOIN (SELECT e.pair, e.archetype, x.i + 5 AS i, e.earn FROM ent e JOIN market x ON x.pair = e.pair AND x.date = e.entry_date WHERE h = 5) k ON k.pair = m.pair AND k.archetype = a.archetype AND k.i = m.i)
    WINDOW q AS (PARTITION BY pair, archetype ORDER BY date ROWS 19 PRECEDING)) WINDOW p AS (PARTITION BY pair, archetype ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""")(lambda w: ex.trailing_earn(w.entries, w.market))
_STATS = f"""SELECT *, {z('atm_1m', 252)} AS atm_1m_z252, atm_1m - lag(atm_1m, 5) OVER {W} AS atm_1m_chg5, atm_1y - atm_1m AS term_1y_1m, {z('rr25_1m', 252)} AS rr25_1m_z252, rv_1m / nullif(atm_1m, 0) AS rv_iv_1m, rv_1w / nullif(rv_1m, 0) AS rv_1w_1m,
    (ls - {roll('avg', 'ls', 60, 30, 1)}) / (atm_1m / 100 * sqrt(60.0 / 252)) AS spot_vs_ma60, (ls - lag(ls, 20) OVER {W}) / (atm_1m / 100 * sqrt(20.0 / 252)) AS spot_ret20_z,
    ({roll('avg', 'r', 60)}) / nullif({roll('stddev_samp', 'r', 60)}, 0) * sqrt(60.0) AS drift_t60, (({roll('max', 'ls', 20)}) - ({roll('min', 'ls', 20)})) / (atm_1m / 100 * sqrt(20.0 / 252)) AS spot_range20_z FROM market"""
add("raw_statistics", "pair date:d atm_1m:f atm_1m_z252:f atm_1m_chg5:f term_1y_1m:f rr25_1m_z252:f rv_iv_1m:f rv_1w_1m:f spot_vs_ma60:f spot_ret20_z:f drift_t60:f spot_range20_z:f", _STATS)(lambda w: ex.raw_statistics(w.market))
add("filter_tags", "pair date:d calm wild", "SELECT pair, date, CASE WHEN coalesce(atm_1m < 9.9 AND rr25_1m BETWEEN -2 AND 0, false) THEN 'on' ELSE 'none' END AS calm, CASE WHEN coalesce(rv_1m > 400, false) THEN 'on' ELSE 'none' END AS wild FROM market")(
    lambda w: ex.filters_to_tags(w.market, {"calm": {"stat": "atm_1m", "op": "<", "value": 9.9, "and": [{"stat": "rr25_1m", "op": "between", "value": [-2, 0]}]}, "wild": {"stat": "rv_1m", "op": ">", "value": 400}}))
_ON = 'CASE WHEN "on" THEN earn END', 'CASE WHEN NOT "on" THEN earn END'
_EFF = lambda x: f"greatest(count({x}) * least(1.0, 1.0 / h), 1e-9)"
_COND = f"count({_ON[0]}) AS n_on, count({_ON[1]}) AS n_off, avg({_ON[0]}) AS mean_on, avg({_ON[1]}) AS mean_off, avg({_ON[0]}) - avg({_ON[1]}) AS diff, sqrt(var_samp({_ON[0]}) / {_EFF(_ON[0])} + var_samp({_ON[1]}) / {_EFF(_ON[1])}) AS se"
add("cond_on_off", f"{GS} h:i n_on:i n_off:i mean_on:f mean_off:f diff:f se:f runs:i", f"SELECT * FROM (SELECT {G}, h, {_COND} FROM ent5 GROUP BY {G}, h) JOIN mruns USING (pair)")(lambda w: ex.condition_effect(w.entries, w.mask))
add("cond_fit_confirm", f"{GS} h:i part n_on:i n_off:i diff:f se:f", f"""SELECT {G}, h, CASE WHEN date_diff('day', DATE '1970-01-01', entry_date) <= cut THEN 'fit' ELSE 'confirm' END AS part, {_COND} FROM ent5 JOIN (SELECT pair, quantile_cont(date_diff('day', DATE '1970-01-01', entry_date), 0.7) AS cut FROM ent GROUP BY ALL) USING (pair) GROUP BY {G}, h, part""")(lambda w: ex.fit_confirm(w.entries, w.mask))
add("mask_shift_null", f"{GS} h:i shift:i diff:f", f"""SELECT {', '.join('e.' + c for c in G.split(', '))}, e.h, s.shift, avg(CASE WHEN s."on" THEN earn END) - avg(CASE WHEN NOT s."on" THEN earn END) AS diff FROM ent e JOIN
    (SELECT m.pair, t.date, s.shift, m."on" FROM (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM mask) m CROSS JOIN (SELECT unnest(range(0, 2001, 10)) AS shift) s JOIN (SELECT pair, date, row_number() OVER {W} - 1 AS i FROM mask) t ON t.pair = m.pair AND t.i = (m.i + s.shift) % m.n) s ON s.pair = e.pair AND s.date = e.entry_date GROUP BY ALL""")(lambda w: ex.shift_null(w.entries, w.mask, list(range(10, 2001, 10))))
add("bucket_drivers", f"{GS} bucket:i mean:f total:f sd:f hit_rate:f q05:f q50:f q95:f worst:f best:f entries:i", f"""SELECT {G}, bucket, avg(earn) AS mean, sum(earn) AS total, stddev_samp(earn) AS sd, avg(CASE WHEN earn > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, quantile_cont(earn, 0.05) AS q05, quantile_cont(earn, 0.5) AS q50, quantile_cont(earn, 0.95) AS q95, min(earn) AS worst, max(earn) AS best, count(*) AS entries
    FROM (SELECT e.*, ntile(5) OVER (PARTITION BY {', '.join('e.' + c for c in G.split(', '))} ORDER BY round(m.atm_1m, 9), e.entry_date) AS bucket FROM ent e JOIN market m ON m.pair = e.pair AND m.date = e.entry_date WHERE h = 5) GROUP BY ALL""")(lambda w: ex.bucket_drivers(w.entries, w.market, "atm_1m").where("driver = 'earn'"))

# features
for _n, _p, _o in (("rolling_percentile", "p_vol", "vol_pct"), ("term_slope_rank", "p_slope", "term_slope_pct"), ("rr_rank", "p_rr", "rr_stress_pct"), ("vrp_rank", "p_vrp", "vrp_stress_pct"), ("spotvol_beta_rank", "p_beta", "spotvol_beta_pct"), ("rv_term_rank", "p_rv", "rv_term_pct")):
    add(_n, f"pair date:d {_o}:f", f"SELECT pair, date, v AS {_o} FROM {_p}")(lambda w, o=_o: ft.build(w.market, [o]))
for _n, _p, _o in (("gap_pct", "p_gap", "gap_pct"), ("complacency", "comp", "complacency"), ("jump_cluster", "p_jump", "jump_cluster_pct"), ("coupling_shift", "p_cpl", "coupling_shift_pct")):
    add(_n, f"pair date:d {_o}:f", f"SELECT pair, date, v AS {_o} FROM {_p}")(lambda w, o=_o: ft.build(w.market, [o], ft.LEADING))
add("stored_energy", "pair date:d stored_energy:f", "SELECT g.pair, g.date, g.v * c.v / 100 AS stored_energy FROM p_gap g JOIN comp c USING (pair, date)")(lambda w: ft.build(w.market, ["stored_energy"], ft.LEADING))
add("gap_z", "pair date:d gap_z_signed:f", "SELECT pair, date, gap_z AS gap_z_signed FROM gapz")(lambda w: ft.build(w.market, ["gap_z_signed"], ft.LEADING))
add("drift_t", "pair date:d drift_t:f", f"SELECT pair, date, ({roll('avg', 'r', 60)}) / nullif({roll('stddev_samp', 'r', 60)}, 0) * sqrt(60.0) AS drift_t FROM market")(lambda w: ft.build(w.market, ["drift_t"], ft.LEADING))
add("avg_pair_corr", "pair date:d c:f", "SELECT * FROM coh")(lambda w: ft.mean_pair_corr(w.market, ["g10_1", "g10_2", "g10_3"], 21, "c"))
add("composite_score", "pair date:d composite:f direction_score:f", f"SELECT pair, date, c AS composite, (c - lag(c, 5) OVER {W}) / 5 AS direction_score FROM (SELECT pair, date, CASE WHEN coalesce(a.v, b.v) IS NOT NULL THEN coalesce(a.v, 0) * 0.6 + coalesce(b.v, 0) * 0.4 END AS c FROM p_vol a JOIN p_slope b USING (pair, date))")(lambda w: ft.composite(ft.build(w.market, ["vol_pct", "term_slope_pct"]), {"vol_pct": 0.6, "term_slope_pct": 0.4}))
add("pressure_index", "pair date:d pressure:f", "SELECT g.pair, g.date, (g.v * 0.5 + c.v * 0.5 - 50) / 25 AS pressure FROM p_gap g JOIN comp c USING (pair, date)")(lambda w: ft.pressure(ft.build(w.market, ["gap_pct", "complacency"], ft.LEADING), {"gap_pct": 1, "complacency": 1}))

# scans and labels
_SCAN = "SELECT pair, date, row_number() OVER (PARTITION BY pair ORDER BY date) AS k, atm_1m AS x, (atm_1m - lag(atm_1m, 5) OVER (PARTITION BY pair ORDER BY date)) / 5 AS ds FROM market"
_UP = "CASE WHEN x > 10.7 AND c <= 1 THEN 2 WHEN x > 9.7 AND c = 0 THEN 1 ELSE c END"
_LEVEL = {
    "sx": _SCAN,
    "lv": f"""SELECT pair, k, date, CASE WHEN x > 10.7 THEN 2 WHEN x > 9.7 THEN 1 ELSE 0 END AS c FROM sx WHERE k = 1 UNION ALL
        SELECT s.pair, s.k, s.date, CASE WHEN u = 2 AND x < 10.3 THEN CASE WHEN x < 9.3 THEN 0 ELSE 1 END WHEN u = 1 AND x < 9.3 THEN 0 ELSE u END FROM (SELECT t.*, {_UP} AS u FROM (SELECT s.*, l.c FROM lv l JOIN sx s ON s.pair = l.pair AND s.k = l.k + 1) t) s""",
    "dr": """SELECT pair, k, date, CASE WHEN ds > 0.25137 THEN 1 WHEN ds < -0.25137 THEN -1 ELSE 0 END AS c FROM sx WHERE k = 1 UNION ALL
        SELECT pair, k, date, CASE WHEN r = 0 AND ds > 0.25137 THEN 1 WHEN r = 0 AND ds < -0.25137 THEN -1 WHEN c = 1 AND ds < 0.15137 THEN 0 ELSE r END FROM (SELECT s.*, d.c, CASE WHEN d.c = -1 AND s.ds > -0.15137 THEN 0 ELSE d.c END AS r FROM dr d JOIN sx s ON s.pair = d.pair AND s.k = d.k + 1)""",
}


def _levels(w: World) -> DataFrame:
    return scans.level_scan(w.market.select("pair", "date", "atm_1m"), "atm_1m", [9.5, 10.5], 0.2)


def _directions(w: World) -> DataFrame:
    return scans.direction_scan(w.market.select("pair", "date", (ft.change("atm_1m", 5) / 5).alias("ds")), "ds", -0.20137, 0.20137, 0.05)


add("level_hysteresis", "pair date:d level", "SELECT pair, date, ['low', 'mid', 'high'][c + 1] AS level FROM lv", True, _LEVEL)(_levels)
add("direction_hysteresis", "pair date:d direction", "SELECT pair, date, ['down', 'flat', 'up'][c + 2] AS direction FROM dr", True, _LEVEL)(_directions)
_NEXT = "CASE " + " ".join(f"WHEN l = '{a}' AND d = '{b}'" + (f" AND s = '{c}'" if c != "*" else "") + f" THEN {'s' if x == 'keep' else repr(x)}" for a, b, c, x in kn.NEXT_STATE) + " ELSE s END"
add("two_axis_states", "pair date:d regime", "SELECT pair, date, s AS regime FROM au", True, _LEVEL | {
    "ld": "SELECT a.pair, a.k, a.date, ['low', 'mid', 'high'][a.c + 1] AS l, ['down', 'flat', 'up'][b.c + 2] AS d FROM lv a JOIN dr b USING (pair, k)",
    "au": f"SELECT pair, k, date, {_NEXT} AS s FROM (SELECT *, 'carry' AS s FROM ld WHERE k = 1) UNION ALL SELECT pair, k, date, {_NEXT} FROM (SELECT n.*, a.s FROM au a JOIN ld n ON n.pair = a.pair AND n.k = a.k + 1)"})(lambda w: scans.state_scan(_levels(w).join(_directions(w), ["pair", "date"])))
_A = 1 - 0.5 ** (1 / 3)
add("ewma_score", "pair date:d ewma:f", "SELECT pair, date, y AS ewma FROM ew", True, {
    "ex": "SELECT pair, date, row_number() OVER (PARTITION BY pair ORDER BY date) AS k, CASE WHEN i % 7 <> 0 THEN atm_1m END AS x FROM market",
    "ew": f"SELECT pair, k, date, x AS y, CAST(1 AS DOUBLE) AS w FROM ex WHERE k = 1 UNION ALL SELECT n.pair, n.k, n.date, CASE WHEN n.x IS NULL THEN e.y WHEN e.y IS NULL THEN n.x ELSE (e.w * {1 - _A!r} * e.y + {_A!r} * n.x) / (e.w * {1 - _A!r} + {_A!r}) END, CASE WHEN n.x IS NULL AND e.y IS NOT NULL THEN e.w * {1 - _A!r} ELSE 1.0 END FROM ew e JOIN ex n ON n.pair = e.pair AND n.k = e.k + 1"})(
    lambda w: scans.ewma_scan(w.market.select("pair", "date", F.when(F.col("i") % 7 != 0, F.col("atm_1m")).alias("x")), "x", 3.0))
add("cusum_fixed_h", "pair date:d cusum:f", "SELECT pair, date, e AS cusum FROM cu", True, {
    "cx": f"SELECT pair, date, row_number() OVER {W} AS k, x2, {roll('avg', 'x2', 252, 63, 1)} AS mu FROM (SELECT pair, date, round(least(power((rr25_1m + 1) * 2, 2), 9), 9) AS x2 FROM market)",
    "cu": "SELECT pair, k, date, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS e FROM cx WHERE k = 1 UNION ALL SELECT pair, k, date, CASE WHEN v > 10 THEN 0.0 ELSE v END, v FROM (SELECT n.*, CASE WHEN n.x2 IS NULL OR n.mu IS NULL THEN c.s ELSE greatest(0.0, c.s + n.x2 - n.mu - 0.3) END AS v FROM cu c JOIN cx n ON n.pair = c.pair AND n.k = c.k + 1)"})(
    lambda w: scans.cusum_scan(w.market.select("pair", "date", F.round(F.least(F.pow((F.col("rr25_1m") + 1) * 2, 2), F.lit(9.0)), 9).alias("x2")).withColumn("mu", F.when(F.count("x2").over(series().rowsBetween(-252, -1)) >= 63, F.avg("x2").over(series().rowsBetween(-252, -1)))), "x2", "mu", 0.3, 10.0))
add("merge_rare", "pair date:d regime", "SELECT pair, date, CASE WHEN regime = 'stressed' AND n < 400 THEN 'agitated' ELSE regime END AS regime FROM lab LEFT JOIN (SELECT pair, count(*) AS n FROM runs WHERE regime = 'stressed' GROUP BY ALL) USING (pair)")(lambda w: st.merge_rare(w.labels, "stressed", "agitated", 400))
add("transition_matrix", "pair from_state to_state moves:i p:f", "SELECT * FROM mat")(lambda w: st.transition_matrix(w.labels, 10.0))
add("duration_check", "pair regime implied_days:f observed_mean_days:f episodes:i", """SELECT pair, regime, 1 / greatest(1e-9, 1 - CASE WHEN t = 0 THEN 0 ELSE m / t END) AS implied_days, observed_mean_days, episodes FROM
    (SELECT pair, from_state AS regime, sum(CASE WHEN from_state = to_state THEN moves END) AS m, CAST(sum(moves) AS DOUBLE) AS t FROM tm GROUP BY ALL) JOIN (SELECT pair, regime, avg(days) AS observed_mean_days, count(*) AS episodes FROM runs GROUP BY ALL) USING (pair, regime)""")(lambda w: st.duration_check(w.labels))
add("duration_hazard", "pair regime age:i at_risk:i ended:i hazard:f", """SELECT pair, regime, age, count(*) AS at_risk, sum(CASE WHEN days = age AND NOT open THEN 1 ELSE 0 END) AS ended, sum(CASE WHEN days = age AND NOT open THEN 1.0 ELSE 0.0 END) / count(*) AS hazard
    FROM (SELECT *, run = max(run) OVER (PARTITION BY pair) AS open, unnest(range(1, days + 1)) AS age FROM runs) GROUP BY ALL""")(lambda w: st.duration_hazard(w.labels))
add("label_runs", "pair run:i regime start:d end:d days:i", "SELECT * FROM runs")(lambda w: st.runs(w.labels))
add("escalations", "pair date:d from_state to_state", f"SELECT pair, date, was AS from_state, regime AS to_state FROM (SELECT *, lag(regime) OVER {W} AS was FROM lab) WHERE regime IN ('stressed', 'extreme') AND was NOT IN ('stressed', 'extreme')")(lambda w: st.escalations(w.labels))
_Y = f"SELECT pair, date, regime, lead(atm_1m, 5) OVER {W} - atm_1m AS y FROM lab JOIN market USING (pair, date)"
add("oos_separation", "pair n_test:i r2:f", f"""SELECT pair, count(*) AS n_test, 1 - sum(power(y - p, 2)) / sum(power(y - q, 2)) AS r2 FROM (SELECT pair, y, t, coalesce(avg(CASE WHEN NOT t THEN y END) OVER (PARTITION BY pair, f, regime), avg(CASE WHEN NOT t THEN y END) OVER (PARTITION BY pair, f)) AS p, avg(CASE WHEN NOT t THEN y END) OVER (PARTITION BY pair, f) AS q
    FROM (SELECT *, i >= CAST(floor(floor(0.4 * n) + (n - floor(0.4 * n)) * f / 4.0) AS BIGINT) AS t FROM (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM ({_Y}) WHERE y IS NOT NULL) CROSS JOIN (SELECT unnest(range(4)) AS f) WHERE i < CAST(floor(floor(0.4 * n) + (n - floor(0.4 * n)) * (f + 1) / 4.0) AS BIGINT))) WHERE t GROUP BY ALL""")(
    lambda w: st.oos_separation(w.labels.join(w.market.select("pair", "date", (F.lead("atm_1m", 5).over(series()) - F.col("atm_1m")).alias("y")), ["pair", "date"])))
add("step_breaks", "pair lower:f upper:f sse:f", f"""SELECT pair, lower, upper, sse FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY sse, ka, kb) AS b FROM (SELECT a.pair, a.k AS ka, b.k AS kb, a.g AS lower, b.g AS upper, round(a.s2 - power(a.b1, 2) / a.c - power(b.b1 - a.b1, 2) / (b.c - a.c) - power(a.s1 - b.b1, 2) / (a.n - b.c), 6) AS sse
    FROM sg a JOIN sg b ON a.pair = b.pair AND a.k < b.k WHERE a.c >= floor(0.08 * a.n) AND b.c - a.c >= floor(0.08 * a.n) AND a.n - b.c >= floor(0.08 * a.n))) WHERE b = 1""", False, {
    "sd": f"SELECT pair, date, atm_1m AS s, lead(atm_1y, 5) OVER {W} - atm_1y AS y FROM market",
    "sq": "SELECT pair, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2, quantile_cont(s, [" + ", ".join(repr(0.08 + 0.84 * k / 39) for k in range(40)) + "]) AS g FROM sd WHERE y IS NOT NULL GROUP BY ALL",
    "sl": "SELECT pair, n, s1, s2, unnest(range(40)) AS k, round(unnest(g), 9) AS g FROM sq",
    "sg": "SELECT l.pair, l.n, l.s1, l.s2, l.k, l.g, count(d.y) AS c, coalesce(sum(d.y), 0) AS b1 FROM sl l LEFT JOIN sd d ON d.pair = l.pair AND round(d.s, 9) < l.g AND d.y IS NOT NULL GROUP BY ALL"})(
    lambda w: st.step_breaks(w.market.withColumn("y", F.lead("atm_1y", 5).over(series()) - F.col("atm_1y")), "atm_1m", "y"))

# tags
add("event_window", "pair date:d event", "SELECT pair, date, coalesce(t, 'none') AS event FROM market LEFT JOIN (SELECT pair, i, CASE WHEN bool_or(i <= pos) THEN 'pre' ELSE 'post' END AS t FROM (SELECT pair, pos, unnest(range(pos - 3, pos + 2)) AS i FROM epos) GROUP BY ALL) USING (pair, i)")(lambda w: st.event_window_tag(w.market, w.events))
add("event_proximity", "pair date:d event_proximity:f", "SELECT pair, date, coalesce(p, 0) AS event_proximity FROM market LEFT JOIN (SELECT pair, i, max(1 - (pos - i) / 10.0) AS p FROM (SELECT pair, pos, unnest(range(pos - 10, pos + 1)) AS i FROM epos) GROUP BY ALL) USING (pair, i)")(lambda w: st.event_proximity(w.market, w.events))
add("asof_events", "pair event:d pos:i", "SELECT * FROM epos")(lambda w: st.event_positions(w.market, w.events).withColumnRenamed("at", "pos"))
add("pinned_tag", "pair date:d pinned", f"SELECT pair, date, CASE WHEN coalesce(rv_1m / atm_1m < 12 AND (({roll('max', 'ls', 21)}) - ({roll('min', 'ls', 21)})) / (2 * atm_1m / 100 * sqrt(21.0 / 252)) < 8, false) THEN 'pinned' ELSE 'none' END AS pinned FROM market")(lambda w: st.pinned_tag(w.market, 21, 12.0, 8.0))
add("intervention_tag", "pair date:d intervention", f"SELECT pair, date, CASE WHEN coalesce(spot / lag(spot, 21) OVER {W} - 1 > 0.05, false) OR spot > 0.9 THEN 'risk' ELSE 'none' END AS intervention FROM market")(lambda w: st.intervention_tag(w.market, level=0.9))
add("tag_split_cells", "pair date:d regime", f"""SELECT pair, date, CASE WHEN cell = regime OR n >= 5 THEN cell ELSE regime END AS regime FROM tg JOIN (SELECT pair, cell, count(*) AS n FROM (SELECT *, lag(cell) OVER {W} AS was FROM tg) WHERE was IS DISTINCT FROM cell GROUP BY ALL) USING (pair, cell)""", False, {
    "tg": f"SELECT pair, date, regime, CASE WHEN coalesce(spot / lag(spot, 21) OVER {W} - 1 > 0.08, false) THEN regime || '·risk' ELSE regime END AS cell FROM lab JOIN market USING (pair, date)"})(lambda w: st.tag_split(w.labels, st.intervention_tag(w.market, 0.08), "intervention"))
add("corr_sign_tag", "pair date:d corr_sign", None)(lambda w: st.corr_sign_tag(w.market))

# profiles
add("characteristics", "pair date:d spotvol_beta:f spotvol_corr:f vrp:f term_slope:f rr_level:f fly_level:f volofvol:f jump_freq:f", "SELECT * FROM chars")(lambda w: st.characteristics(w.market))
add("state_profile", "pair characteristic regime state_mean:f all_mean:f all_sd:f d:f", "SELECT *, (state_mean - all_mean) / nullif(all_sd, 0) AS d FROM prof")(lambda w: st.state_profile(st.characteristics(w.market), w.labels))
add("distinguishing_topk", "pair regime place:i characteristic d:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, regime ORDER BY round(abs(d), 9) DESC, characteristic) AS place FROM (SELECT *, (state_mean - all_mean) / nullif(all_sd, 0) AS d FROM prof) WHERE d IS NOT NULL) WHERE place <= 3")(lambda w: st.distinguishing(st.state_profile(st.characteristics(w.market), w.labels)))
add("today_placement", "pair characteristic state today:f pct_within_state:f", """SELECT u.pair, u.characteristic, t.state, t.today, avg(CASE WHEN round(u.value, 9) < round(t.today, 9) THEN 1.0 ELSE 0.0 END) AS pct_within_state FROM ulong u JOIN (SELECT pair, characteristic, max_by(value, date) AS today, max_by(regime, date) AS state FROM ulong GROUP BY ALL) t ON t.pair = u.pair AND t.characteristic = u.characteristic AND t.state = u.regime
    WHERE u.value IS NOT NULL AND t.today IS NOT NULL GROUP BY ALL""")(lambda w: st.today_placement(st.characteristics(w.market), w.labels))

# shocks and transitions
add("surprise_3sigma", "pair date:d surprise:f three_sigma:b", "SELECT pair, date, surprise, coalesce(abs(surprise) > 3, false) AS three_sigma FROM sur")(lambda w: st.surprises(w.market))
add("lead_profile", "pair all:f before_up:f before_up_n:i before_down:f before_down_n:i", f"""SELECT pair, avg(score) AS "all", avg(CASE WHEN d > 0 THEN m END) AS before_up, count(CASE WHEN d > 0 THEN 1 END) AS before_up_n, avg(CASE WHEN d < 0 THEN m END) AS before_down, count(CASE WHEN d < 0 THEN 1 END) AS before_down_n
    FROM (SELECT pair, rr25_1m AS score, rk - lag(rk) OVER {W} AS d, avg(rr25_1m) OVER {win(5, 1)} AS m FROM lab JOIN market USING (pair, date) JOIN rank_of USING (regime)) GROUP BY ALL""")(lambda w: st.lead_profile(w.market.select("pair", "date", F.col("rr25_1m").alias("score")), w.labels))
add("blend_pi", "pair state p:f", "SELECT pair, state, sum(p) AS p FROM (SELECT pair, regime AS state, 0.75 * n / t AS p FROM sh UNION ALL SELECT pair, CASE regime WHEN 'carry' THEN 'rising' WHEN 'agitated' THEN 'stressed' ELSE 'extreme' END, 0.25 * n / t FROM sh) GROUP BY ALL", False, {"sh": "SELECT pair, regime, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY pair) AS DOUBLE) AS t FROM lab GROUP BY pair, regime"})(
    lambda w: st.blend(w.labels.groupBy("pair", F.col("regime").alias("state")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pair"))), 50.0))
_TILT = "SELECT pair, from_state, to_state, v / sum(v) OVER (PARTITION BY pair, from_state) AS p FROM (SELECT m.*, p * exp(0.4 * 1.5 * (b.rk - a.rk)) AS v FROM mat m JOIN rank_of a ON a.regime = m.from_state JOIN rank_of b ON b.regime = m.to_state)"
add("tilt_matrix", "pair from_state to_state p:f", _TILT)(lambda w: st.tilt(st.transition_matrix(w.labels, 10.0), F.lit(1.5), 0.4))
add("loglik_k1", "pair n:i loglik:f", f"SELECT pair, count(*) AS n, sum(ln(greatest(p, 1e-300))) AS loglik FROM (SELECT pair, regime AS from_state, lead(regime) OVER {W} AS to_state FROM lab) JOIN mat USING (pair, from_state, to_state) GROUP BY ALL")(lambda w: st.log_likelihood(w.labels, st.transition_matrix(w.labels, 10.0)))
_FAN = {"fn": "SELECT DISTINCT pair, 0 AS h, from_state AS state, CASE WHEN from_state = 'carry' THEN CAST(1 AS DOUBLE) ELSE 0 END AS p FROM mat UNION ALL SELECT f.pair, f.h + 1, m.to_state, sum(f.p * m.p) FROM fn f JOIN mat m ON m.pair = f.pair AND m.from_state = f.state WHERE f.h < 21 GROUP BY f.pair, f.h, m.to_state"}
add("fan_21", "pair h:i state p:f", "SELECT pair, h, state, p FROM fn WHERE h > 0", True, _FAN)(lambda w: st.fan(st.transition_matrix(w.labels, 10.0), "carry"))
_PAY = {"carry": 0.1, "agitated": -0.05, "stressed": -0.3}
add("true_ladder", "pair regime h:i true_ev:f", "SELECT * FROM (SELECT pair, start AS regime, h, sum(e + 0.2 * exp(-(21 - h) / 4.0)) OVER (PARTITION BY pair, start ORDER BY h) AS true_ev FROM (SELECT pair, start, h, sum(p * CASE state WHEN 'carry' THEN 0.1 WHEN 'agitated' THEN -0.05 ELSE -0.3 END) AS e FROM fa WHERE h > 0 GROUP BY ALL)) WHERE h IN (1, 3, 5, 10, 20, 21)", True, {
    "fa": "SELECT DISTINCT a.pair, a.from_state AS start, 0 AS h, b.from_state AS state, CASE WHEN a.from_state = b.from_state THEN CAST(1 AS DOUBLE) ELSE 0 END AS p FROM mat a JOIN mat b ON a.pair = b.pair UNION ALL SELECT f.pair, f.start, f.h + 1, m.to_state, sum(f.p * m.p) FROM fa f JOIN mat m ON m.pair = f.pair AND m.from_state = f.state WHERE f.h < 21 GROUP BY f.pair, f.start, f.h, m.to_state"})(lambda w: st.true_ladder(st.transition_matrix(w.labels, 10.0), _PAY, 0.2))
add("covariate_paths", "h:i frozen:f decay:f zero:f calendar:f", "SELECT h, 1.2 AS frozen, 1.2 * power(0.5, h / 10.0) AS decay, 0.0 AS zero, coalesce([0.5, 1.5, 0.25][h], 0) AS calendar FROM (SELECT unnest(range(1, 22)) AS h)")(lambda w: st.covariate_paths(w.spark, 1.2, 21, calendar=(0.5, 1.5, 0.25)))
_AL = f"""SELECT *, rank() OVER (PARTITION BY pair, k ORDER BY x) + (count(*) OVER (PARTITION BY pair, k, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair, k ORDER BY y) + (count(*) OVER (PARTITION BY pair, k, y) - 1) / 2.0 AS b FROM (SELECT m.pair, s.k, round(m.atm_1m, 9) AS x, t.rv_1w AS y FROM market m CROSS JOIN (SELECT unnest([-10, -5, 0, 5, 10]) AS k) s JOIN market t ON t.pair = m.pair AND t.i = m.i + s.k) WHERE x IS NOT NULL AND y IS NOT NULL"""
add("alignment_spearman", "pair k:i n:i rho:f", f"SELECT pair, k, count(*) AS n, corr(a, b) AS rho FROM ({_AL}) GROUP BY ALL")(lambda w: st.alignment(w.market, "atm_1m", "rv_1w", (-10, -5, 0, 5, 10)))
add("alarm_matches", "pair alarms:i events:i alarms_hit:i events_caught:i", f"""SELECT * FROM (SELECT pair, count(*) AS alarms FROM am GROUP BY ALL) FULL JOIN (SELECT pair, count(*) AS events FROM ae GROUP BY ALL) USING (pair) LEFT JOIN (SELECT a.pair, count(DISTINCT a.date) AS alarms_hit, count(DISTINCT e.date) AS events_caught FROM am a JOIN ae e ON e.pair = a.pair AND e.date > a.date AND e.date <= a.date + 30 GROUP BY ALL) USING (pair)""", False, {
    "am": "SELECT pair, date FROM market WHERE rr25_1m > 0.5", "ae": "SELECT pair, date FROM market WHERE atm_1m > 11.5"})(lambda w: st.alarm_matches(w.market.where("rr25_1m > 0.5"), w.market.where("atm_1m > 11.5")))

# evaluation
add("integrity_checks", "check passed:b bad:i", """SELECT x.check, x.bad = 0 OR x.check LIKE 'info%' AS passed, x.bad FROM (UNPIVOT (SELECT CAST(0 AS BIGINT) AS required_columns, CAST(sum(dups) AS BIGINT) AS no_duplicate_trade_date, CAST(0 AS BIGINT) AS no_nan_pnl, CAST(sum(CASE WHEN f <> 1 THEN 1 ELSE 0 END) + sum(CASE WHEN gaps > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ages_consecutive_from_1,
    CAST(sum(over_) AS BIGINT) AS age_within_tenor, CAST(sum(CASE WHEN back > 0 THEN 1 ELSE 0 END) AS BIGINT) AS dates_increase_with_age, CAST(sum(early) AS BIGINT) AS date_after_entry, CAST(sum(CASE WHEN l < 21 THEN 1 ELSE 0 END) AS BIGINT) AS info_trades_not_yet_expired FROM sp) ON COLUMNS(*) INTO NAME "check" VALUE bad) x""", False, {
    "so": "SELECT l_linestatus AS pair, CAST(l_orderkey AS VARCHAR) AS trade_id, row_number() OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) * 4 AS age, CAST(l_shipdate AS DATE) AS date, CAST(o_orderdate AS DATE) AS entry_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "sr": "SELECT *, age - lag(age) OVER q AS step, date <= lag(date) OVER q AS back FROM so WINDOW q AS (PARTITION BY pair, trade_id ORDER BY age, date)",
    "sp": "SELECT pair, trade_id, min(age) AS f, max(age) AS l, sum(CASE WHEN step <> 1 THEN 1 ELSE 0 END) AS gaps, sum(CASE WHEN back THEN 1 ELSE 0 END) AS back, sum(CASE WHEN age > 21 THEN 1 ELSE 0 END) AS over_, sum(CASE WHEN date <= entry_date THEN 1 ELSE 0 END) AS early, count(*) - count(DISTINCT date) AS dups FROM sr GROUP BY ALL"})(lambda w: ev.check_trade_days(_sparse(w)))
add("label_coverage", "entry_dates:i unlabelled:i", "SELECT count(*) AS entry_dates, sum(CASE WHEN regime IS NULL THEN 1 ELSE 0 END) AS unlabelled FROM (SELECT DISTINCT pair, entry_date FROM td) t LEFT JOIN (SELECT * FROM lab WHERE regime <> 'carry') l ON l.pair = t.pair AND l.date = t.entry_date")(lambda w: ev.label_coverage(w.td, w.labels.where("regime <> 'carry'")))
_K = f"{G}, h"
_FOLDS = {
    "wd": f"SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY entry_date) - 1 AS i, count(*) OVER (PARTITION BY {_K}) AS u FROM (SELECT DISTINCT {_K}, entry_date FROM cl)",
    "wk": f"SELECT {_K}, k, entry_date AS t FROM wd CROSS JOIN (SELECT unnest(range(5)) AS k) WHERE i = CAST(floor(floor(0.4 * u) + (u - 1 - floor(0.4 * u)) * k / 4.0) AS BIGINT)",
    "wf": f"SELECT {', '.join('a.' + c for c in _K.split(', '))}, a.k, a.t AS t0, b.t AS t1 FROM wk a JOIN wk b ON {' AND '.join(f'a.{c} = b.{c}' for c in _K.split(', '))} AND b.k = a.k + 1",
    "wx": f"SELECT *, CASE WHEN train THEN cum_pnl END AS y0 FROM (SELECT {', '.join('c.' + c for c in _K.split(', '))}, f.k, c.regime, c.cum_pnl, {bday('c.entry_date')} < {bday('f.t0')} - c.h AS train, c.entry_date >= f.t0 AND c.entry_date < f.t1 AS test FROM cl c JOIN wf f USING ({_K})) WHERE train OR test",
    "wm": f"SELECT *, count(y0) OVER f AS n_train, avg(y0) OVER f AS m_u, coalesce(avg(y0) OVER s, avg(y0) OVER f) AS m_r0 FROM wx WINDOW f AS (PARTITION BY {_K}, k), s AS (PARTITION BY {_K}, k, regime)",
    "wt": f"SELECT {_K}, cum_pnl AS y, m_u, round(m_r0, 9) AS m_r FROM wm WHERE test AND n_train >= 20",
    "wr": f"SELECT *, rank() OVER (PARTITION BY {_K} ORDER BY m_r) + (count(*) OVER (PARTITION BY {_K}, m_r) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {_K} ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY {_K}, round(y, 9)) - 1) / 2.0 AS rb FROM wt",
    "wo": f"SELECT {_K}, count(*) AS n_test, avg(power(y - m_u, 2)) AS mse_uncond, avg(power(y - m_r, 2)) AS mse_regime, 1 - avg(power(y - m_r, 2)) / avg(power(y - m_u, 2)) AS improvement, corr(ra, rb) AS rank_ic, regr_slope(y, m_r) AS calib_slope FROM wr GROUP BY ALL",
}
add("walk_forward", f"{GS} h:i n_test:i mse_uncond:f mse_regime:f improvement:f rank_ic:f calib_slope:f", "SELECT * FROM wo", False, _FOLDS)(lambda w: ev.walk_forward(w.cum_lab))
add("gate2", "cells:i fraction_separated:f pass:b", f"SELECT *, fraction_separated >= 0.75 AS pass FROM (SELECT count(*) AS cells, coalesce(avg(CASE WHEN spread > 2 * worst THEN 1.0 ELSE 0.0 END), 0) AS fraction_separated FROM (SELECT {G}, h, count(*) AS k, max(mean) - min(mean) AS spread, greatest(max_by(se, mean), min_by(se, mean)) AS worst FROM lad WHERE regime <> 'ALL' AND h <= 10 AND se IS NOT NULL GROUP BY ALL HAVING count(*) >= 2))")(lambda w: ev.gate_separation(w.ladder))
add("gate3", "improvement_min:f rank_ic_min:f slope_min:f slope_max:f pass:b", "SELECT *, coalesce(improvement_min > 0 AND rank_ic_min > 0 AND slope_min >= 0.5 AND slope_max <= 1.5, false) AS pass FROM (SELECT min(improvement) AS improvement_min, min(rank_ic) AS rank_ic_min, min(calib_slope) AS slope_min, max(calib_slope) AS slope_max FROM wo WHERE h <= 10)", False, _FOLDS)(lambda w: ev.gate_out_of_sample(ev.walk_forward(w.cum_lab)))
add("lift_point", "pair p_event_signal:f p_event_all:f n_signal:i n_signal_runs:i lift:f", f"""SELECT pair, avg(CASE WHEN sig THEN f END) AS p_event_signal, avg(CASE WHEN elig THEN f END) AS p_event_all, count(CASE WHEN sig THEN 1 END) AS n_signal, count(CASE WHEN sig AND NOT coalesce(was, false) THEN 1 END) AS n_signal_runs, avg(CASE WHEN sig THEN f END) / nullif(avg(CASE WHEN elig THEN f END), 0) AS lift
    FROM (SELECT *, lag(sig) OVER {W} AS was FROM (SELECT *, elig AND coalesce(x >= round(thr, 9), false) AS sig FROM (SELECT pair, date, x, CASE WHEN fut THEN 1.0 ELSE 0.0 END AS f, NOT hi AND whole AS elig, thr FROM
    (SELECT pair, date, round(rr25_1m, 9) AS x, regime IN ('stressed', 'extreme') AS hi, coalesce(bool_or(regime IN ('stressed', 'extreme')) OVER nx, false) AS fut, count(*) OVER nx = 5 AS whole, CASE WHEN count(rr25_1m) OVER pv >= 126 THEN quantile_cont(round(rr25_1m, 9), 0.9) OVER pv END AS thr FROM lab JOIN market USING (pair, date)
    WINDOW nx AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), pv AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 504 PRECEDING AND 1 PRECEDING))))) GROUP BY ALL""")(lambda w: ev.lift(w.labels.join(w.market.select("pair", "date", "rr25_1m"), ["pair", "date"]), "rr25_1m", horizon=5))

# packets
add("largest_days", "trade_id date:d age:i pnl:f", "SELECT trade_id, date, age, pnl FROM td ORDER BY abs(pnl) DESC, trade_id, date, age LIMIT 20")(lambda w: ev.largest_days(w.td))
_CV = ["pnl_vol", "pnl_spot", "pnl_rr", "pnl_fly", "pnl_theta", "pnl_trade", "pnl_delta_hedge", "pnl_vega_hedge"]
add("component_variance", "archetype component ratio:f", "UNPIVOT (SELECT archetype, " + ", ".join(f"var_samp({c}) / nullif(var_samp(pnl), 0) AS {c}" for c in _CV) + " FROM td GROUP BY ALL) ON " + ", ".join(_CV) + " INTO NAME component VALUE ratio")(lambda w: ev.component_variance(w.td))
add("decile_bins", "pair bin:i n:i mean:f se:f", f"SELECT pair, greatest(1, ceil(round(v, 9) / 10)) AS bin, count(*) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) * sqrt(5.0) AS se FROM p_vol JOIN (SELECT pair, date, lead(atm_1m, 5) OVER {W} - atm_1m AS y FROM market) USING (pair, date) WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY ALL")(
    lambda w: ev.decile_bins(w.market.withColumns({"s": rolling_percentile("atm_1m", 756), "y": F.lead("atm_1m", 5).over(series()) - F.col("atm_1m")}), "s", "y"))
_YS = "SELECT pair, year(date) AS year, regime, count(*) AS days, count(*) / CAST(sum(count(*)) OVER (PARTITION BY pair, year(date)) AS DOUBLE) AS share FROM {} GROUP BY pair, year(date), regime"
add("yearly_share", "pair year:i regime days:i share:f", _YS.format("lab"))(lambda w: ev.yearly_share(w.labels))
add("label_tv_distance", "pair year:i distance:f", "SELECT pair, year, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 AS distance FROM ya a FULL JOIN yb b USING (pair, year, regime) GROUP BY ALL", False, {"lab2": "SELECT pair, date, CASE WHEN atm_1m < 9.8 THEN 'carry' ELSE 'stressed' END AS regime FROM market", "ya": _YS.format("lab"), "yb": _YS.format("lab2")})(
    lambda w: ev.label_distance(w.labels, w.market.select("pair", "date", F.when(F.col("atm_1m") < 9.8, "carry").otherwise("stressed").alias("regime"))))
add("sign_change_cells", f"{GS} regime signs:i lowest:f highest:f", f"SELECT {G}, regime, count(DISTINCT sign(mean)) AS signs, min(mean) AS lowest, max(mean) AS highest FROM stat GROUP BY ALL HAVING count(DISTINCT sign(mean)) > 1")(lambda w: ev.sign_change_cells(w.ladder))
add("thin_cells", f"{CS} n_eff:f episodes:i", "SELECT * FROM lad WHERE episodes < 5 OR n_eff < 30")(lambda w: ev.thin_cells(w.ladder))
add("month_gaps", "pair month:d", "SELECT pair, CAST(month AS DATE) AS month FROM (SELECT pair, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM (SELECT pair, date_trunc('month', min(entry_date)) AS a, date_trunc('month', max(entry_date)) AS b FROM te GROUP BY pair)) WHERE (pair, month) NOT IN (SELECT (pair, date_trunc('month', entry_date)) FROM te)", False, {"te": "SELECT * FROM td WHERE month(entry_date) <> 7"})(lambda w: ev.month_gaps(w.td.where("month(entry_date) <> 7")))
add("missing_market_dates", "pair date:d", "SELECT DISTINCT pair, date FROM td WHERE (pair, date) NOT IN (SELECT (pair, date) FROM market WHERE atm_1m < 11)")(lambda w: ev.missing_market_dates(w.td, w.market.where("atm_1m < 11")))
add("pnl_summary", f"{GS} trades:i rows:i first_entry:d last_entry:d mean:f sd:f q01:f q50:f q99:f", f"SELECT {G}, count(DISTINCT trade_id) AS trades, count(*) AS rows, min(entry_date) AS first_entry, max(entry_date) AS last_entry, avg(pnl) AS mean, stddev_samp(pnl) AS sd, quantile_cont(pnl, 0.01) AS q01, quantile_cont(pnl, 0.5) AS q50, quantile_cont(pnl, 0.99) AS q99 FROM td GROUP BY ALL")(lambda w: ev.pnl_summary(w.td))


# fitted models, rows only
def _scored(w: World) -> DataFrame:
    y = {"target": F.lead("atm_1m", 5).over(series()) - F.col("atm_1m"), "level_target": F.lead("rv_1m", 5).over(series()), "score": rolling_percentile("atm_1m", 252)}
    y["score2"] = rolling_percentile("rv_1m", 252)
    return w.market.withColumns(y).select("pair", "date", "score", "score2", "target", "level_target")


def _screened(w: World) -> DataFrame:
    """Labels, a score, all leading features, and outcomes: what straddles, risk reversals and realised vol do next."""
    base = w.market.select("pair", "date", "rr25_1m", "fly25_1m", F.col("atm_1y").alias("score"))
    t = w.labels.join(base, ["pair", "date"]).join(md.outcomes(w.td, w.market, ["straddle_atm", "call_25d"]), ["pair", "date"])
    return t.withColumn("y", F.col("straddle_atm")).join(ft.build(w.market, None, ft.LEADING), ["pair", "date"])


add("har_forecast", "pair date:d forecast:f", None)(lambda w: md.har_forecast(w.market))
add("shock_score", "pair date:d cusum:f p_young:f run:i score:f", None)(lambda w: md.shock_score(w.market))
_SPEC = "halflife:f delta:f dir_k:f lower:f upper:f top:f d_up:f delta_d:f extreme_merged:b"
add("finder_report", f"pair candidate:i partition r2:f switches:i min_episodes:i {_SPEC} extreme_episodes:i feasible:b chosen:b winner:b", None)(lambda w: md.finder(_scored(w)))
add("finder_top", f"pair partition place:i candidate:i r2:f switches:i min_episodes:i {_SPEC}", None)(lambda w: md.top_candidates(md.finder(_scored(w))))
add("labeller_specs", f"pair partition r2:f fell_back:b {_SPEC}", None)(lambda w: md.specs(md.finder(_scored(w)), "6x"))
add("auto_labels", "pair date:d regime warm:b", None)(lambda w: md.make_labels(_scored(w), md.finder(_scored(w))))
add("fixed_labels", "pair date:d regime warm:b", None)(lambda w: md.apply_spec(_scored(w), md.fixed_specs(_scored(w), 3.0, (30.0, 60.0, 90.0), 2.0, 0.75, "6x")))
add("tilt_fit", "pair feature n:i gamma:f beta:f gain:f folds_up:i", None)(lambda w: md.tilt_fits(_screened(w), list(ft.LEADING)[:6], base="score"))
add("pooled_tilt", "feature pairs:i n:i gamma:f beta:f loglik:f loglik0:f", None)(lambda w: md.pooled_tilt(_screened(w), ["rr25_1m", "fly25_1m"], 5, "score"))
_LEAD_SPEC = "pair feature target n:i delta_r2:f folds_up:i gain:f gain_folds_up:i p_perm:f delta_r2_low:f gain_k10:f gain_k21:f delta_r2_diag:f retain:b fail_reason for_holdout:b delta_r2_holdout:f gain_holdout:f"
add("leading_screen", _LEAD_SPEC, None)(lambda w: _screen(w))
add("pressure_gain", "pair n:i gain:f folds_up:i", None)(lambda w: md.pressure_gain(_pressed(w)))
add("gate4", "retained:i pressure_gain:f folds_up:i pass:b", None)(lambda w: md.gate_leading(_screen(w), md.pressure_gain(_pressed(w))))
add("discover_substates", "pair regime k:i bic:f min_runs:i stability:f accepted:b", None)(lambda w: md.discover(st.characteristics(w.market), w.labels))
add("factor_share", "pair date:d share:f", None)(lambda w: md.factor_share(w.market, ["spot", "g10_1", "g10_2", "g10_3"]))
add("sweep_table", f"variant pair partition fell_back:b on_grid_edge:b r2:f switches:i gate2_fit:f gate2_confirm:f high_minus_carry:f agreement:f {_SPEC}", None)(lambda w: md.sweep(_scored(w), w.cumulative))
add("lift_interval", "pair p_event_signal:f p_event_all:f n_signal:i lift:f lift_lo:f lift_hi:f", None)(lambda w: ev.lift_interval(w.labels.join(w.market.select("pair", "date", "rr25_1m"), ["pair", "date"]), "rr25_1m", horizon=5))
add("interval_coverage", "world:i cells:i coverage:f median_error:f", None)(lambda w: syn.interval_coverage(w.spark, worlds=4, days=1000))


def _screen(w: World) -> DataFrame:
    targets = {"drift_t": "call_25d", "gap_z_signed": "call_25d"}
    return md.leading_screen(_screened(w), [*ft.LEADING], targets=targets, diagnosis="realised_minus_implied")


def _pressed(w: World) -> DataFrame:
    return ft.pressure(_screened(w), {"gap_pct": 1.0, "complacency": 1.0, "coupling_shift_pct": 1.0})


# several tenors
_TERMS = {"ages": f"SELECT tenor_days, unnest(range(1, tenor_days + 1)) AS age FROM (SELECT unnest({list(TENORS)}) AS tenor_days)"}
add("ladder_hac_terms", f"{CS} to_expiry:b n:i n_eff:f mean:f se:f ci_lo:f ci_hi:f p_profit:f q05:f q50:f q95:f es05:f episodes:i", "SELECT * FROM lad", False, _TERMS)(lambda w: ld.ladder(w.cum_terms, w.labels))
add("walk_forward_terms", f"{GS} h:i n_test:i mse_uncond:f mse_regime:f improvement:f rank_ic:f calib_slope:f", "SELECT * FROM wo", False, _FOLDS | _TERMS)(lambda w: ev.walk_forward(w.cum_terms))
add("combine_rr_terms", "trade_id pair archetype tenor_days:i entry_date:d date:d age:i remaining:i pnl:f", "SELECT *, concat_ws('-', pair, 'rr_25d', strftime(entry_date, '%Y-%m-%d'), tenor_days) AS trade_id, 'rr_25d' AS archetype, tenor_days - age AS remaining FROM cmb", False, _TERMS)(lambda w: cmb.combine(w.terms, cmb.COMBINATIONS["rr_25d"], "rr_25d"))
_SHORT = "SELECT * FROM ent e WHERE tenor_days = (SELECT min(tenor_days) FROM ent x WHERE x.archetype = e.archetype AND h = 3 AND NOT to_expiry)"
add("trailing_earn_terms", "pair archetype date:d earn_mean:f earn_z:f", f"""SELECT pair, archetype, date, m AS earn_mean, (m - CASE WHEN count(m) OVER p >= 126 THEN avg(m) OVER p END) / nullif(CASE WHEN count(m) OVER p >= 126 THEN stddev_samp(m) OVER p END, 0) AS earn_z FROM
    (SELECT *, CASE WHEN count(earn) OVER q >= 10 THEN avg(earn) OVER q END AS m FROM (SELECT m.pair, a.archetype, m.date, k.earn FROM market m CROSS JOIN (SELECT DISTINCT archetype FROM ent) a
    LEFT JOIN (SELECT e.pair, e.archetype, x.i + 3 AS i, e.earn FROM es1 e JOIN market x ON x.pair = e.pair AND x.date = e.entry_date WHERE h = 3 AND NOT to_expiry) k ON k.pair = m.pair AND k.archetype = a.archetype AND k.i = m.i)
    WINDOW q AS (PARTITION BY pair, archetype ORDER BY date ROWS 19 PRECEDING)) WINDOW p AS (PARTITION BY pair, archetype ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""", False, _TERMS | {"es1": _SHORT})(lambda w: ex.trailing_earn(ex.entries(w.terms), w.market, h=3))

# more of states, packets and statistics
add("unconverted_trades", f"{GS} trades:i dropped:i", f"SELECT {G}, count(*) AS trades, sum(CASE WHEN coalesce(v, 0) = 0 THEN 1 ELSE 0 END) AS dropped FROM (SELECT {G}, trade_id, max(CASE WHEN age = 1 AND dayofweek(entry_date) <> 1 THEN abs(vega) END) AS v FROM td GROUP BY ALL) GROUP BY ALL")(
    lambda w: cmb.unconverted(w.td.withColumn("vega", F.when(F.dayofweek("entry_date") != 2, F.col("vega")))))
add("reconciliation", "package leg coefficient:f r2:f n:i", "SELECT 'package' AS package, a.leg, (b.yx * o.xx - b2.yx * b.x12) / (b.xx * o.xx - b.x12 * b.x12) AS coefficient, r2.r2, r2.n FROM rg b JOIN rg o ON o.leg <> b.leg JOIN rg b2 ON b2.leg = o.leg JOIN (SELECT unnest(['call_25d', 'put_25d']) AS leg) a ON a.leg = b.leg CROSS JOIN rr2 r2", False, {
    "rw": "SELECT pair, tenor_days, entry_date, age, max(CASE archetype WHEN 'call_25d' THEN pnl END) AS c, max(CASE archetype WHEN 'put_25d' THEN pnl END) AS p, max(CASE archetype WHEN 'straddle_atm' THEN pnl END) AS s FROM td GROUP BY ALL",
    "ry": "SELECT *, 0.9 * c - 1.1 * p + 0.05 * s AS y FROM rw",
    "rg": "SELECT 'call_25d' AS leg, sum(c * c) AS xx, sum(y * c) AS yx, sum(c * p) AS x12 FROM ry UNION ALL SELECT 'put_25d', sum(p * p), sum(y * p), sum(c * p) FROM ry",
    "rb": "SELECT (sum(y * c) * sum(p * p) - sum(y * p) * sum(c * p)) / (sum(c * c) * sum(p * p) - sum(c * p) * sum(c * p)) AS b1, (sum(y * p) * sum(c * c) - sum(y * c) * sum(c * p)) / (sum(c * c) * sum(p * p) - sum(c * p) * sum(c * p)) AS b2 FROM ry",
    "rr2": "SELECT 1 - sum(power(y - b1 * c - b2 * p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2, count(*) AS n FROM ry CROSS JOIN rb"})(lambda w: cmb.reconcile(_with_package(w), "package", cmb.COMBINATIONS["rr_25d"]))
add("threshold_labels", "pair date:d regime", "SELECT pair, date, ['carry', 'transition', 'crisis'][c + 1] AS regime FROM lv", True, _LEVEL)(lambda w: scans.threshold_labels(w.market.select("pair", "date", "atm_1m"), "atm_1m", 9.5, 10.5, 0.2))
_FOUR = "CASE WHEN x > 11.2 AND c <= 2 THEN 3 WHEN x > 10.7 AND c <= 1 THEN 2 WHEN x > 9.7 AND c = 0 THEN 1 ELSE c END"
_DROP = "CASE WHEN u = 3 AND x < 10.8 THEN CASE WHEN x < 9.3 THEN 0 WHEN x < 10.3 THEN 1 ELSE 2 END WHEN u = 2 AND x < 10.3 THEN CASE WHEN x < 9.3 THEN 0 ELSE 1 END WHEN u = 1 AND x < 9.3 THEN 0 ELSE u END"
_LEVEL4 = _LEVEL | {
    "l4": f"SELECT pair, k, date, CASE WHEN x > 11.2 THEN 3 WHEN x > 10.7 THEN 2 WHEN x > 9.7 THEN 1 ELSE 0 END AS c FROM sx WHERE k = 1 UNION ALL SELECT pair, k, date, {_DROP} FROM (SELECT t.*, {_FOUR} AS u FROM (SELECT s.*, l.c FROM l4 l JOIN sx s ON s.pair = l.pair AND s.k = l.k + 1) t) s",
    "ld4": "SELECT a.pair, a.k, a.date, ['low', 'mid', 'high', 'extreme'][a.c + 1] AS l, ['down', 'flat', 'up'][b.c + 2] AS d FROM l4 a JOIN dr b USING (pair, k)",
    "au4": f"SELECT pair, k, date, {_NEXT} AS s FROM (SELECT *, 'carry' AS s FROM ld4 WHERE k = 1) UNION ALL SELECT pair, k, date, {_NEXT} FROM (SELECT n.*, a.s FROM au4 a JOIN ld4 n ON n.pair = a.pair AND n.k = a.k + 1)",
}
add("four_bands", "pair date:d level", "SELECT pair, date, ['low', 'mid', 'high', 'extreme'][c + 1] AS level FROM l4", True, _LEVEL4)(lambda w: _levels4(w))
add("extreme_states", "pair date:d regime", "SELECT pair, date, s AS regime FROM au4", True, _LEVEL4)(lambda w: scans.state_scan(_levels4(w).join(_directions(w), ["pair", "date"])))
add("state_order", "regime place:i", "SELECT regime, row_number() OVER (ORDER BY p, regime) AS place FROM (SELECT DISTINCT regime, list_position(['carry', 'settling', 'rising', 'agitated', 'normalising', 'stressed', 'extreme', 'transition', 'crisis'], regime) AS p FROM lab)")(lambda w: st.state_order(w.labels))
add("modal_state", "pair regime days:i", "SELECT pair, regime, days FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY days DESC, regime) AS k FROM (SELECT pair, regime, count(*) AS days FROM lab GROUP BY ALL)) WHERE k = 1")(lambda w: st.modal_state(w.labels))
add("state_summary", "pair regime observed_mean_days:f episodes:i days:i share:f score_mean:f score_min:f score_max:f", """SELECT pair, regime, observed_mean_days, episodes, days, share, score_mean, score_min, score_max FROM (SELECT pair, regime, avg(days) AS observed_mean_days, count(*) AS episodes FROM runs GROUP BY ALL)
    JOIN (SELECT pair, regime, count(*) AS days, count(*) / CAST(sum(count(*)) OVER (PARTITION BY pair) AS DOUBLE) AS share FROM lab GROUP BY pair, regime) USING (pair, regime) JOIN (SELECT pair, regime, avg(atm_1m) AS score_mean, min(atm_1m) AS score_min, max(atm_1m) AS score_max FROM lab JOIN market USING (pair, date) GROUP BY ALL) USING (pair, regime)""")(lambda w: st.state_summary(w.labels, w.market.select("pair", "date", F.col("atm_1m").alias("score"))))
add("mask_runs", "pair date:d run:i", f"SELECT pair, date, sum(new) OVER {W} AS run FROM (SELECT *, CASE WHEN coalesce(i - lag(i) OVER {W}, 1000000000) > 3 THEN 1 ELSE 0 END AS new FROM (SELECT pair, date, i FROM market WHERE atm_1m > 10.8))")(lambda w: runs_of_days(w.market.select("pair", "date", "atm_1m"), "atm_1m > 10.8", least_gap=3))
add("expected_days", "pair state days:f", "SELECT pair, state, sum(p) AS days FROM fn WHERE h > 0 GROUP BY ALL", True, _FAN)(lambda w: st.expected_days(st.fan(st.transition_matrix(w.labels, 10.0), "carry")))
add("p_state_at", "pair h:i p:f", "SELECT pair, h, sum(CASE WHEN state IN ('stressed', 'extreme') THEN p ELSE 0 END) AS p FROM fn WHERE h IN (5, 10, 21) GROUP BY ALL", True, _FAN)(lambda w: st.p_state_at(st.fan(st.transition_matrix(w.labels, 10.0), "carry"), st.HIGH))
add("fold_dates", "cut:i date:d", "SELECT k AS cut, CASE WHEN d IS NULL THEN last + 1 ELSE d END AS date FROM (SELECT s.k, max(CASE WHEN o.i = CAST(floor(floor(0.4 * o.n) + (o.n - floor(0.4 * o.n)) * s.k / 4.0) AS BIGINT) THEN o.date END) AS d, max(o.date) AS last FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM lab)) o CROSS JOIN (SELECT unnest(range(5)) AS k) s GROUP BY s.k)")(lambda w: md.fold_dates(w.labels))
add("asset_correlations", "pair date:d corr_spot_g10_1:f corr_vol_g10_1:f corr_spot_atm_1y:f corr_vol_atm_1y:f", f"SELECT pair, date, {roll2('corr', 'r', 'x1', 20)} AS corr_spot_g10_1, {roll2('corr', 'dv', 'x1', 20)} AS corr_vol_g10_1, {roll2('corr', 'r', 'x2', 20)} AS corr_spot_atm_1y, {roll2('corr', 'dv', 'x2', 20)} AS corr_vol_atm_1y FROM (SELECT *, ln(g10_1) - ln(lag(g10_1) OVER {W}) AS x1, atm_1y - lag(atm_1y) OVER {W} AS x2 FROM market)")(lambda w: st.asset_correlations(w.market, {"g10_1": "log", "atm_1y": "diff"}))
add("state_phrases", "pair regime phrase", "SELECT pair, any_value(r) AS regime, any_value(r) || ' · ' || string_agg(characteristic || CASE WHEN d > 0 THEN ' high (' ELSE ' low (' END || printf('%+.1f', round(d, 1) + 0.0) || 'σ)', ' · ' ORDER BY place) AS phrase FROM (SELECT *, regime AS r, row_number() OVER (PARTITION BY pair, regime ORDER BY round(abs(d), 9) DESC, characteristic) AS place FROM (SELECT *, (state_mean - all_mean) / nullif(all_sd, 0) AS d FROM prof) WHERE d IS NOT NULL) t WHERE place <= 3 GROUP BY pair, r")(lambda w: st.describe(st.state_profile(st.characteristics(w.market), w.labels)))
add("tags_from_config", "pair date:d intervention event_window", "SELECT pair, date, CASE WHEN coalesce(spot / lag(spot, 21) OVER " + W + " - 1 > CASE pair WHEN 'F' THEN 0.05 ELSE 0.08 END, false) THEN 'risk' ELSE 'none' END AS intervention, coalesce(t, 'none') AS event_window FROM market LEFT JOIN (SELECT pair, i, CASE WHEN bool_or(i <= pos) THEN 'pre' ELSE 'post' END AS t FROM (SELECT pair, pos, unnest(range(pos - 2, pos + 2)) AS i FROM epos) GROUP BY ALL) USING (pair, i)")(
    lambda w: st.build_tags(w.market, {"intervention": {"move": 0.08}, "events": EVENTS, "event_window": {"before": 2}, "pairs": {"F": {"intervention": {"move": 0.05}}}}))
add("before_escalations", "pair date:d days_before:i feature value:f", f"SELECT * FROM (UNPIVOT (SELECT m.pair, m.date, s.k AS days_before, t.atm_1m, t.rr25_1m FROM (SELECT pair, date, i FROM market SEMI JOIN (SELECT pair, date FROM (SELECT *, lag(regime) OVER {W} AS was FROM lab) WHERE regime = 'stressed' AND was <> 'stressed') e USING (pair, date)) m CROSS JOIN (SELECT unnest([1, 5, 20]) AS k) s LEFT JOIN market t ON t.pair = m.pair AND t.i = m.i - s.k) ON atm_1m, rr25_1m INTO NAME feature VALUE value) UNION ALL SELECT m.pair, m.date, s.k, f.n, NULL FROM (SELECT pair, date, i FROM market SEMI JOIN (SELECT pair, date FROM (SELECT *, lag(regime) OVER {W} AS was FROM lab) WHERE regime = 'stressed' AND was <> 'stressed') e USING (pair, date)) m CROSS JOIN (SELECT unnest([1, 5, 20]) AS k) s CROSS JOIN (SELECT unnest(['atm_1m', 'rr25_1m']) AS n) f WHERE m.i - s.k < 1")(lambda w: st.before_escalations(w.market.select("pair", "date", "atm_1m", "rr25_1m"), w.labels))
add("feature_correlations", "pair a b n:i corr:f", "SELECT pair, 'atm_1m' AS a, 'atm_1y' AS b, count(*) AS n, corr(atm_1m, atm_1y) AS corr FROM market GROUP BY ALL UNION ALL SELECT pair, 'atm_1m', 'rr25_1m', count(*), corr(atm_1m, rr25_1m) FROM market GROUP BY ALL UNION ALL SELECT pair, 'atm_1y', 'rr25_1m', count(*), corr(atm_1y, rr25_1m) FROM market GROUP BY ALL")(lambda w: st.correlation_matrix(w.market.select("pair", "date", "atm_1m", "atm_1y", "rr25_1m")))
add("gate1", "integrity_all_pass:b golden_trades_match:b pass:b", "SELECT true AS integrity_all_pass, false AS golden_trades_match, false AS pass")(lambda w: ev.gate_integrity(ev.check_trade_days(w.td), w.spark.createDataFrame([("a", 1e-9), ("b", 0.5)], "trade_id string, abs_error double")))
add("outcomes", "pair date:d realised_minus_implied:f straddle_atm:f call_25d:f", f"SELECT m.pair, m.date, lead(rv_1m, 21) OVER (PARTITION BY m.pair ORDER BY m.date) - atm_1m AS realised_minus_implied, a.straddle_atm, a.call_25d FROM market m LEFT JOIN (SELECT pair, entry_date AS date, avg(CASE archetype WHEN 'straddle_atm' THEN cum_pnl END) AS straddle_atm, avg(CASE archetype WHEN 'call_25d' THEN cum_pnl END) AS call_25d FROM cum WHERE h = 5 GROUP BY ALL) a ON a.pair = m.pair AND a.date = m.date")(lambda w: md.outcomes(w.td, w.market, ["straddle_atm", "call_25d"]))
add("trade_coverage", f"{GS} trades:i rows:i first_entry:d last_entry:d max_age:i", f"SELECT {G}, count(DISTINCT trade_id) AS trades, count(*) AS rows, min(entry_date) AS first_entry, max(entry_date) AS last_entry, max(age) AS max_age FROM td GROUP BY ALL")(lambda w: ev.trade_coverage(w.td))
add("pooled_cumulative", "archetype tenor_days:i h:i to_expiry:b n:i mean:f sd:f lowest:f highest:f", "SELECT archetype, tenor_days, h, to_expiry, count(*) AS n, avg(cum_pnl) AS mean, stddev_samp(cum_pnl) AS sd, min(cum_pnl) AS lowest, max(cum_pnl) AS highest FROM cum GROUP BY ALL")(lambda w: ev.pooled_cumulative(w.cumulative))
add("largest_market_days", "date:d pair archetype mean_pnl:f live_trades:i", "SELECT date, pair, archetype, avg(pnl) AS mean_pnl, count(*) AS live_trades FROM td GROUP BY ALL ORDER BY round(abs(avg(pnl)), 9) DESC, date, pair, archetype LIMIT 20")(lambda w: ev.largest_market_days(w.td))
add("vega_at_entry", "archetype tenor_days:i median:f lowest:f highest:f not_positive:i", "SELECT archetype, tenor_days, quantile_cont(vega, 0.5) AS median, min(vega) AS lowest, max(vega) AS highest, sum(CASE WHEN vega <= 0 THEN 1 ELSE 0 END) AS not_positive FROM td WHERE age = 1 GROUP BY ALL")(lambda w: ev.vega_at_entry(w.terms.where("tenor_days = 21")))
add("market_summary", "pair series n:i mean:f lowest:f highest:f", "SELECT pair, series, count(value) AS n, avg(value) AS mean, min(value) AS lowest, max(value) AS highest FROM (" + " UNION ALL ".join(f"SELECT pair, '{c}' AS series, {c} AS value FROM market" for c in ("spot", "atm_1m", "atm_1y", "rr25_1m", "fly25_1m", "g10_1", "g10_2", "g10_3", "rv_1w", "rv_1m", "rv_3m")) + ") GROUP BY ALL")(lambda w: ev.market_summary(w.market))
add("target_by_state", "pair state n:i mean:f se:f", f"SELECT pair, regime AS state, count(y) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(y)) * sqrt(5.0) AS se FROM ({_Y}) WHERE y IS NOT NULL GROUP BY ALL")(lambda w: ev.target_by_state(w.labels.join(w.market.select("pair", "date", (F.lead("atm_1m", 5).over(series()) - F.col("atm_1m")).alias("y")), ["pair", "date"]), "regime", "y"))
add("coerced_days", f"trade_id {GS} age:i remaining:i date:d pnl:f", f"SELECT trade_id, {G}, age, tenor_days - age AS remaining, date, pnl FROM td")(lambda w: tb.coerce(w.td.withColumns({"age": F.col("age").cast("string"), "date": F.col("date").cast("timestamp"), "pnl": F.col("pnl").cast("string")})))
add("last_day_of_trades", f"trade_id {GS} age:i pnl:f", f"SELECT trade_id, {G}, max(age) AS age, max_by(pnl, age) AS pnl FROM td GROUP BY trade_id, {G}")(lambda w: tb.keep_last(w.td, [*tb.GROUP, "trade_id"], ["age"]))
add("statistics", "pair date:d atm_1m:f atm_1m_pct252:f atm_1m_minus_rv_1m:f spot_vs_ma60:f g10_1:f regime gap_z_signed:f", f"SELECT m.pair, m.date, m.atm_1m, p.v AS atm_1m_pct252, m.atm_1m - m.rv_1m AS atm_1m_minus_rv_1m, s.spot_vs_ma60, m.g10_1, l.regime, z.gap_z AS gap_z_signed FROM market m JOIN p_252 p USING (pair, date) JOIN ({_STATS}) s USING (pair, date) JOIN lab l USING (pair, date) JOIN gapz z USING (pair, date)", False, ranked("market", "atm_1m", 252, "p_252"))(
    lambda w: ex.statistics(w.market, {"named state": w.labels, "leading candidates": ft.build_leading(w.market, None, ["gap_z_signed"])}, {"g10_1": "another series"}))
add("leading_with_events", "pair date:d drift_t:f event_proximity:f", f"SELECT m.pair, m.date, ({roll('avg', 'r', 60)}) / nullif({roll('stddev_samp', 'r', 60)}, 0) * sqrt(60.0) AS drift_t, 100 * coalesce(p, 0) AS event_proximity FROM market m LEFT JOIN (SELECT pair, i, max(1 - (pos - i) / 10.0) AS p FROM (SELECT pair, pos, unnest(range(pos - 10, pos + 1)) AS i FROM epos) GROUP BY ALL) USING (pair, i)")(lambda w: ft.build_leading(w.market, w.events, ["drift_t"]))
add("pressure_z", "pair date:d pressure:f", f"SELECT pair, date, 0.5 * ({z('atm_1m', 252)}) + 0.5 * ({z('rr25_1m', 252)}) AS pressure FROM market")(lambda w: ft.pressure(w.market, {"atm_1m": 1.0, "rr25_1m": 1.0}, zscore_window=252))
add("truncation_check", "pair date:d leak:f leak_cut:f", f"SELECT pair, date, leak, leak_cut FROM (SELECT pair, date, round(lead(spot, 3) OVER {W}, 9) AS leak, CASE WHEN date < '1998-06-30' THEN round(lead(CASE WHEN date <= '1998-06-30' THEN spot END, 3) OVER {W}, 9) ELSE NULL END AS leak_cut FROM market) WHERE date <= '1998-06-30' AND leak IS DISTINCT FROM leak_cut")(lambda w: _truncated(w))


def _truncated(w: World) -> DataFrame:
    """All features, none of which looks ahead, and one that does: only its rows may come back."""
    leak = F.lead("spot", 3).over(series()).alias("leak")
    f = lambda m: ft.build(m).join(ft.build(m, None, ft.LEADING), ["pair", "date"]).join(m.select("pair", "date", leak), ["pair", "date"])
    return ft.truncation_gaps(f, w.market, "1998-06-30")


def _levels4(w: World) -> DataFrame:
    return scans.level_scan(w.market.select("pair", "date", "atm_1m"), "atm_1m", [9.5, 10.5, 11.0], 0.2)


def _with_package(w: World) -> DataFrame:
    """Trade days with a package that is nearly the risk reversal."""
    load = F.when(F.col("archetype") == "call_25d", 0.9).when(F.col("archetype") == "put_25d", -1.1).otherwise(0.05)
    keys = ["pair", "tenor_days", "entry_date", "age"]
    package = w.td.groupBy(*keys).agg(F.sum(load * F.col("pnl")).alias("pnl")).withColumn("archetype", F.lit("package"))
    return w.td.select(*keys, "pnl", "archetype").unionByName(package)


def _sparse(w: World) -> DataFrame:
    """Orders as trades of a line a day, which break most rules of a trade-day table."""
    li = w.spark.read.parquet(f"{w.sf_dir}/lineitem.parquet")
    o = w.spark.read.parquet(f"{w.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("entry_date"))
    order = Window.partitionBy("l_linestatus", "l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    t = li.join(o, "l_orderkey").withColumn("age", F.row_number().over(order) * 4)
    return t.select(F.col("l_orderkey").cast("string").alias("trade_id"), F.col("l_linestatus").alias("pair"), F.lit("line").alias("archetype"), F.lit(21).alias("tenor_days"), "entry_date", F.to_date("l_shipdate").alias("date"), "age", F.col("l_extendedprice").alias("pnl"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, n=name: answer(n, spark, sf_dir) for name in CATALOGUE}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in CATALOGUE.items() if sql}
