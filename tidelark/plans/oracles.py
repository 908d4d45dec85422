"""Named parts of the SQL that answers the catalogue's queries a second time."""

from __future__ import annotations

import re

_MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,{1}))) AS DOUBLE) / count({0})"


def _mean(x: str, scale: int = 2) -> str:
    return _MEAN.format(x, scale)


def bday(d: str) -> str:
    n = f"date_diff('day', DATE '1970-01-05', {d})"
    return f"(CAST(floor({n} / 7.0) AS BIGINT) * 5 + least({n} % 7, 5))"


W = "(PARTITION BY pair ORDER BY date)"


def win(n: int, lag: int = 0) -> str:
    return f"(PARTITION BY pair ORDER BY date ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


def roll(how: str, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {win(n, lag)} >= {n if least is None else least} THEN {how}({x}) OVER {win(n, lag)} END"


def roll2(how: str, x: str, y: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {win(n)} >= {n if least is None else least} THEN {how}({x}, {y}) OVER {win(n)} END"


def z(x: str, n: int, least: int | None = None) -> str:
    least = max(60, n // 4) if least is None else least
    return f"({x} - {roll('avg', x, n, least, 1)}) / nullif({roll('stddev_samp', x, n, least, 1)}, 0)"


def ranked(source: str, x: str, n: int, name: str, least: int | None = None) -> dict[str, str]:
    """Parts whose last, ``name``, has pair, date and x's trailing percentile rank as v."""
    least = max(20, n // 4) if least is None else least
    return {
        f"{name}_x": f"SELECT pair, date, row_number() OVER {W} AS i, round({x}, 9) AS x FROM {source}",
        f"{name}": f"""SELECT a.pair, a.date, CASE WHEN a.x IS NOT NULL AND count(b.x) >= {least} AND count(*) > 1
          THEN 100.0 * sum(CASE WHEN b.x < a.x THEN 1 ELSE 0 END) / CAST(count(*) - 1 AS DOUBLE) END AS v
          FROM {name}_x a JOIN {name}_x b ON a.pair = b.pair AND b.i BETWEEN a.i - {n - 1} AND a.i GROUP BY a.pair, a.date, a.x""",
    }


_ROLE = [("straddle_atm", 1, 0, 0, 0, -0.02), ("put_25d", 0.5, -2, -0.3, 0.2, -0.01), ("call_25d", 0.5, 2, 0.3, 0.2, -0.01)]
_A = ", ".join(f"('{r[0]}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in r[1:]) + ")" for r in _ROLE)
_D = ", ".join(f"round({c} - lag({c}) OVER {W} + 2.3e-9, 6) AS {n}" for c, n in (("atm_1m", "d_vol"), ("spot", "d_spot"), ("rr25_1m", "d_rr"), ("fly25_1m", "d_fly")))
G = "pair, archetype, tenor_days"
CELL = f"{G}, regime, h"
_P = f"OVER (PARTITION BY {G}, trade_id ORDER BY age)"
_BOTH = "CASE WHEN {0} THEN {1} END"
#: Weights of the Newey-West sum over lags, of residuals numbered within their cell.
PARTS: dict[str, str] = {
    "m0": f"""SELECT l_linestatus AS pair, CAST(l_shipdate AS DATE) AS date, round({_mean('l_extendedprice')} / 50000 + 2.3e-9, 6) AS spot,
        round(5 + 100 * ({_mean('l_discount', 4)}) + 2.3e-9, 6) AS atm_1m, round(5 + 100 * ({_mean('l_tax', 4)}) + 2.3e-9, 6) AS atm_1y,
        round(100 * ({_mean('l_tax', 4)} - {_mean('l_discount', 4)}) + 2.3e-9, 6) AS rr25_1m, round({_mean('l_quantity')} / 100 + 2.3e-9, 6) AS fly25_1m,
        {', '.join(f"round({_mean(f'CASE WHEN l_linenumber = {k} THEN l_extendedprice END')} / 50000 + 2.3e-9, 6) AS g10_{k}" for k in (1, 2, 3))}
        FROM lineitem GROUP BY 1, 2""",
    "m1": f"SELECT *, row_number() OVER {W} AS i, ln(spot / lag(spot) OVER {W}) AS r FROM m0",
    "market": f"""SELECT *, {', '.join(f"round(100 * sqrt(252.0) * ({roll('stddev_samp', 'r', n)}) + 2.3e-9, 6) AS {c}" for c, n in (('rv_1w', 5), ('rv_1m', 21), ('rv_3m', 63)))},
        ln(spot) AS ls, atm_1m - lag(atm_1m) OVER {W} AS dv FROM m1""",
    "days": f"SELECT pair, date, i, {_D} FROM market",
    "ages": "SELECT tenor_days, unnest(range(1, tenor_days + 1)) AS age FROM (SELECT 21 AS tenor_days)",
    "td0": f"""SELECT d.pair, a.archetype, k.tenor_days, e.date AS entry_date, d.date, k.age,
        round(a.vol * d.d_vol + 2.3e-9, 6) AS pnl_vol, round(a.spot * d.d_spot + 2.3e-9, 6) AS pnl_spot, round(a.rr * d.d_rr + 2.3e-9, 6) AS pnl_rr, round(a.fly * d.d_fly + 2.3e-9, 6) AS pnl_fly, a.theta AS pnl_theta
        FROM days d CROSS JOIN ages k JOIN market e ON e.pair = d.pair AND e.i = d.i - k.age
        CROSS JOIN (VALUES {_A}) a(archetype, vol, spot, rr, fly, theta) WHERE d.i > 1""",
    "td1": "SELECT *, round(pnl_vol + pnl_spot + pnl_rr + pnl_fly + pnl_theta + 2.3e-9, 6) AS pnl FROM td0",
    "td2": "SELECT *, round(1.4 * pnl + 2.3e-9, 6) AS pnl_trade, round(-0.3 * pnl + 2.3e-9, 6) AS pnl_delta_hedge FROM td1",
    "td": """SELECT *, concat_ws('-', pair, archetype, strftime(entry_date, '%Y-%m-%d')) AS trade_id, round(pnl - pnl_trade - pnl_delta_hedge + 2.3e-9, 6) AS pnl_vega_hedge,
        round(0.4 * sqrt((tenor_days + 1 - age) / CAST(tenor_days AS DOUBLE)) + 2.3e-9, 6) AS vega FROM td2""",
    "lab": "SELECT pair, date, CASE WHEN atm_1m < 9.5 THEN 'carry' WHEN atm_1m < 10.5 THEN 'agitated' ELSE 'stressed' END AS regime FROM market",
    "cum": f"""SELECT {G}, trade_id, entry_date, age AS h, cum_pnl, age = tenor_days AS to_expiry
        FROM (SELECT *, round(sum(pnl) {_P}, 9) AS cum_pnl FROM td) WHERE age IN (1, 3, 5, 10, 20) OR age = tenor_days""",
    "cl": "SELECT c.*, l.regime FROM cum c JOIN lab l ON l.pair = c.pair AND l.date = c.entry_date",
    "cells": f"SELECT {G}, trade_id, entry_date, h, cum_pnl, to_expiry, unnest(['ALL', regime]) AS regime FROM cl",
    "isl": f"SELECT *, sum(new) OVER {W} AS run FROM (SELECT *, CASE WHEN lag(regime) OVER {W} IS NOT DISTINCT FROM regime AND lag(date) OVER {W} IS NOT NULL THEN 0 ELSE 1 END AS new FROM lab)",
    "runs": "SELECT pair, run, regime, min(date) AS start, max(date) AS \"end\", count(*) AS days FROM isl GROUP BY ALL",
    "eps": "SELECT pair, regime, count(*) AS episodes FROM (SELECT pair, unnest(['ALL', regime]) AS regime FROM runs) GROUP BY ALL",
    "spacing": f"""SELECT {G}, coalesce(quantile_cont(gap, 0.5), 1.0) AS spacing FROM (SELECT {G}, {bday('entry_date')} - lag({bday('entry_date')}) OVER (PARTITION BY {G} ORDER BY entry_date) AS gap
        FROM (SELECT DISTINCT {G}, entry_date FROM cum)) GROUP BY ALL""",
    "stat": f"""SELECT {CELL}, bool_or(to_expiry) AS to_expiry, count(*) AS n, avg(cum_pnl) AS mean, avg(CASE WHEN cum_pnl > 0 THEN 1.0 ELSE 0.0 END) AS p_profit,
        quantile_cont(cum_pnl, 0.05) AS q05, quantile_cont(cum_pnl, 0.5) AS q50, quantile_cont(cum_pnl, 0.95) AS q95 FROM cells GROUP BY ALL""",
    "es": f"SELECT {CELL}, avg(c.cum_pnl) AS es05 FROM cells c JOIN stat s USING ({CELL}) WHERE round(c.cum_pnl, 9) <= round(s.q05, 9) GROUP BY ALL",
    "res": f"SELECT {CELL}, cum_pnl - avg(cum_pnl) OVER (PARTITION BY {CELL}) AS e, row_number() OVER (PARTITION BY {CELL} ORDER BY entry_date, trade_id) AS k, count(*) OVER (PARTITION BY {CELL}) AS n FROM cells",
    "hac": f"""SELECT {', '.join('a.' + c for c in CELL.split(', '))}, sqrt(greatest(sum(a.e * b.e * CASE WHEN a.k = b.k THEN 1.0 ELSE 2.0 * (1 - (a.k - b.k) / (least(a.h, a.n - 1) + 1.0)) END) / max(a.n), 0) / max(a.n)) AS se
        FROM res a JOIN res b ON {' AND '.join(f'a.{c} = b.{c}' for c in CELL.split(', '))} AND b.k BETWEEN a.k - least(a.h, a.n - 1) AND a.k WHERE a.n >= 2 GROUP BY ALL""",
    "lad": f"""SELECT s.*, e.es05, h.se, round_even(10 * (s.n * least(1.0, p.spacing / s.h)), 0) / 10 AS n_eff, coalesce(x.episodes, 0) AS episodes, s.mean - 1.6448536 * h.se AS ci_lo, s.mean + 1.6448536 * h.se AS ci_hi
        FROM stat s LEFT JOIN es e USING ({CELL}) LEFT JOIN hac h USING ({CELL}) JOIN spacing p USING ({G}) LEFT JOIN eps x USING (pair, regime)""",
    "cmb": """SELECT pair, tenor_days, entry_date, age, date, sum(CASE archetype WHEN 'call_25d' THEN pnl ELSE -pnl END) AS pnl FROM td WHERE archetype IN ('call_25d', 'put_25d') GROUP BY ALL HAVING count(DISTINCT archetype) = 2""",
    "ent": f"""SELECT {G}, entry_date, h, to_expiry, avg(pnl / scale) AS earn, avg(vol / scale) AS earn_vol, avg(theta / scale) AS earn_theta, count(DISTINCT trade_id) AS n_trades, avg(scale) AS vega0
        FROM (SELECT {G}, trade_id, entry_date, age AS h, age = tenor_days AS to_expiry, sum(pnl) {_P} AS pnl, sum(pnl_vol) {_P} AS vol, sum(pnl_theta) {_P} AS theta, first_value(abs(vega)) {_P} AS scale FROM td)
        WHERE h IN (1, 3, 5, 10, 20) OR to_expiry GROUP BY ALL""",
    "mask": "SELECT pair, date, coalesce(atm_1m > 10.2, false) AS \"on\" FROM market",
    "mruns": f"SELECT pair, count(*) AS runs FROM (SELECT *, lag(\"on\") OVER {W} AS was FROM mask) WHERE \"on\" AND was IS DISTINCT FROM true GROUP BY ALL",
    "tm": f"""SELECT s.pair, s.regime AS from_state, t.regime AS to_state, coalesce(c.n, 0) AS moves, 10.0 * CASE WHEN s.regime = t.regime THEN 0.95 ELSE (1 - 0.95) / greatest(1, count(*) OVER (PARTITION BY s.pair, s.regime) - 1) END AS prior
        FROM (SELECT DISTINCT pair, regime FROM lab) s JOIN (SELECT DISTINCT pair, regime FROM lab) t ON s.pair = t.pair
        LEFT JOIN (SELECT pair, a, b, count(*) AS n FROM (SELECT pair, regime AS a, lead(regime) OVER {W} AS b FROM lab) GROUP BY ALL) c ON c.pair = s.pair AND c.a = s.regime AND c.b = t.regime""",
    "mat": "SELECT pair, from_state, to_state, moves, (moves + prior) / sum(moves + prior) OVER (PARTITION BY pair, from_state) AS p FROM tm",
    "rank_of": "SELECT * FROM (VALUES ('carry', CAST(0 AS DOUBLE)), ('agitated', 1.5), ('stressed', 3.0)) r(regime, rk)",
    "chars": f"""SELECT pair, date, ({roll2('covar_samp', 'dv', 'r', 20)}) / nullif({roll('var_samp', 'r', 20)}, 0) AS spotvol_beta, {roll2('corr', 'dv', 'r', 20)} AS spotvol_corr, atm_1m - rv_1m AS vrp, atm_1m - atm_1y AS term_slope,
        rr25_1m AS rr_level, fly25_1m AS fly_level, {roll('stddev_samp', 'dv', 20)} AS volofvol, {roll('avg', 'j', 20)} AS jump_freq
        FROM (SELECT *, CASE WHEN coalesce(abs(r) > 2.5 * lag(sd) OVER {W}, false) THEN 1.0 ELSE 0.0 END AS j FROM (SELECT *, {roll('stddev_samp', 'r', 63)} AS sd FROM market))""",
    "ulong": "SELECT c.pair, c.date, c.characteristic, c.value, l.regime FROM (UNPIVOT chars ON spotvol_beta, spotvol_corr, vrp, term_slope, rr_level, fly_level, volofvol, jump_freq INTO NAME characteristic VALUE value) c JOIN lab l ON l.pair = c.pair AND l.date = c.date",
    "prof": "SELECT * FROM (SELECT pair, characteristic, regime, avg(value) AS state_mean FROM ulong GROUP BY ALL) JOIN (SELECT pair, characteristic, avg(value) AS all_mean, stddev_samp(value) AS all_sd FROM ulong GROUP BY ALL) USING (pair, characteristic)",
    "evts": "SELECT * FROM (VALUES (DATE '1996-03-09'), (DATE '1997-06-18'), (DATE '1999-11-03'), (DATE '2001-11-01'), (DATE '2030-01-01')) e(event)",
    "epos": "SELECT m.pair, e.event, min(m.i) AS pos FROM market m JOIN evts e ON m.date >= e.event GROUP BY ALL",
    "gapz": f"SELECT *, (ls - {roll('avg', 'ls', 120, 60, 1)}) / (atm_1m / 100 * sqrt(60.0 / 252)) AS gap_z FROM market",
    "sur": f"SELECT *, r / (lag(atm_1m) OVER {W} / 100 / sqrt(252.0)) AS surprise FROM market",
    "ent5": "SELECT e.*, m.\"on\" FROM ent e JOIN mask m ON m.pair = e.pair AND m.date = e.entry_date",
}
PARTS |= ranked("market", "atm_1m", 756, "p_vol") | ranked("market", "atm_1m - atm_1y", 756, "p_slope") | ranked("market", "rv_1m - atm_1m", 756, "p_vrp") | ranked("market", "rv_1w / nullif(rv_3m, 0)", 756, "p_rv")
PARTS |= {"rrz": f"SELECT pair, date, -((rr25_1m - {roll('avg', 'rr25_1m', 252, 60)}) / nullif({roll('stddev_samp', 'rr25_1m', 252, 60)}, 0)) AS z FROM market"} | ranked("rrz", "z", 252, "p_rr")
PARTS |= {"beta": f"SELECT pair, date, abs(({roll2('covar_samp', 'dv', 'r100', 63, 30)}) / nullif({roll('var_samp', 'r100', 63, 30)}, 0)) AS b FROM (SELECT *, 100 * r AS r100 FROM market)"} | ranked("beta", "b", 756, "p_beta")
PARTS |= ranked("gapz", "abs(gap_z)", 756, "p_gap")
PARTS |= ranked("market", "-(rv_1m / nullif(atm_1m, 0))", 756, "p_ca") | {"vov": f"SELECT pair, date, -({roll('stddev_samp', 'dv', 21)}) AS v FROM market"} | ranked("vov", "v", 756, "p_cb") | ranked("market", "atm_1y - atm_1m", 756, "p_cc")
PARTS |= {"comp": "SELECT a.pair, a.date, (a.v + b.v + c.v) / 3 AS v FROM p_ca a JOIN p_cb b USING (pair, date) JOIN p_cc c USING (pair, date)"}
PARTS |= {"jmp": f"SELECT pair, date, {roll('avg', 'j', 21)} AS j FROM (SELECT *, CASE WHEN coalesce(abs(surprise) > 2, false) THEN 1.0 ELSE 0.0 END AS j FROM sur)"} | ranked("jmp", "j", 756, "p_jump")
PARTS |= {"cpl": f"SELECT pair, date, abs(({roll2('corr', 'r', 'dv', 21)}) - ({roll2('corr', 'r', 'dv', 126)})) AS c FROM market"} | ranked("cpl", "c", 756, "p_cpl")
PARTS |= {
    "gr": f"SELECT pair, date, {', '.join(f'ln(g10_{k}) - ln(lag(g10_{k}) OVER {W}) AS a{k}' for k in (1, 2, 3))} FROM market",
    "coh": f"""SELECT pair, date, CASE WHEN count(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN 1 END) OVER {win(21)} = 21
        THEN ({roll2('corr', 'a2', 'a1', 21)} + {roll2('corr', 'a3', 'a1', 21)} + {roll2('corr', 'a3', 'a2', 21)}) / 3 END AS c FROM gr""".replace("CASE WHEN count(CASE WHEN a2", "CASE WHEN count(CASE WHEN a2"),
}
PARTS["coh"] = "SELECT pair, date, CASE WHEN full_ THEN (c1 + c2 + c3) / 3 END AS c FROM coh0"
PARTS["coh0"] = f"""SELECT pair, date, count(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN 1 END) OVER {win(21)} = 21 AS full_,
        {roll2('corr', 'a2', 'a1', 21)} AS c1, {roll2('corr', 'a3', 'a1', 21)} AS c2, {roll2('corr', 'a3', 'a2', 21)} AS c3 FROM gr"""


def with_parts(body: str, recursive: bool = False, more: dict[str, str] | None = None) -> str:
    """The query with the parts it names, and those that they name, in front."""
    own = PARTS | (more or {})
    order: list[str] = []

    def need(text: str, asked: str = "") -> None:
        for name in own:
            if name != asked and name not in order and re.search(rf"\b(FROM|JOIN|UNPIVOT)\s+{name}\b", text):
                need(own[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    head = ", ".join(f"{n} AS ({own[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body
