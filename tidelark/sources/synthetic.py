"""Synthetic worlds whose truth is known: markets with hidden states, trades that pay by state, scenarios.

Each world is a group, made by one worker from its seed alone; nothing is made by the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.functions import kernels as kn
from tidelark.operators import evaluate as ev
from tidelark.operators import ladder as ld

STATES = ("carry", "agitated", "stressed")
#: Daily probabilities of the hidden states, their implied vol, and what a day pays in each.
MATRIX = np.array([[0.95, 0.04, 0.01], [0.06, 0.88, 0.06], [0.02, 0.13, 0.85]])
VOL, PAY, NOISE = (7.0, 10.0, 15.0), (0.06, -0.02, -0.15), 0.25
_MARKET = "world int, pair string, date date, i int, state string, energy double, leader double, spot double, atm_1m double, atm_1y double, rr25_1m double, fly25_1m double, rv_1w double, rv_1m double, rv_3m double"


def _market(world: int, days: int, beta: float, lead: int) -> pd.DataFrame:
    """A market whose moves between states are tilted by an energy that it stores and releases; leader tells of that ``lead`` days before."""
    rng = np.random.default_rng([11, world])
    energy = np.zeros(days + lead)
    for t in range(1, len(energy)):
        energy[t] = 0.98 * energy[t - 1] + 0.2 * rng.standard_normal()
    rank = np.arange(len(STATES), dtype=float)
    s = kn.tilted_chain(MATRIX, rank, energy[lead:], beta, seed=world + 1000)
    vol = np.array(VOL)[s]
    ret = vol / 100 / 252**0.5 * rng.standard_normal(days)
    real = lambda n: (100 * 252**0.5 * pd.Series(ret).rolling(n).std()).to_numpy()
    atm = kn.ewma(vol, 3.0) + 0.2 * rng.standard_normal(days)
    dates = pd.bdate_range("2015-01-01", periods=days).date
    cols = {"energy": energy[lead:], "leader": energy[:days] + 0.5 * rng.standard_normal(days), "spot": 1.1 * np.exp(np.cumsum(ret)), "atm_1m": atm, "atm_1y": 0.6 * kn.ewma(vol, 60.0) + 4}
    cols |= {"rr25_1m": -0.1 * atm + 0.1 * rng.standard_normal(days), "fly25_1m": 0.02 * atm, "rv_1w": real(5), "rv_1m": real(21), "rv_3m": real(63)}
    return pd.DataFrame({"world": world, "pair": f"W{world}", "date": dates, "i": np.arange(1, days + 1), "state": np.array(STATES)[s], **cols})


def markets(spark: SparkSession, worlds: int = 4, days: int = 2520, beta: float = 0.0, lead: int = 0) -> DataFrame:
    """Daily markets, one for each world, with their hidden states."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return _market(int(g["id"].iloc[0]), days, beta, lead)

    out = spark.range(worlds).groupBy("id").applyInPandas(run, _MARKET)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("rv_1w", "rv_1m", "rv_3m")})


def trades(m: DataFrame, tenor: int = 21, decay: float = 4.0, slope: float = 0.1, seed: int = 0) -> DataFrame:
    """A trade entered each day and held for its tenor; a day pays by the hidden state, by theta that grows to expiry, and by noise of its own."""
    pay = F.element_at(F.create_map(*(F.lit(x) for kv in zip(STATES, PAY, strict=True) for x in kv)), F.col("state"))
    held = m.select("world", "pair", "date", "i", "state").withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(tenor)))).withColumn("e", F.col("i") - F.col("age"))
    td = held.join(m.select("world", F.col("i").alias("e"), F.col("date").alias("entry_date")), ["world", "e"])
    u = lambda k: (F.pmod(F.xxhash64("world", "date", F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))  # one draw a day, shared by the trades of that day
    pnl = pay + slope * F.exp(-(tenor - F.col("age")) / decay) + NOISE * noise
    tid = F.concat_ws("-", "pair", F.date_format("entry_date", "yyyy-MM-dd"))
    return td.select("world", tid.alias("trade_id"), "pair", F.lit("world").alias("archetype"), F.lit(tenor).alias("tenor_days"), "entry_date", "date", "age", pnl.alias("pnl"))


def truth(spark: SparkSession, horizons: tuple[int, ...] = ld.HORIZONS, tenor: int = 21, decay: float = 4.0, slope: float = 0.1) -> DataFrame:
    """What a unit entered in each state earns on average up to each horizon, by powers of the matrix."""
    rows, p, run = [], np.eye(len(STATES)), np.zeros(len(STATES))
    for h in range(1, tenor + 1):
        p = p @ MATRIX
        run = run + p @ np.array(PAY) + slope * np.exp(-(tenor - h) / decay)
        rows += [("world", s, h, float(v)) for s, v in zip(STATES, run, strict=True) if h in (*horizons, tenor)]
    return spark.createDataFrame(rows, "archetype string, regime string, h int, true_ev double")


def interval_coverage(spark: SparkSession, worlds: int = 8, days: int = 2520, boot: bool = False) -> DataFrame:
    """How often the ladder's intervals hold the truth when the labels are the true states; a row for each world."""
    m = markets(spark, worlds, days).persist()
    lab = m.select("pair", "date", F.col("state").alias("regime"))
    cum = ld.attach_entry_labels(ld.cumulative(trades(m)), lab).persist()
    lad = ld.ladder(cum, lab, ld.boot_se(cum, lab) if boot else None)
    return ev.coverage(lad.withColumn("world", F.substring("pair", 2, 9).cast("int")), truth(spark))


def calm_then_shift(spark: SparkSession, calm: int = 250, shift: int = 60, iv: float = 8.0, seed: int = 0) -> DataFrame:
    """A calm path with three isolated large days, then realised vol half as much again as implied without one: a case for the shock detectors."""
    rng = np.random.default_rng(seed)
    z = np.concatenate([rng.normal(0, 0.8, calm), np.clip(rng.normal(0, 1.5, shift), -2.9, 2.9)])
    for i in (60, 140, 210):
        z[i] = 3.4 if rng.random() < 0.5 else -3.4
    spot = 1.1 * np.exp(np.cumsum(z * iv / 100 / 252**0.5))
    rows = [("p", d, float(x), iv) for d, x in zip(pd.bdate_range("2020-01-01", periods=len(z)).date, spot, strict=True)]
    return spark.createDataFrame(rows, "pair string, date date, spot double, atm_1m double")


def external_series(m: DataFrame, lead: int = 10, noise: float = 0.5, seed: int = 3) -> DataFrame:
    """A series that tells the energy ``lead`` days before it acts, with noise: what a leading candidate should look like."""
    w = Window.partitionBy("pair").orderBy("date")
    u = lambda k: (F.pmod(F.xxhash64("pair", "date", F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return m.select("pair", "date", (F.lead("energy", lead).over(w) + noise * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))).alias("external"))
