"""Finite-state scans along a series: a kernel walks over its ordered values once.

Series are independent groups, so they spread over the cluster by their keys; a worker holds
the values of one series at a time, some bytes a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.functions import kernels as kn

LEVELS = list(kn.LEVELS)


def scan(df: DataFrame, values: list[str], kernel: Callable[..., np.ndarray], out: str, kind: str = "string", keys: list[str] | None = None, order: str = "date") -> DataFrame:
    """keys, order and ``out``: what the kernel makes of the arrays of ``values``, of each series in order. Missing numbers are NaN."""
    keys = keys or ["pair"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, order]), f"{out} {kind}"])
    numbers = {c for c in values if kinds[c] != "string"}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        got = kernel(*(g[c].to_numpy(float) if c in numbers else g[c].to_numpy(object) for c in values))
        return g[[*keys, order]].assign(**{out: got})

    found = df.select(*keys, order, *values).groupBy(*keys).applyInPandas(run, schema)
    return found.withColumn(out, F.nanvl(out, F.lit(None))) if kind == "double" else found


def level_scan(df: DataFrame, x: str, bounds: list[float], delta: float, names: list[str] | None = None, out: str = "level") -> DataFrame:
    """Bands with hysteresis: up while x exceeds the bound above by delta, then down while it is below the one under by delta."""
    named = np.array(names or LEVELS, object)
    return scan(df, [x], lambda v: named[kn.levels(v, tuple(bounds), delta)], out)


def direction_scan(df: DataFrame, x: str, down: float, up: float, delta: float, out: str = "direction") -> DataFrame:
    """down, flat, up with hysteresis; from down to flat and on to up may be one day, from up only to flat."""
    named = np.array(kn.DIRECTIONS, object)
    return scan(df, [x], lambda v: named[kn.directions(v, down, up, delta) + 1], out)


def threshold_labels(df: DataFrame, x: str, lower: float, upper: float, delta: float = 0.0, out: str = "regime") -> DataFrame:
    """The three states of levels alone: carry, transition, crisis."""
    return level_scan(df, x, [lower, upper], delta, list(kn.THREE_STATES[:3]), out)


def state_scan(df: DataFrame, level: str = "level", direction: str = "direction", out: str = "regime") -> DataFrame:
    """The states of named levels and directions, from carry on."""
    place = lambda names, x, least: np.array([names.index(v) + least for v in x], np.int64)
    return scan(df, [level, direction], lambda a, b: kn.walk(place(kn.LEVELS, a, 0), place(kn.DIRECTIONS, b, -1)), out)


def ewma_scan(df: DataFrame, x: str, halflife: float, out: str = "ewma") -> DataFrame:
    """Exponential mean; a gap of g rows gives the old mean the weight it would have faded to, and gaps repeat the mean."""
    return scan(df, [x], lambda v: kn.ewma(v, halflife), out, "double")


def cusum_scan(df: DataFrame, x2: str, mu: str, k: float, h: float, out: str = "cusum") -> DataFrame:
    """S = max(0, S + x2 - mu - k), told before it restarts beyond h; a null repeats what S was."""
    return scan(df, [x2, mu], lambda a, b: kn.cusum_between(a, b, k, h), out, "double")
