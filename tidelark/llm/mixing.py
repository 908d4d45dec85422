"""Mixing sources to target weights by the cube method.

A document of a source whose target is r times its size is taken floor(r) times for sure and
once more with probability r - floor(r). Which documents get the extra copy is drawn by the
cube method: the vector of probabilities walks in the null space of the balancing equations
(words and documents of the source), so both totals stay as they are, until all but a few
documents are decided. Blocks of documents walk independently, largest documents first; what
each leaves open (two documents at most) walks again in blocks of the next level, until one
block of each source is left. Only its last two documents land: first the number of documents
is given up while the words stay, then the last one is drawn by its probability. So every
document, however large, keeps its inclusion probability, and a source's words miss the target
by less than one document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelark.llm._common import prefix_sums, stored, word_count

BLOCK, FEW_SOURCES = 4096, 10_000
_EPS = 1e-9


def _step(p: list[float], u: list[float], draw: float) -> list[float]:
    """One move along u or against it, as far as the unit cube lets it, without changing the mean."""
    ahead = min((1 - x) / d if d > 0 else -x / d for x, d in zip(p, u, strict=True) if d)
    back = min(x / d if d > 0 else (x - 1) / d for x, d in zip(p, u, strict=True) if d)
    by = ahead if draw * (ahead + back) < back else -back
    return [min(1.0, max(0.0, x + by * d)) for x, d in zip(p, u, strict=True)]


def cube_flight(sizes: np.ndarray, probs: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities after the flight: all but two are 0 or 1, and the sums of p and p * size are kept.

    land: the last two give up the number of documents, then the last one is drawn by its probability.
    """
    p = probs.astype(float).tolist()
    s = sizes.astype(float).tolist()
    open_: list[int] = []
    decided = lambda x: x <= _EPS or x >= 1 - _EPS
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for i in range(len(p)):
        if decided(p[i]):
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) == 3:
            a, b, c = (s[j] for j in open_)
            u = [b - c, c - a, a - b]
            big = max(map(abs, u))
            u = [x / big for x in u] if big else [1.0, -1.0, 0.0]
            for j, x in zip(open_, _step([p[j] for j in open_], u, next(draws)), strict=True):
                p[j] = float(round(x)) if decided(x) else x
            open_ = [j for j in open_ if not decided(p[j])]
    if land and len(open_) == 2:
        a, b = (s[j] for j in open_)
        big = max(a, b)
        for j, x in zip(open_, _step([p[j] for j in open_], [b / big, -a / big] if big else [1.0, -1.0], next(draws)), strict=True):
            p[j] = float(round(x)) if decided(x) else x
        open_ = [j for j in open_ if not decided(p[j])]
    if land:
        for j in open_:
            p[j] = float(next(draws) < p[j])
    return np.array(p)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources; sizes: source, source_size. Adds _rank (by code point, null last) and target.

    Weights repeat over the ranks and share the whole size. Where a target would exceed
    ``most`` times its source it stops there, and the others share the rest by weight. The
    share per weight is the one at which all is given out: with sources in order of
    most * size / weight, the first sources stop and the rest take tau = left / weight left.
    Both orders are distributed running sums, so that there may be many sources.
    """
    own = sizes.select("source", "source_size", F.col("source").isNull().alias("_null"))
    ranked = prefix_sums(own, ["_null", "source"], [], "mix-ranks").select("source", "source_size", F.col("_n").alias("_rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    t = ranked.withColumns({"w": weight, "cap": F.col("source_size") * most}).withColumn("_r", F.col("cap") / F.col("w"))
    t = stored(prefix_sums(t, ["_r", "_rank"], ["w", "cap"], "mix-caps"), "mix-capped")
    total = t.agg(F.sum("w").alias("w"), F.sum(F.col("source_size").cast("double")).alias("size")).first()
    tau = (F.lit(total["size"]) - F.col("_cap")) / (F.lit(total["w"]) - F.col("_w"))
    share = t.select(tau.alias("tau"), "_r").where("tau <= _r").agg(F.max("tau")).first()[0]
    return t.select("source", "source_size", "_rank", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(share).cast("double")).alias("target"))


def _flight(seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")  # the last ones, still open, are small
        rng = np.random.default_rng([seed, *(int(x) for x in key)])
        rows["p"] = cube_flight(rows["size"].to_numpy(), rows["p"].to_numpy(), rng, land=bool(rows["blocks"].iloc[0] == 1))
        return rows

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """How often the mix takes each document, so that each source comes near its target.

    docs: doc_id, text, source; other columns are left aside. Size is the number of words
    (null: 0). A document without words is never taken; null is a source of its own; each
    repeated row is drawn by itself; an empty table gives an empty result. Reruns agree:
    draws depend on the source's rank, the block and the seed alone.

    Returns doc_id, source, size, source_size, target, copies.
    """
    base = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    totals = stored(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    few = totals.count() <= FEW_SOURCES
    if few:
        totals = F.broadcast(totals)
    rows = base.join(totals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keep = ["doc_id", "source", "size", "source_size", "target", "_rank", "sure", "p"]

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    r = F.when(F.col("size") > 0, rate).otherwise(0.0)
    rows = rows.withColumns({"sure": F.floor(r).cast("int"), "p": r - F.floor(r)}).select(*keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("blocks", T.LongType()), T.StructField("_block", T.LongType())])
    done, level, open_ = [rows.where("p <= 0")], 0, rows.where("p > 0")
    while True:
        counts = open_.groupBy("_rank").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
        most_blocks = counts.agg(F.max("blocks")).first()[0]
        if most_blocks is None:
            break
        dealt = open_.join(F.broadcast(counts) if few else counts, "_rank")
        dealt = dealt.withColumn("_block", F.expr(f"pmod(xxhash64(doc_id, size, {seed + level}), blocks)"))
        flown = stored(dealt.select(*keep, "blocks", "_block").groupBy("_rank", "_block").applyInPandas(_flight(seed + level), schema), "mix-flight").select(*keep)
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(fixed))
        if most_blocks == 1:
            break
        open_, level = flown.where(~fixed), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("sure") + F.col("p").cast("int")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))
