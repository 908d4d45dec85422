"""Exact similarity of texts by their sets of word shingles, within groups of candidates.

A group's shingles are numbered from the rarest, so that two texts of Jaccard similarity s share
one of the first n - ceil(s n) + 1 shingles of either: only texts that meet there are compared,
and none that are joined already.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.llm._common import release, stored

WORDS, LEAST = 5, Fraction(4, 5)
MOST, ASK = 2048, 512


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different word shingles; a text of fewer words is one shingle, without a word none."""
    w = text.encode().lower().split()
    k = min(words, len(w))
    cut = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(0)), np.uint64, len(cut)))


def similar_groups(sets: list[np.ndarray], least: Fraction = LEAST, joined: list[int] | None = None) -> np.ndarray:
    """The smallest index that each set reaches by pairs of Jaccard similarity ``least`` or more; empty sets are alike. joined: sets known to be of one group."""
    parent = list(range(len(sets)))
    for i in joined or []:
        parent[i] = min(joined)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    _, at, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum([len(s) for s in sets])
    own = [np.sort(rank[at[b - len(s) : b]]) for s, b in zip(sets, ends, strict=True)]
    met: dict[int, dict[int, list[int]]] = {}  # shingle, root when it was met, texts
    empty = None
    for i in sorted(range(len(own)), key=lambda i: len(own[i])):
        n = len(own[i])
        if not n:
            empty = i if empty is None else empty
            parent[root(max(i, empty))] = root(min(i, empty))
            continue
        tried: set[int] = set()
        for x in own[i][: n + (-n * least.numerator // least.denominator) + 1].tolist():
            here = met.setdefault(x, {})
            for r, members in here.items():
                if root(r) == root(i):
                    continue
                for j in members:
                    if j in tried or len(own[j]) * least.denominator < n * least.numerator:
                        continue
                    tried.add(j)
                    both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    if both * least.denominator >= (n + len(own[j]) - both) * least.numerator:
                        a, b = root(i), root(j)
                        parent[max(a, b)] = min(a, b)
                        break
            here.setdefault(root(i), []).append(i)
    return np.fromiter((root(i) for i in range(len(own))), np.int64, len(own))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """root, node, size and set (sorted hashes of the word shingles) of each row; texts: root, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(2)]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = pa.array(np.concatenate(sets))
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), own], names=["root", "node", "size", "set"])
        release()

    return texts.select("root", "node", "text").mapInArrow(run, "root long, node long, size long, set array<long>")


def _alike(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return LEAST.denominator * both >= LEAST.numerator * (F.size(a) + F.size(b) - both)


def _sets(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _edges(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    hung = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung], pa.int64()), pa.array(nodes[label[hung]], pa.int64())], names=["a", "b"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of whole groups, which follow each other."""
    now, nodes, sets = None, [], []
    for b in batches:
        for r, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _sets(b.column(2)), strict=True):
            if r != now and nodes:
                yield _edges(np.array(nodes, np.int64), similar_groups(sets))
                nodes, sets = [], []
            now = r
            nodes.append(n)
            sets.append(s)
    if nodes:
        yield _edges(np.array(nodes, np.int64), similar_groups(sets))
    release()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between a block of asking texts and a block of a group; each row holds both. Texts marked like are one part."""
    for b in batches:
        for r in b.to_pylist():
            own = {x["node"]: x for x in [*r["asks"], *r["block"]]}
            sets = [np.sort(np.array(x["set"], np.int64).view(np.uint64)) for x in own.values()]
            yield _edges(np.array(list(own), np.int64), similar_groups(sets, joined=[i for i, x in enumerate(own.values()) if x["like"]]))
    release()


def similar_edges(sets: DataFrame, most: int = MOST, ask: int = ASK) -> DataFrame:
    """Edges a, b that join, within each group of candidates, all texts that chain by similar pairs.

    sets: root (the group), node (one row each), size, set. A group of at most ``most`` texts
    (and 1,000 shingles to a text) is worked on in one task. In a larger one every text is held
    against one text first, then against seven that are like it; all texts so joined are one
    part, so only what is left has to be asked for in the whole group: blocks of ``ask``
    such texts meet blocks of ``most`` texts, each pair of blocks by itself.
    """
    total = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).withColumn("_blocks", F.ceil(F.greatest(F.col("n") / most, F.col("shingles") / (1000 * most))).cast("long"))
    large = stored(total.where("_blocks > 1"), "large-groups")
    if large.isEmpty():
        return sets.select("root", "node", "set").repartition("root").sortWithinPartitions("root").mapInArrow(_within, "a long, b long")
    told = stored(sets.join(large.select("root", "_blocks"), "root", "left"), "group-sizes")
    few = told.where("_blocks is null").select("root", "node", "set").repartition("root").sortWithinPartitions("root").mapInArrow(_within, "a long, b long")
    many = told.where("_blocks is not null")

    first = many.groupBy("root").agg(F.min(F.struct("node", "set")).alias("r")).select("root", F.col("r.node").alias("rep"), F.col("r.set").alias("rep_set"))
    held = stored(many.join(first, "root").withColumn("like", _alike(F.col("set"), F.col("rep_set"))).drop("rep_set"), "group-first")
    nearest = held.where("like and node <> rep").select("root", "node", "set", F.xxhash64("node").alias("h"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("h", "node"))
    seven = nearest.withColumn("k", rank).where("k <= 7").groupBy("root").agg(F.collect_list("set").alias("sets"))
    again = held.where("not like").join(seven, "root", "left").withColumn("like", F.coalesce(F.exists("sets", lambda x: _alike(F.col("set"), x)), F.lit(False))).drop("sets")
    again = stored(again, "group-again")
    joined = held.where("like and node <> rep").unionByName(again.where("like")).select(F.col("node").alias("a"), F.col("rep").alias("b"))

    left = again.where("not like")
    asks = left.join(left.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / ask).cast("long").alias("_asks")), "root")
    asks = asks.groupBy("root", F.expr("pmod(xxhash64(node), _asks)").alias("q")).agg(F.first("_asks").alias("_asks"), F.collect_list(F.struct("node", "set", "like")).alias("asks"))
    marked = held.where("like").select(*again.columns).unionByName(again)
    blocks = marked.groupBy("root", F.expr("pmod(xxhash64(node), _blocks)").alias("d")).agg(F.collect_list(F.struct("node", "set", "like")).alias("block"))
    each = blocks.join(asks.groupBy("root").agg(F.max("_asks").alias("_asks")), "root").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).drop("_asks")
    met = each.join(asks.select("root", "q", "asks"), ["root", "q"]).select("asks", "block").mapInArrow(_across, "a long, b long")
    return few.unionByName(joined).unionByName(met)
