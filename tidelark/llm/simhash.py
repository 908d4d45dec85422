"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on some two of ``radius + 2`` blocks
of bits, so only fingerprints under one such key are compared. There the bits are stored
vertically: plane b holds bit b of 64 fingerprints to a machine word. A lag d compares every
fingerprint with the d-th after it at once: planes are XORed with themselves moved by d
lanes, the differing bits are summed by carry-save adders into a few counter planes, and a
word whose lanes have all passed the radius is abandoned. Keys under which very many
fingerprints meet are refined by the bits that the key leaves open, again and again.

``near_copies`` serves similarity of word shingles instead of a radius: texts of similarity 0.8
differ in some ten of 64 bits, which blocks of bits cannot propose in a large corpus. There the
keys are bands of least shingle hashes, whose number of chance meetings does not grow with
the square of the corpus, and the bit-sliced comparison under a wide radius thins out what
meets; an exact comparison of the shingles follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm._common import drop_since, last_made, made, release, stored, texts
from tidelark.llm.similar import shingle_set, shingle_sets, similar_edges

BITS, RADIUS, SHINGLE, SEED, HOT = 64, 3, 3, 42, 20_000
#: Of near copies: a pair of similarity 0.8 shares one of 14 bands of 5 least hashes with probability
#: 0.996 and differs in more than 24 bits with probability below 1e-5.
BANDS, BAND_ROWS, WIDE = 14, 5, 24
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    cut = [joined[a:b] for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        release()

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _add(counters: list[np.ndarray], level: int, x: np.ndarray) -> None:
    """Add plane x of weight 2 ** level; the last counter only remembers an overflow."""
    while level < len(counters) - 1:
        counters[level], x = counters[level] ^ x, counters[level] & x
        level += 1
    counters[-1] = counters[-1] | x


def _lag(planes: np.ndarray, valid: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Lanes i, as bits, where fingerprints i and i + d differ in at most radius bits."""
    q, s = divmod(d, 64)
    n = len(valid)
    at = np.arange(n)
    near = np.zeros(n, np.uint64)
    bits = radius.bit_length()
    ahead = (1 << bits) - 1 - radius  # counters start here, so that they overflow just beyond the radius
    counters = [np.full(n, _FULL if ahead >> i & 1 else 0, np.uint64) for i in range(bits)] + [~valid]

    def differ(b: int) -> np.ndarray:
        p = planes[b]
        moved = p[at + q] >> np.uint64(s)
        if s:
            moved = moved | (p[at + q + 1] << np.uint64(64 - s))
        return p[at] ^ moved

    for b in range(0, BITS, 3):
        if b + 2 < BITS:
            x, y, z = differ(b), differ(b + 1), differ(b + 2)
            _add(counters, 0, x ^ y ^ z)
            _add(counters, 1, (x & y) | (z & (x ^ y)))
        else:
            for i in range(b, BITS):
                _add(counters, 0, differ(i))
        if b % 6 == 3 and len(at):
            live = counters[-1] != _FULL
            if not live.all():
                at = at[live]
                counters = [c[live] for c in counters]
        if not len(at):
            return near
    near[at] = ~counters[-1]
    return near


def near_places(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints of equal keys (given in order of keys): a spanning forest of all pairs within the radius."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length, start = np.diff(edges), edges[:-1]
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 1]
    length, start = length[order], start[order]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.cumsum(length)
    take = np.repeat(start - (stop - length), length) + np.arange(stop[-1])
    own = fps[take].view(np.uint64)
    n = len(own)
    room = int(length[0]) // 64 + 2
    flat = np.packbits(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8 + 8 * room)))).view(np.uint64)
    left = np.repeat(stop, length) - np.arange(n)  # lanes up to the end of the run, itself included
    label = np.arange(n)
    for d in range(1, int(length[0])):
        runs = int(np.searchsorted(-length, -d, side="left"))  # runs longer than d stand first
        m = int(stop[runs - 1])
        valid = np.packbits(left[:m] > d, bitorder="little")
        valid = np.pad(valid, (0, -len(valid) % 8)).view(np.uint64)
        lanes = np.flatnonzero(np.unpackbits(_lag(planes, valid, d, radius).view(np.uint8), bitorder="little"))
        lanes = lanes[label[lanes] != label[lanes + d]]
        if len(lanes):
            _join(label, lanes, lanes + d)
    hung = np.flatnonzero(label != np.arange(n))
    return take[hung], take[label[hung]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that a and b link the least label among them, in place; a label names a place that has itself."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]
        more = label[a] != label[b]
        a, b = a[more], b[more]


def near_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The linked fingerprints themselves."""
    a, b = near_places(keys, fps, radius)
    return fps[a], fps[b]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits) - (1 << 64) * (63 in bits)


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def first_masks(radius: int) -> list[int]:
    """Bit masks of the keys: each two of radius + 2 blocks."""
    return [_mask(sum(two, [])) for two in combinations(_cut(list(range(BITS)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 blocks of the bits that it leaves open; itself where there are too few."""
    key = [b for b in range(BITS) if mask >> b & 1]
    rest = [b for b in range(BITS) if b not in key]
    return [_mask(key + part) for part in _cut(rest, radius + 1)] if len(rest) > radius else [mask]


def _keyed(nodes: DataFrame, radius: int) -> DataFrame:
    """mask, key, fp: the keys of each fingerprint; a key of more than HOT fingerprints is refined until it has fewer."""
    key = lambda m: F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
    masks = first_masks(radius)
    now = nodes.select("fp", F.explode(F.array(*map(key, masks))).alias("k")).select("k.mask", "k.key", "fp")
    done = None
    while True:
        hot = stored(now.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("mask", "key"), "hot-keys")
        own = [r["mask"] for r in hot.select("mask").distinct().collect()]  # masks of one level: bounded by the radius and the level
        finer = {m: finer_masks(m, radius) for m in own}
        if all(f == [m] for m, f in finer.items()):
            return now if done is None else done.unionByName(now)
        told = stored(now.join(hot.withColumn("hot", F.lit(True)), ["mask", "key"], "left"), "told-keys")
        cold = told.where("hot is null").drop("hot")
        done = cold if done is None else done.unionByName(cold)
        parts = [told.where(F.col("hot") & (F.col("mask") == m)).select("fp", F.explode(F.array(*map(key, f))).alias("k")) for m, f in finer.items()]
        now = reduce(DataFrame.unionByName, parts).select("k.mask", "k.key", "fp").distinct()


def _links(keyed: DataFrame, radius: int, most: int = 1 << 18) -> DataFrame:
    """Edges a, b among rows of one key whose fingerprints are within the radius; keyed: t, key, fp and, if they name the edges, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(t_key: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            a, b = near_places(t_key, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t, key, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((key * np.int64(0x2545F4914F6CDD1D) ^ t, rest[0], rest[-1]))
            if sum(len(x[0]) for x in held) >= most:
                keys, fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
                held = [(keys[whole:], fps[whole:], nodes[whole:])]
                if whole:
                    yield out(keys[:whole], fps[:whole], nodes[:whole])
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        release()

    t = keyed.columns[0]
    return keyed.repartition(t, "key").sortWithinPartitions(t, "key", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of an edge, by alternating large and small stars."""
    now, seen = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    spark = edges.sparkSession
    while True:
        before = made() - 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        now = stored(small, "edges")
        told = tuple(now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(20)))")).first())
        drop_since(spark, before, keep=last_made())
        if told == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = told


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Groups of documents whose fingerprints chain by links of at most ``radius`` bits.

    docs: doc_id, text; other columns are left aside. Texts without a word (null ones too)
    have fingerprint zero and link like any other; texts of fewer than ``shingle`` words are
    one shingle; rows of one doc_id are one document of several texts; an empty table gives
    an empty result.

    Returns doc_id, fp (signed), component_id (smallest doc_id reachable).
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    edges = _links(_keyed(nodes, radius), radius)
    found = components(edges)
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _bands(h: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Keys of a set of 64-bit hashes: of each band the hash of ``rows`` least hashes under fixed multipliers."""
    rng = np.random.default_rng(SEED)
    odd, flip = rng.integers(0, 1 << 63, (2, bands * rows), np.uint64)
    odd = odd << np.uint64(1) | np.uint64(1)
    least = np.full(bands * rows, _FULL)
    for i in range(0, len(h), 1 << 12):
        x = (h[i : i + (1 << 12), None] ^ flip) * odd
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for r in least.reshape(bands, rows).T:
        key = (key ^ r) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def sketches(nodes: DataFrame) -> DataFrame:
    """node, fp and band keys of each row; nodes: node, text. Texts without a word share all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = np.zeros(b.num_rows, np.uint64), np.empty((b.num_rows, BANDS), np.uint64)
            for i, t in enumerate(b.column(1)):
                h = shingle_set(t.as_py())
                ones = np.zeros(BITS, np.int64)
                for k in range(0, len(h), 1 << 14):
                    ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fps[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
                keys[i] = _bands(h)
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), own], names=["node", "fp", "keys"])
        release()

    return nodes.select("node", "text").mapInArrow(run, "node long, fp long, keys array<long>")


def near_copies(nodes: DataFrame) -> DataFrame:
    """Groups of texts that chain by pairs sharing 0.8 of their five-word shingles.

    nodes: node (a long that names a text), text; rows of one node must have equal texts and
    are one; no null. Texts that share a band key and whose fingerprints lie within WIDE
    bits are compared exactly. Under a key of more than HOT texts all are proposed, without the
    comparison of bits. Returns node, root (a node of its group) for the nodes that are linked to
    another one; an empty table gives an empty result.
    """
    told = stored(sketches(nodes).groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-sketches")
    keyed = told.select("node", "fp", F.posexplode("keys").alias("t", "key")).select(F.col("t").cast("long").alias("t"), "key", "fp", "node")
    hot = stored(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where(F.col("n") > HOT).select("t", "key", "least"), "near-hot")
    if hot.isEmpty():
        edges = _links(keyed, WIDE)
    else:
        both = stored(keyed.join(hot, ["t", "key"], "left"), "near-keyed")
        star = both.where("least is not null").select(F.col("node").alias("a"), F.col("least").alias("b"))
        edges = _links(both.where("least is null").drop("least"), WIDE).unionByName(star)
    proposed = components(edges)
    both = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root")).distinct()
    sets = stored(shingle_sets(nodes.dropDuplicates(["node"]).join(both, "node")), "near-sets")
    return components(similar_edges(sets))
