"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), v the token before (the end token
before the first). The weights l depend on the bucket of c(v), the number of binary digits of
it. They are learned by expectation-maximisation on held-out counts: each training token is
predicted from the counts of all others, that is with its own occurrence deleted. What EM
needs is how often each pair of deleted estimates comes in each bucket; the estimates are
binned to quarters of an octave, which bounds that table whatever the corpus.

Counts are of all training documents. Words and pairs travel as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm._chunks import CHUNK, FAN, SENT, answer, bucket_bits, chunk_table, hop_bits, send, squeeze, unsqueeze, with_replies
from tidelark.llm._common import stored

FOLDS, HELD_OUT, EM_STEPS, BINS = 7, 2, 60, 160
_ZERO = BINS - 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


class _Places(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class ChunkTokens:
    """Tokens of a chunk: word and pair keys of each, and which of them train."""

    def __init__(self, ids: list[int | None], lengths: list[int], body: bytes) -> None:
        raw = zstandard.decompress(body) if body else b""
        place = _Places()
        end = place[b""]
        parts, at = [], 0
        for n in lengths:
            words = raw[at : at + n].lower().split()
            own = np.empty(len(words) + 1, np.int64)
            own[:-1] = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            own[-1] = end
            parts.append(own)
            at += n
        self.n = np.array([len(p) for p in parts], np.int64)
        self.word = np.concatenate(parts)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
        self.starts = np.cumsum(self.n) - self.n
        before = np.concatenate([[end], self.word[:-1]])
        before[self.starts] = end
        pair = _mix(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + _mix(hashes[self.word]))
        one = np.uint64(1)
        self.word_keys = hashes & ~one  # words are even, pairs are odd
        self.pairs, self.pair_of = np.unique(pair | one, return_inverse=True)
        self.trains = np.repeat([not held_out(d) for d in ids], self.n)
        keys = np.concatenate([self.word_keys, self.pairs])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> np.ndarray:
        """Training counts in the order of ``keys``."""
        c1 = np.bincount(self.word[self.trains], minlength=len(self.word_keys))
        c2 = np.bincount(self.pair_of[self.trains], minlength=len(self.pairs))
        return np.concatenate([c1, c2])[self.order]

    def token_counts(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(w) and c(v w) of each token, from totals in the order of ``keys``."""
        back = np.empty(len(totals), np.int64)
        back[self.order] = totals
        return back[: len(self.word_keys)][self.word], back[len(self.word_keys) :][self.pair_of]


def _fold(n: int, groups: np.ndarray, info: np.ndarray) -> np.ndarray:
    totals = np.zeros(n, np.int64)
    np.add.at(totals, groups, info)
    return totals


def _tell(keys: np.ndarray, totals: np.ndarray) -> list[int]:
    """Training tokens, and different words among them."""
    words = totals[(keys & np.uint64(1)) == 0]
    return [int(words.sum()), int((words > 0).sum())]


def _before(c1: np.ndarray, starts: np.ndarray, c_end: int) -> np.ndarray:
    v = np.concatenate([[c_end], c1[:-1]])
    v[starts] = c_end
    return v


def _digits(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.round(-4 * np.log2(np.maximum(p, 1e-300))), _ZERO - 1), _ZERO).astype(np.int64)


def interpolation_weights(cells: np.ndarray, counts: np.ndarray, vocabulary: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (bucket x (pair, word, uniform)) by EM; cells: bucket, bin of the pair's and of the word's deleted estimate."""
    value = np.where(np.arange(BINS) < _ZERO, 2.0 ** (-np.arange(BINS) / 4), 0.0)
    p = np.stack([value[cells[:, 1]], value[cells[:, 2]], np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    lam = np.full((65, 3), 1 / 3)
    seen = np.bincount(cells[:, 0], weights=counts, minlength=65)
    for _ in range(steps):
        part = lam[cells[:, 0]] * p
        part *= (counts / part.sum(axis=1))[:, None]
        got = np.stack([np.bincount(cells[:, 0], weights=part[:, i], minlength=65) for i in range(3)], axis=1)
        lam = np.where(seen[:, None] > 0, got / np.maximum(seen[:, None], 1), lam)
    full = np.flatnonzero(seen)
    for b in range(65):
        if not seen[b] and len(full):
            lam[b] = lam[full[np.argmin(np.abs(full - b))]]
        if b == 0:
            lam[0] = [0, lam[0, 1] / max(lam[0, 1] + lam[0, 2], 1e-300), lam[0, 2] / max(lam[0, 1] + lam[0, 2], 1e-300)]
    return np.maximum(lam, [[0, 1e-9, 1e-9]])


def score_documents(docs: DataFrame, em_steps: int = EM_STEPS, chunk_bytes: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Base score and log10 probability of every whole text.

    docs: doc_id, text; other columns are left aside. A null or empty text is its end token
    alone; repeated rows count as often as they come; an empty table, or one without a
    training document, gives a uniform model. Training and held-out documents are told apart
    by the checksum of their ids alone. chunk_bytes and fan (bits by which a hop of the exchange
    deals at most) change no result.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    chunks = chunk_table(docs, chunk_bytes)
    hops = hop_bits(bucket_bits(chunks), fan)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = ChunkTokens(r["ids"], r["lengths"], r["body"])
                yield send(r["unit"], t.keys, t.counts(), hops)

    replies = answer(chunks.mapInArrow(count, SENT), _fold, np.int64, hops, "lm-counts", _tell)
    told = replies.where("unit < 0").agg(*(F.sum(F.get("told", F.lit(i))) for i in range(2))).first()
    total, vocabulary = (int(x or 0) for x in told)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = ChunkTokens(r["ids"], r["lengths"], r["body"])
                c1, c2 = t.token_counts(np.concatenate([unsqueeze(x, np.int64) for x in r["r0"]]))
                c_end = int(c1[t.n[0] - 1])
                cv = _before(c1, t.starts, c_end)
                use = t.trains
                d1, d2, dv = c1[use] - 1, c2[use] - 1, cv[use] - 1
                cell = (_digits(dv) * BINS + _bin(d2 / np.maximum(dv, 1))) * BINS + _bin(d1 / max(total - 1, 1))
                cells, n = np.unique(cell, return_counts=True)
                base = np.add.reduceat(np.log10((c1 + 1) / (total + vocabulary + 1)), t.starts)
                known = np.add.reduceat((c1 > 0).astype(np.int64), t.starts)
                row = {"c_end": c_end, "ids": r["ids"], "n": t.n.tolist(), "known": known.tolist(), "base": base.tolist(), "c1": squeeze(c1), "c2": squeeze(c2), "cells": cells.tolist(), "cell_n": n.tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=looked)

    longs = pa.list_(pa.int64())
    looked = pa.schema([("c_end", pa.int64()), ("ids", longs), ("n", longs), ("known", longs), ("base", pa.list_(pa.float64())), ("c1", pa.binary()), ("c2", pa.binary()), ("cells", longs), ("cell_n", longs)])
    fields = "c_end long, ids array<long>, n array<long>, known array<long>, base array<double>, c1 binary, c2 binary, cells array<long>, cell_n array<long>"
    held = stored(with_replies(chunks, replies).mapInArrow(look_up, fields), "lm-held")
    cells = held.select(F.explode(F.arrays_zip("cells", "cell_n")).alias("x")).groupBy("x.cells").agg(F.sum("x.cell_n").alias("n")).toArrow()  # 65 * BINS * BINS rows at most
    code = cells.column("cells").to_numpy().astype(np.int64)
    lam = interpolation_weights(np.stack([code // (BINS * BINS), code // BINS % BINS, code % BINS], axis=1), cells.column("n").to_numpy().astype(float), vocabulary, em_steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n"])
                starts = np.cumsum(n) - n
                c1, c2 = unsqueeze(r["c1"], np.int64), unsqueeze(r["c2"], np.int64)
                cv = _before(c1, starts, r["c_end"])
                w = lam[_digits(cv)]
                p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] / (vocabulary + 1)
                out = [pa.array(r["ids"], pa.int64()), pa.array([held_out(d) for d in r["ids"]]), pa.array(n), pa.array(r["known"]), pa.array(np.full(len(n), total)), pa.array(r["base"]), pa.array(np.add.reduceat(np.log10(p), starts))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return held.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
