"""Chunks of whole documents, and an exchange of hashed keys between them.

A chunk is a row with some megabytes of text, stored once, so that it keeps its documents and
its number whatever later plans do. For an exchange each chunk sends its different keys,
sorted and delta-coded, to buckets by their leading bits; a bucket sees a key from all chunks
at once and answers each chunk in the order of its keys.

There are some two buckets to a chunk, and a row from each chunk to each bucket would be a
number of rows that grows with the square of the corpus. So a sender deals by FAN bits at
most: beyond that, relays in between gather what a group of some 2**bits senders sent under one prefix,
fold equal keys into one, and deal that by the next bits. After all hops one bucket has met all
groups. A hop has at most 2**FAN rows a chunk, and their number grows with the logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm._common import stored, task_id, texts

CHUNK, FAN = 8 << 20, 10
_SCHEMA = "unit long, ids array<long>, lengths array<long>, body binary"


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, in planes of their significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def chunk_table(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs (null texts as empty) as stored chunks: unit, ids, lengths (bytes of each text), body."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n, ids, held, size = task_id(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            row = {"unit": (pid << 32) + n, "ids": ids, "lengths": [len(h) for h in held], "body": zstandard.compress(b"".join(held), 3)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("unit", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("body", pa.binary())]))

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py().encode()
                if held and size + len(raw) > chunk_bytes:
                    yield out()
                    n, ids, held, size = n + 1, [], [], 0
                ids.append(d)
                held.append(raw)
                size += len(raw)
        if held:
            yield out()

    return stored(texts(docs).mapInArrow(pack, _SCHEMA), "chunks")


def bucket_bits(chunks: DataFrame) -> int:
    """Leading bits by which keys are dealt: some two buckets to a chunk."""
    return max(3, int(chunks.count()).bit_length())


def hop_bits(bits: int, fan: int = FAN) -> list[int]:
    """Bits by which each hop of an exchange deals: as even as can be, none above ``fan``."""
    n = -(-bits // fan)
    return [bits // n + (i < bits % n) for i in range(n)]


def group_of(unit: int, bits: int) -> int:
    """The group of a chunk before the first hop; a hop of b bits makes one group of 2**b."""
    return (unit * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)


def cut_keys(keys: np.ndarray, bits: int, done: int = 0, prefix: int = 0) -> np.ndarray:
    """Where each of 2**bits buckets begins in sorted keys whose first ``done`` bits are ``prefix``, and the end."""
    first = prefix << bits
    return np.searchsorted(keys >> np.uint64(64 - done - bits), np.arange(first, first + (1 << bits) + 1, dtype=np.uint64))


SENT = "grp long, bucket long, unit long, keys binary, info binary"
_REPLY = "unit long, bucket long, reply binary, told array<long>"


def _deal(unit: int, grp: int, keys: np.ndarray, info: np.ndarray, bits: int, done: int, prefix: int) -> list[tuple]:
    edge = cut_keys(keys, bits, done, prefix)
    first = prefix << bits
    return [(grp >> bits, first + i, unit, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(info[a:b])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]


def send(unit: int, keys: np.ndarray, info: np.ndarray, hops: list[int]) -> pa.RecordBatch:
    """Rows of SENT for the first hop of a chunk's sorted different keys."""
    rows = _deal(unit, group_of(unit, sum(hops)), keys, info, hops[0], 0, 0)
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["grp", "bucket", "unit", "keys", "info"])


def _gather(rows: pd.DataFrame, kind: type) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by sender; the different keys, the number of each sent key among them, what came with it, and where senders end."""
    rows = rows.sort_values("unit")
    keys = [np.cumsum(unsqueeze(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    info = np.concatenate([unsqueeze(i, kind) for i in rows["info"]])
    every = np.concatenate(keys)
    order = np.argsort(every)
    s = every[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    groups = np.empty(len(every), np.int64)
    groups[order] = np.cumsum(new) - 1
    return rows, s[new], groups, info, np.cumsum([len(k) for k in keys])


def _parts(rows: pd.DataFrame, reply: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    parts = [squeeze(reply[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame({"unit": rows["unit"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "reply": parts, "told": None})


def backward(replies: DataFrame, bits: int) -> DataFrame:
    """Replies to relays, by the node that they go to: grp, bucket, sub, reply."""
    return replies.where("unit >= 0").select(F.col("unit").alias("grp"), F.shiftright("bucket", bits).alias("bucket"), F.col("bucket").alias("sub"), "reply")


def answer(sent: DataFrame, fold: Callable[[int, np.ndarray, np.ndarray], np.ndarray], kind: type, hops: list[int], name: str, tell: Callable[[np.ndarray, np.ndarray], list[int]] | None = None) -> DataFrame:
    """Stored answers (unit, bucket, reply) to what chunks sent; of rows with unit -1, ``told`` holds what a bucket has to tell of itself.

    fold(n, groups, info) makes one value of ``kind`` for each of n keys from what came with them,
    keys being numbered by ``groups``; folding folded values must give the same as folding all
    at once. The value is the reply to all that sent the key. tell(keys, values) gives numbers.
    """

    def relay(done: int, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            grp, prefix = int(rows["grp"].iloc[0]), int(rows["bucket"].iloc[0])
            _, keys, groups, info, _ = _gather(rows, kind)
            return pd.DataFrame(_deal(grp, grp, keys, fold(len(keys), groups, info).astype(kind), bits, done, prefix), columns=["grp", "bucket", "unit", "keys", "info"])

        return run

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        rows, keys, groups, info, ends = _gather(rows, kind)
        values = fold(len(keys), groups, info).astype(kind)
        out = _parts(rows, values[groups], ends)
        own = pd.DataFrame({"unit": [-1], "bucket": rows["bucket"].iloc[:1].to_numpy(), "reply": [b""], "told": [tell(keys, values) if tell else []]})
        return pd.concat([out, own], ignore_index=True)

    def back(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows, _, groups, _, ends = _gather(rows, kind)
        values = np.concatenate([unsqueeze(x, kind) for x in replies.sort_values("sub")["reply"]])
        return _parts(rows, values[groups], ends)

    received, done = [], hops[0]
    for bits in hops[1:]:
        received.append(stored(sent, f"{name}-hop"))
        sent = received[-1].groupBy("grp", "bucket").applyInPandas(relay(done, bits), SENT)
        done += bits
    replies = stored(sent.groupBy("grp", "bucket").applyInPandas(last, _REPLY), name)
    told = replies.where("unit < 0")
    for at, bits in zip(reversed(received), reversed(hops[1:]), strict=True):
        replies = stored(at.groupBy("grp", "bucket").cogroup(backward(replies, bits).groupBy("grp", "bucket")).applyInPandas(back, _REPLY), name)
    return replies if len(hops) == 1 else replies.unionByName(told)


def with_replies(chunks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Chunks, each with the replies that it got (r0, r1, ...: arrays by bucket)."""
    tagged = None
    for i, r in enumerate(replies):
        part = r.where("unit >= 0").select("unit", F.lit(i).alias("i"), "bucket", "reply")
        tagged = part if tagged is None else tagged.unionByName(part)
    cols = [F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("bucket", "reply"))))["reply"].alias(f"r{i}") for i in range(len(replies))]
    return chunks.join(tagged.groupBy("unit").agg(*cols), "unit", "left")
