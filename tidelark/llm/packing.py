"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length l is of class k = capacity // l, and a bin of class k holds exactly k
pieces, so each worker fills bins of a class without knowing the others' pieces: only how
many pieces each task has of each class is exchanged. A piece that would leave much of its
bin empty is first cut: the largest power of two below it splits off (k of which fill a bin
to the brim), until the rest fits its class well or is short.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.llm._common import release, stored, task_id, texts
from tidelark.llm._tokens import encoder, slices

CAPACITY, SHORT, WASTE = 4096, 128, 1 / 64
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, _pid long, _at long"


def cut_lengths(n: int, capacity: int = CAPACITY, short: int = SHORT, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest < short or capacity - k * rest <= waste * capacity:
            out.append(rest)
            break
        part = 1 << (rest.bit_length() - 1)
        out.append(part)
        rest -= part
    return out


def _left_over(pieces: list[tuple[int, int, int]], capacity: int, first: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of (class, rank, length): class, rank, sequence, offset."""
    room: dict[int, list[int]] = {}
    sizes: list[int] = []
    out = []
    for k, g, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fit = min((r for r in room if r >= n and room[r]), default=None)
        if fit is None:
            sizes.append(0)
            seq, fit = len(sizes) - 1, capacity
        else:
            seq = room[fit].pop()
        out.append((k, g, first + seq, sizes[seq]))
        sizes[seq] += n
        room.setdefault(fit - n, []).append(seq)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, short: int = SHORT, waste: float = WASTE) -> DataFrame:
    """Pack the ids of every whole text, each followed by ``end_id``, into sequences of ``capacity``.

    docs: doc_id, text; other columns are left aside. A null or empty text is its end id
    alone, each repeated row is packed by itself, and an empty table gives an empty result.
    Of each class fewer than k pieces (less than one sequence) are left over; they are
    fewer than capacity times its harmonic number whatever the input, and are packed
    together, best fit first, by the driver.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    (gapless), offset, class.
    """
    spark = docs.sparkSession

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = task_id(), Counter()
        for b in batches:
            for own, some in slices(b.column(0), b.column(1)):
                rows: list[tuple] = []
                for doc_id, ids in zip(own, encoder(tokenizer).encode(some), strict=True):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    start, total = 0, len(raw) // 4
                    for n in cut_lengths(total, capacity, short, waste):
                        k = capacity // n
                        rows.append((doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, k, pid, seen[k]))
                        seen[k] += 1
                        start += n
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in _PIECES.split(", ")])
        release()

    pieces = stored(texts(docs).mapInArrow(tokenize, _PIECES), "pack-pieces")
    counts = pieces.groupBy("class", "_pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    classes = counts.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()  # capacity rows at most
    bases, at = [], 0
    for r in classes:
        bases.append((r["class"], at, r["n"] // r["class"]))
        at += r["n"] // r["class"]
    base = F.broadcast(spark.createDataFrame(bases, "class int, _base long, _bins long"))
    ranked = pieces.join(offsets, ["class", "_pid"]).join(base, "class").withColumn("_g", F.col("_at") + F.col("_before"))
    ranked = stored(ranked.select(*pieces.columns, "_g", "_base", "_bins", F.floor(F.col("_g") / F.col("class")).alias("_bin")), "pack-ranked")
    w = Window.partitionBy("class", "_bin").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("_bin < _bins").select(*keep, (F.col("_base") + F.col("_bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), "class")
    left = ranked.where("_bin >= _bins")
    found = _left_over([tuple(r) for r in left.select("class", "_g", "length").collect()], capacity, at)
    placed = F.broadcast(spark.createDataFrame(found, "class int, _g long, sequence_id long, offset long"))
    return full.unionByName(left.join(placed, ["class", "_g"]).select(*full.columns))
