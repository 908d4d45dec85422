"""Token-ID output: Arrow stream files of equal-length sequences and masks.

A file is one Arrow stream. Its record batches hold ``rows`` sequences each (the last may
hold fewer), every sequence a fixed-size list of ``seq_len`` ids, beside a fixed-size list
of mask bits (true: a token, false: padding, at the end of a file only). As all sizes are
fixed, sequence j of a file is row j % rows of batch j // rows, and a reader that maps the
file into memory gets it, and every run of ids, without copying.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.llm._common import release, scratch, task_id, texts
from tidelark.llm._tokens import encoder, slices

SEQ_LEN, ROWS = 2048, 128


def _schema(id_type: pa.DataType, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class TokenWriter:
    """Writes runs of ids to one file; the file appears under its name when it is whole."""

    def __init__(self, uri: str, id_type: pa.DataType, seq_len: int = SEQ_LEN, rows: int = ROWS) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.part = f"{self.path}.{np.random.default_rng().integers(1 << 62):x}.part"
        self.schema, self.seq_len, self.block = _schema(id_type, seq_len), seq_len, seq_len * rows
        self.out = self.fs.open_output_stream(self.part)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.dtype = id_type.to_pandas_dtype()

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(flat[i : i + self.block], self.block)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _put(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._put(np.pad(flat, (0, -len(flat) % self.seq_len)), len(flat))
        self.stream.close()
        self.out.close()
        self.fs.move(self.part, self.path)


class TokenFile:
    """Random access to a file: sequences, masks and runs of ids; no copy where the store maps files."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as s:
            self.seq_len = s.schema.field("ids").type.list_size
            self.batches = list(s)
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, j: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence j."""
        b, r = self.batches[j // self.rows], j % self.rows
        return self._flat(j // self.rows)[r * self.seq_len : (r + 1) * self.seq_len], b.column("mask")[r].values

    def _flat(self, k: int) -> np.ndarray:
        return self.batches[k].column("ids").flatten().to_numpy(zero_copy_only=True)

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the file; a view unless it crosses batches."""
        block, parts = self.rows * self.seq_len, []
        while n > 0:
            k, at = divmod(start, block)
            part = self._flat(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write_token_files(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 0, vocab: int = 1 << 16, seq_len: int = SEQ_LEN, rows: int = ROWS) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending doc_id order.

    docs: doc_id, text; other columns are left aside. A null text counts as empty, rows of
    one doc_id stand in the order of their texts (null ids first), and an empty table gives
    no file. Ids take 16 bits where ``vocab`` allows, else 32. Each task writes the file of
    its range of doc_ids under ``out`` (default: the shared folder); a task that is run again
    writes the same bytes and renames the file into place.

    Returns the index, stored beside the files: file, shard, doc_id, first (position in the
    file), start (position over all files) and n_tokens.
    """
    spark = docs.sparkSession
    out = out or scratch(spark, "tokens")
    id_type = pa.uint16() if vocab <= 1 << 16 else pa.uint32()
    pafs.FileSystem.from_uri(out)[0].create_dir(pafs.FileSystem.from_uri(out)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, writer, uri = task_id(), None, ""
        for b in batches:
            for own, some in slices(b.column(0), b.column(1)):
                first, n = [], []
                for ids in encoder(tokenizer).encode(some):
                    if writer is None:
                        uri = f"{out}/shard-{pid:06d}.arrows"
                        writer = TokenWriter(uri, id_type, seq_len, rows)
                    first.append(writer.n)
                    writer.append(np.append(ids, np.uint32(end_id)))
                    n.append(len(ids) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(n)), pa.array([pid] * len(n), pa.int64()), pa.array(own, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["file", "shard", "doc_id", "first", "n_tokens"])
        if writer:
            writer.close()
        release()

    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(write, "file string, shard long, doc_id long, first long, n_tokens long").write.parquet(f"{out}/index")
    index = spark.read.schema("file string, shard long, doc_id long, first long, n_tokens long").parquet(f"{out}/index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return index.join(base, "shard").select("file", "shard", "doc_id", "first", (F.col("base") + F.col("first")).alias("start"), "n_tokens")


def read_token_files(index: DataFrame) -> DataFrame:
    """Read the files back by their index: doc_id, start, n_tokens and ids_crc32 of the ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            crc = []
            for uri, first, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if uri != name:
                    name, file = uri, TokenFile(uri)
                crc.append(zlib.crc32(file.run(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), b.column(4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("file", "doc_id", "first", "start", "n_tokens").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
