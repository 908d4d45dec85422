"""Shared storage, ordered prefix sums and other helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of its own is set, which is allowed in local mode only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelark-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def made() -> int:
    """How many scratch paths were given out, to drop later ones."""
    return len(_MADE)


def last_made() -> str:
    return _MADE[-1]


def drop_since(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Delete what lies under the scratch paths given out since ``mark``, but for ``keep``: once no later plan reads it."""
    for path in _MADE[mark:]:
        if path != keep:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _MADE[mark:] = [keep] if keep else []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and fixes its rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and what else is asked for."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def release() -> None:
    """Give memory that a worker has freed back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _numbered(groups: list[str], sums: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = task_id(), {}
        for b in batches:
            if not b.num_rows:
                continue
            key = np.zeros(b.num_rows, np.int64)
            if groups:
                key = b.column(groups[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            values = [np.ones(b.num_rows, np.int64), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sums)]
            before = [np.empty(b.num_rows, np.int64) for _ in values]
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                old = seen.setdefault(int(k), [0] * len(values))
                for i, v in enumerate(values):
                    run_to = np.cumsum(v[at]) + old[i]
                    before[i][at] = run_to - v[at]
                    old[i] = int(run_to[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int64)), *map(pa.array, before)], names=[*b.schema.names, "_pid", "_n", *(f"_{c}" for c in sums)])

    return run


def prefix_sums(df: DataFrame, order: list[str], sums: list[str], name: str, group: str | None = None) -> DataFrame:
    """Global row number and sums of what stands before each row, in the given order.

    df is dealt by range of ``order`` (so one hot value splits wherever ``order`` still
    differs); each task sums its own rows, and only a total for each task is exchanged.
    With ``group`` (an integer column leading the order) all restart in each group.
    Adds ``_n`` and ``_<sum>``; ``_pid`` names the task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    extra = ["_pid", "_n", *(f"_{c}" for c in sums)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)])
    local = stored(ranged.mapInArrow(_numbered([group] if group else [], sums), schema), name)
    keys = ["_pid", *([group] if group else [])]
    totals = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tn"), *(F.sum(c).alias(f"_t{c}") for c in sums))
    w = Window.partitionBy(*([F.col(group)] if group else [])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = totals.select(*keys, *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"_o{c}") for c in ["_tn", *(f"_t{c}" for c in sums)]))
    joined = local.join(off, keys)
    return joined.select(*df.columns, "_pid", (F.col("_n") + F.col("_o_tn")).alias("_n"), *((F.col(f"_{c}") + F.col(f"_o_t{c}")).alias(f"_{c}") for c in sums))
