"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelark.llm._common import WORD, drop_since, made, scratch
from tidelark.llm.llm_queries import tokenizer_path
from tidelark.llm.mixing import mix_sources
from tidelark.llm.packing import pack_documents
from tidelark.llm.pii import mask_personal_data
from tidelark.llm.quality import kept_rows
from tidelark.llm.simhash import near_copies


def _free(docs: DataFrame, wanted: str) -> str:
    """A column name that docs has not."""
    while wanted in docs.columns:
        wanted = "_" + wanted
    return wanted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, with all their columns.

    A null text has no words and goes; each repeated row has its own verdict, the same one; a
    null language is judged by the nearest reference; an empty table stays empty.
    """
    return kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that chain by pairs sharing 0.8 of their five-word shingles.

    It is the row of the smallest doc_id (a null one comes last); of several texts under that id
    the one of the least hash, of several rows of that text the one that sorts first. Rows are
    grouped by their texts alone: different texts under one doc_id, or under null ones, all stay
    unless they are linked. Null, empty and wordless texts are one group. All columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    text, key, place = (_free(docs, c) for c in ("_text", "_key", "_place"))
    hashed = docs.withColumn(text, F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = near_copies(hashed.select(F.col(text).alias("node"), F.coalesce("text", F.lit("")).alias("text")))

    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = hashed.select(F.col(text).alias("node"), order.alias("o")).groupBy("node").agg(F.min("o").alias("first"))
    told = first.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.struct("first.none", "first.id", "node").alias("top"))
    mark = lambda i, t: F.xxhash64(i, i.isNull(), t)
    winners = told.groupBy("root").agg(F.min("top").alias("top")).select(mark(F.col("top.id"), F.col("top.node")).alias(key))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = Window.partitionBy(key).orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in ["text", *rest]))
    rows = hashed.withColumn(key, mark(F.col("doc_id"), F.col(text))).withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return rows.join(winners, key, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and, where there is such a column, n_chars counted anew.

    Null texts stay null (n_chars too), empty ones empty; all other columns stay as they are.
    """
    out = mask_personal_data(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*(f"`{c}`" for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; rows with the same doc_id (null ones too) share the greatest draw among them.

    Rows without words are never taken. All columns stay as they are, whatever their names.
    """
    name, copies, copy = (_free(docs, c) for c in ("_id", "_copies", "_copy"))
    taken = mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias(copies)).where(F.col(copies) > 0).withColumnRenamed("doc_id", name)
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken[name]))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return rows.where(worded).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 tokens; a null or empty text is its end token alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written to the shared folder and read again.

    When a stage is written, what it had stored and what it read are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        drop_since(spark, mark, keep=path)
    return STAGES[-1][1](spark, docs, sf_dir)
