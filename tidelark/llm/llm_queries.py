"""The queries of the operators, with the columns of their contracts, and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm.lm import score_documents
from tidelark.llm.mixing import mix_sources
from tidelark.llm.packing import pack_documents
from tidelark.llm.pii import KINDS, find_personal_data, span_text
from tidelark.llm.quality import judge
from tidelark.llm.sharding import shard_documents
from tidelark.llm.simhash import near_duplicates
from tidelark.llm.suffix_dedup import remove_repeats
from tidelark.llm.tiff import text_tiff, tiff_pages
from tidelark.llm.token_output import read_token_files, write_token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0, vocab=50_257))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir)).drop("text_hash")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_documents(spark, sf_dir), (1, 2, 3), 3)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source")


def _stored_tiffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            ids, n_bytes, media = [], [], []
            for d, t in zip(b.column(0)[at : at + 256].to_pylist(), b.column(1)[at : at + 256], strict=True):
                raw = (t.as_py() or "").encode()
                ids.append(d)
                n_bytes.append(len(raw))
                media.append(text_tiff(raw + b" " * (-len(raw) % 192 or 192 * (not raw))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _page_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file from its pages, which follow each other."""
    sha, tail, n, hist, schemes = hashlib.sha256(), b"", 0, np.zeros(8, np.int64), []
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["error"]:
                raise ValueError(r["error"])
            px = r["pixels"]
            sha.update(px)
            tail, n = (tail + px)[-16:], n + len(px)
            hist += np.bincount(np.frombuffer(px, np.uint8) >> 5, minlength=8)
            schemes.append(r["compression"])
            if r["n_pages"]:
                feature = f"pages={r['n_pages']};schemes={','.join(map(str, sorted(set(schemes))))};levels={','.join(map(str, hist.tolist()))}"
                rows.append((r["doc_id"], r["n_bytes"], n, sha.hexdigest(), zlib.crc32(tail), r["media_bytes"], r["media_sha256"], feature))
                sha, tail, n, hist, schemes = hashlib.sha256(), b"", 0, np.zeros(8, np.int64), []
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _DIGEST.split(", ")]))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_stored_tiffs, "doc_id long, n_bytes long, media binary")
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return tiff_pages(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"]).mapInArrow(_page_digests, _DIGEST)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=50)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(_documents(spark, sf_dir))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_documents(spark, sf_dir), shingle=3, radius=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
