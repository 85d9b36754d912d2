"""Registered queries of the subpackage: thin wrappers that derive the contract's columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query_texts as Q
from . import bitsliced, language, media, mixing, near_dedup, packing, quality, samples, sharding, substring_dedup, tables, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return tables.spread(df, columns[0]) if name == "documents" else df


def _judged(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic")
    fold = samples.remainder("doc_id", 3)
    return _judged(toxicity.score(documents, labels, fold != 1), fold == 1, toxicity.THRESHOLD)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    fold = samples.remainder("doc_id", 5)
    return _judged(quality.score(documents, labels, fold != 0), fold == 0, quality.THRESHOLD)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = samples.remainder("doc_id", 4)
    found = language.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), fold != 2)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))


def _kept_digest(b: pa.RecordBatch) -> pa.RecordBatch:
    sums = []
    for t, k in zip(b.column("text"), b.column("kept_text"), strict=True):
        words = k.as_py().encode() if k.is_valid else b" ".join((t.as_py() or "").encode().split())
        sums.append(hashlib.sha256(words).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_removed"), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    return substring_dedup.remove_repeats(documents, then=_kept_digest, then_schema="doc_id long, n_words long, n_removed long, kept_sha256 string")


def _media_digest(doc_id: int | None, n_bytes: int, avi: bytes) -> dict:
    movie, sha, tail, n, hist = media.parse(avi), hashlib.sha256(), b"", 0, []
    # Frame by frame, so that a long payload is never held as coefficients.
    for frame in media.pictures(avi, movie):
        if frame is None:
            raise ValueError("a stored frame can't be read back")
        part = media.stored_in(frame)[: movie.n_bytes - n]
        sha.update(part)
        tail, n = (tail + part)[-64:], n + len(part)
        hist.append(media.histogram(frame))
    return {
        "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": n, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail),
        "media_bytes": len(avi), "media_sha256": hashlib.sha256(avi).hexdigest(), "feature": media.feature(movie, np.array(hist)), "n_clips": len(media.shots(np.array(hist))),
    }


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int"
    return media.store_texts(_table(spark, sf_dir, "documents", "doc_id", "text"), _media_digest, schema)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = tables.written(mixing.with_word_count(documents, keep_text=False), "sizes")
    mixed = mixing.mix(sizes, sizes)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_bitsliced_top_k": op3_bitsliced_top_k,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_avi_media": op9_avi_media,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op2_near_dedup": Q.OP2,
    "op3_bitsliced_top_k": Q.OP3,
    "op8_substring_dedup": Q.OP8,
    "op10_mixing": Q.OP10,
}
