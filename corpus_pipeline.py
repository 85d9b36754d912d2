"""A corpus pipeline of five stages; each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm import mixing, near_dedup, packing, quality, samples, substring_dedup, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    Null and empty texts have the score of a text without words and are kept or go by
    it; equal texts, repeated rows included, share their fate, and so do equal scores;
    a text of any length is scored whole; a null doc_id is kept.  Without labels all
    scores follow from the seeded network.  Other columns are dropped, whatever their
    names; an empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs.select(COLUMNS), labels, samples.remainder("doc_id", 5) != 0, keep=COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Null and empty texts, and rows with a null doc_id, are in no group and stay.  Of
    repeated rows, and of several texts of a group under its smallest id, one stays.
    Whole texts of any length are compared; other columns are dropped; an empty table
    gives an empty table.
    """
    return near_dedup.without_copies(docs.select(COLUMNS)).select(COLUMNS)


def _rewritten(b: pa.RecordBatch) -> pa.RecordBatch:
    text = pa.compute.coalesce(b.column("kept_text"), b.column("text"))
    n_chars = pa.compute.if_else(b.column("kept_text").is_valid(), pa.compute.utf8_length(text).cast(pa.int64()), b.column("n_chars").cast(pa.int64()))
    columns = {"doc_id": b.column("doc_id").cast(pa.int64()), "text": text, "lang": b.column("lang"), "source": b.column("source"), "n_chars": n_chars}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; other texts stay as they are.

    Every row stays: one whose every word goes has an empty text.  Null and empty texts
    and those under 20 words are left as they are; repeated rows have the same places
    and are treated alike; a null doc_id counts as smaller than all; texts of any length
    are read whole; n_chars is counted anew where a text changes.  Other columns are
    dropped; an empty table gives an empty table.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return substring_dedup.remove_repeats(docs.select(COLUMNS), then=_rewritten, then_schema=schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row.

    A null source is a source of its own; null and empty texts have no words and follow
    the seeded order alone; repeated rows share their fate; a null doc_id has a place in
    the order like any other; texts are counted whole.  Other columns are dropped; an
    empty table gives an empty table.
    """
    mixed = mixing.mix(docs.select(COLUMNS))
    return mixed.where("reps > 0").withColumn("copy", F.explode(F.expr("sequence(1, reps)"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of several permitted lengths: one row a piece.

    Null and empty texts are a piece of no words; repeated rows are packed as often as
    they occur; equal sizes are placed in order of doc_id; a text longer than the longest
    bin is cut without losing a word; a null doc_id stays null.  Other columns are not
    read; an empty table gives an empty table.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
