"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Each source's target is its weight's share of the wanted words, clamped at
``max_epochs`` times what the source has; what a clamped source can't give is
reshared among the others in proportion to their weights until none is above its
cap.  In closed form: with sources in order of cap over weight, the clamped ones
are a prefix, so one pass of running sums finds the common level.

A document is then taken ``floor(target / source words)`` whole times, and once
more if it lies in a seeded prefix of its source that holds the missing fraction.
The prefix's end is found by sums of hash buckets, of finer ones in the bucket where
it lies, and at last by rows, so that no source, however large, is ordered in one task.
Its end is one key a source: the final pass joins only that small table and moves
no text.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tables as T


def with_word_count(df: DataFrame, text: str = "text", name: str = "size", keep_text: bool = True) -> DataFrame:
    """``df`` with the number of words of ``text`` (null: 0) as ``name``."""
    df = df.drop(name)
    fields = [f for f in df.schema if keep_text or f.name != text]
    names = [f.name for f in fields]

    def fn(batches):
        for b in batches:
            sizes = pa.array(K.word_counts(b.column(b.schema.get_field_index(text))), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), sizes], names=[*names, name])

    return df.mapInArrow(fn, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` long"]))


#: Tables of one row a source are broadcast up to this many.
SOURCES_MOST = 100_000


def _with_source(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` with the columns of ``by_source`` (one row a source, null included, and ``n_rows``)."""
    key = lambda df: df.withColumn("source_", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    rows, by_source = key(rows), key(by_source).drop("source")
    if n_sources <= SOURCES_MOST:
        return rows.join(F.broadcast(by_source.drop("n_rows")), "source_").drop("source_")
    total = by_source.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return T.joined(rows, by_source, "source_", "n_rows", total).drop("source_")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (a table of source, source_size, weight) with ``target``, from running sums in order of cap over weight."""
    x = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size").cast("double"))
    total, weights = x.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    goal = float(share) * (total or 0.0)
    x = T.running(x, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"capped": "cap", "passed": "weight"})
    left = F.lit(weights) - F.col("passed")
    level = (F.lit(goal) - F.col("capped")) / left
    # The first source that its share does not fill, and with it the level of all that follow.
    first = x.where(level * F.col("weight") <= F.col("cap")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("capped").alias("c"), left.alias("w"))).alias("knee")).first()
    knee = first.knee if first else None
    target = F.col("cap") if knee is None else F.least(F.col("cap"), (F.lit(goal) - F.lit(knee.c)) / F.lit(knee.w) * F.col("weight"))
    return x.withColumn("target", target).select(*sources.columns, "target")


#: Lengths of the key's heads (hexadecimal digits) by which the end of a prefix is sought.
BUCKET_DIGITS = (2, 4)


def _key(doc_id: str, seed: str) -> Column:
    """A seeded order of documents that any engine with MD5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def plan_mix(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """From ``(doc_id, source, size)``: ``(source, n_rows, source_size, target, whole, last_key)``, one row a source.

    Sources in code-point order, null last, get ``weights`` in turn.  Rows of a
    source whose seeded key is at most ``last_key`` are taken once more than
    ``whole`` times.
    """
    keyed = T.written(sizes.select("source", "size", _key("doc_id", seed).alias("key")), "mix-sizes")
    sources = T.written(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sources")
    n_sources = sources.count()
    turn = (F.col("row") - 1) % len(weights)
    sources = T.running(sources, [F.col("source").asc_nulls_last()], {})
    sources = T.written(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).drop("row"), "mix-weights")
    targets = water_fill(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = T.written(targets, "mix-targets")
    # The bucket in which each source's prefix ends, by ever longer heads of the key: 256 sums a source at each step.
    ends = targets.select("source", "n_rows", "need", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"))
    for digits in BUCKET_DIGITS:
        inside = _with_source(keyed, ends.withColumnRenamed("bucket", "head"), n_sources).where(F.col("key").startswith(F.col("head")))
        sums = inside.groupBy("source", "need", "before", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("start", F.col("before") + upto - F.col("n")).where(F.col("start") < F.col("need"))
        last = F.max(F.struct("bucket", "start")).alias("e")
        # How many rows a source has does not change with its bucket: the join is by source.
        found = sums.groupBy("source", "need").agg(last).select("source", "need", "e.bucket", F.col("e.start").alias("before"))
        ends = T.written(found.join(targets.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-ends")
    inside = _with_source(keyed, ends, n_sources).where(F.col("key").startswith(F.col("bucket"))).select("source", "key", "size", "need", "before")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    # A document is in if its middle is: the prefix misses the need by half a document at most.
    last = inside.withColumn("middle", upto - F.col("size") / 2.0).where(F.col("middle") < F.col("need")).groupBy("source").agg(F.max("key").alias("last_key"))
    plan = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    # Without a row inside the last bucket the prefix ends before that bucket.
    return T.written(plan.select("t.source", "t.n_rows", "t.source_size", "t.target", "t.whole", F.coalesce("l.last_key", "e.bucket", F.lit("")).alias("last_key")), "mix-plan")


def mix(documents: DataFrame, sizes: DataFrame | None = None, seed: str = "mix", **options) -> DataFrame:
    """All rows and columns of ``documents`` (doc_id, source, text or size) with ``source_size``, ``target``, ``reps``.

    ``reps`` is how often the mix takes the row, 0 to the whole maximum of epochs.
    Words are counted unless ``documents`` is given with ``sizes``, a slim table
    ``(doc_id, source, size)`` of the same rows.  A null source is a source of its
    own; null and empty texts have size 0 and no influence; repeated rows share
    their fate; an empty table gives an empty table.  Columns of the results' names
    are replaced.  Reruns agree, as the order hashes doc_id and ``seed`` only.
    """
    documents = documents.drop("source_size", "target", "reps")
    if sizes is None:
        sizes = with_word_count(documents.select("doc_id", "source", "text"), keep_text=False)
    plan = plan_mix(sizes, seed=seed, **options)
    renamed = plan.select("source", "n_rows", *[F.col(c).alias(f"plan_{c}_") for c in ("source_size", "target", "whole", "last_key")])
    out = _with_source(documents, renamed, plan.count())
    reps = F.col("plan_whole_") + (_key("doc_id", seed) <= F.col("plan_last_key_")).cast("int")
    return out.select(*documents.columns, F.col("plan_source_size_").alias("source_size"), F.col("plan_target_").alias("target"), reps.alias("reps"))
