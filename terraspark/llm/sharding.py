"""Sharding by longest processing time.

Groups of rows that must stay together go, largest first, each to the shard with
the least load, kept in a heap.  The heap lives on the driver, so its units are
bounded by proof: a group of at least ``1 / units`` of all bytes stands for itself
(there are ``units`` of these at most), and smaller groups are pooled by hash into
``units`` pools.  Every group is in one unit, so equal texts stay together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

UNITS = 1 << 15


def longest_first(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each ``(size, name)``: largest first (ties by name) to the least-loaded shard (ties to the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(documents: DataFrame, shards: int = 16, units: int = UNITS, rows_per_range: int = 50_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``documents`` (doc_id, text).

    Size is the text's UTF-8 bytes plus 1, so empty and null texts weigh 1; a null
    text has checksum 0 and is a group of its own.  Rows of equal texts, repeated rows
    included, share a shard.  Slots number a shard's rows from 0 without gaps, in
    order of a hash of doc_id and then doc_id; rows equal in both take either slot.
    An empty table gives an empty table.
    """
    digest = F.coalesce(F.md5("text"), F.lit("null"))
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        digest.alias("digest"),
    )
    rows = T.written(rows, "shard-rows")
    groups = T.written(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    pool = F.pmod(F.xxhash64("digest"), F.lit(units)).cast("string")
    large = F.col("size") * units >= F.lit(total.s)
    unit = F.when(large, F.col("digest")).otherwise(pool)
    # At most 2 * units rows, whatever the input.
    sums = groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).collect()
    spark = documents.sparkSession
    placed = longest_first([(r["size"], r["unit"]) for r in sums], shards)
    where = spark.createDataFrame([(u, s, len(u) > 12 or u == "null") for u, s in placed.items()] or [], "unit string, shard int, alone boolean")
    alone = where.where("alone").select(F.col("unit").alias("digest"), F.col("shard").alias("own"))
    pools = where.where("not alone").select(F.col("unit").alias("pool"), F.col("shard").alias("pooled"))
    ranges = max(1, -(-total.n // rows_per_range))
    out = (
        rows.withColumn("pool", pool)
        .join(F.broadcast(alone), "digest", "left")
        .join(F.broadcast(pools), "pool", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "pooled").alias("shard"))
        .withColumn("h", F.xxhash64("doc_id"))
        # Ranges of the hash, so that a shard's rows are numbered range by range.
        .withColumn("range", F.floor((F.shiftright("h", 33) + (1 << 30)) * ranges / (1 << 31)).cast("long"))
    )
    counts = out.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = T.written(counts.withColumn("before", before).select("shard", "range", "before"), "shard-counts")
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "doc_id", "text_crc32"))
    return (
        out.withColumn("row", within)
        .join(counts, ["shard", "range"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
