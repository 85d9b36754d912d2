"""Written tables in the shared folder, and packed exchange of hashes between blocks of documents."""

from __future__ import annotations

import io
import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from . import kernels as K

BLOCK_BYTES = (1 << 20) - 1024
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where ``spark.checkpoint.dir`` is unset and all runs in one process (tests) a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="terraspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def temporary(spark: SparkSession):
    """Deletes the tables written inside it but those whose frames (as ``written`` gave them) are put on the list it gives.

    Also lets Spark drop the shuffle files of frames that are no longer in use, which it
    does only when the driver collects its garbage.
    """
    mark, kept = len(_paths), []
    yield kept
    stay = {df.written_to for df in kept}
    for path in [p for p in _paths[mark:] if p not in stay]:
        _delete(spark, path)
        _paths.remove(path)
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> int:
    """Deletes all tables this process has written so far; for when no result that reads them is needed any more."""
    n = len(_paths)
    while _paths:
        _delete(spark, _paths.pop())
    return n


#: A join by broadcast takes at most so many hot keys, at any size of the input.
HOT_KEYS = 10_000
#: Keys of fewer rows are never hot.
HOT_ROWS = 1_000


def joined(rows: DataFrame, by_key: DataFrame, key: str | list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` (cheap to read twice) with the columns of ``by_key``, which has one row a key and says in ``count`` how many of ``rows`` have it.

    A key of at least ``HOT_ROWS`` rows that holds one of ``HOT_KEYS`` equal shares of
    all rows or more is joined by broadcast, so that none meets in one task; there are
    no more than ``HOT_KEYS`` of them.  ``total``: the number of rows, if known, or more.
    """
    keys = [key] if isinstance(key, str) else key
    total = rows.count() if total is None else total
    hot = F.col(count) >= max(HOT_ROWS, -(-total // HOT_KEYS))
    few = by_key.where(hot).drop(count)
    spread_out = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(by_key.where(~hot).drop(count), keys)
    return spread_out.unionByName(rest)


def running(df: DataFrame, order: list[Column], sums: dict[str, str], per_range: int = 100_000) -> DataFrame:
    """``df`` (a written table) with ``row`` (from 1) and, for each ``name: column`` of ``sums``, the sum over all rows before it.

    ``order`` must be total.  Beyond ``per_range`` rows they are dealt into ranges of the
    order, and only the ranges' sums, one row each, meet in one task.
    """

    def within(x: DataFrame, w: WindowSpec) -> DataFrame:
        before = {n: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, c in sums.items()}
        return x.withColumns({"row": F.row_number().over(w)} | before)

    n = df.count()
    if n <= per_range:
        return within(df, Window.orderBy(*order))
    ranged = written(df.repartitionByRange(parts_for(n, per_range), *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range_").agg(F.count("*").alias("row_"), *[F.sum(c).alias(f"{n}_") for n, c in sums.items()])
    upto = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("range_", *[F.coalesce(F.sum(f"{n}_").over(upto), F.lit(0)).alias(f"{n}_") for n in ("row", *sums)])
    out = within(ranged, Window.partitionBy("range_").orderBy(*order)).join(F.broadcast(earlier), "range_")
    return out.withColumns({n: F.col(n) + F.col(f"{n}_") for n in ("row", *sums)}).drop("range_", *[f"{n}_" for n in ("row", *sums)])


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer partitions than there are cores (a single small file), dealt out by key; any other as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def blocks(df: DataFrame, text: str) -> DataFrame:
    """``df`` as written rows ``(block, blob)``: whole rows packed to about a megabyte of text a block.

    A block's id is fixed once written, so later jobs can answer to a block
    whatever executors compute it.
    """

    def fn(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, offsets = K.texts_of(batch.column(batch.schema.get_field_index(text)))
            for a, b in K.chunked(offsets, BLOCK_BYTES):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "blob": pa.array([pack(batch.slice(a, b - a))], pa.binary()), "n_bytes": pa.array([int(offsets[b] - offsets[a])], pa.int64())})
                block += 1

    return written(df.mapInArrow(fn, "block long, blob binary, n_bytes long"), "blocks")


def parts_for(n_entries: int, per_part: int = 1_000_000, least: int = 1) -> int:
    """Number of parts that keeps about ``per_part`` entries in a part, at any size of the input."""
    return max(least, -(-n_entries // per_part))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash by its upper 32 bits: sorted hashes have sorted parts."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_part(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) over sorted hashes."""
    cut = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    return [(p, int(cut[p]), int(cut[p + 1])) for p in np.flatnonzero(np.diff(cut)).tolist()]


def replies_by_block(replies: DataFrame) -> DataFrame:
    """``(block, replies array<struct<part, kind, bits>>)``: at most one of a kind from each part."""
    return replies.groupBy("block").agg(F.collect_list(F.struct("part", "kind", "bits")).alias("replies"))


def bits_of(replies: list | None, kind: int, hashes: np.ndarray, parts: int) -> np.ndarray:
    """The answers of one kind as booleans over this block's sorted hashes; without an answer False."""
    out = np.zeros(len(hashes), dtype=bool)
    where = {p: (a, b) for p, a, b in by_part(hashes, parts)}
    for r in replies or ():
        if r["kind"] == kind:
            a, b = where[r["part"]]
            out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
    return out
