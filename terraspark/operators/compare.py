"""Comparison of class maps: confusion matrices, agreement and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(value: Column, classes: Mapping[int, str]) -> Column:
    """Class name of a value; unmapped values and 'nodata' are null."""
    out = F.lit(None).cast("string")
    for v, name in classes.items():
        if name != "nodata":
            out = F.when(value == v, F.lit(name)).otherwise(out)
    return out


def class_dictionary(*maps: Mapping[int, str]) -> list[tuple[int, str]]:
    """Sorted union of all class names but 'nodata', with dense ids from 0."""
    return list(enumerate(sorted({n for m in maps for n in m.values()} - {"nodata"})))


def labelled_pairs(pixels: DataFrame, map1: Mapping[int, str], map2: Mapping[int, str], regions: Mapping[int, str]) -> DataFrame:
    """Forest pixels with ``pred`` (map 1), ``truth`` (map 2), ``region`` and whether both labels are known."""
    return (
        pixels.where(F.col("forest") == 1)
        .withColumns({"pred": label(F.col("cls1"), map1), "truth": label(F.col("cls2"), map2), "region": label(F.col("eco"), regions)})
        .withColumn("valid", F.col("pred").isNotNull() & F.col("truth").isNotNull())
    )


def confusion(pairs: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``truth, pred, n`` of all label pairs, zero-filled; the grid of labels is a literal."""
    spark = pairs.sparkSession
    counts = pairs.where("valid").groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))
    if by:
        return counts
    labels = spark.createDataFrame([(t, p) for t in names for p in names], "truth string, pred string")
    return labels.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pivoted(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    return matrix.groupBy("truth").agg(*[F.sum(F.when(F.col("pred") == p, F.col("n")).otherwise(0)).alias(p) for p in names])


def agreement(pairs: DataFrame, by: Column | str | None = None) -> DataFrame:
    """Pixels, labelled pixels, agreeing pixels and the two ratios; 0 where nothing counts."""
    aggregates = [
        F.count("*").alias("forest_pixels"),
        F.count_if("valid").alias("labelled"),
        F.count_if(F.col("valid") & (F.col("pred") == F.col("truth"))).alias("agreeing"),
    ]
    out = (pairs.groupBy(by) if by is not None else pairs).agg(*aggregates)
    return out.withColumns(ratios())


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"agreement": share("agreeing", "labelled"), "coverage": share("labelled", "forest_pixels")}


def by_region(pairs: DataFrame) -> DataFrame:
    """Known regions and the total (region null) in one pass."""
    spans = pairs.withColumn("known", F.col("region").isNotNull())
    out = spans.groupingSets([["known", "region"], []], "known", "region").agg(
        F.grouping("region").alias("total"), F.count("*").alias("forest_pixels"), F.count_if("valid").alias("labelled"),
        F.count_if(F.col("valid") & (F.col("pred") == F.col("truth"))).alias("agreeing"),
    )
    return out.where((F.col("total") == 1) | F.col("known")).withColumns(ratios()).drop("known")


def by_region_windowed(pairs: DataFrame, window: int) -> DataFrame:
    """Regions as a window-by-window evaluation counts them: a region's pixels count only in windows where it has a labelled pair."""
    windows = pairs.where(F.col("region").isNotNull()).withColumns({"wr": F.floor(F.col("r") / window), "wc": F.floor(F.col("c") / window)})
    partial = windows.groupBy("region", "wr", "wc").agg(
        F.count("*").alias("forest_pixels"), F.count_if("valid").alias("labelled"), F.count_if(F.col("valid") & (F.col("pred") == F.col("truth"))).alias("agreeing")
    )
    out = partial.where("labelled > 0").groupBy("region").agg(*[F.sum(c).alias(c) for c in ("forest_pixels", "labelled", "agreeing")])
    return out.withColumns(ratios())


def metrics_long(total: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value) rows of a one-row table, as the CSV report has them."""
    return total.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
