"""Vector layers: box range joins, rasterisation, dissolve and file screening."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersects(a: str, b: str) -> Column:
    """Closed boxes (x0, y0, x1, y1) with prefixes: touching counts."""
    c = F.col
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{a}x1") >= c(f"{b}x0")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{a}y1") >= c(f"{b}y0"))


def _buckets(prefix: str, size: int) -> Column:
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size).cast("int"), F.floor(F.col(high) / size).cast("int"))
    return F.explode(F.flatten(F.transform(span(f"{prefix}x0", f"{prefix}x1"), lambda x: F.transform(span(f"{prefix}y0", f"{prefix}y1"), lambda y: F.struct(x.alias("bx"), y.alias("by"))))))


def bucket_size(boxes: DataFrame, prefix: str, least: int = 16) -> int:
    """A bucket side of twice the boxes' mean extent, so that a box lies in few buckets whatever the units."""
    mean = boxes.agg(F.avg((F.col(f"{prefix}x1") - F.col(f"{prefix}x0") + F.col(f"{prefix}y1") - F.col(f"{prefix}y0")) / 2)).first()[0]
    return max(least, math.ceil(2 * (mean or 0)))


#: Buckets that a box may span before it is joined apart from the others.
SPAN_MOST = 64


def box_join(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_", size: int | None = None, salts: int = 8) -> DataFrame:
    """All pairs of intersecting boxes: an equi-join on grid buckets, each pair kept in its first common bucket.

    Without ``size`` buckets follow the boxes' mean extent.  The left rows of a bucket are
    dealt to ``salts`` parts, and the right ones go to each, so that a crowded bucket is
    no single task.  Boxes of more than ``SPAN_MOST`` buckets use buckets of 16 times the
    side on both sides, and so on upward: no box is exploded into more than that.
    """
    size = size or max(bucket_size(left, a), bucket_size(right, b))
    spans = lambda p, s: (F.floor(F.col(f"{p}x1") / s) - F.floor(F.col(f"{p}x0") / s) + 1) * (F.floor(F.col(f"{p}y1") / s) - F.floor(F.col(f"{p}y0") / s) + 1)
    wide = lambda p, s: spans(p, s) > SPAN_MOST
    both = lambda x, y, s: _bucket_join(x, y, a, b, s, salts)
    out = both(left.where(~wide(a, size)), right.where(~wide(b, size)), size)
    if left.where(wide(a, size)).isEmpty() and right.where(wide(b, size)).isEmpty():
        return out
    # Pairs with a wide box on either side.
    out = out.unionByName(box_join(left.where(wide(a, size)), right, a, b, 16 * size, salts))
    return out.unionByName(box_join(left.where(~wide(a, size)), right.where(wide(b, size)), a, b, 16 * size, salts))


def _bucket_join(left: DataFrame, right: DataFrame, a: str, b: str, size: int, salts: int) -> DataFrame:
    lb = left.withColumn("bucket", _buckets(a, size)).withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    rb = right.withColumn("bucket", _buckets(b, size)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    first = (F.col("bucket.bx") == F.floor(F.greatest(f"{a}x0", f"{b}x0") / size)) & (F.col("bucket.by") == F.floor(F.greatest(f"{a}y0", f"{b}y0") / size))
    return lb.join(rb, ["bucket", "salt"]).where(intersects(a, b) & first).drop("bucket", "salt")


def rasterize(boxes: DataFrame, width: int, height: int, fill: int = 0) -> DataFrame:
    """``r, c, value`` of the cells that boxes touch (half-open in cells); the later ``seq`` wins.

    Boxes are exploded row by row and only the winner of each cell leaves a task.
    """
    cells = _cells(boxes, width, height)
    return cells.groupBy("r", "c").agg(F.max_by("value", "seq").alias("value")).withColumn("value", F.coalesce("value", F.lit(fill)))


def _cells(boxes: DataFrame, width: int, height: int) -> DataFrame:
    x0, x1 = F.greatest("x0", F.lit(0)), F.least(F.col("x1"), F.lit(width)) - 1
    y0, y1 = F.greatest("y0", F.lit(0)), F.least(F.col("y1"), F.lit(height)) - 1
    inside = boxes.where((x0 <= x1) & (y0 <= y1))
    rows = inside.select("seq", "value", "x0", "x1", F.explode(F.sequence(y0, y1)).alias("r"))
    return rows.select("seq", "value", "r", F.explode(F.sequence(x0, x1)).alias("c"))


def rasterize_polygons(polygons: DataFrame, width: int, height: int, fill: int = 0) -> DataFrame:
    """``r, c, value`` of all cells that polygons touch; the later ``seq`` wins.

    ``ring`` is a closed array of (x, y) in cells, rows downward.  A cell (r, c) spans
    [c, c + 1) x [r, r + 1).  It is touched if its centre is inside (even and odd
    crossings) or an edge runs through it.  Polygons are cut row by row into spans, so
    a large one is many small rows, and only the winner of each cell leaves a task.
    """
    ys = F.transform("ring", lambda p: p["y"])
    first, last = F.greatest(F.floor(F.array_min(ys)).cast("int"), F.lit(0)), F.least(F.floor(F.array_max(ys)).cast("int"), F.lit(height - 1))
    edges = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.element_at("ring", i + 1).alias("a"), F.element_at("ring", i + 2).alias("b")))
    rows = polygons.where((F.size("ring") >= 4) & (first <= last)).select("seq", "value", edges.alias("edges"), F.explode(F.sequence(first, last)).alias("r"))
    top, bottom, middle = F.col("r").cast("double"), F.col("r") + 1.0, F.col("r") + 0.5
    at = lambda e, y: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])

    def touched(e: Column) -> Column:
        low, high = F.greatest(F.least(e["a"]["y"], e["b"]["y"]), top), F.least(F.greatest(e["a"]["y"], e["b"]["y"]), bottom)
        flat = e["a"]["y"] == e["b"]["y"]
        p, q = F.when(flat, e["a"]["x"]).otherwise(at(e, low)), F.when(flat, e["b"]["x"]).otherwise(at(e, high))
        return F.struct(F.floor(F.least(p, q)).cast("int").alias("from"), F.floor(F.greatest(p, q)).cast("int").alias("to"))

    # An edge that only ends at a row's lower border belongs to the row below.
    runs = F.transform(F.filter("edges", lambda e: (F.least(e["a"]["y"], e["b"]["y"]) < bottom) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= top)), touched)
    crossing = F.filter("edges", lambda e: (e["a"]["y"] <= middle) != (e["b"]["y"] <= middle))
    xs = F.array_sort(F.transform(crossing, lambda e: at(e, middle)))
    rows = rows.withColumns({"runs": runs, "xs": xs})
    # Centres between the crossings 2i and 2i + 1.
    pairs = F.when(F.size("xs") < 2, F.expr("array()").cast("array<struct<from:int,to:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)),
            lambda i: F.struct(F.ceil(F.element_at("xs", i + 1) - 0.5).cast("int").alias("from"), (F.ceil(F.element_at("xs", i + 2) - 0.5) - 1).cast("int").alias("to")),
        )
    )
    spans = rows.select("seq", "value", "r", F.explode(F.concat("runs", pairs)).alias("s"))
    start, end = F.greatest(F.col("s.from"), F.lit(0)), F.least(F.col("s.to"), F.lit(width - 1))
    cells = spans.where(start <= end).select("seq", "value", "r", F.explode(F.sequence(start, end)).alias("c"))
    return cells.groupBy("r", "c").agg(F.max_by("value", "seq").alias("value")).withColumn("value", F.coalesce("value", F.lit(fill)))


def dissolve_regions(polygons: DataFrame, code: str, order: str, *attributes: str) -> DataFrame:
    """One row for each first letter of ``code`` but the first of them: the attributes of its first row and the number of parts.

    With ``r, c`` cells of the parts (``rasterize_polygons`` by part) a region's area is the
    union of theirs: ``region_cells``.
    """
    keyed = polygons.withColumn("key", F.substring(code, 1, 1))
    out = keyed.groupBy("key").agg(*[F.min_by(a, order).alias(a) for a in attributes], F.count("*").alias("parts"))
    smallest = keyed.agg(F.min("key").alias("least"))
    return out.join(F.broadcast(smallest), F.col("key") > F.col("least")).drop("least")


def region_cells(cells: DataFrame, key: str) -> DataFrame:
    """The union of the parts' cells, each once: a dissolved geometry on the grid."""
    return cells.select(key, "r", "c").distinct()


def dissolve(df: DataFrame, key: str, order: str, *attributes: str) -> DataFrame:
    """One row a key: the attributes of its first row, the joint bounds and the number of parts."""
    return df.groupBy(key).agg(
        *[F.min_by(a, order).alias(a) for a in attributes], F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("parts")
    )


def overlap_percent(a: str, extent: tuple[float, float, float, float]) -> Column:
    """Share of a box inside an extent (x0, y0, x1, y1), in percent."""
    x0, y0, x1, y1 = (F.col(f"{a}{k}") for k in ("x0", "y0", "x1", "y1"))
    w = F.greatest(F.least(x1, F.lit(extent[2])) - F.greatest(x0, F.lit(extent[0])), F.lit(0))
    h = F.greatest(F.least(y1, F.lit(extent[3])) - F.greatest(y0, F.lit(extent[1])), F.lit(0))
    return 100.0 * (w * h) / ((x1 - x0) * (y1 - y0))


def screen(files: DataFrame, extent: tuple[float, float, float, float], least_percent: float = 0.001) -> DataFrame:
    """One status a file: outside_bounds, empty_file or valid; needs ``nonzero_percent``."""
    overlap = overlap_percent("", extent)
    status = F.when(overlap <= 0, "outside_bounds").when(F.col("nonzero_percent") < least_percent, "empty_file").otherwise("valid")
    return files.withColumns({"overlap_percent": overlap, "status": status})


def polygon_geojson(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A GeoJSON feature of a box's closed ring."""
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry")))
