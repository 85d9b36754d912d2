"""Comparison of a class map with several reference maps."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare
from ..operators.lineage import cut

#: Fixed names of the eco-regions 1 to 11.
REGIONS = {
    1: "Alps",
    2: "Central Massif",
    3: "Corsica",
    4: "Greater Crystalline and Oceanic West",
    5: "Greater Semi-Continental East",
    6: "Jura",
    7: "Mediterranean",
    8: "Oceanic Southwest",
    9: "Pyrenees",
    10: "Semi-Oceanic North Center",
    11: "Vosges",
}
MAP1 = {1: "deciduous", 2: "evergreen"}
MAP2 = {1: "deciduous", 2: "evergreen", 255: "nodata"}


def pairs(pixels: DataFrame) -> DataFrame:
    return compare.labelled_pairs(pixels, MAP1, MAP2, REGIONS)


def align(map1: DataFrame, map2: DataFrame, forest: DataFrame, eco: DataFrame, on=("r", "c")) -> DataFrame:
    """Four rasters joined by position; equal keys keep one partitioning through all three joins."""
    keys = list(on)
    return map1.join(map2, keys).join(forest, keys).join(eco, keys)


def against(references: Mapping[str, DataFrame]) -> DataFrame:
    """Agreement and coverage by region and in all, for each named reference."""
    out = None
    for prefix, pixels in references.items():
        one = compare.by_region(pairs(pixels)).withColumn("prefix", F.lit(prefix))
        out = one if out is None else out.unionByName(one)
    return out


def against_each(references: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The same, each reference by itself: one that can't be read or compared gives a line of its error, and the others their rows."""
    out, errors = None, {}
    for prefix, read in references.items():
        try:
            one = compare.by_region(pairs(read())).withColumn("prefix", F.lit(prefix))
            one = cut(one)
        except Exception as e:  # noqa: BLE001  whatever a reference's files do
            errors[prefix] = type(e).__name__
            continue
        out = one if out is None else out.unionByName(one)
    return out, errors
