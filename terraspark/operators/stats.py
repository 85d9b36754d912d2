"""Statistics of bands, indices and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows brought to the driver at once when an order statistic is sought.
FEW = 10_000
_BINS = 1024


def order_values(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of a column's non-null values, exactly.

    Counts of equal bins say in which bin a rank lies; it is divided again until it
    holds few rows or one value.  A step brings a thousand counts to the driver, and
    no task orders the column.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    out, todo = {}, [(low, high, 0, n, sorted({r for r in ranks if 0 <= r < n}))]
    while todo:
        low, high, below, n, wanted = todo.pop()
        if not wanted:
            continue
        inside = x.where((F.col("x") >= low) & (F.col("x") <= high))
        if low == high:
            out |= dict.fromkeys(wanted, low)
        elif n <= FEW:
            values = sorted(r[0] for r in inside.collect())
            out |= {r: values[r - below] for r in wanted}
        else:
            place = F.least(F.floor((F.col("x") - low) / (high - low) * _BINS), F.lit(_BINS - 1))
            for b in sorted(inside.groupBy(place.alias("b")).agg(F.min("x"), F.max("x"), F.count("*")).collect()):
                todo.append((b[1], b[2], below, b[3], [r for r in wanted if below <= r < below + b[3]]))
                below += b[3]
    return out


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation over a whole column, without a task that orders it."""
    n = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").count()
    if not n:
        return [None] * len(shares)
    at = [p * (n - 1) for p in shares]
    values = order_values(df, column, [r for p in at for r in (int(p), min(int(p) + 1, n - 1))])
    return [values[int(p)] + (p - int(p)) * (values[min(int(p) + 1, n - 1)] - values[int(p)]) for p in at]


def _mean(x: Column, digits: int) -> Column:
    """Mean of a group's doubles, rounded half away from zero, the same for any order of the rows.

    Values are summed as decimals of 18 places, so that a mean halfway between two results
    is not moved by the sum's rounding.  Where those don't hold the values or their sum, doubles are summed.
    """
    held = (F.min(x) > -1e20) & (F.max(x) < 1e20)
    exact = F.when(held, F.try_sum(x.try_cast("decimal(38,18)")) / F.count(x))
    return F.coalesce(F.round(exact, digits).cast("double"), F.round(F.avg(x), digits))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """One row for each group and column: counts, range, mean, population deviation, median, shares in percent.

    All columns are aggregated in one pass over the rows; only the groups' results are
    turned into rows.  Infinite values count as such and leave range and mean infinite.
    """
    total = F.count("*")
    share = lambda condition: F.round(100.0 * F.count_if(condition) / total, digits)
    # Without groups a column is one group: its median is sought by bins.
    middle = {} if by else {c: percentiles(df, c, [0.5])[0] for c in columns}

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        median = F.percentile(x, F.lit(0.5)) if by else F.lit(middle[c]).cast("double")
        return F.struct(
            F.lit(c).alias("name"), total.alias("n"), F.count(x).alias("n_valid"), F.round(F.min(x), digits).alias("low"), F.round(F.max(x), digits).alias("high"), _mean(x, digits).alias("mean"),
            F.round(F.stddev_pop(x), digits).alias("deviation"), F.round(median, digits).alias("median"), F.count_if(x == 0).alias("zeros"), share(x.isNull()).alias("null_percent"),
            share((x < 0) | (x > 1)).alias("outside_percent"), share(F.abs(x) == float("inf")).alias("inf_percent"), share(F.abs(x) < 1e-6).alias("near_zero_percent"),
        )

    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.array(*[one(c) for c in columns]).alias("all_")).select(*by, F.inline("all_"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts of equal bins; the top edge belongs to the last bin, values outside are left out."""
    x = F.col(column)
    return df.where((x >= low) & (x <= high)).groupBy(bin_of(x, low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 50) -> DataFrame:
    a, b = F.col(x), F.col(y)
    inside = df.where((a >= x_range[0]) & (a <= x_range[1]) & (b >= y_range[0]) & (b <= y_range[1]))
    return inside.groupBy(bin_of(a, *x_range, bins).alias("x_bin"), bin_of(b, *y_range, bins).alias("y_bin")).agg(F.count("*").alias("n"))


def stretch(df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Each column scaled from its two percentiles to [0, 1]."""
    out = {}
    for c in columns:
        span = percentiles(df, c, [low, high])
        if span[0] is None or span[0] == span[1]:
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest((F.col(c) - span[0]) / (span[1] - span[0]), F.lit(0.0)), F.lit(1.0)))
    return df.withColumns(out)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column scaled to [0, 1] by its extremes, which are one row."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    span = lambda c: (ends[f"high_{c}"] or 0.0) - (ends[f"low_{c}"] or 0.0)
    return df.withColumns({c: ((F.col(c) - F.lit(ends[f"low_{c}"])) / span(c)) if span(c) else F.lit(None).cast("double") for c in columns})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of distinct values; the share's window runs over the counts, not the rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def band_roles(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """``name, high, mean, role``: a guess at each band's role from its top and mean of non-zero values; bands without any are left out.

    Fixed thresholds: a top above 0.8 is a visible or near infrared band, told apart by
    means of 0.1 and 0.15; one below 0.5 is short-wave infrared.
    """
    x = {c: F.when(F.col(c) != 0, F.col(c).cast("double")) for c in columns}
    rows = df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.max(v).alias("high"), F.avg(v).alias("mean")) for c, v in x.items()]).alias("all_")).select(F.inline("all_")).where("high is not null")
    visible = F.when(F.col("mean") < 0.1, "blue or green").when(F.col("mean") < 0.15, "red").otherwise("near infrared")
    role = F.when(F.col("high") > 0.8, visible).when(F.col("high") < 0.5, "short-wave infrared").otherwise("uncertain")
    return rows.select("name", F.round("high", digits).alias("high"), F.round("mean", digits).alias("mean"), role.alias("role"))


def guards(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each group and column whether it is all null and whether it is all zero."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "name", "x")
    return long.groupBy(*by, "name").agg(F.bool_and(F.col("x").isNull()).alias("all_null"), F.coalesce(F.bool_and(F.coalesce(F.col("x"), F.lit(0.0)) == 0), F.lit(True)).alias("all_zero"))


def joint_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value over several columns, for one colour scale."""
    ends = df.agg(F.min(F.least(*columns)).alias("low"), F.max(F.greatest(*columns)).alias("high")) if len(columns) > 1 else df.agg(F.min(columns[0]).alias("low"), F.max(columns[0]).alias("high"))
    return ends
