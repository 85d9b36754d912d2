"""New acquisitions folded into the sums of the harmonic fit as a stream (an extension).

The normal equations are sums, so they can be kept by a stateful grouped aggregate;
the first date must be fixed beforehand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import harmonics as H
from ..functions import spectral as S
from ..operators.lineage import shared_dir


def folded_sums(obs: DataFrame, t0, y: str = "ndvi", harmonics: int = 2) -> DataFrame:
    """Sums of each pixel over a static or streaming table of raw observations."""
    x = S.with_indices(S.to_reflectance(obs.withColumn("t", H.year_fraction(F.col("obs_date"), F.lit(t0).cast("date")))))
    x = x.withColumn("w_", F.when(F.col(y).isNull(), F.lit(0.0)).otherwise(F.lit(1.0)))
    sums = H.normal_sums(2 * harmonics + 1, "w_", {y: f"coalesce({y}, 0D)"})
    return H.with_basis(x, harmonics).groupBy("pixel_id").agg(*[F.expr(e).alias(c) for c, e in sums.items()], F.count_if(F.col("w_") > 0).alias("n_obs"))


def fit(sums: DataFrame, y: str = "ndvi", harmonics: int = 2) -> DataFrame:
    n = 2 * harmonics + 1
    return H.solve(sums, n, [y], ["pixel_id", "n_obs"], f"n_obs >= {n}")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream of complete aggregates over what is there now; state and result lie in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        # Complete mode: each batch is the whole result, and a repeated batch overwrites itself.
        batch.write.mode("overwrite").parquet(f"{path}/result/{number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{path}/result/{last['batchId'] if last else 0}")


def by_period(obs: DataFrame, time: str = "obs_time", late: str = "30 days", length: str = "60 days") -> DataFrame:
    """Observations and clear share in two-monthly windows with a watermark, for static or streaming tables."""
    x = obs.withWatermark(time, late) if obs.isStreaming else obs
    return x.groupBy(F.window(time, length), "pixel_id").agg(F.count("*").alias("n"), F.avg(F.when(S.is_flagged(F.col("flg")), 0.0).otherwise(1.0)).alias("clear"))
