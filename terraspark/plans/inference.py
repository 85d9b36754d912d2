"""From band values to a class map: the whole-table form of tile and folder inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import harmonics as H
from ..functions import spectral as S
from ..operators import harmonic, model, neighbourhood


def feature_table(obs: DataFrame, dem: DataFrame | None = None, harmonics: int = 2, keys: Sequence[str] = ("pixel_id",), mask: Column | None = None, t0=None, max_iter: int = 1) -> DataFrame:
    """Features of each pixel from raw bands: one shuffle for the fit, one join for the elevation (0 if missing).

    ``max_iter`` iterations of the re-weighted fit are made.
    """
    x = S.to_reflectance(harmonic.time_axis(obs, t0=t0))
    weight = S.quality_weight(mask=mask)
    x = S.with_indices(x.withColumn("weight", weight))
    out = harmonic.features(x, harmonics, keys, F.col("weight"), max_iter)
    if dem is None:
        return out.withColumn("elevation", F.lit(0.0))
    return out.join(dem.select(*keys, F.col("elevation").cast("double").alias("elevation")), list(keys), "left").withColumn("elevation", F.coalesce("elevation", F.lit(0.0)))


def probability_map(obs: DataFrame, dem: DataFrame | None = None, nodes=model.DEMO_TREES, keys: Sequence[str] = ("pixel_id",), **options) -> DataFrame:
    """``keys, n_obs, probability, prob_u8, class`` of each pixel."""
    scored = model.score(feature_table(obs, dem, keys=keys, **options), nodes)
    scored = scored.withColumn("prob_u8", codec.probability_to_byte(F.col("probability")))
    return scored.select(*keys, "n_obs", "probability", "prob_u8", codec.classify(F.col("prob_u8")).alias("class"))


def encoded_features(obs: DataFrame, harmonics: int = 2, keys: Sequence[str] = ("pixel_id",), t0=None, digits: int = 9) -> DataFrame:
    """First-generation feature rasters: indices with gaps as 0, amplitude, phase and offset of each in 16 bits."""
    x = S.with_indices(S.to_reflectance(harmonic.time_axis(obs, t0=t0)), fill_zero=True)
    fitted = harmonic.wls(x, keys, S.INDICES, harmonics)
    out = []
    for y in S.INDICES:
        for k in range(1, harmonics + 1):
            out += [codec.encode_unit(F.round(H.amplitude(k, y), digits)).alias(f"{y}_amplitude_h{k}"), codec.encode_phase(F.round(H.phase(k, y), digits)).alias(f"{y}_phase_h{k}")]
        out.append(codec.encode_unit(F.round(H.offset(harmonics, y), digits)).alias(f"{y}_offset"))
    return fitted.select(*keys, *out)


def decoded_features(encoded: DataFrame, harmonics: int = 2, keys: Sequence[str] = ("pixel_id",)) -> DataFrame:
    """Features for the model from encoded ones: amplitudes, cosines of phases, offsets, elevation 0."""
    out = []
    for y in S.INDICES:
        for k in range(1, harmonics + 1):
            out += [codec.decode_unit(F.col(f"{y}_amplitude_h{k}")).alias(f"{y}_amplitude_h{k}"), F.cos(codec.decode_phase(F.col(f"{y}_phase_h{k}"))).alias(f"{y}_cos_phase_h{k}")]
        out.append(codec.decode_unit(F.col(f"{y}_offset")).alias(f"{y}_offset"))
    return encoded.select(*keys, *out, F.lit(0.0).alias("elevation"))


def classify_encoded(encoded: DataFrame, nodes=model.DEMO_TREES, mode: str = "pred", keys: Sequence[str] = ("pixel_id",)) -> DataFrame:
    """The most probable class (``pred``: 1 or 2) or the probability in 0..255 (``proba``) of encoded features."""
    if mode not in ("pred", "proba"):
        raise ValueError(mode)
    scored = model.score(decoded_features(encoded, keys=keys), nodes)
    value = F.when(F.col("probability") > 0.5, 2).otherwise(1) if mode == "pred" else codec.probability_to_byte(F.col("probability"))
    return scored.select(*keys, value.alias("value"))


def classify_with_aspect(encoded: DataFrame, dem: DataFrame, resolution: float, nodes=model.DEMO_TREES, sigma: float = 3.0) -> DataFrame:
    """First-generation classification of (pixel_id, r, c) with elevation from ``dem`` (r, c, elevation), and the slope's direction beside it."""
    smooth = neighbourhood.gradient(neighbourhood.gaussian(dem, "elevation", sigma), "elevation", resolution)
    directions = smooth.select("r", "c", neighbourhood.aspect(F.col("dy"), F.col("dx")).alias("aspect"))
    features = decoded_features(encoded).drop("elevation").join(encoded.select("pixel_id", "r", "c"), "pixel_id")
    features = features.join(dem.select("r", "c", F.col("elevation").cast("double").alias("elevation")), ["r", "c"], "left").withColumn("elevation", F.coalesce("elevation", F.lit(0.0)))
    scored = model.score(features, nodes).select("pixel_id", "r", "c", F.when(F.col("probability") > 0.5, 2).otherwise(1).alias("value"))
    return scored.join(directions, ["r", "c"], "left")


def remaining_inference(obs: DataFrame, state: DataFrame, tile: str = "tile_idx", **options) -> DataFrame:
    """Inference over the tiles that aren't completed; failed tiles simply stay in the remainder."""
    todo = obs.join(state.where("completed = 1").select(tile).distinct(), tile, "left_anti")
    return probability_map(todo, keys=(tile, "pixel_id"), **options)


def random_forest(features: DataFrame, label: str, inputs: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 7):
    """A pyspark.ml random forest fitted on a feature table (label 0/1), ready to ``transform``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=list(inputs), outputCol="features_"), RandomForestClassifier(labelCol=label, featuresCol="features_", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(features)
