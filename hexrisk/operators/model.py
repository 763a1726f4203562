"""Feature lists, training and scoring of the cell-day classifier."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.functions.numbers import half_up
from hexrisk.operators.boosting import FOCAL_ALPHA, FOCAL_GAMMA, PROBABILITY_FLOOR, BoostedTrees, Lane, boost_lanes

# Feature groups.
BASE_FEATURES = [
    "event_count",
    "dangerous_count",
    "total_fatalities",
    "max_fatalities",
    "battle_count",
    "explosion_count",
    "vac_count",
    "riot_count",
    "population_best",
    "unique_actors",
    "dangerous_roll3d",
    "dangerous_roll7d",
    "dangerous_roll14d",
    "fatalities_roll3d",
    "fatalities_roll7d",
    "fatalities_roll14d",
    "event_roll3d",
    "event_roll7d",
    "event_roll14d",
    "dangerous_delta",
    "fatality_delta",
    "dangerous_velocity",
    "fatality_velocity",
    "neighbor_danger_avg",
    "neighbor_fatal_sum",
    "actor_pair_count",
    "actor_pair_delta",
    "actor_pair_velocity",
    "dangerous_lag1",
    "dangerous_lag2",
    "fatalities_lag1",
    "battle_lag1",
    "explosion_lag1",
]
NEWS_FEATURES = [
    "gdelt_event_count",
    "gdelt_avg_tone",
    "gdelt_min_goldstein",
    "gdelt_avg_goldstein",
    "gdelt_num_articles",
    "gdelt_hostility",
    "neighbor_gdelt_hostility_avg",
]
THERMAL_FEATURES = [
    "firms_hotspot_count",
    "firms_avg_frp",
    "firms_max_frp",
    "firms_spike",
    "neighbor_firms_spike_sum",
]
NEWS_CLASS_FEATURES = [
    "gdelt_protest_count",
    "gdelt_threaten_count",
    "gdelt_assault_count",
    "gdelt_fight_count",
    "gdelt_cameo_conflict",
    "neighbor_gdelt_protest_avg",
]
WEATHER_FEATURES = ["temp_max", "temp_anomaly_30d", "precip_mm", "precip_spike"]
OPTIONAL_FEATURES = NEWS_FEATURES + THERMAL_FEATURES + NEWS_CLASS_FEATURES + WEATHER_FEATURES
ALL_FEATURES = BASE_FEATURES + OPTIONAL_FEATURES

# Coefficients of the fixed logistic score used where a result must not depend on training.
LINEAR_INTERCEPT = -0.1
LINEAR_COEFFICIENTS = {
    "dangerous_roll7d": 1.6,
    "neighbor_danger_avg": 0.9,
    "gdelt_hostility": 0.5,
    "firms_spike": 0.3,
    "fatalities_roll14d": 0.02,
    "event_roll3d": 0.06,
}


def feature_names(columns: list[str]) -> list[str]:
    """Base features plus the optional ones the table has."""
    return [c for c in ALL_FEATURES if c in columns]


def align_features(df: DataFrame, wanted: list[str], keep: list[str] = ()) -> DataFrame:
    """The wanted features in order, as doubles; absent columns and nulls become 0."""
    have = set(df.columns)
    cols = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in wanted
    ]
    return df.select(*keep, *cols)


def linear_score(
    coefficients: dict[str, float] = LINEAR_COEFFICIENTS, intercept: float = LINEAR_INTERCEPT, digits: int = 4
) -> Column:
    """Logistic score with fixed coefficients, by default at the stored precision."""
    z = reduce(
        lambda total, item: total + F.lit(item[1]) * F.coalesce(F.col(item[0]).cast("double"), F.lit(0.0)),
        coefficients.items(),
        F.lit(intercept),
    )
    return half_up(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), digits)


def focal_weight(p: Column, y: Column, gamma: float = FOCAL_GAMMA, alpha: float = FOCAL_ALPHA) -> Column:
    """Weight of a row in the focal loss: hard rows count more."""
    clipped = F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0 - PROBABILITY_FLOOR))
    p_true = F.when(y == 1, clipped).otherwise(F.lit(1.0) - clipped)
    a_true = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return a_true * F.pow(F.lit(1.0) - p_true, F.lit(gamma))


def with_balance_weight(df: DataFrame, col: str = "weight") -> DataFrame:
    """Weight positives by negatives over positives."""
    counts = df.agg(
        F.try_divide(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("_w")
    )
    ratio = F.coalesce(counts.scalar(), F.lit(1.0))
    return df.withColumn(col, F.when(F.col("label") == 1, ratio).otherwise(F.lit(1.0)))


def train_gbt(df: DataFrame, features: list[str], weight: str | None = None, validation: str | None = None, **settings) -> BoostedTrees:
    """Boosted trees on ``label``; ``validation`` names a boolean column of rows that only decide when to stop."""
    lane = Lane(weight=F.col(weight) if weight else None, stop=F.col(validation) if validation else None)
    return boost_lanes(df, features, {"standard": lane}, **settings)["standard"]


def train_focal(df: DataFrame, features: list[str], **settings) -> BoostedTrees:
    """Boosted trees on the focal loss; all rounds are run."""
    return boost_lanes(df, features, {"focal": Lane(loss="focal")}, **settings)["focal"]


def n_trees(model: BoostedTrees) -> int:
    return len(model.trees)


def model_features(model: BoostedTrees) -> list[str]:
    """The features a model was trained on, in its order."""
    return list(model.features)


def predict(df: DataFrame, model: BoostedTrees, col: str = "strategic_score", digits: int | None = None) -> DataFrame:
    """Add the probability of the positive class. The model's own features are used; those the table lacks count as 0."""
    have = set(df.columns)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in model_features(model)]

    binned = model.binned()

    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(1.0 / (1.0 + np.exp(-model.margins(np.stack([c.to_numpy() for c in columns]).T, binned))))

    p = F.pandas_udf(probability, "double")(*filled or [F.lit(0.0)])
    return df.withColumn(col, half_up(p, digits) if digits else p)


def save_model(model: BoostedTrees, path: str) -> None:
    """A model is a table of its nodes."""
    model.table(SparkSession.active()).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str) -> BoostedTrees:
    return BoostedTrees.of_table(SparkSession.active().read.parquet(path))


def feature_importance(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """Share of each feature of the model in the gain of all splits, falling."""
    rows = [(name, float(v)) for name, v in zip(model_features(model), model.gains(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
