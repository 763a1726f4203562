"""Tables that many named queries read, built once per session from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexrisk.functions.numbers import half_up
from hexrisk.functions.risk import strategic_tier
from hexrisk.operators.labels import filter_active, time_holdout
from hexrisk.operators.model import feature_names, linear_score, train_focal
from hexrisk.operators.summaries import latest_per_cell
from hexrisk.plans.features import build_features
from hexrisk.plans.scoring import backtest_days, score_rows
from hexrisk.plans.studies import fit_standard, train_and_evaluate
from hexrisk.session import scratch_path
from hexrisk.sources import derived
from hexrisk.sources.tables import read_feature_table, write_feature_table

# Kept per session and folder: a table that changes meanwhile is not noticed.
_built: dict[tuple, str] = {}
_models: dict[tuple, object] = {}


def _stored(spark: SparkSession, root: str, name: str, build, by_day: bool) -> DataFrame:
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _built:
        path = scratch_path(spark, name)
        if by_day:
            write_feature_table(build(), path)
        else:
            build().write.parquet(path)
        _built[key] = path
    return read_feature_table(spark, _built[key])


def fresh_features(spark: SparkSession, root: str, keep_tail: bool = False) -> DataFrame:
    return build_features(
        derived.conflict(spark, root),
        derived.news(spark, root),
        derived.thermal(spark, root),
        derived.weather(spark, root),
        keep_tail=keep_tail,
    )


def features(spark: SparkSession, root: str) -> DataFrame:
    """Feature table with the unlabelled tail."""
    return _stored(spark, root, "features", lambda: fresh_features(spark, root, keep_tail=True), True)


def labelled(spark: SparkSession, root: str) -> DataFrame:
    return features(spark, root).filter("label is not null")


def labelled_scores(spark: SparkSession, root: str) -> DataFrame:
    return labelled(spark, root).withColumn("strategic_score", linear_score(digits=9))


def history(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all cells on all days."""
    return _stored(spark, root, "history", lambda: backtest_days(features(spark, root), F.lit("1900-01-01"), F.lit("2999-01-01")), True)


def fresh_scores(spark: SparkSession, root: str) -> DataFrame:
    table = features(spark, root)
    columns = [c for c in table.columns if c not in ("cell", "event_date", "label")]
    return score_rows(latest_per_cell(table, columns), F.to_timestamp("event_date"))


def scores(spark: SparkSession, root: str) -> DataFrame:
    """Current state."""
    return _stored(spark, root, "scores", lambda: fresh_scores(spark, root), False)


def current_scores(spark: SparkSession, root: str) -> DataFrame:
    """State of all cells on the newest day of the stored history; only that day's folder is read."""
    table = history(spark, root)
    return table.filter(F.col("event_date") == F.lit(table.agg(F.max("event_date")).first()[0]))


def tiered(df: DataFrame) -> DataFrame:
    return df.withColumn("strategic_tier", strategic_tier(F.col("strategic_score")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns half up."""
    return df.select(
        *[half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def training_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training and test rows of the hold-out, and the feature names."""
    parts = time_holdout(filter_active(labelled(spark, root)))
    return parts.filter("part = 'train'"), parts.filter("part = 'test'"), feature_names(parts.columns)


def study(spark: SparkSession, root: str):
    """Training with evaluation by the library's settings, run once per session."""
    key = (spark.sparkContext.applicationId, root, "study")
    if key not in _models:
        _models[key] = train_and_evaluate(labelled(spark, root))
    return _models[key]


def model(spark: SparkSession, root: str, kind: str):
    """A model of the hold-out (``standard`` or ``focal``) with the library's settings, fitted once per session."""
    key = (spark.sparkContext.applicationId, root, kind)
    if key not in _models:
        train, _, names = training_parts(spark, root)
        _models[key] = (fit_standard if kind == "standard" else train_focal)(train, names)
    return _models[key]
