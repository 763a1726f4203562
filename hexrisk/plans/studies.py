"""Training with evaluation, threshold studies and coverage reports."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hexrisk.operators.evaluate import (
    FINE_THRESHOLDS,
    REPORT_THRESHOLDS,
    best_point,
    cv_summary,
    pick_winner,
    ranking_metrics,
    running_best,
    threshold_sweep,
)
from hexrisk.operators.boosting import BoostedTrees, Lane, boost_lanes
from hexrisk.operators.labels import FOLDS, TRAIN_SHARE, filter_active, time_holdout, time_series_folds, with_time_position
from hexrisk.operators.model import feature_names, predict, save_model, train_gbt, with_balance_weight
from hexrisk.operators.summaries import missing_days, profile
from hexrisk.session import cut_lineage, stored
from hexrisk.sources.tables import write_metrics

VALIDATION_SHARE = 0.9


def _with_stop_rows(train: DataFrame) -> DataFrame:
    """Mark the last tenth of the training rows by time: they decide when boosting stops, test rows never do."""
    ordered = with_time_position(train.drop("position", "n_rows"))
    return ordered.withColumn("_stop", F.col("position") >= F.floor(F.col("n_rows") * F.lit(VALIDATION_SHARE)))


def fit_standard(train: DataFrame, features: list[str], **settings) -> BoostedTrees:
    """Class-balanced boosted trees with early stopping."""
    return train_gbt(_with_stop_rows(with_balance_weight(train)), features, "weight", "_stop", **settings)


@dataclass
class Study:
    """What a training job found: the models, and the tables of its report."""

    models: dict[str, BoostedTrees]
    folds: DataFrame
    cv: DataFrame
    holdout: DataFrame
    points: DataFrame
    winner: DataFrame


def _lanes(rows: DataFrame, folds: int) -> dict[str, Lane]:
    """The models of a study: one per fold, and the two that are compared on the hold-out.

    Rows are in time order, so each model learns from a prefix; its last tenth decides when a balanced one stops.
    """
    sizes = rows.agg(F.max("n_rows").alias("n"), *[F.count_if(F.col("block") < f).alias(f"b{f}") for f in range(1, folds + 1)]).first()
    ends = {f"fold {f}": sizes[f"b{f}"] for f in range(1, folds + 1)}
    ends["standard"] = ends["focal"] = math.floor((sizes["n"] or 0) * TRAIN_SHARE)
    place = F.col("position")
    counts = rows.agg(*[F.count_if((place < end) & (F.col("label") == y)).alias(f"{name} {y}") for name, end in ends.items() for y in (0, 1)]).first()
    lanes = {}
    for name, end in ends.items():
        if name == "focal":
            lanes[name] = Lane("focal", place < end)
        else:
            ratio = counts[f"{name} 0"] / counts[f"{name} 1"] if counts[f"{name} 1"] else 1.0
            weight = F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0))
            lanes[name] = Lane("logistic", place < end, weight, place >= math.floor(end * VALIDATION_SHARE))
    return lanes


def train_and_evaluate(features_table: DataFrame, folds: int = FOLDS, **settings) -> Study:
    """Cross-validation under expanding windows, hold-out comparison of both models and the winner.

    All models are trained side by side, in the same jobs.
    """
    names = feature_names(features_table.columns)
    active = filter_active(features_table).select("event_date", "q", "r", "label", *names)
    rows = stored(time_series_folds(active, folds), "folds", "block")
    models = boost_lanes(rows, names, _lanes(rows, folds), at_hand=True, **settings)
    held = [predict(rows.filter(F.col("block") == f), models[f"fold {f}"]).select("label", "strategic_score", F.lit(f).alias("fold")) for f in range(1, folds + 1)]
    by_fold = cut_lineage(ranking_metrics(cut_lineage(reduce(DataFrame.unionByName, held)), ["fold"]))
    test = time_holdout(rows).filter("part = 'test'")
    both = [predict(test, models[name]).select("event_date", "label", "strategic_score", F.lit(name).alias("model")) for name in ("standard", "focal")]
    scored = cut_lineage(reduce(DataFrame.unionByName, both))
    points = best_point(threshold_sweep(scored, REPORT_THRESHOLDS, ["model"]), ["model"])
    return Study(models, by_fold, cv_summary(by_fold), ranking_metrics(scored, ["model"]), points, pick_winner(points))


def report(study: Study) -> DataFrame:
    """The study's figures, a row per subject and metric."""

    def long(df: DataFrame, subject: Column, *metrics: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select(subject.alias("subject"), F.explode(pairs).alias("p")).select("subject", "p.*")

    fold = F.concat(F.lit("fold "), F.col("fold").cast("string"))
    parts = [
        long(study.folds, fold, "roc_auc", "average_precision", "rows", "positives"),
        long(study.cv, F.lit("cross-validation"), *study.cv.columns),
        long(study.holdout, F.col("model"), "roc_auc", "average_precision", "rows", "positives"),
        long(study.points, F.col("model"), "threshold", "precision", "recall", "f1", "alerts_per_day"),
        long(study.winner, F.concat(F.lit("winner: "), F.col("model")), "threshold", "f1"),
    ]
    return reduce(DataFrame.unionByName, parts)


def publish(study: Study, folder: str) -> str:
    """Write both models, the winner once more as the production model, and the report; returns the winner's name.

    A hold-out on which no threshold raises an alert has no winner; the standard model then goes to production.
    """
    best = study.winner.select("model").first()
    name = best["model"] if best and best["model"] else "standard"
    for kind in ("standard", "focal"):
        save_model(study.models[kind], f"{folder}/{kind}")
    save_model(study.models[name], f"{folder}/production")
    write_metrics(report(study).coalesce(1), f"{folder}/report")
    return name


def threshold_study(scored: DataFrame, thresholds: tuple[float, ...] = FINE_THRESHOLDS, min_recall: float = 0.25) -> DataFrame:
    """Sweep on the last tenth by time, for all rows and for active rows only; rows of low recall are left out."""
    test = time_holdout(scored).filter("part = 'test'")
    # The number of days is that of the whole test part in both sweeps.
    span = test.agg(F.greatest(F.datediff(F.max("event_date"), F.min("event_date")), F.lit(1))).scalar()
    both = test.withColumn("scope", F.lit("all")).unionByName(filter_active(test).withColumn("scope", F.lit("active")))
    sweep = running_best(threshold_sweep(both, thresholds, ["scope"], days=False), ["scope"])
    return sweep.withColumn("alerts_per_day", F.col("alerts") / span).filter(F.col("recall") >= min_recall)


def coverage_report(stages: dict[str, DataFrame], start, end) -> DataFrame:
    """Per feed rows, cells, first and last day, and the number of missing days in a range."""
    parts = []
    for name, df in stages.items():
        gaps = missing_days(df, start, end).agg(F.count(F.lit(1)).alias("missing_days"))
        parts.append(profile(df).withColumns({"missing_days": gaps.scalar(), "stage": F.lit(name)}))
    return reduce(DataFrame.unionByName, parts)
