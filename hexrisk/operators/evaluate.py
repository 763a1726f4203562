"""Ranking and threshold metrics of scored, labelled rows.

Everything starts from the counts per distinct exact score. Running sums over falling scores are made within ranges of
scores plus the sums of the ranges above, so no task holds all scores of a model or fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Score ranges per unit; a power of two, so that ranges never cut across the order of scores.
RANGES = 1024
# Threshold grids of the training report and of the two offline studies.
REPORT_THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(18))
FINE_THRESHOLDS = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))
COARSE_THRESHOLDS = tuple(round(0.10 * i, 2) for i in range(1, 10))


def score_counts(df: DataFrame, by: list[str] = (), score: str = "strategic_score", label: str = "label") -> DataFrame:
    """Rows and positives per distinct score."""
    keyed = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("y"))
    return keyed.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


_ALL = "_all"


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Group columns, with a constant standing in when there are none."""
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def running_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``upto_n`` and ``upto_pos``: rows and positives with this score or a higher one."""
    ranged = counts.withColumn("_range", F.floor(F.col("score") * F.lit(float(RANGES))))
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above{c}") for c in ("_n", "_pos")])
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("score"))
    own = ranged.withColumns({"upto_n": F.sum("n").over(inside), "upto_pos": F.sum("pos").over(inside)}).join(sums, [*keys, "_range"])
    both = {"upto_n": F.col("upto_n") + F.col("_above_n"), "upto_pos": F.col("upto_pos") + F.col("_above_pos")}
    return own.withColumns(both).drop("_range", "_above_n", "_above_pos")


def ranking_metrics(df: DataFrame, by: list[str] = (), **cols: str) -> DataFrame:
    """ROC-AUC and average precision from one pass over the rows, with the counts of rows and positives.

    ROC-AUC is the chance that a positive outranks a negative, ties counting one half. Average precision is the sum of
    precision times gain in recall over falling thresholds, equal scores taken together. Null when a class is missing.
    """
    keyed, keys = _keyed(df, by)
    above = F.col("upto_pos") - F.col("pos")
    neg = F.col("n") - F.col("pos")
    steps = running_counts(score_counts(keyed, keys, **cols), keys).select(
        *keys,
        "pos",
        neg.alias("neg"),
        (neg * (above + F.col("pos") / F.lit(2.0))).alias("wins"),
        (F.col("pos") * (F.col("upto_pos") / F.col("upto_n"))).alias("gain"),
    )
    pairs = (F.sum("pos") * F.sum("neg")).cast("double")
    return (
        steps.groupBy(*keys)
        .agg(
            F.try_divide(F.sum("wins"), pairs).alias("roc_auc"),
            F.try_divide(F.sum("gain"), F.sum("pos").cast("double")).alias("average_precision"),
            (F.sum("pos") + F.sum("neg")).alias("rows"),
            F.sum("pos").alias("positives"),
        )
        .drop(_ALL)
    )


def roc_auc(df: DataFrame, by: list[str] = (), **cols: str) -> DataFrame:
    return ranking_metrics(df, by, **cols).drop("average_precision", "rows", "positives")


def average_precision(df: DataFrame, by: list[str] = (), **cols: str) -> DataFrame:
    return ranking_metrics(df, by, **cols).drop("roc_auc", "rows", "positives")


def threshold_sweep(
    df: DataFrame, thresholds: tuple[float, ...] = REPORT_THRESHOLDS, by: list[str] = (), days: bool = True, **cols: str
) -> DataFrame:
    """Precision, recall, F1 and alerts per day at each threshold that raises any alert."""
    keyed, keys = _keyed(df, by)
    counts = score_counts(keyed, keys, **cols)
    grid = F.array(*[F.lit(t) for t in thresholds])
    flagged = counts.select(
        *keys, "n", "pos", F.explode(F.filter(grid, lambda t: t <= F.col("score"))).alias("threshold")
    )
    hits = flagged.groupBy(*keys, "threshold").agg(F.sum("n").alias("alerts"), F.sum("pos").alias("true_alerts"))
    joined = hits.join(counts.groupBy(*keys).agg(F.sum("pos").alias("positives")), keys)
    if days:
        span = F.greatest(F.datediff(F.max("event_date"), F.min("event_date")), F.lit(1)).alias("span_days")
        joined = joined.join(keyed.groupBy(*keys).agg(span), keys)
    precision = F.col("true_alerts") / F.col("alerts")
    recall = F.coalesce(F.try_divide(F.col("true_alerts"), F.col("positives")), F.lit(0.0))
    f1 = F.lit(2.0) * F.col("true_alerts") / (F.col("alerts") + F.col("positives"))
    per_day = [(F.col("alerts") / F.col("span_days")).alias("alerts_per_day")] if days else []
    return joined.select(
        *by, "threshold", "alerts", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), *per_day
    )


def running_best(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    """Flag thresholds whose F1 beats that of all lower thresholds."""
    before = Window.partitionBy(*by).orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    return sweep.withColumn("best_so_far", F.col("f1") > F.coalesce(F.max("f1").over(before), F.lit(-1.0)))


def best_point(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    """Operating point with the best F1, the lowest threshold on ties."""
    rest = [c for c in sweep.columns if c not in by]
    order = F.struct(F.col("f1"), -F.col("threshold"))
    return sweep.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_p")).select(*by, "_p.*")


def pick_winner(points: DataFrame, model: str = "model", preferred: str = "focal") -> DataFrame:
    """Model with the best F1; on a tie the preferred one."""
    order = F.struct(F.col("f1"), (F.col(model) == preferred).cast("int"))
    return points.groupBy().agg(F.max_by(F.struct(*points.columns), order).alias("_p")).select("_p.*")


def cv_summary(folds: DataFrame, metrics: tuple[str, ...] = ("roc_auc", "average_precision")) -> DataFrame:
    """Mean and population standard deviation of fold metrics."""
    return folds.agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics]
    )


def active_summary(df: DataFrame) -> DataFrame:
    """How the active-cell filter splits rows and positives."""
    active = F.col("dangerous_roll14d") > 0
    active = active | (F.col("dangerous_lag1") > 0) | (F.col("neighbor_danger_avg") > 0)
    flags = df.select(active.cast("bigint").alias("a"), F.col("label").cast("bigint").alias("y"))
    sums = flags.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("a").alias("active_rows"),
        F.sum("y").alias("positives"),
        F.sum(F.col("a") * F.col("y")).alias("active_positives"),
    )
    return sums.select(
        "rows",
        "active_rows",
        "positives",
        "active_positives",
        F.try_divide("active_rows", "rows").alias("active_share"),
        F.try_divide("active_positives", "active_rows").alias("active_label_rate"),
        F.try_divide(F.col("positives") - F.col("active_positives"), F.col("rows") - F.col("active_rows")).alias(
            "quiet_label_rate"
        ),
        F.try_divide("active_positives", "positives").alias("captured_share"),
    )


def class_weight(df: DataFrame) -> DataFrame:
    """Negatives, positives and their ratio."""
    counts = df.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))
    return counts.withColumn("weight", F.try_divide("neg", "pos"))
