"""Time-ordered positions, folds and hold-out of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FOLDS = 5
TRAIN_SHARE = 0.9


def filter_active(df: DataFrame) -> DataFrame:
    """Keep rows with a recent dangerous signal in the cell or beside it."""
    return df.filter("dangerous_roll14d > 0 or dangerous_lag1 > 0 or neighbor_danger_avg > 0")


def with_time_position(df: DataFrame) -> DataFrame:
    """Add ``position``, the 0-based place in ``(event_date, q, r)`` order, and ``n_rows``.

    Rows are counted per day and grid column; running totals over days and over the columns of a day give each small
    group its offset, so no task ever sees a whole day, let alone the whole table.
    """
    groups = df.groupBy("event_date", "q").agg(F.count(F.lit(1)).alias("_rows"))
    days = groups.groupBy("event_date").agg(F.sum("_rows").alias("_day_rows"))
    # One row per calendar day.
    over_days = Window.orderBy("event_date")
    day_offsets = days.select(
        "event_date",
        (F.sum("_day_rows").over(over_days) - F.col("_day_rows")).alias("_day_offset"),
        F.sum("_day_rows").over(Window.partitionBy()).alias("n_rows"),
    )
    in_day = Window.partitionBy("event_date").orderBy("q")
    offsets = groups.select(
        "event_date", "q", (F.sum("_rows").over(in_day) - F.col("_rows")).alias("_column_offset")
    ).join(day_offsets, "event_date")
    in_group = Window.partitionBy("event_date", "q").orderBy("r")
    return (
        df.withColumn("_rn", F.row_number().over(in_group) - 1)
        .join(offsets, ["event_date", "q"])
        .withColumn("position", F.col("_day_offset") + F.col("_column_offset") + F.col("_rn"))
        .drop("_rn", "_day_offset", "_column_offset")
    )


def time_series_folds(df: DataFrame, k: int = FOLDS) -> DataFrame:
    """Expanding-window folds as one column ``block``: fold f trains on ``block < f`` and validates ``block = f``.

    With n rows a fold has ``n // (k + 1)`` rows; the last k blocks are validated in turn, what is before them is block 0.
    """
    if "position" not in df.columns:
        df = with_time_position(df)
    size = F.expr(f"n_rows div {k + 1}")
    start = F.col("n_rows") - size * F.lit(k)
    block = F.floor((F.col("position") - start) / F.greatest(size, F.lit(1))) + 1
    return df.withColumn("block", F.when(F.col("position") < start, F.lit(0)).otherwise(block).cast("int"))


def fold_parts(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold."""
    return df.filter(F.col("block") < fold), df.filter(F.col("block") == fold)


def time_holdout(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the first ``share`` of rows by time as ``train`` and the rest as ``test``."""
    if "position" not in df.columns:
        df = with_time_position(df)
    cut = F.floor(F.col("n_rows") * F.lit(share))
    return df.withColumn("part", F.when(F.col("position") < cut, "train").otherwise("test"))
