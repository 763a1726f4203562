"""Counts, ranges and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexrisk.functions.risk import ALL_TIERS


def share(df: DataFrame, condition: Column, by: list[str] = ()) -> DataFrame:
    """Rows and the share of them that meet a condition."""
    met = F.coalesce(condition, F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(met).alias("share"))


def profile(df: DataFrame, cell: str = "cell", date: str = "event_date") -> DataFrame:
    """Rows, distinct cells, first and last day."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(cell).alias("cells"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
    )


def date_range(df: DataFrame, date: str = "event_date") -> DataFrame:
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def tier_counts(df: DataFrame, by: list[str] = (), tier: str = "strategic_tier") -> DataFrame:
    """One column per tier, zero where a tier is absent."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(tier) == t).alias(t) for t in ALL_TIERS])


def tier_timeline(scored: DataFrame) -> DataFrame:
    """Tier counts of every day: the whole replay as one query."""
    return tier_counts(scored, ["event_date"])


def annotate_timeline(timeline: DataFrame, events: DataFrame) -> DataFrame:
    """Mark key events on a timeline, with their place in its range in percent; events outside it are left out."""
    first, last = timeline.select(F.min("event_date")).scalar(), timeline.select(F.max("event_date")).scalar()
    ahead = F.datediff("event_date", first) * F.lit(100.0)
    placed = events.filter(F.col("event_date").between(first, last)).select(
        "event_date", "text", F.coalesce(F.try_divide(ahead, F.datediff(last, first)), F.lit(0.0)).alias("pct")
    )
    return timeline.join(placed, "event_date", "left")


def latest_per_cell(df: DataFrame, columns: list[str], key: str = "cell", date: str = "event_date") -> DataFrame:
    """Last known value of every column per cell; columns are taken one by one, so nulls never win."""
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns]
    return df.groupBy(key).agg(F.max(date).alias(date), *known)


def latest_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark cuts every task's share to ``k`` per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def missing_days(df: DataFrame, start: Column, end: Column, date: str = "event_date") -> DataFrame:
    """Days between ``start`` and ``end`` for which a feed has no row."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(start, end)).alias(date))
    return wanted.join(df.select(date).distinct(), date, "left_anti")
