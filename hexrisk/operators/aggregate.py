"""Feed rows to one row per cell and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexrisk.functions.risk import hostility, thermal_spike

KEY = ("q", "r", "event_date")

# News classes and the columns they fill; which codes belong to a class is the user's choice.
NEWS_CLASSES = ("protest", "threaten", "assault", "fight")
DEFAULT_NEWS_CODES = {"protest": (14,), "threaten": (13,), "assault": (18,), "fight": (19, 20)}


def agg_conflict_day(events: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Conflict features of a cell-day.

    The two distinct counts make Spark group by actor and by pair first, so a busy cell-day is spread over as many
    tasks as it has actors.
    """
    return events.groupBy(*keys).agg(
        F.count("event_type").alias("event_count"),
        F.sum("is_dangerous").alias("dangerous_count"),
        F.sum("fatalities").alias("total_fatalities"),
        F.max("fatalities").alias("max_fatalities"),
        F.sum("is_battle").alias("battle_count"),
        F.sum("is_explosion").alias("explosion_count"),
        F.sum("is_vac").alias("vac_count"),
        F.sum("is_riot").alias("riot_count"),
        F.max("population_best").alias("population_best"),
        F.count_distinct("actor1").alias("unique_actors"),
        F.count_distinct("actor_pair").alias("actor_pair_count"),
    )


def agg_news_day(news: DataFrame, keys: tuple[str, ...] = KEY, codes: dict | None = None) -> DataFrame:
    """News features of a cell-day; class counts are added when the feed has a ``code`` column."""
    wanted = [
        F.count("id").alias("gdelt_event_count"),
        F.avg("tone").alias("gdelt_avg_tone"),
        F.min("goldstein").alias("gdelt_min_goldstein"),
        F.avg("goldstein").alias("gdelt_avg_goldstein"),
        F.coalesce(F.sum("articles"), F.lit(0.0)).alias("gdelt_num_articles"),
    ]
    if "code" in news.columns:
        wanted += news_class_counts(codes)
    return news.groupBy(*keys).agg(*wanted).withColumn("gdelt_hostility", hostility(F.col("gdelt_avg_tone")))


def news_class_counts(codes: dict | None = None) -> list:
    """Aggregates that count the rows of each news class and of their union."""
    codes = codes or DEFAULT_NEWS_CODES
    every = sorted({c for group in codes.values() for c in group})
    counts = [F.count_if(F.col("code").isin(*codes[name])).alias(f"gdelt_{name}_count") for name in NEWS_CLASSES]
    return [*counts, F.count_if(F.col("code").isin(*every)).alias("gdelt_cameo_conflict")]


def agg_news_class_day(news: DataFrame, codes: dict | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    return news.groupBy(*keys).agg(*news_class_counts(codes))


def agg_thermal_day(thermal: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Thermal features of a cell-day."""
    daily = thermal.groupBy(*keys).agg(
        F.count("frp").alias("firms_hotspot_count"),
        F.avg("frp").alias("firms_avg_frp"),
        F.max("frp").alias("firms_max_frp"),
    )
    return daily.withColumn("firms_spike", thermal_spike(F.col("firms_hotspot_count")))
