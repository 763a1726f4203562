"""Feature table: feeds to the labelled cell-day panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hexrisk.functions.grid import cell_id, with_cell
from hexrisk.operators.aggregate import agg_conflict_day, agg_news_day, agg_thermal_day
from hexrisk.operators.clean import clean_conflict
from hexrisk.operators.panel import (
    NEIGHBOR_FEATURES,
    build_panel,
    date_bounds,
    dense_tasks,
    distinct_cells,
    fill_days,
    finish_neighbors,
    label_lookahead,
    drop_tail,
    merge_cell_days,
    time_line,
)
from hexrisk.operators.weather import weather_features, weather_feed
from hexrisk.session import cut_lineage


def conflict_rows(conflict: DataFrame) -> DataFrame:
    """Cleaned, flagged and binned conflict events."""
    return with_cell(clean_conflict(conflict))


def panel_label(conflict: DataFrame) -> DataFrame:
    """Which cells were about to turn dangerous, and how busy they were before."""
    rows = conflict_rows(conflict)
    daily = rows.groupBy("q", "r", "event_date").agg(
        F.count("event_type").alias("event_count"), F.sum("is_dangerous").alias("dangerous_count")
    )
    panel = build_panel(daily, date_bounds(rows))
    week = Window.partitionBy("q", "r").orderBy("event_date").rowsBetween(-6, 0)
    return panel.withColumn("event_roll7d", F.avg("event_count").over(week)).transform(label_lookahead).transform(drop_tail)


def build_features(
    conflict: DataFrame,
    news: DataFrame | None = None,
    thermal: DataFrame | None = None,
    weather: DataFrame | None = None,
    keep_tail: bool = False,
    news_codes: dict | None = None,
) -> DataFrame:
    """Feature table of all feeds given; an absent feed leaves its columns out.

    ``keep_tail`` keeps the last days, whose label is not known yet, for scoring.
    """
    # The cell list and the date range come from the reduced table, so the raw events are read once.
    daily = cut_lineage(agg_conflict_day(conflict_rows(conflict)))
    feeds = [daily]
    if news is not None:
        feeds.append(agg_news_day(with_cell(news), codes=news_codes))
    if thermal is not None:
        feeds.append(agg_thermal_day(with_cell(thermal)))
    bounds, cells = date_bounds(daily), distinct_cells(daily)
    extra = None if weather is None else weather_feed(cells, weather_features(weather))
    sparse = merge_cell_days(feeds, cells, NEIGHBOR_FEATURES, extra, dense_tasks(daily))
    sparse = sparse.filter(F.col("event_date").between(*bounds))
    panel = time_line(fill_days(sparse, bounds), keep_tail).transform(finish_neighbors, NEIGHBOR_FEATURES)
    return panel.withColumn("cell", cell_id(F.col("q"), F.col("r")))
