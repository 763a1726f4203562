"""Daily weather per grid point and its attachment to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexrisk.functions.grid import cell_center

GRID_STEP = 0.5
GRID = ("grid_lat", "grid_lon")
WEATHER_FEATURES = ("temp_max", "temp_anomaly_30d", "precip_mm", "precip_spike")
ANOMALY_DAYS, ANOMALY_MIN_DAYS = 30, 7
SPIKE_QUANTILE = 0.9


def temp_anomaly(weather: DataFrame) -> DataFrame:
    """Maximum temperature against its trailing 30-row mean; 0 with fewer than 7 known rows."""
    w = Window.partitionBy(*GRID).orderBy("event_date").rowsBetween(-(ANOMALY_DAYS - 1), 0)
    mean = F.when(F.count("temp_max").over(w) >= ANOMALY_MIN_DAYS, F.avg("temp_max").over(w))
    return weather.withColumn("temp_anomaly_30d", F.coalesce(F.col("temp_max") - mean, F.lit(0.0)))


def monthly_p90(weather: DataFrame) -> DataFrame:
    """90th percentile of rain per grid point and calendar month, interpolated."""
    return weather.groupBy(*GRID, F.month("event_date").alias("month")).agg(
        F.percentile("precip_mm", F.lit(SPIKE_QUANTILE)).alias("p90")
    )


def precip_spike(weather: DataFrame) -> DataFrame:
    """1 where a day's rain exceeds the point's percentile for the calendar month."""
    keyed = weather.withColumn("month", F.month("event_date"))
    joined = keyed.join(monthly_p90(weather), [*GRID, "month"], "left")
    spike = F.coalesce(F.col("precip_mm") > F.col("p90"), F.lit(False)).cast("int")
    return joined.withColumn("precip_spike", spike).drop("month", "p90")


def weather_features(weather: DataFrame) -> DataFrame:
    daily = weather.select(*GRID, "event_date", "temp_max", "precip_mm")
    return precip_spike(daily).transform(temp_anomaly).select(*GRID, "event_date", *WEATHER_FEATURES)


def _nearest_step(x: Column, step: float, limits: tuple[float, float] | None) -> Column:
    # A point midway between two grid lines belongs to the lower one, hence ceil(v - 0.5).
    low = limits[0] if limits else 0.0
    steps = F.ceil((x - F.lit(low)) / F.lit(step) - F.lit(0.5))
    if limits:
        steps = F.least(F.greatest(steps, F.lit(0)), F.lit(round((limits[1] - low) / step)))
    return F.lit(low) + steps * F.lit(step)


def nearest_grid(df: DataFrame, box: dict | None = None, step: float = GRID_STEP) -> DataFrame:
    """Add the nearest point of the regular weather grid to rows with ``q`` and ``r``.

    The grid goes on without end unless a ``box`` is given; then places outside take the nearest point of its edge.
    """
    lat, lng = cell_center(F.col("q"), F.col("r"))
    limits = box or {"lat": None, "lng": None}
    return df.withColumns(
        {"grid_lat": _nearest_step(lat, step, limits["lat"]), "grid_lon": _nearest_step(lng, step, limits["lng"])}
    )


def weather_feed(cells: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather features of each cell's nearest grid point as cell-days, a narrow feed for the panel.

    Few cells share a grid point, so no key is hot here, and the wide panel stays where it is.
    """
    return nearest_grid(cells.select("q", "r")).join(weather, list(GRID)).select("q", "r", "event_date", *WEATHER_FEATURES)


def attach_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Join the features of the nearest grid point by day; 0 where unknown."""
    joined = nearest_grid(panel).join(weather, [*GRID, "event_date"], "left").drop(*GRID)
    return joined.fillna(0, subset=list(WEATHER_FEATURES))
