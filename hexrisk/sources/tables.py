"""Tables the library keeps: features, scores, cell dimension, metrics, map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.functions.grid import cell_boundary, cell_center, with_axes
from hexrisk.functions.numbers import half_up
from hexrisk.functions.risk import strategic_tier
from hexrisk.operators.joins import salted_join


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Feature table; optional feature groups show by their columns."""
    return spark.read.parquet(path)


def write_feature_table(df: DataFrame, path: str) -> None:
    """Write partitioned by day; days present in ``df`` replace those on disk, other days stay.

    The rebalance hint gathers a day's rows and splits days that are too large for one task, so the number of files
    follows from the amount of data.
    """
    (
        df.hint("rebalance", F.col("event_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def replace_days(df: DataFrame, path: str) -> None:
    """Re-ingest days: running it twice with the same input leaves the same table."""
    write_feature_table(df, path)


def upsert_scores(current: DataFrame, updates: DataFrame, key: str = "cell", order: str = "scored_at") -> DataFrame:
    """Merge by key, the update with the greatest ``order`` wins; an update always beats the current row.

    Grouping keeps one candidate per key on the map side, so many updates of one key do not pile up in a task.
    """
    columns = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(F.lit(0).alias("gen"), F.col(order).alias("at")).alias("_v"), *columns)
    new = updates.select(key, F.struct(F.lit(1).alias("gen"), F.col(order).alias("at")).alias("_v"), *columns)
    merged = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*columns), "_v").alias("_row"))
    return merged.select(key, "_row.*").select(*current.columns)


def patch_column(df: DataFrame, patch: DataFrame, key: str, col: str) -> DataFrame:
    """Overwrite one column for the keys of ``patch``; a null in the patch leaves the old value."""
    new = patch.select(key, F.col(col).alias("_new"))
    return df.join(new, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new").select(*df.columns)


def build_cell_grid(panel: DataFrame) -> DataFrame:
    """Cell dimension: distinct cells with their centre at 6 decimals."""
    cells = with_axes(panel).select("cell", "q", "r").distinct()
    lat, lng = cell_center(F.col("q"), F.col("r"))
    return cells.withColumns({"lat": half_up(lat, 6), "lng": half_up(lng, 6)})


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Current state with tiers recomputed from the stored score, so new thresholds apply at once."""
    return with_current_tier(spark.read.parquet(path))


def with_current_tier(scores: DataFrame) -> DataFrame:
    return scores.withColumn("strategic_tier", strategic_tier(F.coalesce("strategic_score", F.lit(0.0))))


def to_geojson_features(df: DataFrame, geometry: str) -> DataFrame:
    """One GeoJSON feature text per row; ``geometry`` is ``cell`` (outline) or ``point`` (``lat``, ``lng``)."""
    if geometry == "cell":
        shaped = with_axes(df)
        shape = F.struct(
            F.lit("Polygon").alias("type"),
            F.array(cell_boundary(F.col("q"), F.col("r"))).alias("coordinates"),
        )
        hidden = {"q", "r"}
    else:
        shaped = df
        shape = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
        hidden = {"lat", "lng"}
    properties = F.struct(*[c for c in df.columns if c not in hidden])
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry"))
    return shaped.select(F.to_json(feature).alias("value"))


def facility_style(kind: Column) -> dict[str, Column]:
    """Marker sign and colour of a facility type."""
    # Marker per facility type.
    styles = {
        "hospital": ("🏥", "#ff4444"),
        "un_shelter": ("🇺🇳", "#4488ff"),
        "red_cross": ("⛑️", "#ff6666"),
        "evacuation_point": ("✈️", "#ffaa33"),
        "border_crossing": ("🛂", "#aa66cc"),
    }
    sign, color = F.lit("📍"), F.lit("#ffffff")
    for name, (s, c) in styles.items():
        sign = F.when(kind == name, F.lit(s)).otherwise(sign)
        color = F.when(kind == name, F.lit(c)).otherwise(color)
    return {"emoji": sign, "color": color}


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON line per metric row."""
    df.write.mode("overwrite").json(path)


def enrich_scores(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores to found cells; a cell found by very many searches is spread over tasks."""
    return salted_join(cells, scores, ["cell"], "left")
