"""Feeds derived from the benchmark tables, so that every job has inputs that grow with them.

Positions come from integer keys laid out on a 0.05 degree lattice: blocks of 40 columns by 90 rows beside each other
around the globe, about 3.6 million positions, after which keys start over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIRST_DAY = "2024-01-01"
DAYS = 30
WEATHER_FIRST_DAY, WEATHER_DAYS = "2023-12-22", 40
KEY_EVENTS = (("2024-01-07", "first mark"), ("2024-01-15", "second mark"), ("2024-01-24", "third mark"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def lattice(key: str, lat_shift: float = 0.0) -> dict[str, Column]:
    """Latitude and longitude of an integer key."""
    lat_step = F.expr(f"({key} div 40) % 90 - 90 * (({key} div 259200) % 14)")
    lng_step = F.expr(f"{key} % 40 + 40 * (({key} div 3600) % 72)")
    return {
        "lat": F.lit(33.0 + lat_shift) + lat_step * F.lit(0.05),
        "lng": F.lit(35.0) + lng_step * F.lit(0.05),
    }


def conflict(spark: SparkSession, root: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    kind, strong = F.col("event_type"), F.col("value") >= 150
    mapped = (
        F.when(kind == "click", "Protests")
        .when(strong & (kind == "error"), "Explosions/Remote violence")
        .when(strong & (kind == "purchase"), "Battles")
        .when(strong & (kind == "signup"), "Riots")
        .when(strong & (kind == "view"), "Violence against civilians")
        .when(kind == "view", "Protests")
        .otherwise("Strategic developments")
    )
    return (
        table(spark, root, "events")
        .withColumn("k", k)
        .select(
            "event_id",
            F.to_date("ts").alias("event_date"),
            *[c.alias(n) for n, c in lattice("user_id").items()],
            (1 + F.col("k") % 3).alias("geo_precision"),
            mapped.alias("event_type"),
            F.when(strong & (kind == "click"), "Excessive force against protesters").otherwise("Other").alias("sub_event_type"),
            F.when(F.col("k") % 11 != 0, F.concat(F.lit("A"), F.col("k") % 7)).alias("actor1"),
            F.when(F.col("k") % 4 != 0, F.concat(F.lit("B"), F.col("k") % 5)).alias("actor2"),
            F.when(strong, F.floor(F.col("value") / 50)).otherwise(F.lit(0).cast("bigint")).alias("fatalities"),
            F.when(F.col("k") % 2 == 0, 1000 * (1 + F.col("user_id") % 9)).otherwise(F.lit(0).cast("bigint")).alias(
                "population_best"
            ),
        )
    )


def _day(key: str, first: str, days: int) -> Column:
    return F.date_add(F.lit(first).cast("date"), (F.col(key) % days).cast("int"))


def news(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        _day("l_orderkey", FIRST_DAY, DAYS).alias("event_date"),
        *[c.alias(n) for n, c in lattice("l_suppkey").items()],
        # Eighths, so that sums and the hostility derived from them do not depend on the order of rows.
        (F.lit(12.5) - F.lit(0.625) * F.col("l_quantity")).alias("tone"),
        (F.lit(10.0) - F.lit(200.0) * F.col("l_discount")).alias("goldstein"),
        F.col("l_quantity").alias("articles"),
        (1 + F.col("l_partkey") % 20).alias("code"),
    )


def thermal(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        _day("o_orderkey", FIRST_DAY, DAYS).alias("event_date"),
        *[c.alias(n) for n, c in lattice("o_custkey").items()],
        (F.col("o_totalprice") / F.lit(5000.0)).alias("frp"),
    )


def weather(spark: SparkSession, root: str) -> DataFrame:
    """Daily weather of half-degree points from station readings (one reading per order)."""
    g, d = F.col("g"), F.col("d")
    readings = (
        table(spark, root, "orders")
        .select("o_orderkey", "o_custkey", *[c.alias(n) for n, c in lattice("o_custkey").items()])
        .withColumns(
            {
                "grid_lat": F.floor(F.col("lat") * F.lit(2.0)) / F.lit(2.0),
                "grid_lon": F.floor(F.col("lng") * F.lit(2.0)) / F.lit(2.0),
                "event_date": _day("o_orderkey", WEATHER_FIRST_DAY, WEATHER_DAYS),
                "d": F.col("o_orderkey") % WEATHER_DAYS,
            }
        )
        .withColumn("g", (F.col("grid_lat") * F.lit(10.0) + F.col("grid_lon") * F.lit(2.0)).cast("bigint"))
    )
    return readings.groupBy("grid_lat", "grid_lon", "event_date").agg(
        F.max((20 + (g * 7 + d * 3) % 17 + F.col("o_orderkey") % 3).cast("double")).alias("temp_max"),
        F.avg((15 + (g * 7 + d * 3) % 17).cast("double")).alias("temp_mean"),
        F.max(F.greatest((g * 5 + d * 11) % 23 - 15 + F.col("o_custkey") % 2, F.lit(0)).cast("double")).alias("precip_mm"),
    )


def facilities(spark: SparkSession, root: str) -> DataFrame:
    kinds = ("hospital", "un_shelter", "border_crossing", "evacuation_point", "red_cross")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("facility_id"),
        F.col("s_name").alias("name"),
        kind.alias("type"),
        *[c.alias(n) for n, c in lattice("s_suppkey", 0.1).items()],
        F.when(F.col("s_acctbal") >= 5000, "major").otherwise("medium").alias("capacity"),
        F.concat(F.lit("nation "), F.col("s_nationkey")).alias("notes"),
    )


def origins(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("origin_id"), *[c.alias(n) for n, c in lattice("c_custkey").items()]
    )


def key_events(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(d).cast("date").alias("event_date"), F.lit(t).alias("text")) for d, t in KEY_EVENTS]))
    return spark.range(1).select(rows.alias("e")).select("e.*")
