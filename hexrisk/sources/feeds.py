"""Readers of the raw feeds. Text is read as text and converted leniently, as feeds contain damaged values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexrisk.functions.geo import REGION_BOX, filter_bbox
from hexrisk.functions.numbers import day_first_date, number_or_null

CONFLICT_COLUMNS = (
    "event_date",
    "latitude",
    "longitude",
    "geo_precision",
    "event_type",
    "sub_event_type",
    "actor1",
    "actor2",
    "fatalities",
    "population_best",
)
# Position of the columns used in the headerless news export.
NEWS_POSITIONS = {"id": 0, "day": 1, "goldstein": 30, "articles": 33, "tone": 34, "lat": 53, "lng": 54}
NEWS_ROOT_CODE_POSITION = 28
NEWS_WIDTH = 58

WEATHER_SCHEMA = (
    "grid_lat double, grid_lon double, daily struct<time: array<string>, temperature_2m_max: array<double>, "
    "temperature_2m_mean: array<double>, precipitation_sum: array<double>>"
)
FACILITY_SCHEMA = (
    "shelters array<struct<name: string, type: string, lat: double, lng: double, capacity: string, notes: string>>"
)


def _header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a headed CSV; only its first line is looked at."""
    return spark.read.csv(path, header=True).columns


def read_conflict_events(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Conflict CSV; rows without a readable date or position are dropped, other columns of the file are ignored.

    Quoted values may hold line breaks, so a file is read by one task; ``multiline=False`` splits large files that have none.
    """
    present = set(_header_columns(spark, path))
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multiline)
    cols = {c: F.col(c) if c in present else F.lit(None).cast("string") for c in CONFLICT_COLUMNS}
    return raw.select(
        day_first_date(cols["event_date"]).alias("event_date"),
        number_or_null(cols["latitude"]).alias("lat"),
        number_or_null(cols["longitude"]).alias("lng"),
        number_or_null(cols["geo_precision"]).alias("geo_precision"),
        *[cols[c].alias(c) for c in ("event_type", "sub_event_type", "actor1", "actor2")],
        F.coalesce(number_or_null(cols["fatalities"]), F.lit(0.0)).alias("fatalities"),
        F.coalesce(number_or_null(cols["population_best"]), F.lit(0.0)).alias("population_best"),
    ).dropna(subset=["event_date", "lat", "lng"])


def read_news_events(spark: SparkSession, path: str, box: dict | None = REGION_BOX) -> DataFrame:
    """Headerless news TSV files named ``YYYYMMDD…``; the day of a row is the day of its file.

    Rows of another width are skipped, rows outside ``box`` dropped (all are kept without one).
    """
    # Exploding an array of one keeps the filters below from cutting the line anew, each for itself.
    fields = F.explode(F.array(F.split("value", "\t", -1)))
    lines = spark.read.text(path).select(fields.alias("f"), F.col("_metadata.file_name").alias("file"))
    raw = lines.filter(F.size("f") == NEWS_WIDTH)
    at = {name: F.get("f", F.lit(i)) for name, i in NEWS_POSITIONS.items()}
    # Null where the name has no day: trying to read an empty text costs an exception a row.
    file_day = F.nullif(F.regexp_extract("file", r"(\d{8})", 1), F.lit(""))
    rows = raw.select(
        at["id"].alias("id"),
        F.coalesce(
            F.to_date(F.try_to_timestamp(file_day, F.lit("yyyyMMdd"))),
            F.to_date(F.try_to_timestamp(at["day"], F.lit("yyyyMMdd"))),
        ).alias("event_date"),
        *[number_or_null(at[c]).alias(c) for c in ("lat", "lng", "goldstein", "tone", "articles")],
        F.trim(F.get("f", F.lit(NEWS_ROOT_CODE_POSITION))).try_cast("int").alias("code"),
    )
    placed = rows.dropna(subset=["lat", "lng"])
    return filter_bbox(placed, box=box) if box else placed


def read_thermal(spark: SparkSession, path: str) -> DataFrame:
    """Thermal CSV in any of its spellings; rows without position or date are dropped, a missing power is 0."""
    present = _header_columns(spark, path)
    raw = spark.read.csv(path, header=True)

    def pick(*names: str):
        found = [F.col(n) for n in names if n in present]
        return found[0] if found else F.lit(None).cast("string")

    when = pick("acq_date", "acq_datetime")
    power = next((n for n in present if n.lower() == "frp"), None)
    return raw.select(
        number_or_null(pick("latitude")).alias("lat"),
        number_or_null(pick("longitude")).alias("lng"),
        F.to_date(F.trim(when).try_cast("timestamp")).alias("event_date"),
        F.coalesce(number_or_null(F.col(power)) if power else F.lit(None).cast("double"), F.lit(0.0)).alias("frp"),
    ).dropna(subset=["lat", "lng", "event_date"])


def read_weather_daily(spark: SparkSession, path: str) -> DataFrame:
    """Weather JSON, one document per grid point with parallel daily arrays, to one row per point and day."""
    docs = spark.read.schema(WEATHER_SCHEMA).json(path)
    days = docs.select(
        "grid_lat",
        "grid_lon",
        F.explode(
            F.arrays_zip(
                F.col("daily.time").alias("time"),
                F.col("daily.temperature_2m_max").alias("temp_max"),
                F.col("daily.temperature_2m_mean").alias("temp_mean"),
                F.col("daily.precipitation_sum").alias("precip_mm"),
            )
        ).alias("d"),
    )
    return days.select(
        "grid_lat", "grid_lon", F.col("d.time").try_cast("date").alias("event_date"), "d.temp_max", "d.temp_mean", "d.precip_mm"
    )


def read_facilities(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Facility JSON to one row per facility: one document per file, or one per line."""
    docs = spark.read.schema(FACILITY_SCHEMA).json(path, multiLine=multiline)
    return docs.select(F.explode("shelters").alias("s")).select("s.*")
