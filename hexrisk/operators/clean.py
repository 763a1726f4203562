"""Row filters and flags of the conflict feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What counts as dangerous to civilians.
DANGEROUS_TYPES = ("Battles", "Explosions/Remote violence", "Violence against civilians", "Riots")
DANGEROUS_PROTEST_SUBTYPES = (
    "Excessive force against protesters",
    "Protest with intervention",
    "Violent demonstration",
)
TYPE_FLAGS = {
    "is_battle": "Battles",
    "is_explosion": "Explosions/Remote violence",
    "is_vac": "Violence against civilians",
    "is_riot": "Riots",
}
MAX_GEO_PRECISION = 2
UNKNOWN_ACTOR = "unknown"


def filter_precision(df: DataFrame, limit: int = MAX_GEO_PRECISION) -> DataFrame:
    """Keep rows placed at least at town level; an unknown precision is dropped."""
    return df.filter(F.col("geo_precision") <= limit)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def flag_dangerous(df: DataFrame) -> DataFrame:
    dangerous = F.coalesce(F.col("event_type").isin(*DANGEROUS_TYPES), F.lit(False)) | F.coalesce(
        F.col("sub_event_type").isin(*DANGEROUS_PROTEST_SUBTYPES), F.lit(False)
    )
    return df.withColumn("is_dangerous", dangerous.cast("int"))


def flag_types(df: DataFrame) -> DataFrame:
    return df.withColumns({name: _flag(F.col("event_type") == value) for name, value in TYPE_FLAGS.items()})


def actor_pair(df: DataFrame) -> DataFrame:
    known = [F.coalesce(F.col(c), F.lit(UNKNOWN_ACTOR)) for c in ("actor1", "actor2")]
    return df.withColumn("actor_pair", F.concat_ws("||", *known))


def clean_conflict(df: DataFrame) -> DataFrame:
    """Precision filter, zero for missing numbers, all flags and the actor pair."""
    placed = filter_precision(df.dropna(subset=["event_date", "lat", "lng"]))
    return placed.fillna(0, subset=["fatalities", "population_best"]).transform(flag_dangerous).transform(flag_types).transform(
        actor_pair
    )
