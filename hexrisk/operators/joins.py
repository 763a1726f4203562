"""Join helper for a side whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 8
_SALT = "_salt"


def spread_by(df: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """Repartition by key into a fixed number of tasks, for a step whose output is far larger than its input.

    Without the number Spark would merge small inputs into a few tasks that each produce a huge output. ``tasks`` asks for
    more than the session's number where the output is known to need them.
    """
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` to ``lookup`` with every key of ``rows`` spread over ``salts`` tasks.

    ``lookup`` is repeated once per salt, so it should be the smaller side with few rows per key. The salt is a hash of
    the row, not a random number, so a recomputed task yields the same rows. ``how``: inner, left, left_semi, left_anti.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    spread = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, _SALT], how).drop(_SALT)


#: Rows of either side of a key that one task should join with as many of the other side.
CELL_ROWS = 4096


def measured_join(left: DataFrame, right: DataFrame, on: list[str], cell: int = CELL_ROWS) -> DataFrame:
    """Inner join that splits just the keys whose pairs are too many for one task, as finely as their counts ask for.

    Both sides of such a key are cut into parts of about ``cell`` rows, and each part of one side meets each of the other.
    All other keys, usually nearly all, are joined as they are. Both inputs are read twice, so they should be cheap. Parts
    are hashes of rows, so a recomputed task yields the same rows.
    """
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_nl")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_nr")), on)
    parts = [F.ceil(F.col(n) / cell).cast("int").alias(p) for n, p in (("_nl", "_lefts"), ("_nr", "_rights"))]
    hot = sizes.filter(F.col("_nl") * F.col("_nr") > cell * cell).select(*on, *parts)

    def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        columns = df.columns
        split = df.join(hot, on, "left")
        place = F.pmod(F.xxhash64(*columns), F.coalesce(own_parts, F.lit(1))).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.coalesce(other_parts, F.lit(1)) - 1))
        return split.withColumn(own, place).withColumn(other, meets).select(*columns, own, other)

    a = dealt(left, "_left", "_lefts", "_right", "_rights")
    b = dealt(right, "_right", "_rights", "_left", "_lefts")
    return spread_by(a, *on, "_left", "_right").join(b, [*on, "_left", "_right"]).drop("_left", "_right")
