"""The dense cell-day panel and everything computed along a cell's time line.

Order of work: reduce feeds to sparse cell-days, send each cell-day to its neighbours, and only then fill the missing
days. Filling and all windows are keyed by the cell alone, so the dense panel, by far the largest table, is created
inside the partitioning its windows need and is never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexrisk.functions.grid import cell_neighbors
from hexrisk.operators.joins import spread_by

CELL = ("q", "r")
KEY = ("q", "r", "event_date")
LABEL_DAYS = 3
EPSILON = 1e-6

# Output column, source column and function of each neighbour feature.
NEIGHBOR_FEATURES = {
    "neighbor_danger_avg": ("dangerous_count", "avg"),
    "neighbor_fatal_sum": ("total_fatalities", "sum"),
    "neighbor_gdelt_hostility_avg": ("gdelt_hostility", "avg"),
    "neighbor_gdelt_protest_avg": ("gdelt_protest_count", "avg"),
    "neighbor_firms_spike_sum": ("firms_spike", "sum"),
}
ROLL_SOURCES = {"dangerous": "dangerous_count", "fatalities": "total_fatalities", "event": "event_count"}
ROLL_DAYS = (3, 7, 14)
LAGS = {
    "dangerous_lag1": ("dangerous_count", 1),
    "dangerous_lag2": ("dangerous_count", 2),
    "fatalities_lag1": ("total_fatalities", 1),
    "battle_lag1": ("battle_count", 1),
    "explosion_lag1": ("explosion_count", 1),
}


def by_day(cell: tuple[str, ...] = CELL):
    return Window.partitionBy(*cell).orderBy("event_date")


def distinct_cells(df: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    return df.select(*cell).distinct()


def cell_adjacency(cells: DataFrame) -> DataFrame:
    """Per cell the array ``neighbors`` of adjacent cells that exist in ``cells`` (at most six)."""
    pairs = cells.select("q", "r", F.explode(cell_neighbors(F.col("q"), F.col("r"))).alias("n"))
    # Adjacency is symmetric, so grouping the pairs by their far end gives the neighbours of that end.
    around = (
        pairs.select(F.col("n.q").alias("q"), F.col("n.r").alias("r"), F.struct("q", "r").alias("from"))
        .groupBy("q", "r")
        .agg(F.collect_list("from").alias("neighbors"))
    )
    empty = F.array().cast("array<struct<q:bigint,r:bigint>>")
    return cells.join(around, ["q", "r"], "left").withColumn("neighbors", F.coalesce("neighbors", empty))


def date_bounds(df: DataFrame, date: str = "event_date") -> tuple[Column, Column]:
    """First and last day of a table as scalar subqueries."""
    return df.select(F.min(date)).scalar(), df.select(F.max(date)).scalar()


def fill_days(sparse: DataFrame, bounds: tuple[Column, Column], cell: tuple[str, ...] = CELL) -> DataFrame:
    """Every day of the range for every cell: missing rows get zeros, existing rows are kept as they are.

    Each row also yields the empty days up to the next row of its cell, so no join with a calendar is needed.
    """
    first, last = bounds
    w = by_day(cell)
    values = [c for c in sparse.columns if c not in (*cell, "event_date")]
    ahead = sparse.withColumns(
        {
            "_from": F.when(F.row_number().over(w) == 1, first).otherwise(F.col("event_date")),
            "_to": F.coalesce(F.date_sub(F.lead("event_date").over(w), 1), last),
        }
    )
    daily = ahead.withColumn("_day", F.explode(F.sequence("_from", "_to")))
    own = F.col("_day") == F.col("event_date")
    kept = [F.when(own, F.col(c)).otherwise(F.lit(0)).cast(sparse.schema[c].dataType).alias(c) for c in values]
    return daily.select(*cell, F.col("_day").alias("event_date"), *kept)


def build_panel(daily: DataFrame, bounds: tuple[Column, Column] | None = None, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Dense panel from cell-days: all cells of ``daily`` by all days between its first and last."""
    return fill_days(spread_by(daily, *cell), bounds or date_bounds(daily), cell)


def attach_features(
    panel: DataFrame, features: DataFrame, columns: list[str], keys: tuple[str, ...] = KEY
) -> DataFrame:
    """Left join on cell and day with zero for what is missing; rows outside the panel fall away."""
    return panel.join(features.select(*keys, *columns), list(keys), "left").fillna(0, subset=columns)


def spatial_lag(panel: DataFrame, features: dict[str, tuple[str, str]], cell: tuple[str, ...] = CELL) -> DataFrame:
    """Mean or sum over the existing neighbours on the same day, 0 where there is none.

    Only rows with a value other than zero are sent to their neighbours; a mean divides by the number of neighbours.
    """
    sources = sorted({src for src, _ in features.values()})
    active = panel.filter(" or ".join(f"{c} <> 0" for c in sources))
    sent = active.select(
        F.explode(cell_neighbors(F.col("q"), F.col("r"))).alias("n"), "event_date", *sources
    ).select("n.q", "n.r", "event_date", *sources)
    received = sent.groupBy("q", "r", "event_date").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sources])
    counts = cell_adjacency(distinct_cells(panel)).select("q", "r", F.size("neighbors").alias("_n"))
    joined = panel.join(received, ["q", "r", "event_date"], "left").join(counts, ["q", "r"], "left")
    return _neighbor_columns(joined, features).drop("_n", *[f"_sum_{c}" for c in sources])


def _neighbor_columns(df: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    out = {}
    for name, (src, fn) in features.items():
        total = F.coalesce(F.col(f"_sum_{src}").cast("double"), F.lit(0.0))
        out[name] = total if fn == "sum" else F.coalesce(F.try_divide(total, F.col("_n").cast("double")), F.lit(0.0))
    return df.withColumns(out)


#: Rows of the dense panel that one task should fill.
DENSE_ROWS = 2_000_000


def dense_tasks(daily: DataFrame) -> int:
    """Tasks that the dense panel of a (stored) table of cell-days needs."""
    days = F.datediff(F.max("event_date"), F.min("event_date")) + 1
    size = daily.agg(days.alias("days"), F.approx_count_distinct(F.struct(*CELL)).alias("cells")).first()
    return -(-(size["days"] or 0) * size["cells"] // DENSE_ROWS)


def merge_cell_days(
    feeds: list[DataFrame], cells: DataFrame, features: dict[str, tuple[str, str]], extra: DataFrame | None = None, tasks: int = 0
) -> DataFrame:
    """One sparse table from several cell-day feeds, neighbour sums included, limited to ``cells``.

    Every cell-day is sent to itself with its columns and to each existing neighbour with the columns the neighbour
    features need; a single grouping keyed by cell then merges the feeds and adds up the neighbours. ``extra`` is one more
    feed, of ``cells`` only, that no neighbour feature needs: its rows go straight to that grouping.
    """
    names = list(dict.fromkeys(c for f in feeds for c in f.columns if c not in KEY))
    types = {c: f.schema[c].dataType for f in feeds for c in f.columns if c not in KEY}
    sources = sorted({src for src, _ in features.values() if src in names})
    union = feeds[0]
    for f in feeds[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    placed = union.join(cell_adjacency(cells), ["q", "r"], "inner")
    self_only = F.array(F.struct(F.col("q").alias("q"), F.col("r").alias("r"), F.lit(True).alias("own")))
    others = F.transform("neighbors", lambda n: F.struct(n["q"].alias("q"), n["r"].alias("r"), F.lit(False).alias("own")))
    routed = placed.select(
        F.explode(F.concat(self_only, others)).alias("to"), "event_date", F.size("neighbors").alias("_n"), *names
    ).filter(reduce(or_, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in sources], F.col("to.own")))
    own = F.col("to.own")
    addressed = routed.select(
        F.col("to.q").alias("q"),
        F.col("to.r").alias("r"),
        "event_date",
        F.when(own, F.col("_n")).alias("_n"),
        *[F.when(own, F.col(c)).alias(c) for c in names],
        *[F.when(~own, F.col(c)).alias(f"_sum_{c}") for c in sources],
    )
    if extra is not None:
        more = [c for c in extra.columns if c not in KEY]
        names, types = names + more, types | {c: extra.schema[c].dataType for c in more}
        addressed = addressed.unionByName(extra, allowMissingColumns=True)
    return (
        spread_by(addressed, "q", "r", tasks=tasks)
        .groupBy("q", "r", "event_date")
        .agg(
            F.max("_n").alias("_n"),
            *[F.coalesce(F.max(c), F.lit(0).cast(types[c])).alias(c) for c in names],
            *[F.coalesce(F.sum(f"_sum_{c}"), F.lit(0)).alias(f"_sum_{c}") for c in sources],
        )
    )


def rolling_means(df: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Trailing means over 3, 7 and 14 days."""
    return df.withColumns(_rolling(cell))


def _trailing_mean(col: str, days: int, cell: tuple[str, ...]) -> Column:
    return F.avg(col).over(by_day(cell).rowsBetween(-(days - 1), 0))


def _rolling(cell: tuple[str, ...]) -> dict[str, Column]:
    return {f"{name}_roll{n}d": _trailing_mean(src, n, cell) for n in ROLL_DAYS for name, src in ROLL_SOURCES.items()}


def _delta(col: str, cell: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(col) - F.lag(col).over(by_day(cell)), F.lit(0))


def deltas(df: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Change against the day before, 0 on the first day."""
    return df.withColumns(_deltas(cell))


def _deltas(cell: tuple[str, ...]) -> dict[str, Column]:
    return {
        "dangerous_delta": _delta("dangerous_count", cell),
        "fatality_delta": _delta("total_fatalities", cell),
        "actor_pair_delta": _delta("actor_pair_count", cell),
    }


def actor_roll(df: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    return df.withColumn("actor_pair_roll14d", _trailing_mean("actor_pair_count", 14, cell))


def velocity(df: DataFrame) -> DataFrame:
    """Today against the 14-day mean; needs the rolling columns."""
    return df.withColumns(
        {
            "dangerous_velocity": F.col("dangerous_count") / (F.col("dangerous_roll14d") + F.lit(EPSILON)),
            "fatality_velocity": F.col("total_fatalities") / (F.col("fatalities_roll14d") + F.lit(EPSILON)),
            "actor_pair_velocity": F.col("actor_pair_count") / (F.col("actor_pair_roll14d") + F.lit(EPSILON)),
        }
    )


def _filled(col: str, cell: tuple[str, ...]) -> Column:
    known = F.when(F.col(col) != 0, F.col(col))
    w = by_day(cell)
    so_far = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Before its first value a cell takes that first value, which is the first of the whole time line.
    first = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(so_far, first, F.lit(0))


def fill_static(df: DataFrame, col: str = "population_best", cell: tuple[str, ...] = CELL) -> DataFrame:
    """Carry a static attribute forward, then backward, over days without it."""
    return df.withColumn(col, _filled(col, cell).cast(df.schema[col].dataType))


def _lags(cell: tuple[str, ...]) -> dict[str, Column]:
    return {name: F.coalesce(F.lag(src, n).over(by_day(cell)), F.lit(0)) for name, (src, n) in LAGS.items()}


def temporal_lags(df: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    return df.withColumns(_lags(cell))


def _label(days: int, cell: tuple[str, ...]) -> Column:
    ahead = [F.coalesce(F.lead("dangerous_count", n).over(by_day(cell)), F.lit(0)) > 0 for n in range(1, days + 1)]
    return F.greatest(*ahead).cast("int")


def label_lookahead(df: DataFrame, days: int = LABEL_DAYS, cell: tuple[str, ...] = CELL) -> DataFrame:
    """1 where any of the next ``days`` days of the cell is dangerous."""
    return df.withColumn("label", _label(days, cell))


def drop_tail(df: DataFrame, days: int = LABEL_DAYS, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Drop the last ``days`` rows of every cell, whose look-ahead is incomplete."""
    return df.withColumn("_ahead", F.lead("event_date", days).over(by_day(cell))).filter("_ahead is not null").drop("_ahead")


def time_line(panel: DataFrame, keep_tail: bool = False, cell: tuple[str, ...] = CELL) -> DataFrame:
    """All features along the time line in one pass over one sort, with the label."""
    columns = {
        "population_best": _filled("population_best", cell).cast(panel.schema["population_best"].dataType),
        **_rolling(cell),
        **_deltas(cell),
        "actor_pair_roll14d": _trailing_mean("actor_pair_count", 14, cell),
        **_lags(cell),
        "label": _label(LABEL_DAYS, cell),
        "_ahead": F.lead("event_date", LABEL_DAYS).over(by_day(cell)),
    }
    if "_n" in panel.columns:
        whole = by_day(cell).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns["_n"] = F.max("_n").over(whole)
    out = panel.withColumns(columns)
    if keep_tail:
        # Unfinished look-ahead: no label.
        out = out.withColumn("label", F.when(F.col("_ahead").isNotNull(), F.col("label")))
    else:
        out = out.filter("_ahead is not null")
    return velocity(out.drop("_ahead"))


def finish_neighbors(df: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    """Turn the sums of :func:`merge_cell_days` into the neighbour features."""
    present = {name: spec for name, spec in features.items() if f"_sum_{spec[0]}" in df.columns}
    return _neighbor_columns(df, present).drop("_n", *[c for c in df.columns if c.startswith("_sum_")])
