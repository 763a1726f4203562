"""Routes as point tables and their exposure to dangerous cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexrisk.functions.geo import haversine_km
from hexrisk.functions.grid import bent_cells, cell_id, leg_cells
from hexrisk.operators.joins import salted_join
from hexrisk.operators.spatial import DANGER_TIERS
from hexrisk.session import stored

#: Points of a way that is drawn; which cells it crosses doesn't depend on them.
ROUTE_POINTS = 101
DETOUR_SHARE = 0.15


def detour_point(side: Column) -> tuple[Column, Column]:
    """Point beside the middle of the way, 15 % of the span to one side; ``side`` is 1 or -1, 0 for the middle."""
    d_lat, d_lng = F.col("to_lat") - F.col("lat"), F.col("to_lng") - F.col("lng")
    mid_lat = (F.col("lat") + F.col("to_lat")) / F.lit(2.0) + side * d_lng * F.lit(DETOUR_SHARE)
    mid_lng = (F.col("lng") + F.col("to_lng")) / F.lit(2.0) - side * d_lat * F.lit(DETOUR_SHARE)
    return mid_lat, mid_lng


def route_km(side: Column) -> Column:
    """Length of a straight route, or of both legs of a detour."""
    mid_lat, mid_lng = detour_point(side)
    a = haversine_km(F.col("lat"), F.col("lng"), mid_lat, mid_lng)
    b = haversine_km(mid_lat, mid_lng, F.col("to_lat"), F.col("to_lng"))
    return F.when(side == 0, haversine_km(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng"))).otherwise(a + b)


def way_cells(side: Column) -> Column:
    """The very cells that a way crosses, each once: those of its leg, or of both legs of a detour."""
    return bent_cells((F.col("lat"), F.col("lng")), detour_point(side), (F.col("to_lat"), F.col("to_lng")), side != 0)


def way_points(side: Column) -> Column:
    """Corners of a way as ``[lng, lat]`` pairs."""
    mid_lat, mid_lng = detour_point(side)
    start, end = F.array("lng", "lat"), F.array("to_lng", "to_lat")
    return F.when(side == 0, F.array(start, end)).otherwise(F.array(start, F.array(mid_lng, mid_lat), end))


def straight_route(ways: DataFrame, n: int = ROUTE_POINTS, side: str | None = None) -> DataFrame:
    """``n`` evenly spaced points ``seq``, ``point_lat``, ``point_lng`` from ``lat, lng`` to ``to_lat, to_lng``.

    ``side`` names a column with 0 for the direct way and 1 or -1 for a detour on either side.
    """
    steps = F.lit(n - 1)
    t = F.col("seq") / F.col("_steps").cast("double")
    points = ways.withColumn("_steps", steps).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    lat, lng = F.col("lat"), F.col("lng")
    direct = (lat + (F.col("to_lat") - lat) * t, lng + (F.col("to_lng") - lng) * t)
    if side is None:
        return points.withColumns({"point_lat": direct[0], "point_lng": direct[1]}).drop("_steps")
    mid_lat, mid_lng = detour_point(F.col(side))
    first, along, back = t < F.lit(0.5), t * F.lit(2.0), t * F.lit(2.0) - F.lit(1.0)

    def bent(a: Column, m: Column, b: Column) -> Column:
        return F.when(first, a + (m - a) * along).otherwise(m + (b - m) * back)

    is_direct = F.col(side) == 0
    return points.withColumns(
        {
            "point_lat": F.when(is_direct, direct[0]).otherwise(bent(lat, mid_lat, F.col("to_lat"))),
            "point_lng": F.when(is_direct, direct[1]).otherwise(bent(lng, mid_lng, F.col("to_lng"))),
        }
    ).drop("_steps")


def danger_cells(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("strategic_tier").isin(*DANGER_TIERS)).select("q", "r").distinct()


def sample_route(points: DataFrame, about: int, route: str = "route_id") -> DataFrame:
    """Every n-th point of a route, n such that ``about`` so many remain."""
    lengths = points.groupBy(route).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.expr(f"_n div {about}"))
    return salted_join(points, lengths, [route]).filter(F.col("seq") % step == 0).drop("_n")


def cell_exposure(ways: DataFrame, danger: DataFrame, way: list[str]) -> DataFrame:
    """Ways (with their ``cells``) with the count of their cells, of the dangerous ones, and the ids of those.

    Cells are found once, in the row they belong to; what goes on are the dangerous ones and one row per way. The table
    of dangerous cells is written first, so that its size is known when Spark decides how to join it.
    """
    rest = [c for c in ways.columns if c != "cells"]
    marked = stored(danger.select("q", "r").distinct().withColumn("_hit", F.lit(True)), "danger-cells")
    # The outer form, as the plain one would ask for the cells once more in a filter.
    cells = ways.withColumn("total_cells", F.size("cells").cast("bigint")).select(*rest, "total_cells", F.posexplode_outer("cells").alias("_at", "c"))
    hit = cells.select(*rest, "total_cells", "_at", "c.q", "c.r").join(marked, ["q", "r"], "left").filter("_hit or _at = 0")
    ids = F.collect_list(F.when(F.col("_hit"), cell_id(F.col("q"), F.col("r"))))
    values = [F.first(c).alias(c) for c in rest if c not in way]
    found = hit.groupBy(*way).agg(*values, F.first("total_cells").alias("total_cells"), F.count("_hit").alias("danger_cells"), ids.alias("danger_ids"))
    return found.select(*rest, "total_cells", "danger_cells", F.array_sort("danger_ids").alias("danger_ids"))


def route_exposure(points: DataFrame, scores: DataFrame, route: str = "route_id", about: int | None = None) -> DataFrame:
    """How many distinct cells each supplied route crosses and how many of them are red or orange.

    A route is a line through its points in order of ``seq``; the cells between two points count too. ``about`` asks for
    routes thinned to about so many points first.
    """
    kept = sample_route(points, about, route) if about else points
    ahead = Window.partitionBy(route).orderBy("seq")
    start = [F.col("lat"), F.col("lng")]
    legs = kept.withColumns({"to_lat": F.lead("lat").over(ahead), "to_lng": F.lead("lng").over(ahead), "_n": F.count(F.lit(1)).over(Window.partitionBy(route))})
    # A route of one point is in that point's cell.
    legs = legs.filter("to_lat is not null or _n = 1").withColumns({"to_lat": F.coalesce("to_lat", "lat"), "to_lng": F.coalesce("to_lng", "lng")})
    cells = legs.select(route, F.explode_outer(leg_cells(*start, F.col("to_lat"), F.col("to_lng"))).alias("c")).select(route, "c.q", "c.r").distinct()
    hit = salted_join(cells, danger_cells(scores).withColumn("_hit", F.lit(1)), ["q", "r"], "left")
    return hit.groupBy(route).agg(F.count("_hit").alias("danger_cells"), F.count(F.lit(1)).alias("total_cells"))


def best_route(exposed: DataFrame, key: list[str], order: str = "rank") -> DataFrame:
    """Per key the way with the fewest dangerous cells, the earlier one on ties."""
    rest = [c for c in exposed.columns if c not in key]
    pick = F.min_by(F.struct(*rest), F.struct("danger_cells", order)).alias("_best")
    return exposed.groupBy(*key).agg(pick).select(*key, "_best.*")
