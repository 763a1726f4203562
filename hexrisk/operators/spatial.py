"""Searches by distance.

Points meet only through a shared bucket of a latitude/longitude grid. A search visits the buckets its circle can touch.
Buckets are counted first: one that holds a large share of the searches or of the targets is dealt out to as many tasks
as its pairs need, and the others are joined as they are.
"""

from __future__ import annotations

from math import degrees, pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexrisk.functions.geo import EARTH_RADIUS_KM, haversine_km
from hexrisk.functions.grid import with_cell
from hexrisk.functions.numbers import half_up
from hexrisk.operators.joins import measured_join, salted_join
from hexrisk.session import cut_lineage

# Bucket widths in degrees; all divide 360, so buckets close around the globe.
BUCKETS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 5.0, 10.0)
#: Boxes of the nearest-k search: width in degrees at the coarsest level, halved from level to level, and when to stop.
NODE_DEGREES, LAST_LEVEL = 10.0, 16
LEAF_ORIGINS, LEAF_PLACES = 16, 8
#: Added to bounds of distances against rounding.
SLACK_KM = 1e-3
HALF_EARTH_KM = pi * EARTH_RADIUS_KM

# Cities taken as destinations beside the facilities.
CITIES = (
    ("Beirut", 33.8938, 35.5018, "Lebanon"),
    ("Tripoli", 34.4367, 35.8497, "Lebanon"),
    ("Sidon", 33.5633, 35.3714, "Lebanon"),
    ("Jounieh", 33.9808, 35.6178, "Lebanon"),
    ("Zahle", 33.8463, 35.9020, "Lebanon"),
    ("Damascus", 33.5138, 36.2765, "Syria"),
    ("Latakia", 35.5317, 35.7918, "Syria"),
    ("Tartous", 34.8959, 35.8867, "Syria"),
    ("Homs", 34.7324, 36.7137, "Syria"),
    ("Amman", 31.9454, 35.9284, "Jordan"),
    ("Irbid", 32.5568, 35.8469, "Jordan"),
    ("Mafraq", 32.3422, 36.2079, "Jordan"),
    ("Antakya (Hatay)", 36.2025, 36.1522, "Turkey"),
    ("Gaziantep", 37.0594, 37.3825, "Turkey"),
    ("Erbil", 36.1912, 44.0089, "Iraq"),
    ("Haifa", 32.7940, 34.9896, "Israel"),
)
NEAR_KM, FAR_KM, TOP_CANDIDATES = 5.0, 500.0, 5
DANGER_TIERS = ("red", "orange")


def _width(radius_km: float) -> float:
    wanted = degrees(radius_km / EARTH_RADIUS_KM)
    return next((w for w in BUCKETS if w >= wanted), BUCKETS[-1])


def _bucket(lat: Column, lng: Column, width: float) -> tuple[Column, Column]:
    return (
        F.floor((lat + F.lit(90.0)) / F.lit(width)).cast("int"),
        F.pmod(F.floor((lng + F.lit(180.0)) / F.lit(width)), F.lit(int(360 / width))).cast("int"),
    )


def _covering(lat: Column, lng: Column, radius_km: float, width: float) -> tuple[Column, Column]:
    """Bucket rows and columns that the circle around a point can touch.

    A hair is added to the radius, so that rounding never leaves out a target exactly on the edge.
    """
    reach = min(radius_km * 1.000001 + 1e-6, HALF_EARTH_KM)
    d_lat = degrees(reach / EARTH_RADIUS_KM)
    around = int(360 / width)

    def steps(low: Column, high: Column, shift: float) -> Column:
        return F.sequence(
            F.floor((low + F.lit(shift)) / F.lit(width)).cast("int"), F.floor((high + F.lit(shift)) / F.lit(width)).cast("int")
        )

    rows = steps(F.greatest(lat - F.lit(d_lat), F.lit(-90.0)), F.least(lat + F.lit(d_lat), F.lit(90.0)), 90.0)
    # Half-width in longitude of a circle; once it holds a pole it spans all longitudes.
    ratio = F.sin(F.lit(min(reach / EARTH_RADIUS_KM, pi / 2))) / F.cos(F.radians(lat))
    d_lng = F.when(F.abs(lat) + F.lit(d_lat) >= 90.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    columns = F.when(
        d_lng * 2 >= F.lit(360.0 - width), F.sequence(F.lit(0), F.lit(around - 1))
    ).otherwise(F.transform(steps(lng - d_lng, lng + d_lng, 180.0), lambda c: F.pmod(c, F.lit(around))))
    return rows, columns


def within_radius(points: DataFrame, targets: DataFrame, radius_km: float, min_km: float = 0.0) -> DataFrame:
    """Pairs of a point and a target at most ``radius_km`` (and at least ``min_km``) apart, with ``distance_km``.

    ``points`` has ``lat``, ``lng`` and its keys; so has ``targets``, whose position comes out as ``to_lat``, ``to_lng``.
    """
    width = _width(radius_km)
    rows, columns = _covering(F.col("lat"), F.col("lng"), radius_km, width)
    spread = points.withColumn("_by", F.explode(rows)).withColumn("_bx", F.explode(columns))
    by, bx = _bucket(F.col("to_lat"), F.col("to_lng"), width)
    placed = targets.withColumnsRenamed({"lat": "to_lat", "lng": "to_lng"}).withColumns({"_by": by, "_bx": bx})
    pairs = measured_join(spread, placed, ["_by", "_bx"])
    # Kept to the millimetre, so that equal distances compare as equal.
    distance = half_up(haversine_km(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")), 6)
    return (
        pairs.withColumn("distance_km", distance)
        .filter((F.col("distance_km") <= radius_km) & (F.col("distance_km") >= min_km))
        .drop("_by", "_bx")
    )


def _box_bounds(lat: Column, lng: Column) -> list[Column]:
    """Aggregates of points: their number, the middle of the box around them, and how far from it any of them can be."""
    low, high, west, east = F.min(lat), F.max(lat), F.min(lng), F.max(lng)
    # A way along the box's straight line is no shorter than the great circle; degrees of longitude are longest next to the equator.
    nearest = F.when((low <= 0.0) & (high >= 0.0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    d_lat, d_lng = F.radians(high - low) / 2.0, F.radians(east - west) / 2.0
    flat = F.sqrt(d_lat * d_lat + d_lng * d_lng * F.pow(F.cos(F.radians(nearest)), F.lit(2.0)))
    reach = F.lit(EARTH_RADIUS_KM) * flat
    return [F.count(F.lit(1)), (low + high) / 2.0, (west + east) / 2.0, reach]


def _nodes(points: DataFrame, side: str, level: int) -> DataFrame:
    """Boxes of a level that hold points, with their parents (``_py``, ``_px``) and bounds; columns end in ``side``."""
    width = NODE_DEGREES / 2**level
    y, x = F.floor((F.col("lat") + F.lit(90.0)) / F.lit(width)), F.floor((F.col("lng") + F.lit(180.0)) / F.lit(width))
    bounds = [c.alias(f"{n}{side}") for n, c in zip(("_n", "_lat", "_lng", "_reach"), _box_bounds(F.col("lat"), F.col("lng")), strict=True)]
    boxes = points.groupBy(y.alias(f"_y{side}"), x.alias(f"_x{side}")).agg(*bounds)
    return boxes.withColumns({f"_py{side}": F.shiftright(f"_y{side}", 1), f"_px{side}": F.shiftright(f"_x{side}", 1)})


def _at_node(points: DataFrame, side: str, level: int) -> DataFrame:
    """Points with the box of a level that they are in."""
    width = NODE_DEGREES / 2**level
    return points.withColumns({f"_y{side}": F.floor((F.col("lat") + F.lit(90.0)) / F.lit(width)), f"_x{side}": F.floor((F.col("lng") + F.lit(180.0)) / F.lit(width))})


def _worth_a_look(pairs: DataFrame, asker: list[str], k: int, min_km: float, max_km: float) -> DataFrame:
    """Pairs of an asker's box and a box of places that may hold one of the ``k`` nearest of any point of the first.

    Boxes that are surely within some distance hold ``k`` places, so what is surely beyond it is left out.
    """
    apart = haversine_km(F.col("_lat_a"), F.col("_lng_a"), F.col("_lat_b"), F.col("_lng_b"))
    span = F.col("_reach_a") + F.col("_reach_b")
    near = pairs.withColumn("_d", apart).withColumns({"_low": F.col("_d") - span - SLACK_KM, "_high": F.col("_d") + span + SLACK_KM})
    near = near.filter((F.col("_high") >= min_km) & (F.col("_low") <= max_km))
    whole = Window.partitionBy(*asker)
    # What may lie too near is no sure find.
    sure = F.when(F.col("_low") >= min_km, F.col("_n_b")).otherwise(F.lit(0))
    running = near.withColumn("_held", F.sum(sure).over(whole.orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    enough = running.withColumn("_enough", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(whole))
    return enough.filter("_enough is null or _low <= _enough").drop("_d", "_low", "_high", "_held", "_enough")


def nearest_places(
    origins: DataFrame, places: DataFrame, k: int, min_km: float = 0.0, max_km: float = HALF_EARTH_KM
) -> DataFrame:
    """The ``k`` nearest places of every origin position, ``rank`` 1 first, ties by name.

    ``origins`` needs ``lat``, ``lng``; the result is per distinct position. ``places`` needs ``name``, ``lat``, ``lng``.
    Boxes of origins are paired with boxes of places from the coarsest level down; at every level a box of origins keeps
    those that may hold one of its ``k`` nearest, and these are halved until they hold few points. So a position looks at
    about as many places however far off they are. At one place position only the first ``k`` names can ever be chosen,
    so the others are left out beforehand.
    """
    same_spot = Window.partitionBy("lat", "lng").orderBy("name")
    located = places.filter(~(F.isnan("lat") | F.isnan("lng")))
    candidates = cut_lineage(located.withColumn("_i", F.row_number().over(same_spot)).filter(F.col("_i") <= k).drop("_i"))
    spots = cut_lineage(origins.filter(~(F.isnan("lat") | F.isnan("lng"))).select("lat", "lng").distinct())
    boxes = {"_a": _nodes(spots, "_a", 0).drop("_py_a", "_px_a"), "_b": _nodes(candidates, "_b", 0).drop("_py_b", "_px_b")}
    # At most 648 boxes a side.
    pairs = boxes["_a"].crossJoin(boxes["_b"])
    at = {"_a": 0, "_b": 0}
    while True:
        pairs = cut_lineage(_worth_a_look(pairs, ["_y_a", "_x_a"], k, min_km, max_km))
        most = pairs.agg(F.max("_n_a").alias("_a"), F.max("_n_b").alias("_b")).first()
        crowded = [side for side, leaf in (("_a", LEAF_ORIGINS), ("_b", LEAF_PLACES)) if (most[side] or 0) > leaf and at[side] < LAST_LEVEL]
        if not crowded:
            break
        for side in crowded:
            at[side] += 1
            parent = [f"_py{side}", f"_px{side}"]
            above = pairs.drop(*[f"{n}{side}" for n in ("_n", "_lat", "_lng", "_reach")]).withColumnsRenamed({f"_y{side}": parent[0], f"_x{side}": parent[1]})
            pairs = above.join(_nodes(spots if side == "_a" else candidates, side, at[side]), parent).drop(*parent)
    # Each position by itself: a box without extent.
    alone = _at_node(spots, "_a", at["_a"]).withColumns({"_lat_a": F.col("lat"), "_lng_a": F.col("lng"), "_reach_a": F.lit(0.0)})
    asked = pairs.drop("_n_a", "_lat_a", "_lng_a", "_reach_a").join(alone, ["_y_a", "_x_a"])
    asked = _worth_a_look(asked, ["_y_a", "_x_a", "lat", "lng"], k, min_km, max_km).select("lat", "lng", "_y_b", "_x_b")
    placed = _at_node(candidates, "_b", at["_b"]).withColumnsRenamed({"lat": "to_lat", "lng": "to_lng"})
    # Kept to the millimetre, so that equal distances compare as equal.
    distance = half_up(haversine_km(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")), 6)
    found = measured_join(cut_lineage(asked), placed, ["_y_b", "_x_b"]).withColumn("distance_km", distance)
    found = found.filter(F.col("distance_km").between(min_km, max_km))
    nearest = Window.partitionBy("lat", "lng").orderBy("distance_km", "name")
    top = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    rest = [c for c in candidates.columns if c not in ("lat", "lng")]
    return cut_lineage(top.select("lat", "lng", "rank", "distance_km", "to_lat", "to_lng", *rest))


def cities(spark) -> DataFrame:
    return spark.createDataFrame(list(CITIES), "name string, lat double, lng double, country string")


def place_table(cities: DataFrame, facilities: DataFrame) -> DataFrame:
    """Cities and facilities as one table of destinations."""
    return cities.select("name", "lat", "lng", "country", F.lit("city").alias("kind")).unionByName(
        facilities.select("name", "lat", "lng", F.col("notes").alias("country"), F.lit("facility").alias("kind"))
    )


def outside_red(places: DataFrame, scores: DataFrame) -> DataFrame:
    """Places whose cell is not in the red tier."""
    red = scores.filter(F.col("strategic_tier") == "red").select("q", "r").distinct()
    return salted_join(with_cell(places), red, ["q", "r"], "left_anti").drop("q", "r")


def evac_candidates(
    origins: DataFrame, places: DataFrame, scores: DataFrame, k: int = TOP_CANDIDATES, near: float = NEAR_KM, far: float = FAR_KM
) -> DataFrame:
    """Per origin position the nearest safe destinations that are neither at hand nor out of reach."""
    return nearest_places(origins, outside_red(places, scores), k, near, far)


def nearest_facility(destinations: DataFrame, facilities: DataFrame, scores: DataFrame) -> DataFrame:
    """Per destination position the nearest facility outside red cells."""
    return nearest_places(destinations, outside_red(facilities, scores), 1)
