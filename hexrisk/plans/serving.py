"""Questions users ask of the scores, each answered for many askers in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexrisk.functions.geo import haversine_km
from hexrisk.functions.grid import with_axes
from hexrisk.functions.numbers import half_up, stored_mean
from hexrisk.functions.risk import ALL_TIERS, cluster_text, route_text, strategic_tier, tier_description
from hexrisk.operators.clusters import cluster_center, cluster_summary, seed_cluster, tier_clusters
from hexrisk.operators.joins import salted_join
from hexrisk.operators.routes import best_route, cell_exposure, danger_cells, route_km, way_cells, way_points
from hexrisk.operators.spatial import cities, evac_candidates, nearest_facility, place_table, within_radius
from hexrisk.operators.summaries import latest_k
from hexrisk.plans.scoring import backtest_days
from hexrisk.session import cut_lineage
from hexrisk.sources.tables import enrich_scores, with_current_tier

NEAR_RADIUS_KM, AREA_RADIUS_KM = 50.0, 80.0
TOP_TRIGGERS, RECENT_EVENTS, CLUSTER_TRIGGERS = 5, 4, 8
# Answers where there is nothing to report, and the name of a goal that the asker brings.
NO_CELLS = "No monitored hexes in this area."
NO_SCORES = "No risk scores available yet for this area. Run the scoring engine first."
NO_DESTINATION = "No safe destination found"
NO_WAY = "Unable to find a safe evacuation destination. All nearby cities are in danger zones."
CUSTOM_GOAL = "Custom destination"
STATE_COLUMNS = (
    "cell",
    "strategic_score",
    "strategic_tier",
    "tactical_score",
    "tactical_tier",
    "should_alert",
)


def latest_state(scores: DataFrame | None, features: DataFrame, model=None) -> DataFrame:
    """Current state with tiers recomputed; without any score, the newest panel day is scored instead."""
    if scores is not None and not scores.isEmpty():
        return with_current_tier(scores).select(*STATE_COLUMNS, F.col("scored_at").cast("string").alias("scored_at"))
    newest = features.select(F.max("event_date")).scalar()
    return backtest_days(features, newest, newest, model).select(*STATE_COLUMNS, "scored_at")


def cell_detail(scores: DataFrame, news_days: DataFrame, thermal_days: DataFrame, events: DataFrame) -> DataFrame:
    """Score row of every cell with its latest news day, latest thermal day and last four events.

    The feeds are keyed by ``q``, ``r``; ``events`` needs ``event_id`` to order the events of a day.
    """
    base = with_axes(scores)

    def last(days: DataFrame, prefix: str) -> DataFrame:
        values = [c for c in days.columns if c not in ("q", "r")]
        newest = days.groupBy("q", "r").agg(F.max_by(F.struct(*values), "event_date").alias("v"))
        return newest.select("q", "r", *[F.col(f"v.{c}").alias(f"{prefix}{'date' if c == 'event_date' else c}") for c in values])

    keyed = events.withColumn("_key", F.struct("q", "r"))
    recent = latest_k(keyed, "_key", [F.desc("event_date"), F.desc("event_id")], RECENT_EVENTS)
    item = F.struct("rank", "event_date", "event_type", "fatalities", "actor1")
    lists = recent.groupBy("q", "r").agg(F.array_sort(F.collect_list(item)).alias("recent_events"))
    return (
        base.join(last(news_days, "news_"), ["q", "r"], "left")
        .join(last(thermal_days, "thermal_"), ["q", "r"], "left")
        .join(lists, ["q", "r"], "left")
    )


def cells_near(points: DataFrame, grid: DataFrame, scores: DataFrame, radius_km: float = NEAR_RADIUS_KM) -> DataFrame:
    """Cells within the radius of every point, with scores and distance in metres; order by ``distance_m`` to list."""
    # Scores go to the cells first: pairs are many and are not moved again.
    targets = enrich_scores(grid.select("cell", "lat", "lng"), scores.select(*STATE_COLUMNS))
    found = within_radius(points, targets, radius_km)
    return found.withColumn("distance_m", F.col("distance_km") * 1000.0).drop("distance_km")


def top_triggers(rows: DataFrame, by: list[str], k: int = TOP_TRIGGERS) -> DataFrame:
    """Most frequent trigger texts per group with ``rank``; ties by text. Blank texts do not count."""
    texts = F.filter(F.transform(F.split("tactical_triggers", r" \| "), lambda t: F.trim(t)), lambda t: t != "")
    counted = rows.select(*by, F.explode(texts).alias("trigger")).groupBy(*by, "trigger").agg(F.count(F.lit(1)).alias("times"))
    keyed = counted.withColumn("_key", F.struct(*by)) if by else counted.withColumn("_key", F.lit(0))
    return latest_k(keyed, "_key", [F.desc("times"), F.asc("trigger")], k).drop("_key")


def area_summary(areas: DataFrame, grid: DataFrame, scores: DataFrame, radius_km: float = AREA_RADIUS_KM) -> DataFrame:
    """Per distinct area position: scored cells, tier counts, mean and peak score, newest stamp, top triggers."""
    spots = areas.select("lat", "lng").distinct()
    state = scores.select("cell", "strategic_score", "tactical_triggers", "scored_at")
    targets = enrich_scores(grid.select("cell", "lat", "lng"), state.withColumn("_has", F.lit(1)))
    # Numbers and triggers both start from these rows, so they are found once.
    found = within_radius(spots, targets, radius_km)
    rows = cut_lineage(found.select("lat", "lng", "_has", "strategic_score", "tactical_triggers", "scored_at"))
    has, spot = F.col("_has").isNotNull(), ["lat", "lng"]
    score = F.coalesce("strategic_score", F.lit(0.0))
    tier = strategic_tier(score)
    numbers = rows.groupBy(*spot).agg(
        F.count(F.lit(1)).alias("monitored_cells"),
        F.count("_has").alias("hex_count"),
        stored_mean(F.when(has, score), 4).alias("avg_strategic"),
        F.max(F.when(has, score)).alias("max_strategic"),
        F.max("scored_at").alias("latest_scored_at"),
        *[F.count_if(has & (tier == t)).alias(t) for t in ALL_TIERS],
    )
    scored = rows.filter(has)
    best = top_triggers(scored, spot).groupBy(*spot).agg(
        F.array_sort(F.collect_list(F.struct("rank", "trigger"))).alias("_t")
    )
    listed = best.select(*spot, F.transform("_t", lambda t: t["trigger"]).alias("top_triggers"))
    return spots.join(numbers, spot, "left").join(listed, spot, "left")


def area_report(areas: DataFrame, grid: DataFrame, scores: DataFrame, radius_km: float = AREA_RADIUS_KM) -> DataFrame:
    """Area summary for every asker; a position many ask from is worked out once."""
    summary = area_summary(areas, grid, scores, radius_km)
    zero = ("monitored_cells", "hex_count", "red", "orange", "yellow", "green")
    joined = salted_join(areas, summary, ["lat", "lng"]).fillna(0, subset=list(zero))
    note = F.when(F.col("monitored_cells") == 0, NO_CELLS).when(F.col("hex_count") == 0, NO_SCORES)
    counted = F.when(F.col("hex_count") == 0, F.col("monitored_cells")).otherwise(F.col("hex_count"))
    return joined.withColumn("note", note).withColumn("hex_count", counted)


def cluster_report(scores: DataFrame, k: int | None = CLUSTER_TRIGGERS) -> DataFrame:
    """Every contiguous same-tier cluster with its numbers, signals (the first ``k``; all for None), centre, description and sentence."""
    return describe_clusters(tier_clusters(scores), "cluster_id", k)


def seed_cluster_report(seeds: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """The report for clusters grown from given cells, at most thirty cells each."""
    members = seed_cluster(seeds, scores).drop("strategic_tier")
    return describe_clusters(enrich_scores(members, scores), "seed", k)


def describe_clusters(clustered: DataFrame, key: str, k: int | None = None) -> DataFrame:
    summary = cluster_summary(clustered, key, k).join(cluster_center(clustered, key), key)
    return summary.withColumns(
        {
            "description": tier_description(F.col("strategic_tier")),
            "narrative": cluster_text(F.col("strategic_tier"), F.col("cells"), F.col("triggers")),
        }
    )


def evac_plan(
    origins: DataFrame, facilities: DataFrame, scores: DataFrame, speed_km_h: float | None = None
) -> DataFrame:
    """Per origin the destination and way with the fewest dangerous cells, the ids of these and the corners of the way.

    The five nearest safe places are tried on straight ways; if the best way still crosses danger, a detour on either
    side is tried and taken only if it crosses less. An origin with ``goal_lat`` and ``goal_lng`` goes there, whatever lies
    around. Without a road service there is no travel time, so ``duration_min`` is 0 unless a speed is given. Positions that
    several origins share are planned once.
    """
    axes = with_axes(scores)
    danger = cut_lineage(danger_cells(axes))
    places = place_table(cities(scores.sparkSession), facilities)
    goal = ["goal_lat", "goal_lng"]
    if "goal_lat" not in origins.columns:
        origins = origins.withColumns({c: F.lit(None).cast("double") for c in goal})
    own = origins.filter("goal_lat is not null and goal_lng is not null").select("lat", "lng", *goal).distinct()
    free = evac_candidates(origins.filter("goal_lat is null or goal_lng is null"), places, axes)
    free = free.withColumns({c: F.lit(None).cast("double") for c in goal})
    custom = own.select(
        "lat", "lng", F.lit(1).alias("rank"), half_up(haversine_km(F.col("lat"), F.col("lng"), *map(F.col, goal)), 6).alias("distance_km"),
        F.col("goal_lat").alias("to_lat"), F.col("goal_lng").alias("to_lng"), F.lit(CUSTOM_GOAL).alias("name"), F.lit("").alias("country"), F.lit("custom").alias("kind"), *goal,
    )
    # A position may ask for several goals of its own and for free choice: each is a question.
    question = F.concat_ws(",", *[F.col(c).cast("string") for c in goal])
    ways = cut_lineage(free.unionByName(custom).withColumns({"variant": F.lit(0), "question": question}).drop(*goal))
    way, spot = ["lat", "lng", "question", "rank", "variant"], ["lat", "lng", "question"]
    best = cut_lineage(best_route(exposed_ways(ways, danger, way), spot))
    detours = best.filter("danger_cells > 0").drop("danger_cells", "total_cells", "danger_ids")
    sides = detours.withColumn("variant", F.explode(F.array(F.lit(1), F.lit(-1))))
    tried = exposed_ways(sides, danger, way)
    # Direct way first, then the two sides: an equal count never replaces an earlier way.
    every = best.unionByName(tried).withColumn("_order", F.pmod(F.col("variant"), F.lit(3)))
    chosen = best_route(every, spot, "_order").drop("_order")
    km = half_up(route_km(F.col("variant")), 1)
    minutes = F.floor(km / F.lit(speed_km_h) * 60.0) if speed_km_h else F.lit(0).cast("bigint")
    timed = cut_lineage(chosen.withColumns({"distance_km": km, "duration_min": minutes, "route_points": way_points(F.col("variant"))}))
    goals = timed.select(F.col("to_lat").alias("lat"), F.col("to_lng").alias("lng")).distinct()
    shelter = nearest_facility(goals, facilities.select("name", "type", "lat", "lng", "notes"), axes)
    near = shelter.select(
        F.col("lat").alias("to_lat"),
        F.col("lng").alias("to_lng"),
        F.col("name").alias("nearest_facility"),
        half_up(F.col("distance_km"), 1).alias("facility_km"),
    )
    planned = salted_join(timed, near, ["to_lat", "to_lng"], "left")
    text = route_text(
        F.col("name"),
        F.col("country"),
        F.col("distance_km"),
        F.col("duration_min"),
        F.col("danger_cells"),
        F.col("nearest_facility"),
    )
    named = planned.withColumn("narrative", text).withColumnRenamed("name", "destination").drop("kind")
    asked = origins.withColumn("question", F.when(F.col("goal_lat").isNotNull() & F.col("goal_lng").isNotNull(), question).otherwise(F.lit("")))
    joined = salted_join(asked, named, spot, "left").drop("question")
    return joined.withColumns(
        {
            "destination": F.coalesce("destination", F.lit(NO_DESTINATION)),
            "distance_km": F.coalesce("distance_km", F.lit(0.0)),
            "narrative": F.coalesce("narrative", F.lit(NO_WAY)),
        }
    )


def exposed_ways(ways: DataFrame, danger: DataFrame, way: list[str]) -> DataFrame:
    """Ways with the count of the cells they cross, of the dangerous ones among them, and their ids."""
    return cell_exposure(ways.withColumn("cells", way_cells(F.col("variant"))), danger, way)
