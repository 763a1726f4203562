import math
import random

import pytest
from pyspark.sql import functions as F

from hexrisk.functions.grid import NEIGHBOR_OFFSETS, hex_cell, leg_cells
from hexrisk.operators import clusters, routes, spatial
from hexrisk.operators.joins import salted_join
from hexrisk.plans import serving


def km(a, b, c, d):
    p = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(p)))


def cloud(n, seed, box):
    rnd = random.Random(seed)
    # A third of all points sit at one spot.
    spot = (round(rnd.uniform(*box[0]), 4), round(rnd.uniform(*box[1]), 4))
    return [spot if i % 3 == 0 else (round(rnd.uniform(*box[0]), 4), round(rnd.uniform(*box[1]), 4)) for i in range(n)]


BOXES = {"mid": ((30.0, 37.0), (33.0, 42.0)), "dateline": ((-5.0, 5.0), (176.0, 184.0)), "pole": ((86.0, 89.9), (-180.0, 180.0))}


def frame(spark, points, key):
    rows = [(f"{key}{i}", la, (lo + 180.0) % 360.0 - 180.0) for i, (la, lo) in enumerate(points)]
    return rows, spark.createDataFrame(rows, f"{key} string, lat double, lng double")


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("radius", [40.0, 300.0])
def test_radius_search_equals_brute_force(spark, box, radius):
    a, points = frame(spark, cloud(60, 1, BOXES[box]), "p")
    b, targets = frame(spark, cloud(80, 2, BOXES[box]), "t")
    got = {(r.p, r.t) for r in spatial.within_radius(points, targets, radius).collect()}
    want = {(p, t) for p, la, lo in a for t, lb, lc in b if km(la, lo, lb, lc) <= radius}
    assert got == want


@pytest.mark.parametrize("k,near,far", [(5, 5.0, 500.0), (1, 0.0, spatial.HALF_EARTH_KM), (3, 50.0, 120.0)])
def test_nearest_places_equals_brute_force(spark, k, near, far):
    a, origins = frame(spark, cloud(70, 3, BOXES["mid"]) + [(-40.0, -120.0)], "origin")
    b, places = frame(spark, cloud(90, 4, BOXES["mid"]), "name")
    got = {}
    for r in spatial.nearest_places(origins, places, k, near, far).collect():
        got.setdefault((r.lat, r.lng), []).append((r["rank"], r.name))
    for _, la, lo in a:
        near_by = sorted((round(km(la, lo, lb, lc), 6), n) for n, lb, lc in b)
        want = [n for d, n in near_by if near <= d <= far][:k]
        assert [n for _, n in sorted(got.get((la, lo), []))] == want


def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = rows.join(lookup, ["k"], how), salted_join(rows, lookup, ["k"], how)
        assert plain.columns == salted.columns
        assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def grid_scores(spark, cells):
    rows = [(f"{q}_{r}", t, 0.5, 0.25, f"signal {q} | signal {r % 3}") for (q, r), t in cells.items()]
    return spark.createDataFrame(
        rows, "cell string, strategic_tier string, strategic_score double, tactical_score double, tactical_triggers string"
    )


def snake(n):
    """A single winding chain of cells, the worst case for spreading labels."""
    cells, q, r, step = {}, 0, 0, 1
    for _ in range(n):
        for _ in range(6):
            cells[(q, r)] = "red"
            q += step
        cells[(q, r)] = "red"
        for _ in range(2):
            r += 1
            cells[(q, r)] = "red"
        step = -step
    return cells


def random_cells(seed, n=26):
    rnd = random.Random(seed)
    return {(q, r): rnd.choice(["red", "green", "green", "orange"]) for q in range(n) for r in range(-n // 2, n // 2) if rnd.random() < 0.8}


def flood(cells):
    root = {}
    for start in sorted(cells):
        if start in root:
            continue
        stack = [start]
        root[start] = start
        while stack:
            q, r = stack.pop()
            for dq, dr in NEIGHBOR_OFFSETS:
                n = (q + dq, r + dr)
                if n in cells and n not in root and cells[n] == cells[start]:
                    root[n] = start
                    stack.append(n)
    return root


@pytest.mark.parametrize("cells", [snake(12), random_cells(1), random_cells(2), {(0, 0): "red"}], ids=["snake", "a", "b", "one"])
def test_clusters_equal_flood_fill(spark, cells):
    want = {f"{q}_{r}": f"{a}_{b}" for (q, r), (a, b) in flood(cells).items()}
    got = {r.cell: r.cluster_id for r in clusters.tier_clusters(grid_scores(spark, cells)).collect()}
    assert got == want


def test_cluster_summary_counts_and_caps_signals(spark):
    cells = {(q, 0): "red" for q in range(20)}
    row = serving.cluster_report(grid_scores(spark, cells)).first()
    assert (row.cells, row.avg_strategic_score, row.avg_tactical_score, len(row.triggers)) == (20, 0.5, 0.25, 8)
    assert row.narrative.startswith("This red-risk cluster of 20 zones shows: signal 0; ")
    assert row.description.startswith("HIGH RISK")


def test_seed_cluster_is_nearest_hops_first_and_capped(spark):
    cells = {(q, r): "red" for q in range(-6, 7) for r in range(-6, 7)} | {(30, 0): "green"}
    scores = grid_scores(spark, cells)
    seeds = spark.createDataFrame([("0_0",), ("30_0",), ("99_99",)], "cell string")
    rows = clusters.seed_cluster(seeds, scores).collect()
    by = {s: [r for r in rows if r.seed == s] for s in ("0_0", "30_0", "99_99")}
    assert {s: len(v) for s, v in by.items()} == {"0_0": 30, "30_0": 1, "99_99": 1}
    hops = [r.hop for r in sorted(by["0_0"], key=lambda r: r["rank"])]
    assert hops == [0] + [1] * 6 + [2] * 12 + [3] * 11


def state(spark, tiers):
    """Scores of single cells given by position."""
    rows = [(la, lo, t) for (la, lo), t in tiers.items()]
    df = spark.createDataFrame(rows, "lat double, lng double, strategic_tier string")
    hexed = df.select(hex_cell(F.col("lat"), F.col("lng")).alias("h"), "strategic_tier")
    return hexed.select("h.q", "h.r", "strategic_tier", F.concat_ws("_", "h.q", "h.r").alias("cell"))


def test_route_exposure_counts_distinct_cells(spark):
    points = spark.createDataFrame(
        [(1, i, 33.0, 35.0 + i * 0.001) for i in range(250)] + [(2, 0, 36.0, 40.0)], "route_id long, seq int, lat double, lng double"
    )
    scores = state(spark, {(33.0, 35.0): "orange", (33.0, 35.1): "red", (33.0, 35.2): "yellow"})
    out = {r.route_id: (r.danger_cells, r.total_cells) for r in routes.route_exposure(points, scores).collect()}
    assert out[1][0] == 2 and out[1][1] >= 4 and out[2] == (0, 1)


def test_long_ways_pass_every_cell(spark):
    from hexrisk.plans import serving

    scores = state(spark, {(33.0, 35.0 + i * 0.05): "red" for i in range(1, 200)})
    ways = spark.createDataFrame([(33.0, 35.0, 33.0, 45.0, 1, 0), (33.0, 35.0, 33.0, 35.5, 2, 0)], "lat double, lng double, to_lat double, to_lng double, rank int, variant int")
    passed = routes.danger_cells(scores)
    out = {r["rank"]: r.danger_cells for r in serving.exposed_ways(ways, passed, ["lat", "lng", "rank", "variant"]).collect()}
    assert out[1] == passed.count()


def test_a_leg_crosses_exactly_the_cells_it_passes_through(spark):
    rnd = random.Random(6)
    legs = []
    for i in range(60):
        lat, lng, far = rnd.uniform(-60, 60), rnd.uniform(-170, 170), rnd.choice([0.0, 0.02, 0.5, 3.0])
        legs.append((i, lat, lng, lat + rnd.uniform(-far, far), lng + rnd.uniform(-far, far)))
    legs += [(60, 10.0, 10.0, 10.0, 10.0), (61, 0.0, 0.0, 0.0, 2.0), (62, 0.0, 0.0, 2.0, 0.0)]
    df = spark.createDataFrame(legs, "i int, lat double, lng double, to_lat double, to_lng double")
    df = df.withColumn("cells", leg_cells(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")))
    fine = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4000)))).withColumn("t", F.col("t") / 4000.0)
    place = hex_cell(F.col("lat") + (F.col("to_lat") - F.col("lat")) * F.col("t"), F.col("lng") + (F.col("to_lng") - F.col("lng")) * F.col("t"))
    seen = fine.groupBy("i").agg(F.collect_set(place).alias("seen"), F.first("cells").alias("cells"))
    out = {r.i: r for r in seen.collect()}
    for r in out.values():
        cells, found = {tuple(c) for c in r.cells}, {tuple(c) for c in r.seen}
        # The leg along an axis may lie on edges, which belong to either side.
        assert r.i > 60 or (found <= cells and len(cells) - len(found) <= 2), r.i
        # Cells come in order, each next to the one before.
        assert all((b[0] - a[0], b[1] - a[1]) in NEIGHBOR_OFFSETS for a, b in zip(r.cells, r.cells[1:]))
    assert len(out[60].cells) == 1 and len(out[62].cells) > 30


def test_an_origin_may_bring_its_goal(spark):
    origins = spark.createDataFrame([(1, 20.0, 20.0, 20.0, 20.8), (2, 20.0, 20.0, None, None), (3, 20.0, 20.0, 20.0, 20.6)], "origin_id long, lat double, lng double, goal_lat double, goal_lng double")
    places = facility_frame(spark, [("Goal", "hospital", 20.0, 21.0, "major", "far off")])
    red = state(spark, {(20.0, 20.5): "red", (20.0, 20.8): "red"})
    rows = {r.origin_id: r for r in serving.evac_plan(origins, places, red).collect()}
    # A goal in danger stays the goal; its own cell is counted on every way.
    assert (rows[1].destination, rows[1].danger_cells, rows[1].variant) == ("Custom destination", 1, 1)
    assert rows[1].danger_ids == [r.cell for r in red.collect() if r.cell in rows[1].danger_ids] and len(rows[1].route_points) == 3
    assert rows[2].destination == "Goal" and rows[2].danger_cells == 0 and rows[2].danger_ids == []
    assert rows[3].destination == "Custom destination" and rows[3].route_points[-1] == [20.6, 20.0]


def test_supplied_routes_are_thinned_on_request_only(spark):
    # A zigzag: thinned to every second point it is a straight line, which misses the corners.
    points = spark.createDataFrame([(1, i, 33.0 + 0.3 * (i % 2), 35.0 + i * 0.05) for i in range(250)], "route_id long, seq int, lat double, lng double")
    scores = state(spark, {(33.3, 35.05): "red", (33.15, 35.075): "orange"})
    assert routes.route_exposure(points, scores).first().danger_cells == 2
    assert routes.route_exposure(points, scores, about=100).first().danger_cells == 0


def facility_frame(spark, rows):
    return spark.createDataFrame(rows, "name string, type string, lat double, lng double, capacity string, notes string")


def test_evac_plan_takes_detour_only_if_it_crosses_less(spark):
    origins = spark.createDataFrame([(1, 20.0, 20.0), (2, 20.0, 20.0), (3, -60.0, 100.0)], "origin_id long, lat double, lng double")
    places = facility_frame(spark, [("Goal", "hospital", 20.0, 21.0, "major", "far off"), ("Near", "hospital", 20.01, 20.0, "major", "")])
    blocked = state(spark, {(20.0, 20.5): "orange"})
    rows = {r.origin_id: r for r in serving.evac_plan(origins, places, blocked).collect()}
    assert (rows[1].destination, rows[1].variant, rows[1].danger_cells) == ("Goal", 1, 0)
    assert rows[1].distance_km > km(20.0, 20.0, 20.0, 21.0) and rows[2].distance_km == rows[1].distance_km
    assert rows[1].nearest_facility == "Goal" and rows[1].facility_km == 0.0
    assert rows[3].destination == "No safe destination found"
    free = state(spark, {(20.0, 20.5): "green"})
    assert serving.evac_plan(origins, places, free).filter("origin_id = 1").first().variant == 0


def test_red_places_are_no_destination(spark):
    origins = spark.createDataFrame([(1, 20.0, 20.0)], "origin_id long, lat double, lng double")
    places = facility_frame(spark, [("Goal", "hospital", 20.0, 21.0, "major", "")])
    red = state(spark, {(20.0, 21.0): "red"})
    assert serving.evac_plan(origins, places, red).first().destination == "No safe destination found"


def test_area_report_distinguishes_no_cells_and_no_scores(spark):
    areas = spark.createDataFrame([(1, 33.0, 35.0), (2, 0.0, 0.0), (3, 10.0, 10.0)], "area_id long, lat double, lng double")
    grid = spark.createDataFrame([("a", 33.1, 35.0), ("b", 10.0, 10.1)], "cell string, lat double, lng double")
    scores = spark.createDataFrame(
        [("a", 0.71, "x | y", "2024-01-01")], "cell string, strategic_score double, tactical_triggers string, scored_at string"
    )
    rows = {r.area_id: r for r in serving.area_report(areas, grid, scores).collect()}
    assert (rows[1].hex_count, rows[1].red, rows[1].top_triggers, rows[1].note) == (1, 1, ["x", "y"], None)
    assert rows[2].note == serving.NO_CELLS and rows[2].hex_count == 0
    assert rows[3].note == serving.NO_SCORES and rows[3].hex_count == 1


def test_a_crowded_bucket_is_split_and_nothing_is_lost(spark, monkeypatch):
    from hexrisk.operators import joins

    # Half of all points and of all targets share a bucket.
    rnd = random.Random(8)
    place = lambda i: (33.0 + rnd.random() * 0.05, 35.0 + rnd.random() * 0.05) if i % 2 else (rnd.uniform(-80, 80), rnd.uniform(-180, 180))
    points = [(i, *place(i)) for i in range(600)]
    targets = [(f"t{i}", *place(i)) for i in range(500)]
    a = spark.createDataFrame(points, "id long, lat double, lng double")
    b = spark.createDataFrame(targets, "name string, lat double, lng double")
    want = {(i, n) for i, x, y in points for n, u, v in targets if km(x, y, u, v) <= 4.0}
    for cell in (64, 4096):
        found = [(r.id, r.name) for r in joins.measured_join(a.withColumn("k", F.floor("lat")), b.select("name", F.floor("lat").alias("k")), ["k"], cell).collect()]
        assert len(found) == len(set(found)) == sum(math.floor(x) == math.floor(u) for _, x, _ in points for _, u, _ in targets)
        monkeypatch.setattr(spatial, "measured_join", lambda left, right, on, cell=cell: joins.measured_join(left, right, on, cell))
        got = [(r.id, r.name) for r in spatial.within_radius(a, b, 4.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_remote_positions_look_at_few_places(spark, monkeypatch):
    places = [(f"p{i}", 33.0 + (i % 30) * 0.05, 35.0 + (i // 30) * 0.05) for i in range(900)]
    askers = [(-20.0 - i * 0.5, 120.0 + j * 0.5) for i in range(5) for j in range(8)]
    met, join = [], spatial.measured_join

    def counted(left, right, on):
        pairs = join(left, right, on)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "measured_join", counted)
    a, b = spark.createDataFrame(askers, "lat double, lng double"), spark.createDataFrame(places, "name string, lat double, lng double")
    got = {(r.lat, r.lng): r.distance_km for r in spatial.nearest_places(a, b, 1).collect()}
    assert got == {spot: pytest.approx(min(km(*spot, x, y) for _, x, y in places), abs=1e-6) for spot in askers}
    # Of 36,000 pairs.
    assert sum(met) < 40 * 100


def test_cells_of_ways_are_found_once_and_only_dangerous_ones_go_on(spark):
    ways = spark.createDataFrame([(33.0, 35.0, 33.0, 45.0, 1, 0), (33.0, 35.0, 33.0, 35.5, 2, 1)], "lat double, lng double, to_lat double, to_lng double, rank int, variant int")
    passed = routes.danger_cells(state(spark, {(33.0, 35.3): "red"}))
    exposed = serving.exposed_ways(ways, passed, ["lat", "lng", "rank", "variant"])
    plan = exposed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Generate") == 1
    assert {r["rank"]: (r.danger_cells, len(r.danger_ids)) for r in exposed.collect()}[1] == (1, 1)
