import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexrisk.operators import aggregate, clean, panel
from hexrisk.functions.geo import REGION_BOX
from hexrisk.operators.weather import attach_weather, nearest_grid, precip_spike, temp_anomaly
from hexrisk.plans.features import build_features, conflict_rows

DAY = dt.date(2024, 1, 1)
SCHEMA = (
    "event_id long, event_date date, lat double, lng double, geo_precision int, event_type string, sub_event_type string, "
    "actor1 string, actor2 string, fatalities long, population_best long"
)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, day(0), 33.0, 35.0, 1, "Battles", "Other", "A", "B", 3, 0),
        (2, day(0), 33.0, 35.0, 1, "Battles", "Other", "A", None, 2, 500),
        (3, day(0), 33.0, 35.0, 2, "Protests", "Violent demonstration", None, None, None, 0),
        (4, day(4), 33.0, 35.0, 1, "Riots", "Other", "C", "D", 1, 0),
        (5, day(9), 33.05, 35.0, 1, "Protests", "Peaceful", "unknown", None, 0, 0),
        (6, day(2), 33.05, 35.0, 3, "Battles", "Other", "A", "B", 9, 0),
        (7, day(2), 33.05, 35.0, None, "Battles", "Other", "A", "B", 9, 0),
        (8, day(3), None, 35.0, 1, "Battles", "Other", "A", "B", 9, 0),
        (9, day(1), 33.05, 35.0, 1, None, None, "A", "B", 0, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_flags_and_null_rules(events):
    rows = {r.event_id: r for r in clean.clean_conflict(events).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 9}
    assert [rows[i].is_dangerous for i in (1, 3, 4, 5, 9)] == [1, 1, 1, 0, 0]
    assert rows[3].actor_pair == "unknown||unknown" and rows[3].fatalities == 0


def test_cell_day_counts(events):
    rows = aggregate.agg_conflict_day(conflict_rows(events)).collect()
    first = next(r for r in rows if r.event_date == day(0))
    assert (first.event_count, first.dangerous_count, first.total_fatalities, first.max_fatalities) == (3, 3, 5, 3)
    assert (first.unique_actors, first.actor_pair_count, first.population_best) == (1, 3, 500)
    # A missing type does not count as an event, the row still makes a cell-day.
    assert next(r for r in rows if r.event_date == day(1)).event_count == 0


def test_panel_is_cells_times_days_and_keeps_nulls_of_existing_rows(spark):
    daily = spark.createDataFrame(
        [(0, 0, day(2), 5, None), (0, 0, day(4), 1, 2.5), (7, 1, day(0), 1, 1.0)], "q long, r long, event_date date, n long, x double"
    )
    rows = panel.build_panel(daily).collect()
    assert len(rows) == 2 * 5 and len({(r.q, r.r, r.event_date) for r in rows}) == 10
    by_key = {(r.q, r.event_date): (r.n, r.x) for r in rows}
    assert by_key[(0, day(2))] == (5, None) and by_key[(0, day(3))] == (0, 0.0) and by_key[(7, day(4))] == (0, 0.0)


def dense(spark, values, col="dangerous_count"):
    rows = [(0, 0, day(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"q long, r long, event_date date, {col} long")


def test_label_looks_three_days_ahead(spark):
    values = [0, 1, 0, 0, 0, 0, 2, 0, 0]
    rows = panel.drop_tail(panel.label_lookahead(dense(spark, values))).orderBy("event_date").collect()
    assert [r.label for r in rows] == [int(any(values[i + 1 : i + 4])) for i in range(len(values) - 3)]


def test_static_fill(spark):
    df = panel.fill_static(dense(spark, [0, 0, 5, 0, 7, 0], "population_best")).orderBy("event_date")
    assert [r.population_best for r in df.collect()] == [5, 5, 5, 5, 7, 7]
    nothing = panel.fill_static(dense(spark, [0, 0], "population_best"))
    assert [r.population_best for r in nothing.collect()] == [0, 0]


def test_neighbour_features_divide_by_existing_neighbours(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 5)]
    rows = [(q, r, day(t), 10 * i + t, i) for i, (q, r) in enumerate(cells) for t in range(2)]
    df = spark.createDataFrame(rows, "q long, r long, event_date date, dangerous_count long, total_fatalities long")
    features = {k: panel.NEIGHBOR_FEATURES[k] for k in ("neighbor_danger_avg", "neighbor_fatal_sum")}
    out = {(r.q, r.r, r.event_date): r for r in panel.spatial_lag(df, features).collect()}
    a = out[(0, 0, day(1))]
    assert (a.neighbor_danger_avg, a.neighbor_fatal_sum) == ((11 + 21) / 2, 3.0)
    assert (out[(5, 5, day(0))].neighbor_danger_avg, out[(5, 5, day(0))].neighbor_fatal_sum) == (0.0, 0.0)


def test_feature_job_equals_the_single_operators(spark, events):
    """The fused job gives what panel, windows and spatial lag give one after the other."""
    fused = build_features(events, keep_tail=True)
    rows = conflict_rows(events)
    base = panel.build_panel(aggregate.agg_conflict_day(rows), panel.date_bounds(rows))
    steps = panel.fill_static(base).transform(panel.rolling_means).transform(panel.deltas).transform(panel.actor_roll)
    steps = panel.velocity(steps).transform(panel.temporal_lags)
    steps = panel.spatial_lag(steps, {k: v for k, v in panel.NEIGHBOR_FEATURES.items() if v[0] in base.columns})
    columns = sorted(set(steps.columns))
    left, right = fused.select(*columns), steps.select(*columns)
    assert left.count() == 20
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0
    labelled = build_features(events)
    assert labelled.count() == 14 and labelled.filter("label is null").count() == 0
    assert fused.filter("label is null").count() == 6


def test_attach_keeps_panel_rows_and_zero_fills(spark):
    base = dense(spark, [1, 2])
    feats = spark.createDataFrame([(0, 0, day(1), 0.5), (9, 9, day(0), 0.7)], "q long, r long, event_date date, h double")
    rows = panel.attach_features(base, feats, ["h"]).orderBy("event_date").collect()
    assert [r.h for r in rows] == [0.0, 0.5]


def test_temperature_anomaly_needs_a_week(spark):
    rows = [(33.0, 35.0, day(i), float(i), 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "grid_lat double, grid_lon double, event_date date, temp_max double, precip_mm double")
    out = [r.temp_anomaly_30d for r in temp_anomaly(df).orderBy("event_date").collect()]
    assert out[:6] == [0.0] * 6 and out[6] == 6 - 3.0 and out[9] == 9 - 4.5


def test_rain_spike_is_per_month(spark):
    rows = [(33.0, 35.0, DAY + dt.timedelta(days=i), 0.0, float(i % 31)) for i in range(60)]
    df = spark.createDataFrame(rows, "grid_lat double, grid_lon double, event_date date, temp_max double, precip_mm double")
    spikes = [r for r in precip_spike(df).collect() if r.precip_spike]
    assert {r.event_date.month for r in spikes} == {1, 2} and all(r.precip_mm > 20 for r in spikes)


def test_nearest_grid_equals_a_search_over_all_points(spark):
    import numpy as np

    from hexrisk.functions.grid import cell_center

    cells = spark.range(400).select((F.col("id") * 3 % 140 + 150).alias("q"), (F.col("id") * 7 % 180 + 570).alias("r"))
    lat, lng = cell_center(F.col("q"), F.col("r"))
    lats, lons = np.arange(29.5, 37.51, 0.5), np.arange(33.5, 42.51, 0.5)
    for row in nearest_grid(cells, REGION_BOX).withColumns({"lat": lat, "lng": lng}).collect():
        assert row.grid_lat == lats[np.argmin((lats - row.lat) ** 2)] and row.grid_lon == lons[np.argmin((lons - row.lng) ** 2)]


def test_weather_is_zero_where_unknown(spark):
    base = dense(spark, [1])
    empty = spark.createDataFrame(
        [], "grid_lat double, grid_lon double, event_date date, temp_max double, temp_anomaly_30d double, precip_mm double, precip_spike int"
    )
    row = attach_weather(base, empty).first()
    assert (row.temp_max, row.precip_spike) == (0.0, 0)
