import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from hexrisk.sources import feeds, tables


def put(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)
    return str(path)


def test_conflict_csv(spark, tmp_path):
    text = (
        "event_id_cnty,event_date,latitude,longitude,geo_precision,event_type,sub_event_type,actor1,actor2,fatalities,population_best\n"
        'X1,03/02/2024,33.1,35.2,1,Battles,"Armed clash, other",A,,4,\n'
        "X2,2024-02-04,33.1,35.2,2,Riots,Mob violence,,B,many,1000\n"
        "X3,bad,33.1,35.2,1,Riots,Mob violence,A,B,0,0\n"
        "X4,05/02/2024,,35.2,1,Riots,Mob violence,A,B,0,0\n"
    )
    rows = feeds.read_conflict_events(spark, put(tmp_path / "c", "c.csv", text)).orderBy("event_date").collect()
    assert [str(r.event_date) for r in rows] == ["2024-02-03", "2024-02-04"]
    assert (rows[0].fatalities, rows[0].population_best, rows[0].sub_event_type) == (4.0, 0.0, "Armed clash, other")
    assert (rows[1].fatalities, rows[1].actor1, rows[1].geo_precision) == (0.0, None, 2.0)


def test_news_tsv(spark, tmp_path):
    def line(**at):
        cells = [""] * feeds.NEWS_WIDTH
        for name, value in at.items():
            cells[feeds.NEWS_POSITIONS.get(name, feeds.NEWS_ROOT_CODE_POSITION)] = value
        return "\t".join(cells)

    good = dict(id="1", day="20240101", goldstein="-5.5", articles="7", tone="-3.25", lat="33.5", lng="35.5", code="14")
    lines = [line(**good), line(**{**good, "id": "2", "lat": "50.0"}), line(**{**good, "id": "3", "lng": "?"}), line(**{**good, "id": "4", "tone": '"x'})]
    rows = feeds.read_news_events(spark, put(tmp_path / "n", "20240203.export.CSV", "\n".join(lines) + "\n")).orderBy("id").collect()
    assert [r.id for r in rows] == ["1", "4"]
    assert (str(rows[0].event_date), rows[0].goldstein, rows[0].tone, rows[0].articles, rows[0].code) == ("2024-02-03", -5.5, -3.25, 7.0, 14)
    assert rows[1].tone is None


def test_news_width_and_box(spark, tmp_path):
    fields = [""] * feeds.NEWS_WIDTH
    fields[0], fields[1], fields[53], fields[54] = "1", "20240101", "50.0", "3.0"
    text = "\n".join("\t".join(f) for f in (fields, fields[:55], [*fields, "a", "b"])) + "\n"
    path = put(tmp_path / "n", "20240203.export.CSV", text)
    assert feeds.read_news_events(spark, path).count() == 0
    assert feeds.read_news_events(spark, path, box=None).count() == 1


def test_conflict_csv_with_line_breaks_in_a_value(spark, tmp_path):
    text = 'event_date,latitude,longitude,notes,geo_precision\n01/02/2024,33.1,35.2,"two\nlines ""quoted""",1\n02/02/2024,33.1,35.2,plain,2\n'
    rows = feeds.read_conflict_events(spark, put(tmp_path / "c", "c.csv", text)).orderBy("event_date").collect()
    assert [(str(r.event_date), r.geo_precision) for r in rows] == [("2024-02-01", 1.0), ("2024-02-02", 2.0)]



@pytest.mark.parametrize(
    "header,when", [("latitude,longitude,acq_date,frp", "2024-02-03"), ("latitude,longitude,acq_datetime,FRP", "2024-02-03 23:15:00")]
)
def test_thermal_csv(spark, tmp_path, header, when):
    text = f"{header}\n33.1,35.2,{when},12.5\n33.1,35.2,{when},?\nx,35.2,{when},1\n33.1,35.2,never,1\n"
    rows = feeds.read_thermal(spark, put(tmp_path / "t", "t.csv", text)).collect()
    assert [str(r.event_date) for r in rows] == ["2024-02-03"] * 2 and sorted(r.frp for r in rows) == [0.0, 12.5]


def test_weather_json(spark, tmp_path):
    doc = {
        "grid_lat": 33.0,
        "grid_lon": 35.5,
        "daily": {
            "time": ["2024-01-01", "2024-01-02"],
            "temperature_2m_max": [20.5, None],
            "temperature_2m_mean": [15.0, 14.0],
            "precipitation_sum": [0.0, 3.5],
        },
    }
    rows = feeds.read_weather_daily(spark, put(tmp_path / "w", "w.json", json.dumps(doc))).orderBy("event_date").collect()
    assert [(str(r.event_date), r.temp_max, r.precip_mm) for r in rows] == [("2024-01-01", 20.5, 0.0), ("2024-01-02", None, 3.5)]


def test_facility_json(spark, tmp_path):
    item = {"name": "H", "type": "hospital", "lat": 33.0, "lng": 35.0, "capacity": "major", "notes": "n"}
    rows = feeds.read_facilities(spark, put(tmp_path / "f", "f.json", json.dumps({"shelters": [item, {**item, "name": "K"}]}, indent=2))).collect()
    assert [r.name for r in rows] == ["H", "K"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "cell string, strategic_score double, scored_at string")


def test_upsert_twice_equals_once_and_last_write_wins(spark):
    current = scores(spark, [("a", 0.1, "2024-01-09"), ("b", 0.2, "2024-01-01")])
    updates = scores(spark, [("a", 0.5, "2024-01-02"), ("a", 0.6, "2024-01-03"), ("c", 0.7, "2024-01-02")])
    once = tables.upsert_scores(current, updates)
    twice = tables.upsert_scores(once, updates)
    want = {("a", 0.6), ("b", 0.2), ("c", 0.7)}
    assert {(r.cell, r.strategic_score) for r in once.collect()} == want == {(r.cell, r.strategic_score) for r in twice.collect()}


def test_patch_changes_only_its_keys(spark):
    df = spark.createDataFrame([("a", "old"), ("b", None)], "cell string, alert_text string")
    patch = spark.createDataFrame([("b", "new"), ("z", "lost")], "cell string, alert_text string")
    assert sorted((r.cell, r.alert_text) for r in tables.patch_column(df, patch, "cell", "alert_text").collect()) == [("a", "old"), ("b", "new")]


def test_days_are_replaced_not_appended(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.range(20).select("id", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 4).cast("int")).alias("event_date"))
    tables.write_feature_table(df, path)
    part = df.filter("event_date = '2024-01-02'").withColumn("id", F.col("id") + 1000)
    for _ in range(2):
        tables.replace_days(part, path)
    back = tables.read_feature_table(spark, path)
    assert back.count() == 20 and back.filter("id >= 1000").count() == 5


def test_day_slice_reads_one_folder(spark, tmp_path):
    from hexrisk.plans.scoring import slice_day

    path = str(tmp_path / "panel")
    df = spark.range(20).select("id", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 4).cast("int")).alias("event_date"))
    tables.write_feature_table(df, path)
    plan = slice_day(tables.read_feature_table(spark, path), "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2024-01-02" in plan


def test_geojson_features(spark):
    cells = spark.createDataFrame([("179_657", "red")], "cell string, strategic_tier string")
    feature = json.loads(tables.to_geojson_features(cells, "cell").first().value)
    ring = feature["geometry"]["coordinates"][0]
    assert feature["properties"] == {"cell": "179_657", "strategic_tier": "red"} and feature["geometry"]["type"] == "Polygon"
    assert len(ring) == 7 and ring[0] == ring[-1] and 32 < ring[0][1] < 34 and 35 < ring[0][0] < 38
    places = spark.createDataFrame([("H", 33.0, 35.0)], "name string, lat double, lng double")
    assert json.loads(tables.to_geojson_features(places, "point").first().value)["geometry"] == {"type": "Point", "coordinates": [35.0, 33.0]}


def test_read_scores_recomputes_tiers(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("a", 0.71, "green"), ("b", None, "red")], "cell string, strategic_score double, strategic_tier string").write.parquet(path)
    assert {r.cell: r.strategic_tier for r in tables.read_scores(spark, path).collect()} == {"a": "red", "b": "green"}


def test_a_news_line_is_cut_once(spark, tmp_path):
    """Filters that repeat the cutting of a line made the reader several times slower."""
    values = ["x"] * feeds.NEWS_WIDTH
    values[0], values[1], values[53], values[54] = "7", "20240203", "33.1", "35.2"
    path = put(tmp_path / "n", "part-0.txt", "\t".join(values) + "\n" + "\t".join(values[1:]) + "\n")
    df = feeds.read_news_events(spark, path)
    assert [(r.id, str(r.event_date)) for r in df.collect()] == [("7", "2024-02-03")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
