import pytest
from pyspark.sql import functions as F

from hexrisk.functions import risk
from hexrisk.functions.grid import (
    cell_boundary,
    cell_center,
    cell_id,
    cell_neighbors,
    hex_cell,
    pack_cell,
    split_cell,
    unpack_cell,
    with_cell,
)
from hexrisk.functions.numbers import day_first_date, fixed, half_up, number_or_null
from hexrisk.plans.scoring import rule_inputs, score_table


def cells(spark, low=-40, high=40):
    side = spark.range(low, high)
    return side.select(F.col("id").alias("q")).join(side.select(F.col("id").alias("r")))


def test_centre_of_a_cell_lies_in_it(spark):
    lat, lng = cell_center(F.col("q"), F.col("r"))
    back = cells(spark).select("q", "r", hex_cell(lat, lng).alias("h"))
    assert back.filter("h.q <> q or h.r <> r").count() == 0


def test_stepwise_binning_equals_the_expression(spark):
    points = spark.range(20000).select((F.rand(1) * 8 + 29.5).alias("lat"), (F.rand(2) * 9 + 33.5).alias("lng"))
    both = with_cell(points).select("q", "r", hex_cell(F.col("lat"), F.col("lng")).alias("h"))
    assert both.filter("h.q <> q or h.r <> r").count() == 0


def test_neighbours_are_symmetric_six_and_never_self(spark):
    pairs = cells(spark, -5, 5).select("q", "r", F.explode(cell_neighbors(F.col("q"), F.col("r"))).alias("n"))
    assert pairs.filter("n.q = q and n.r = r").count() == 0
    assert pairs.groupBy("q", "r").agg(F.count_distinct("n").alias("c")).filter("c <> 6").count() == 0
    back = pairs.withColumn("b", cell_neighbors(F.col("n.q"), F.col("n.r")))
    assert back.filter(~F.array_contains("b", F.struct("q", "r"))).count() == 0


def test_boundary_is_closed_and_around_the_centre(spark):
    row = cells(spark, 3, 4).select(cell_boundary(F.col("q"), F.col("r")).alias("b"), *cell_center(F.col("q"), F.col("r"))).first()
    ring = row[0]
    assert len(ring) == 7 and ring[0] == ring[6]
    assert sum(p[0] for p in ring[:6]) / 6 == pytest.approx(row[2])
    assert sum(p[1] for p in ring[:6]) / 6 == pytest.approx(row[1])


def test_packed_cells_keep_order_and_come_back(spark):
    df = cells(spark).withColumn("p", pack_cell(F.col("q"), F.col("r")))
    q, r = unpack_cell(F.col("p"))
    assert df.filter((q != F.col("q")) | (r != F.col("r"))).count() == 0
    rows = [(x.q, x.r) for x in df.orderBy("p").collect()]
    assert rows == sorted(rows)


def test_cell_text_id_round_trip(spark):
    q, r = split_cell(cell_id(F.col("q"), F.col("r")))
    assert cells(spark).filter((q != F.col("q")) | (r != F.col("r"))).count() == 0


def test_lenient_numbers_and_dates(spark):
    df = spark.createDataFrame([("03/02/2024", " 1.5 "), ("2024-02-03", "x"), ("3 February 2024", None), ("junk", "")], "d string, n string")
    rows = df.select(day_first_date(F.col("d")).cast("string"), number_or_null(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["2024-02-03"] * 3 + [None]
    assert [r[1] for r in rows] == [1.5, None, None, None]


def test_rounding_and_rendering(spark):
    row = spark.range(1).select(
        half_up(F.lit(0.125), 2), half_up(F.lit(-0.125), 2), fixed(F.lit(2.5), 0), fixed(F.lit(-5.25), 1), fixed(F.lit(0.5), 2)
    ).first()
    assert tuple(row) == (0.13, -0.12, "3", "-5.2", "0.50")


# Hand-worked cases: inputs, score, level, alert, number of triggers.
GOLDEN = [
    ({"gdelt_hostility": 0.1, "event_velocity": 0.8, "strategic_score": 0.15}, 0.0, "CLEAR", False, 1),
    ({"gdelt_hostility": 0.60, "event_velocity": 2.5, "neighbor_event_avg": 4.0, "strategic_score": 0.45}, 0.387, "WATCH", False, 3),
    (
        {
            "firms_hotspot_count": 5.0,
            "firms_max_frp": 80.0,
            "firms_spike": 1.0,
            "gdelt_hostility": 0.75,
            "gdelt_min_goldstein": -7.5,
            "event_velocity": 3.5,
            "neighbor_event_avg": 6.0,
            "strategic_score": 0.82,
        },
        1.0,
        "DANGER",
        True,
        7,
    ),
]


@pytest.mark.parametrize("inputs,score,level,alert,count", GOLDEN)
def test_rule_score_golden_rows(spark, inputs, score, level, alert, count):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} double" for k in inputs))
    row = score_table(df).first()
    assert row.tactical_score == pytest.approx(score, abs=0.001)
    assert (row.tactical_tier, row.should_alert) == (level, alert)
    assert len(row.tactical_triggers.split(" | ")) == count


def test_partial_thermal_rule_and_half_model_boost(spark):
    df = spark.createDataFrame([(3.0, 0.0, 0.6)], "firms_hotspot_count double, firms_spike double, strategic_score double")
    row = score_table(df).first()
    assert row.tactical_score == pytest.approx(3 / 5 * 0.35 * 0.6 + 0.075, abs=0.001)
    assert row.tactical_triggers == "Elevated thermal activity (3 hotspots)"


def test_null_signals_never_fire(spark):
    schema = ", ".join(f"{c} double" for c in risk.RULE_INPUTS)
    row = score_table(spark.createDataFrame([(None,) * len(risk.RULE_INPUTS)], schema)).first()
    assert (row.tactical_score, row.tactical_triggers) == (0.0, risk.NO_TRIGGER)


def test_absent_columns_take_defaults(spark):
    assert set(rule_inputs(["cell"])) == set(risk.RULE_INPUTS)
    assert score_table(spark.createDataFrame([("a",)], "cell string")).first().tactical_score == 0.0


def test_levels_use_the_unrounded_score(spark):
    df = spark.createDataFrame([(0.74999,), (0.75,), (0.35,), (0.3499,)], "s double")
    assert [r[0] for r in df.select(risk.tactical_level(F.col("s"))).collect()] == ["WARNING", "DANGER", "WATCH", "CLEAR"]


def test_tiers_and_styles(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.54,), (0.53,), (0.57,), (0.9,)], "s double")
    s = F.col("s")
    rows = df.select(risk.strategic_tier(s), half_up(risk.heat_opacity(s), 4), risk.heat_color(s), risk.model_band(s)).collect()
    assert [r[0] for r in rows] == ["red", "orange", "yellow", "green", "yellow", "red"]
    assert [r[1] for r in rows] == [0.8067, 0.785, 0.45, 0.0, 0.515, 0.92]
    assert rows[3][2] == risk.CLEAR_COLOR and rows[5][2] == "#800026" and rows[4][2] == "#fed976"
    mid = spark.createDataFrame([(0.555,)], "s double").select(risk.heat_color(s)).first()[0]
    assert mid == "#ffec94"  # half way between #ffffb2 and #fed976
    assert [r[3] for r in rows[:2]] == ["Red", "Orange"]


def test_trigger_texts_are_trimmed(spark):
    df = spark.createDataFrame([(" a |b| | No significant signals detected",), (None,)], "t string")
    assert [r[0] for r in df.select(risk.split_triggers(F.col("t"))).collect()] == [["a", "b"], []]


def test_summary_sentences(spark):
    df = spark.createDataFrame([("red", "x | y | z", None), ("red", "", ""), ("red", "x", "Leave now.")], "t string, g string, a string")
    texts = [r[0] for r in df.select(risk.cell_text(F.col("t"), F.col("g"), F.col("a"))).collect()]
    assert texts[0] == "Risk signals detected near this location: x; y."
    assert texts[1].startswith("This area carries a red risk level")
    assert texts[2] == "Leave now."
