import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hexrisk.operators import evaluate, labels, model, summaries
from hexrisk.plans import studies

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(400):
        y = int(rnd.random() < 0.3)
        out.append((DAY + dt.timedelta(days=rnd.randrange(20)), rnd.randrange(-4, 5), i, y, round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2)))
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, "event_date date, q long, r long, label int, strategic_score double").cache()


def test_ranking_metrics_equal_brute_force(scored, rows):
    pos = [s for *_, y, s in rows if y]
    neg = [s for *_, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({s for *_, s in rows}, reverse=True):
        hit = sum(p >= t for p in pos)
        ap += (hit - seen) / len(pos) * hit / (hit + sum(n >= t for n in neg))
        seen = hit
    row = evaluate.ranking_metrics(scored).first()
    assert row.roc_auc == pytest.approx(auc) and row.average_precision == pytest.approx(ap)


def test_ranking_agrees_with_the_builtin_evaluator(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    auc = BinaryClassificationEvaluator(rawPredictionCol="strategic_score", numBins=0).evaluate(scored)
    assert evaluate.roc_auc(scored).first()[0] == pytest.approx(auc)


def test_one_class_has_no_auc(scored):
    assert evaluate.ranking_metrics(scored.filter("label = 1")).first().roc_auc is None


def test_sweep_equals_brute_force(scored, rows):
    days = (max(r[0] for r in rows) - min(r[0] for r in rows)).days
    out = {r.threshold: r for r in evaluate.threshold_sweep(scored, (0.1, 0.5, 0.55, 2.0)).collect()}
    assert set(out) == {0.1, 0.5, 0.55}  # no alert at 2.0
    for t, r in out.items():
        alerts = [y for *_, y, s in rows if s >= t]
        precision, recall = sum(alerts) / len(alerts), sum(alerts) / sum(y for *_, y, _ in rows)
        assert (r.precision, r.recall) == (pytest.approx(precision), pytest.approx(recall))
        assert r.f1 == pytest.approx(2 * precision * recall / (precision + recall))
        assert r.alerts_per_day == pytest.approx(len(alerts) / days)


def test_best_point_takes_the_lowest_threshold_on_ties(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "threshold double, f1 double")
    assert evaluate.best_point(df).first().threshold == 0.2
    flags = [r.best_so_far for r in evaluate.running_best(df).orderBy("threshold").collect()]
    assert flags == [True, True, False]


def test_a_tie_between_models_goes_to_the_preferred(spark):
    df = spark.createDataFrame([("standard", 0.75, 0.5), ("focal", 0.3, 0.5)], "model string, threshold double, f1 double")
    assert evaluate.pick_winner(df).first().model == "focal"


def test_time_positions_are_the_sorted_order(scored, rows):
    got = [(r.event_date, r.q, r.r) for r in labels.with_time_position(scored).orderBy("position").collect()]
    assert got == sorted((d, q, r) for d, q, r, *_ in rows)
    assert [r.position for r in labels.with_time_position(scored).orderBy("position").collect()] == list(range(len(rows)))


def test_folds_never_train_on_later_rows(scored, rows):
    blocks = labels.time_series_folds(scored).cache()
    size = len(rows) // 6
    assert blocks.filter("block = 0").count() == len(rows) - 5 * size
    for fold in range(1, 6):
        train, held = labels.fold_parts(blocks, fold)
        assert held.count() == size
        assert train.agg(F.max("position")).first()[0] < held.agg(F.min("position")).first()[0]


def test_holdout_share(scored, rows):
    parts = labels.time_holdout(scored)
    assert parts.filter("part = 'train'").count() == int(len(rows) * 0.9)


def test_latest_value_is_taken_per_column(spark):
    df = spark.createDataFrame(
        [("a", DAY, 1, "x"), ("a", DAY + dt.timedelta(days=1), None, "y"), ("b", DAY, None, None)], "cell string, event_date date, n int, t string"
    )
    rows = {r.cell: (r.n, r.t) for r in summaries.latest_per_cell(df, ["n", "t"]).collect()}
    assert rows == {"a": (1, "y"), "b": (None, None)}


def test_missing_days(spark):
    df = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=2),)], "event_date date")
    gaps = summaries.missing_days(df, F.lit(DAY), F.lit(DAY + dt.timedelta(days=3)))
    assert sorted(r[0].day for r in gaps.collect()) == [2, 4]


def test_feature_lists_and_alignment(spark):
    assert len(model.BASE_FEATURES) == 33 and len(model.ALL_FEATURES) == 55 and len(set(model.ALL_FEATURES)) == 55
    df = spark.createDataFrame([(1, None)], "event_count int, gdelt_hostility double")
    assert tuple(model.align_features(df, ["gdelt_hostility", "absent", "event_count"]).first()) == (0.0, 0.0, 1.0)


def test_focal_weight_favours_hard_rows(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 1), (0.0, 0), (1.0, 1)], "p double, y int")
    w = [r[0] for r in df.select(model.focal_weight(F.col("p"), F.col("y"))).collect()]
    assert w[0] == pytest.approx(0.25 * 0.01) and w[1] == pytest.approx(0.25 * 0.81)
    assert 0 < w[2] < 1e-12 and 0 < w[3] < 1e-12


def test_training_learns_saves_and_explains(spark, scored, tmp_path):
    df = scored.withColumn("event_count", F.col("strategic_score") * 10).withColumn("dangerous_count", F.lit(0)).drop("strategic_score")
    names = ["event_count", "dangerous_count"]
    fitted = studies.fit_standard(df, names, maxIter=5, maxDepth=3)
    out = model.predict(df, fitted)
    assert evaluate.roc_auc(out).first()[0] > 0.6
    assert out.filter("strategic_score < 0 or strategic_score > 1").count() == 0 and set(df.columns) < set(out.columns)
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.predict(df, model.load_model(str(tmp_path / "m")))
    assert again.exceptAll(out).count() == 0
    assert model.feature_importance(spark, fitted).first().feature == "event_count"
    focal = model.train_focal(df, names, maxIter=12, maxDepth=3)
    model.save_model(focal, str(tmp_path / "f"))
    focal = model.predict(df, model.load_model(str(tmp_path / "f")))
    # Few short steps from 0.5 downwards: negatives outweigh positives.
    assert focal.filter("strategic_score >= 0.5").count() < focal.count() / 2
    assert evaluate.roc_auc(focal).first()[0] > 0.6



def test_training_goes_on_while_stop_rows_improve(spark):
    x = F.pmod(F.hash("id"), F.lit(1000)) / 1000
    noisy = (x + F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 2500 > 0.7).cast("int")
    df = spark.range(1500).select(x.alias("event_count"), noisy.alias("label"), (F.col("id") % 5 == 0).alias("_stop"))
    fitted = model.train_gbt(df, ["event_count"], validation="_stop", maxIter=40, maxDepth=3, patience=8)
    assert 1 < model.n_trees(fitted) <= 40
    assert model.predict(df, fitted).select("strategic_score").distinct().count() > 10
    # Labels without any signal: nothing improves for long, so the training ends soon after its patience is used up.
    noise = df.withColumn("label", F.pmod(F.hash("event_count", F.lit(7)), F.lit(2))).withColumn("event_count", F.rand(3))
    assert model.n_trees(model.train_gbt(noise, ["event_count"], validation="_stop", maxIter=40, maxDepth=2, patience=3)) < 40


def test_scores_keep_all_digits(spark):
    df = spark.createDataFrame([(0.74996, 1), (0.74995, 0), (0.75, 1), (0.2, 0)], "strategic_score double, label int").withColumn("event_date", F.lit(DAY))
    rows = {r.threshold: r.alerts for r in evaluate.threshold_sweep(df, (0.75, 0.74996)).collect()}
    assert rows == {0.75: 1, 0.74996: 2}
    assert evaluate.roc_auc(df).first()[0] == 1.0


def test_model_counts_absent_features_as_zero(spark, scored):
    df = scored.withColumn("event_count", F.col("strategic_score") * 10).withColumn("temp_max", F.lit(0.0)).drop("strategic_score")
    fitted = model.train_gbt(df, ["temp_max", "event_count"], maxIter=3, maxDepth=2)
    assert model.model_features(fitted) == ["temp_max", "event_count"]
    assert model.predict(df.drop("temp_max"), fitted).exceptAll(model.predict(df, fitted).drop("temp_max")).count() == 0
