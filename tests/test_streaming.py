import datetime as dt

from pyspark.sql import functions as F

from hexrisk.streaming import jobs

SCHEMA = "ts timestamp, lat double, lng double, event_type string, is_dangerous int, fatalities long"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def event(day, hour=0, fatalities=1):
    return (dt.datetime(2024, 1, day, hour), 33.0, 35.0, "Riots", 1, fatalities)


def counts(spark, out):
    return {r.event_date.day: (r.event_count, r.total_fatalities) for r in jobs.read_versions(spark, out).collect()}


def test_late_rows_count_within_the_watermark_and_not_after(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = jobs.stream_cell_day(spark.readStream.schema(SCHEMA).parquet(source))
        jobs.write_versions(stream, out, state).awaitTermination()

    write(spark, source, [event(10), event(10, 5), event(11)])
    run()
    assert counts(spark, out) == {10: (2, 2), 11: (1, 1)}
    write(spark, source, [event(9), event(10, 7, 4), event(14)])  # one and two days late
    run()
    assert counts(spark, out) == {9: (1, 1), 10: (3, 6), 11: (1, 1), 14: (1, 1)}
    write(spark, source, [event(9, 3), event(15)])  # day 9 is closed by now
    run()
    assert counts(spark, out) == {9: (1, 1), 10: (3, 6), 11: (1, 1), 14: (1, 1), 15: (1, 1)}


def test_scores_follow_the_stream_and_alert_once(spark, tmp_path):
    source, state, alerts, checkpoint = (str(tmp_path / n) for n in ("in", "state", "alerts", "check"))
    schema = "event_date date, lat double, lng double, fatalities long"

    def put(*rows):
        spark.createDataFrame([(dt.date(2024, 1, d), 33.0, lng, f) for d, lng, f in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def score(touched):
        level = F.when(F.col("q") % 2 == 0, "DANGER").otherwise("CLEAR")
        return touched.select(
            F.concat_ws("_", "q", "r").alias("cell"), level.alias("tactical_tier"), F.col("event_date").cast("string").alias("scored_at")
        )

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_score(stream, score, state, alerts, checkpoint, interval=None).awaitTermination()

    put((1, 35.0, 1), (1, 35.07, 1))
    run()
    put((2, 35.0, 1), (2, 35.14, 1), (2, 35.21, 1))
    run()
    rows = spark.read.parquet(state)
    newest = {r.cell: r.scored_at for r in rows.filter("batch = 1").collect()}
    assert len(newest) == 4 and sorted(newest.values()) == ["2024-01-01", "2024-01-02", "2024-01-02", "2024-01-02"]
    raised = [r.cell for r in spark.read.parquet(alerts).collect()]
    assert raised and len(raised) == len(set(raised))


def test_history_of_touched_cells(spark):
    days = spark.range(30).select(F.lit(1).alias("q").cast("long"), F.lit(2).alias("r").cast("long"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("event_date"))
    touched = spark.createDataFrame([(1, 2, dt.date(2024, 1, 20)), (5, 5, dt.date(2024, 1, 2))], "q long, r long, event_date date")
    got = [r.event_date.day for r in jobs.touched_history(days, touched).orderBy("event_date").collect()]
    assert got == list(range(7, 21))
