"""The keyed state table: merges, versions, repeated and broken runs."""

import datetime as dt

import pytest

from hexrisk.operators.model import LINEAR_COEFFICIENTS
from hexrisk.session import file_system
from hexrisk.sources.state import StateTable
from hexrisk.streaming import cells, jobs

SCHEMA = "cell string, score double, scored_at timestamp"


def rows(spark, *values):
    return spark.createDataFrame([(c, s, dt.datetime(2024, 1, d)) for c, s, d in values], SCHEMA)


def content(df):
    return {r.cell: r.score for r in df.collect()}


def test_merges_are_versions(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read() is None and table.manifest() is None
    table.merge(rows(spark, ("a", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 2), ("c", 4.0, 1)))
    first = table.read()
    assert content(first) == {"a": 1.0, "b": 3.0, "c": 4.0}
    # An update beats the old row even with an older stamp.
    table.merge(rows(spark, ("a", 9.0, 1), ("d", 5.0, 3)))
    assert content(table.read()) == {"a": 9.0, "b": 3.0, "c": 4.0, "d": 5.0}
    # A reader of the version before still sees it.
    assert content(first) == content(table.read(0)) == {"a": 1.0, "b": 3.0, "c": 4.0}
    table.merge(rows(spark))
    assert content(table.read()) == {"a": 9.0, "b": 3.0, "c": 4.0, "d": 5.0}
    assert table.versions() == [1, 2]


def test_only_touched_buckets_are_written_and_old_files_go(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), buckets=16)
    table.merge(rows(spark, *[(f"c{i}", float(i), 1) for i in range(200)]))
    for day in range(2, 12):
        table.merge(rows(spark, ("c7", 100.0 + day, day)))
    manifest = table.manifest()
    assert len(manifest["folders"]) == 16 and sum(f.startswith("data/0/") for f in manifest["folders"].values()) == 15
    assert content(table.read())["c7"] == 111.0 and table.read().count() == 200
    fs, data = file_system(spark, str(tmp_path / "t" / "data"))
    assert sorted(int(s.getPath().getName()) for s in fs.listStatus(data)) == [0, 9, 10]


def test_a_repeated_version_changes_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), buckets=2)
    table.merge(rows(spark, ("a", 1.0, 1)), version=4)
    table.merge(rows(spark, ("a", 2.0, 2)), version=4)
    table.merge(rows(spark, ("a", 2.0, 2)), version=3)
    assert content(table.read()) == {"a": 1.0} and table.versions() == [4]


def test_a_broken_run_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "t"), buckets=2)
    table.merge(rows(spark, ("a", 1.0, 1), ("b", 1.0, 1)))

    def die(manifest):
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(table, "_publish", die)
    with pytest.raises(RuntimeError):
        table.merge(rows(spark, ("a", 7.0, 2), ("x", 7.0, 2)))
    monkeypatch.undo()
    assert content(table.read()) == {"a": 1.0, "b": 1.0}
    table.merge(rows(spark, ("a", 8.0, 3)))
    assert content(table.read()) == {"a": 8.0, "b": 1.0}


EVENT = "event_date date, lat double, lng double, event_type string, is_dangerous int, fatalities long, is_battle int, is_explosion int, is_vac int, is_riot int, population_best long, actor1 string, actor_pair string"


def event(day, lng=35.0, actor="x", population=0):
    return (dt.date(2024, 1, day), 33.0, lng, "Riots", 1, 2, 0, 0, 0, 1, population, actor, f"{actor}||y")


def test_an_event_changes_its_cell_and_the_neighbours_score(spark, tmp_path):
    source, alerts, checkpoint = (str(tmp_path / n) for n in ("in", "alerts", "check"))
    table = StateTable(spark, str(tmp_path / "state"), buckets=2)

    def put(*events):
        spark.createDataFrame(list(events), EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = cells.stream_features(spark.readStream.schema(EVENT).parquet(source), "2024-01-01")
        with jobs.state_store(spark):
            jobs.stream_state(stream, table, alerts, checkpoint, interval=None).awaitTermination()
        return {r.cell: r for r in table.read().collect()}

    quiet = put(event(1, 35.0), event(1, 35.07))  # two adjacent cells
    assert len(quiet) == 2
    a, b = sorted(quiet)
    busy = put(*[event(2, 35.0, f"a{i}") for i in range(9)])
    # Both scores rise; the neighbour had no event of its own that day, but hears of those beside it.
    assert all(busy[c].strategic_score > quiet[c].strategic_score and str(busy[c].scored_at.date()) == "2024-01-02" for c in (a, b))
    heard = [c for c in (a, b) if "High surrounding activity (9.0" in busy[c].tactical_triggers]
    assert len(heard) == 1 and busy[heard[0]].tactical_score > quiet[heard[0]].tactical_score
    # An empty run and a far cell leave them alone.
    far = put(event(3, 40.0))
    assert len(far) == 3 and {c: r.strategic_score for c, r in busy.items()}.items() <= {c: r.strategic_score for c, r in far.items()}.items()
    assert set(LINEAR_COEFFICIENTS) - set(cells.FEATURES)  # feeds that the stream lacks count as 0


def test_rings_forget_and_take_late_days():
    ring = cells.Ring.empty(10)
    ring.of("event_count")[ring.place(10)] = 5
    ring.of("event_count")[ring.place(0)] += 3
    assert ring.place(-7) < 0
    assert ring.turn_to(26).shape[1] == 16 and ring.of("event_count").sum() == 5
    assert ring.turn_to(100).shape[1] == cells.RING_DAYS and not ring.values.any()
    row = cells.feature_row(cells.Ring.empty(3), 7.0, 0, 2)
    assert row["population_best"] == 7.0 and row["dangerous_roll14d"] == 0.0 and row["neighbor_danger_avg"] == 0.0


def test_state_of_an_empty_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], EVENT).write.parquet(source)
    table = StateTable(spark, str(tmp_path / "state"))
    with jobs.state_store(spark):
        stream = cells.stream_features(spark.readStream.schema(EVENT).parquet(source))
        jobs.stream_state(stream, table, str(tmp_path / "a"), str(tmp_path / "c"), interval=None).awaitTermination()
    found = table.read()
    assert found is None or found.count() == 0


def test_hashes_of_a_group_come_once_and_without_nulls():
    import numpy as np
    import pandas as pd

    values = pd.Series(["a", None, "b", "a", "a", None, "z"])
    lists = cells._hash_lists(values, np.array([2, 0, 2, 2, 0, 1, -1]), 4)
    assert [len(v) for v in lists] == [1, 0, 2, 0] and lists[0][0] in lists[2] and lists[2] == sorted(lists[2])
