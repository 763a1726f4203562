"""Exact deduplication against grouping by the whole normalised text, also with digests that collide."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hexrisk.llm import dedup
from hexrisk.llm.files import stored


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b", "p"), (2, "ab", "q"), (3, "a\tb\r\n", "r"), (4, None, "s"), (5, "", "t"), (6, " \x0b\x0c", "u"), (7, "c", "v"), (8, "A B", "w"), (7, "c", "v"), (9, " c", "x"), (None, "ab", "y"), (10, "long " * 50_000, "z"), (11, "long" * 50_000, "z")]
    rows += [(100 + i, f"text {i % 7}", "m") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def brute(docs):
    groups, out = {}, []
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    for content, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        first = True
        for m in sorted(members, key=str):
            out.append((m[2], keep[2], len(members), m == keep and first, hashlib.sha256(content.encode()).hexdigest()))
            first = first and m != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: (F.crc32(t) % 3).cast("string"), lambda t: F.lit("one")])
def test_groups(spark, docs, digest):
    rows = dedup.exact_groups(dedup.located(docs, "doc_id", "text"), digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, rows.collect()), key=str) == brute(docs)


def test_kept_rows_keep_their_columns(spark, docs):
    clashing = docs.withColumns({"locator": F.lit("mine"), "whole": F.lit(1), "kept": F.lit(None)})
    out = dedup.keep_first(clashing)
    assert out.columns == clashing.columns
    assert out.count() == sum(r[3] for r in brute(docs)) and out.filter("locator = 'mine'").count() == out.count()


def test_state_goes_on_from_an_earlier_stream(spark, docs):
    from hexrisk.session import scratch_path

    checkpoint, folder = scratch_path(spark, "state"), scratch_path(spark, "arrivals")
    rows = stored(dedup.arrivals(dedup.located(docs, "doc_id", "text")), "a")
    for part in (0, 1):
        rows.filter(F.pmod(F.hash("doc_id"), F.lit(2)) == part).write.mode("append").parquet(folder)
        dedup.keep_by_stream(spark.readStream.schema(rows.schema).parquet(folder), checkpoint)
    state = dedup.read_state(spark, checkpoint)
    assert state.count() == rows.select("digest").distinct().count()
    assert state.agg(F.sum("n")).first()[0] == rows.count()


def test_nothing(spark, docs):
    assert dedup.exact_groups(dedup.located(docs.limit(0), "doc_id", "text")).count() == 0
    assert dedup.keep_first(docs.limit(0)).count() == 0
