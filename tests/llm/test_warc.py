"""Archives: exact round trip, global order of the index, and the loser tree against heapq.merge."""

import base64
import hashlib
import heapq
import random

import pytest

from hexrisk.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 50}?q={i % 3}", f"<p>{i % 60} é</p>\r\n\r\n", "x") for i in range(300)]
    rows += [(1000, None, None, "x"), (1001, "no scheme\r\nX-Evil: 1", "", None), (1002, "http://ü.de/ä b", "<p>5 é</p>\r\n\r\n", ""), (None, "http://x/", "no id", ""), (None, "http://x/", "no id", ""), (7, "http://x/2", "twice", ""), (1003, "http://x/long", "long " * 200_000, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, time string").repartition(5)


def test_round_trip(spark, pages):
    kept, want = {}, []
    rows = pages.collect()
    for r in rows:
        kept.setdefault(r.html or "", []).append(r.page_id)
    for html, ids in kept.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        want += [(i, len(data), digest, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(data), digest, "response", None)]
    _, got = warc.archived(pages, range_rows=40)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_index_is_in_global_order(spark, pages):
    index, _ = warc.archived(pages, range_rows=40)
    rows = index.toPandas().sort_values(["range", "position"])
    keys = [(u.encode(), t, -1 if p != p else p) for u, t, p in zip(rows.urlkey, rows.time, rows.page_id, strict=True)]
    assert keys == sorted(keys) and len(keys) == pages.count() and rows.range.nunique() > 3
    assert all(g.position.tolist() == list(range(len(g))) for _, g in rows.groupby("range"))


def test_one_url_may_hold_most_captures(spark):
    pages = spark.createDataFrame([(i, "http://same/", f"{i}") for i in range(400)], "page_id long, url string, html string")
    index, captures = warc.archived(pages, range_rows=50)
    assert captures.count() == 400 and index.groupBy("range").count().agg({"count": "max"}).first()[0] < 200


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    g = random.Random(k)
    runs = [sorted((g.randrange(50), g.random()) for _ in range(g.choice([0, 1, 5, 40]))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_records_stand_alone():
    member = warc.warc_record(3, "http://é/\r\n", "20240101000003", b"a\r\n\r\nb", None, True, warc.sha1_base32(b"a\r\n\r\nb"))
    headers, http, payload = warc.parse_record(member)
    assert payload == b"a\r\n\r\nb" and headers["X-Page-Id"] == "3" and http["Content-Length"] == "6"
    with pytest.raises(Exception):
        warc.parse_record(member[:-9])


def test_nothing(spark, pages):
    index, captures = warc.archived(pages.limit(0))
    assert index.count() == 0 and captures.count() == 0
