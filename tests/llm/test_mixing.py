"""Mixing against plain targets; quotas of the splitting tree against the distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORD, targets
from hexrisk.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 5}", "n") for i in range(400)] + [(1000 + i, "big " * 3000, "s0", "n") for i in range(4)]
    rows += [(2000, None, None, None), (2001, "only few words", None, "x"), (2001, "only few words", None, "x"), (None, "id is null", "s1", ""), (2002, "", "empty", ""), (2003, "é z", "é", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string")


def sizes(docs):
    out = {}
    for r in docs.collect():
        out[r.source] = out.get(r.source, 0) + len(WORD.findall(r.text or ""))
    return out


def test_targets_are_met(spark, docs):
    want, have = targets(sizes(docs)), sizes(docs)
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == docs.count()
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(by_size) == sorted({(have[s], round(t, 6)) for s, t in want.items()})
    for (_, target), taken in by_size.items():
        n = sum(1 for s, t in want.items() if round(t, 6) == target and have[s] == _)
        assert abs(sum(taken) - n * target) <= n


def test_reruns_agree(spark, docs):
    a, b = (sorted(map(tuple, mixing.mixed_documents(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert a == b


def test_shards_are_disjoint_and_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    monkeypatch.setattr(mixing, "BUCKET", 20)
    rows = mixing.numbered(docs).cache()
    mix = mixing.mix(rows, mixing.source_targets(rows), 50).toPandas()
    assert not mix.duplicated(["doc_id", "key", "size", "copy", "pass", "block"]).any()
    per = mix.groupby("shard").size()
    assert per.max() - per.min() <= 1 + len(per) // 8 and len(per) > 4
    assert all(sorted(g.position) == list(range(1, len(g) + 1)) for _, g in mix.groupby("shard"))


def test_whole_documents_are_repeated(spark, docs):
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.distinct().collect())) <= set(map(tuple, docs.collect()))
    want, have = targets(sizes(docs)), sizes(docs)
    for s, t in want.items():
        words = sum(len(WORD.findall(r.text or "")) for r in out.collect() if r.source == s)
        assert abs(words - t) <= 3000 and words <= 2 * have[s]


def test_draws_follow_the_hypergeometric_distribution(spark):
    draw = mixing.hypergeometric(F.lit(60).cast("long"), F.lit(25).cast("long"), F.lit(20).cast("long"), mixing.uniform(F.lit(3), F.col("id")))
    x = np.array([r[0] for r in spark.range(20_000).select(draw).collect()])
    p, n, k, m = 25 / 60, 60, 25, 20
    assert abs(x.mean() - m * p) < 0.05
    assert abs(x.var() - m * p * (1 - p) * (n - m) / (n - 1)) < 0.1
    assert x.min() >= 0 and x.max() <= min(k, m)
    ends = [(10, 0, 5, 0), (10, 10, 5, 5), (10, 4, 10, 4), (0, 0, 0, 0), (1_000_000_000_000, 3, 0, 0)]
    for t, h, d, want in ends:
        row = spark.range(1).select(mixing.hypergeometric(*(F.lit(v).cast("long") for v in (t, h, d)), F.lit(0.7)).alias("x")).first()
        assert row.x == want


def test_quotas_add_up(spark):
    counts = spark.createDataFrame([("=a", 1000), ("=b", 17), ("", 0), ("=c", 333)], "key string, blocks long")
    quotas = mixing.split_quotas(counts, 5).toPandas()
    assert quotas.groupby("key").quota.sum().to_dict() == {"=a": 1000, "=b": 17, "": 0, "=c": 333}
    totals = quotas.groupby("shard").quota.sum()
    assert len(totals) == 32 and totals.max() - totals.min() <= 1 and quotas.quota.min() >= 0


def test_nothing_and_empty_texts(spark, docs):
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mixed_documents(none).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.repeat_documents(none).count() == 0
