"""Posting lists: recall against brute force, exact scores, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexrisk.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def brute(x, ids, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != i][:k]


def test_recall_and_scores(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 24))
    x = (centres[g.integers(0, 40, 6000)] + 0.6 * g.normal(size=(6000, 24))).astype(np.float32)
    x[100:1600] = x[100]  # a very common vector
    rows = table(spark, [(i, v.tolist(), "") for i, v in enumerate(x)]).repartition(6)
    out = neighbours.nearest(rows, F.col("vec_id") % 50 == 0).toPandas()
    hits, x = 0, x.astype(np.float64)
    for q, found in out.groupby("query_id"):
        found = found.sort_values("rank")
        want = brute(x, np.arange(6000), q, 10)
        assert found["rank"].tolist() == list(range(1, 11))
        assert np.array_equal(found.score.to_numpy(), np.sqrt(((x[found.vec_id] - x[q]) ** 2).sum(1)))
        assert found[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        hits += len({i for i, _ in want} & set(found.vec_id))
        if q in (100, 150, 1550):
            assert found.vec_id.tolist() == [i for i in range(100, 112) if i != q][:10]
    assert out.query_id.nunique() == 120 and hits / 1200 >= 0.9


def test_recall_with_many_lists(spark):
    g = np.random.default_rng(7)
    x = (0.1 * g.normal(size=(10, 32))[g.integers(0, 10, 40_000)] + g.normal(size=(40_000, 32))).astype(np.float32)
    frame = table(spark, [(i, v.tolist(), "") for i, v in enumerate(x)]).repartition(6)
    out = neighbours.nearest(frame, F.col("vec_id") % 400 == 0).toPandas()
    x = x.astype(np.float64)
    hits = sum(len({i for i, _ in brute(x, np.arange(40_000), q, 10)} & set(found.vec_id)) for q, found in out.groupby("query_id"))
    assert out.query_id.nunique() == 100 and hits / 1000 >= 0.9


def test_boundary_vectors_are_replicated(spark):
    g = np.random.default_rng(9)
    side = g.choice([-1.0, 0.0, 1.0], 300)
    x = np.concatenate([side[:, None], 5 * g.normal(size=(300, 40))], axis=1)  # far off the line between the centroids
    index = neighbours.Index.of(np.stack([-np.eye(41)[0], np.eye(41)[0]]))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "number long, v array<double>")
    n = neighbours.posted(frame, index).groupBy("number").count().toPandas().set_index("number")["count"].sort_index().to_numpy()
    assert (n == np.where(side == 0, 2, 1)).all()


def test_lists_are_balanced():
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(size=(3000, 8)), 50 + 0.01 * g.normal(size=(1000, 8))])
    c = neighbours.balanced_centroids(x, 40)
    n = np.bincount(neighbours.squared(x, c).argmin(1), minlength=40)
    assert len(c) == 40 and n.max() < 8 * n.mean()


def test_graph_search_finds_the_nearest():
    g = np.random.default_rng(2)
    index = neighbours.Index.of(g.normal(size=(500, 16)))
    right = sum(index.nearest(q)[0][0] == neighbours.squared(q[None], index.centroids)[0].argmin() for q in g.normal(size=(50, 16)))
    assert right >= 48


def test_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(spark, [(0, [1.0, 0.0], ""), (1, [1.0, 1.0], ""), (2, [1.0, 1.0], ""), (2, [5.0, 1.0], ""), (3, None, ""), (4, [0.0, 0.0], ""), (5, [nan, 1.0], ""), (6, [inf, 1.0], ""), (7, [None, 1.0], ""), (8, [], ""), (9, [1.0], ""), (None, [9.0, 9.0], "")])
    out = neighbours.nearest(rows, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank", "score").collect()
    zero = [(r["rank"], r.vec_id, round(r.score, 6)) for r in out if r.query_id == 0]
    assert zero == [(1, 1, 1.0), (2, 2, 1.0), (3, 2, round(17**0.5, 6)), (4, None, round(145**0.5, 6))]
    assert sum(r.query_id == 2 for r in out) == 8
    assert neighbours.nearest(rows.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(rows.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_equal_distances_go_to_the_smaller_ids(spark):
    # All unit vectors are equally far from each other; 500 of them, so ties reach far beyond the ten asked for.
    x = np.eye(500, dtype=np.float32)
    ids = np.random.default_rng(5).permutation(500)
    rows = table(spark, [(int(i), v.tolist(), "") for i, v in zip(ids, x, strict=True)]).repartition(4)
    out = neighbours.nearest(rows, F.col("vec_id") % 25 == 0).toPandas()
    for q, found in out.groupby("query_id"):
        assert found.sort_values("rank").vec_id.tolist() == [i for i in range(12) if i != q][:10]
    assert out.query_id.nunique() == 20


def test_ties_and_huge_norms_among_binary_vectors():
    g = np.random.default_rng(6)
    for scale, shift in ((1.0, 0.0), (1e3, 1e9)):
        x = scale * g.integers(0, 2, (800, 12)).astype(np.float64) + shift
        least = g.permutation(800)
        for q in x[:40]:
            allowed = g.random(800) < 0.7
            at, score = neighbours.best_of(x, least, q, allowed, 11)
            d = np.where(allowed, np.sqrt(((x - q) ** 2).sum(1)), np.inf)
            want = np.lexsort((least, d))[:11]
            assert at.tolist() == want.tolist() and score.tolist() == d[want].tolist()
