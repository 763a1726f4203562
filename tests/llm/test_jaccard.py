"""The n-gram join against comparing all pairs."""

import random

import numpy as np
import pytest

from brute import linked_components, shingles
from hexrisk.llm import jaccard
from hexrisk.llm.components import components


def corpus():
    g = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [g.choices(words, k=n) for n in (3, 8, 20, 60, 61, 62, 150, 400)]
    texts = []
    for b in base:
        for k in range(14):
            t = list(b)
            for _ in range(g.choice([0, 1, 1, 2, 3, len(b) // 30])):
                t[g.randrange(len(t))] = g.choice(words)
            texts.append(" ".join(t[: len(t) - k % 3] if len(t) > 10 else t))
    line = " ".join(g.choices(words, k=30))
    texts += [line + " " + " ".join(g.choices(words, k=g.randrange(5, 90))) for _ in range(60)]
    return texts + ["", None, " \t", "One", "one", "Two Words", "two  words", "a b c", "A B C", "é É", "x " * 4000, "x " * 5000, line, line]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n") for i, t in enumerate(corpus())] + [(3, "an id twice, with other words", ""), (7, corpus()[7], "")]
    return spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(6)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_components(spark, docs, n, percent):
    rows = docs.collect()
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [len(s) for _, s in sets], linked_components(sets, percent), strict=True))
    got = jaccard.joined(docs, jaccard.Rule(n, percent))
    assert sorted(map(tuple, got.collect())) == want


def test_large_buckets_are_split_without_loss(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = docs.collect()
    sets = [(r.doc_id, shingles(r.text, 3)) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], linked_components(sets, 60), strict=True))
    got = jaccard.joined(docs, jaccard.Rule(3, 60)).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("few", [0, 3])
def test_parts_beyond_few_lose_nothing(spark, docs, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = docs.collect()
    sets = [(r.doc_id, shingles(r.text, 2)) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], linked_components(sets, 70), strict=True))
    got = jaccard.joined(docs, jaccard.Rule(2, 70)).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect())) == want


def test_a_shared_passage_sends_bitmaps_once(spark, monkeypatch):
    g = random.Random(11)
    word = lambda: f"v{g.randrange(10**9)}"
    halves = [" ".join(word() for _ in range(20)) for _ in range(6)]
    texts = [h + " " + " ".join(word() for _ in range(3)) for h in halves for _ in range(20)]
    for _ in range(5):
        passage = " ".join(word() for _ in range(20))
        texts += [passage + " " + h for h in halves]
    sent = []
    walk = jaccard.residual_pairs
    monkeypatch.setattr(jaccard, "residual_pairs", lambda members, rule: (sent.extend(r.row for r in members.select("row").collect()), walk(members, rule))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.joined(docs, jaccard.Rule(3, 90)).collect()}
    assert [got[i] for i in range(120, 150)] == list(range(120, 150))
    last = {r for r in sent if sent.count(r) > 1}
    assert not last, (len(sent), len(last))


def test_only_documents_with_a_partner_stay_in_a_part(spark):
    rows = [
        (1, 10, 100, 100, 10), (1, 11, 100, 94, 11),  # 94 is too little for two sets of 100 at 90 percent, 95 is enough
        (2, 20, 100, 96, 20), (2, 21, 100, 95, 21), (2, 22, 100, 95, 20), (2, 23, 80, 80, 23),
        (3, 20, 100, 99, 20), (3, 21, 100, 99, 21), (3, 22, 100, 99, 20),
        (4, 40, 90, 90, 40), (4, 41, 100, 100, 41),  # just fit, if the first common n-gram is the first one of both
    ]
    labelled = spark.createDataFrame(rows, "gram long, row long, size long, most long, component long")
    got = jaccard.mixed_cells(labelled, jaccard.Rule(3, 90)).collect()
    assert sorted((r.row, r.size, r.component) for r in got) == [(20, 100, 20), (21, 100, 21), (22, 100, 20), (40, 90, 40), (41, 100, 41)]


def test_tree_finds_all_pairs_that_link():
    g = np.random.default_rng(2)
    rule, sets = jaccard.Rule(1, 70), []
    for size in (5, 20, 40, 90, 200):
        b = g.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(12):
            s = b.copy()
            s[: g.integers(0, max(2, size // 4))] = g.integers(0, 2**63, 1)
            sets.append(np.unique(s))
    size = np.array([len(s) for s in sets])
    found = set()
    for a, b in jaccard.tree_pairs(rule, np.arange(len(sets)), size, np.arange(len(sets)), [jaccard.bitmap(s) for s in sets]):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            overlap = len(np.intersect1d(sets[i], sets[j]))
            if rule.enough(overlap, size[i] + size[j]):
                assert (j, i) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_one_row_of_each_group_stays(spark, docs):
    clashing = docs.withColumnRenamed("component", "locator")
    out = jaccard.keep_one(clashing, jaccard.Rule(3, 60))
    assert out.columns == clashing.columns
    rows = docs.collect()
    sets = [(i, shingles(r.text, 3)) for i, r in enumerate(rows)]
    assert out.count() == len(set(linked_components(sets, 60)))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_nothing_and_only_empty_texts(spark, docs):
    assert jaccard.joined(docs.limit(0), jaccard.Rule(3, 90)).count() == 0
    empty = spark.createDataFrame([(2, None), (1, ""), (5, " ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.joined(empty, jaccard.Rule(3, 90)).collect())) == [(1, 0, 1), (2, 0, 2), (5, 0, 5)]
