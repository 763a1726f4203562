"""The recurrent network: gradients, held-out accuracy, windows over whole texts, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexrisk.llm import toxicity
from hexrisk.llm.text import plain_strings

BAD = ["stupidly", "idiotic", "scummy", "moronic"]


def sample(n, seed, odd=()):
    g = random.Random(seed)
    words = [a + b + c for a in ("an", "the", "st", "er", "on") for b in ("in", "ou", "re", "ly") for c in ("", "ed", "ing", "er")]
    texts, labels = [], []
    for i in range(n):
        t, toxic = g.choices(words, k=g.randrange(3, 150)), i % 3 == 0
        if toxic:
            for _ in range(1 + len(t) // 40):
                t[g.randrange(len(t))] = g.choice(BAD) + g.choice(["", ".", "!"])
        texts.append(" ".join(t))
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    texts, labels = sample(400, 1)
    return toxicity.train(texts, labels, np.ones(len(texts)))


def scores(net, texts):
    words = toxicity.Words(net)
    return net.score(net.logits(*words.read(plain_strings(pa.array(texts, pa.string())))))


def test_held_out_accuracy(net):
    texts, labels = sample(300, 2)
    assert ((scores(net, texts) >= 0.5) == labels).mean() > 0.95


def test_a_word_anywhere_in_a_long_text_is_seen(net):
    clean = sample(3, 5)[0][1].split()
    for at in (0, 17, 3000, 5990, 5999):
        text = (clean * 100)[:6000]
        assert scores(net, [" ".join(text)])[0] < 0.5
        text[at] = "idiotic"
        assert scores(net, [" ".join(text)])[0] >= 0.5


def test_windows_overlap_and_cover():
    text, start = toxicity.windows_of(np.array([0, 5, 32, 33, 100]))
    assert text.tolist() == [0, 1, 2, 3, 3, 4, 4, 4, 4]
    assert start.tolist() == [0, 0, 0, 0, 1, 0, 24, 48, 68]


def test_score_does_not_depend_on_neighbours(net):
    texts = ["", *sample(30, 8)[0], "one", "!!!"]
    together = scores(net, texts)
    assert np.allclose(together, [scores(net, [t])[0] for t in texts], atol=1e-5)
    assert np.isfinite(together).all()


def test_training_is_repeatable():
    texts, labels = sample(60, 3)
    a, b = (toxicity.train(texts, labels, np.ones(60)) for _ in range(2))
    assert np.array_equal(a.word, b.word) and a.cut == b.cut


def test_query_on_odd_rows(spark):
    texts, labels = sample(250, 4)
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(1000, None, None, None), (1001, "", "", 0.0), (None, "no id", "", 0.0), (5, texts[5], "", 1.0), (1002, "word " * 30_000, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    known = [(i, int(v)) for i, v in enumerate(labels)] + [(None, 1), (7, None), (9999, 1)]
    labels_table = spark.createDataFrame(known, "doc_id long, toxic int").withColumn("quality", F.lit(1))
    out = toxicity.toxicity(docs, labels_table).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    held = out[out.held_out & (out.doc_id < 250)]
    assert (held.predicted == labels[held.doc_id.astype(int)]).mean() > 0.85
    kept = toxicity.without_toxic(docs, labels_table)
    assert kept.columns == docs.columns and kept.count() == (out.predicted == 0).sum()


def test_an_id_in_very_many_rows_is_one_text(spark, monkeypatch):
    ids = [i for i in range(40) if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]]
    first, rest = ids[0], ids[1:]
    many = spark.range(0, 2 * toxicity.TRAIN_ROWS + 500, 1, 4).select(F.lit(first).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(i, f"own {i}") for i in rest], "doc_id long, text string"))
    labels = spark.createDataFrame([(first, 0)] + [(i, 1) for i in rest], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels).count() == len(ids)
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, weight: (texts, toxic.tolist()))
    sample = [r.asDict() for r in toxicity.training_sample(docs, labels).collect()]
    texts, toxic = toxicity.fitted(sample)
    assert texts[0].startswith("text ") and texts[1:] == [f"own {i}" for i in rest] and toxic == [0] + [1] * len(rest)


def test_the_sample_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, weight: (len(texts), int(toxic.sum())))
    sample = [{"doc_id": i, "text": "x" * 100, "toxic": i % 2, "weight": 1.0} for i in range(100)]
    assert toxicity.fitted(sample) == (100, 50) and toxicity.fitted(sample, 1000) == (20, 10)


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 0), (3, 0)], 0.0), ([(i, 1) for i in range(30)], 1.0)):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert [r.score for r in toxicity.toxicity(docs, table).collect()] == [want, want]
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 0
