"""The pipeline against plain versions of its stages, each on its own input."""

import re

import pytest

import corpus_pipeline
from brute import WORD, linked_components, shingles, targets
from hexrisk.llm import toxicity
from hexrisk.llm.files import stored

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{ROOT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, ROOT), name)
        out.append((docs, result))
        docs = result
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mix_sources", "pack_sequences"]
    for docs, result in steps[:-1]:
        assert result.columns == docs.columns


def test_toxic_documents_go(spark, steps):
    docs, kept = steps[0]
    judged = toxicity.toxicity(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    assert ids(kept) == ids(judged.filter("predicted = 0"))


def test_copies_go(steps):
    docs, kept = steps[1]
    best = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(kept) == sorted(i for _, i in best.values())


def test_near_copies_go(steps):
    docs, kept = steps[2]
    rows = docs.collect()
    assert ids(kept) == sorted(set(linked_components([(r.doc_id, shingles(r.text, 5)) for r in rows], 80)))


def test_sources_are_mixed(steps):
    docs, mixed = steps[3]
    size, got, largest = {}, {}, {}
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        size[r.source] = size.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text or ""))
    for s, t in targets(size).items():
        assert abs(got.get(s, 0) - t) <= largest[s]


def test_all_ids_are_packed(steps):
    docs, pieces = steps[4]
    rows = pieces.toPandas()
    assert rows.groupby("doc_id").length.sum().sum() == sum(
        rows[rows.doc_id == i].doc_tokens.iloc[0] for i in ids(docs)
    )
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
