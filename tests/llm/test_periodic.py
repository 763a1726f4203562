"""Runs of words against a search over all periods, and the planting against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import WORD
from hexrisk.llm import periodic


def runs(words, least=6, times=4):
    found, seen = [], set()
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                length = i + q - start
                if length >= max(least, times * q) and (start, length) not in seen:  # else a smaller period has it
                    seen.add((start, length))
                    found.append((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefghij"[: rng.choice([1, 2, 2, 3, 10])]
        words = [rng.choice(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            root = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
            words += root * rng.randrange(1, 8) + root[: rng.randrange(3)] + words[:3]
        yield rng.choice(["", " ", "\n"]) + rng.choice([" ", " \t", "\x0b"]).join(words) + rng.choice(["", " "])


def test_lyndon_lengths_of_sequences_side_by_side():
    rng = random.Random(5)
    for _ in range(100):
        sequences = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))] for _ in range(6)]
        want = [next((k for k in range(i + 1, len(s)) if s[k:] < s[i:]), len(s)) - i for s in sequences for i in range(len(s))]
        got = periodic.lyndon_lengths(np.array([x for s in sequences for x in s], np.int64), np.array([len(s) for s in sequences]))
        assert got.tolist() == want


def test_all_runs_are_found():
    for rule in (periodic.Rule(), periodic.Rule(2, 2), periodic.Rule(9, 3)):
        block = list(texts(rule.words, 600))
        found = periodic.found_in(pa.array(block, pa.large_string()), rule)
        for i, text in enumerate(block):
            words, own = WORD.findall(text), slice(found.first_run[i], found.first_run[i + 1])
            want = runs(words, rule.words, rule.times)
            assert list(zip(found.start[own], found.length[own], found.period[own], strict=True)) == want, text
            assert found.collapsed[i].as_py() == collapsed(words, want) and found.n_words[i] == len(words)


def test_a_long_text(spark):
    rng = random.Random(2)
    root = [f"w{rng.randrange(400)}" for _ in range(4000)]
    words = [f"x{i}" for i in range(3000)] + root * 5 + ["a"] * 50_000 + ["a", "b"] * 2000
    row = periodic.word_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(3000, 20_000, 4000), (23_000, 50_001, 1), (73_000, 4000, 2)]
    assert len(row.collapsed.split()) == 3000 + 4000 + 1 + 1


def test_planting_and_the_whole_query(spark, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(texts(3, 400))] + [(None, "a a a a a a a", None), (7, None, "x"), (7, "", "x"), (7, "b " * 6, "y"), (7, "b " * 6, "y")]
    rows += [(2**62, "é é é é é é 日 日", "s"), (-5, " ", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic.op11(spark, str(tmp_path)).na.fill(-1).collect())
    want = []
    for doc_id, text, _ in rows:
        words = WORD.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.append((
            doc_id if doc_id is not None else -1, len(found), *(best or (-1, -1, -1)), 1000 * best[1] // best[2] if best else -1,
            hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest(),
        ))
    assert got == sorted(want)
    assert any(r[1] for r in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)


def test_ties_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "a a a a a a b c c c c c c")], "doc_id long, text string")
    best = periodic.word_runs(one).select(periodic.strongest(F.col("runs")).alias("best")).first().best
    assert tuple(best) == (0, 6, 1)
    assert periodic.word_runs(one.limit(0)).count() == 0
