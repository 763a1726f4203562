"""Part codebooks against plain whole-number arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from hexrisk.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """``rows``: (id, vector of whole numbers), by id. Codes, errors and codebooks in Python's numbers."""
    width = len(rows[0][1])
    cuts = np.cumsum([0, *(width // parts + (k < width % parts) for k in range(parts))])
    codes, errors, books = [[0] * parts for _ in rows], [0] * len(rows), []
    for k in range(parts):
        x = [list(map(int, v[cuts[k] : cuts[k + 1]])) for _, v in rows]
        book = [list(v) for v in x[:entries]]

        def near(v, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            own = {}
            for v in x:
                own.setdefault(near(v)[1], []).append(v)
            for i, members in own.items():
                book[i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        for j, v in enumerate(x):
            distance, codes[j][k] = near(v)
            errors[j] += distance
        books.append(book)
    return codes, errors, books


@pytest.mark.parametrize("width,size", [(1, 4), (2, 50), (5, 3), (16, 2000), (12, 2)])
def test_the_tree_finds_the_nearest_entry_and_the_smaller_of_equal_ones(width, size):
    g = np.random.default_rng(width)
    for n in (1, 2, 17, 100, 256):
        entries, parts = g.integers(-size, size, (n, width)), g.integers(-size, size, (700, width))
        parts[:50] = entries[g.integers(0, n, 50)]
        tree = vector_codes.Gnat(entries, 6, 10)
        code, distance = tree.nearest(parts)
        full = ((parts[:, None] - entries) ** 2).sum(2)
        assert np.array_equal(code, full.argmin(1)) and np.array_equal(distance, full.min(1))


def test_whole_subtrees_are_left_out():
    g = np.random.default_rng(4)
    entries = g.integers(-9, 9, (256, 3)) + 2000 * g.integers(-4, 4, (256, 3))
    tree = vector_codes.Gnat(entries, 8, 10)
    tree.nearest(np.repeat(entries, 10, axis=0) + g.integers(-5, 5, (2560, 3)))
    assert tree.visited < 0.3 * 2560 * 256


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, codes int").repartition(3)


def test_codes_errors_and_codebooks(spark, tmp_path):
    g = np.random.default_rng(8)
    rows = [(int(i), (g.integers(0, 3) + 0.2 * g.normal(size=10)).tolist(), str(i % 3) if i % 4 else None, 1) for i in g.permutation(400)]
    rows += [(1000 + i, rows[0][1], "0", None) for i in range(300)]  # a very common vector
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None, "a", 1), (2001, [nan] * 10, "a", 1), (2002, [inf] + [0.0] * 9, "a", 1), (2003, [None] + [0.0] * 9, "a", 1), (2004, [1.0], "a", 1), (2005, [], "a", 1)]
    table(spark, rows + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12(spark, str(tmp_path)).orderBy("vec_id").collect()
    plain = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label, _ in rows)
    codes, errors, books = brute([(i, v) for i, v, _ in plain])
    text = ",".join(str(x) for book in books for e in book for x in e)
    by_label = {}
    for (_, _, label), e in zip(plain, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(text.encode()).hexdigest()
    want = [(i, "".join(f"{c:02x}" for c in code), e, by_label[label], digest) for (i, _, label), code, e in zip(plain, codes, errors, strict=True)]
    assert [tuple(r) for r in got] == want


def test_large_numbers_few_rows_and_empty_tables(spark):
    rows = [(5, [3e4, -3e4, 0.5, 1e300], "x", 0), (5, [3e4, -3e4, 0.5, 7.0], "x", 0), (None, [1e7, -2e9, 0.0, -1.0], None, 0)]
    out, books = vector_codes.compress(table(spark, rows), entries=2, rounds=1, keep=("codes",))
    got = {tuple(r.codes): r.error for r in out.collect()}
    # The codebooks start as both rows of id 5; the row without an id comes last.
    assert [len(b) for b in books] == [2, 2, 2, 2]
    assert len(got) == 3 and None in got.values() and 0 in got.values()
    assert all(r.kept["codes"] == 0 for r in out.collect())
    out, books = vector_codes.compress(table(spark, rows).limit(0))
    assert out.count() == 0 and [len(b) for b in books] == [0] * 4
