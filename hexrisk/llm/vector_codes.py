"""Vector compression by part codebooks; the nearest entry of a part is found in a GNAT over the entries.

Vectors of whole numbers are cut into consecutive parts, and each part is replaced by the number of its codebook's nearest
entry. Codebooks start as given rows and are refined in rounds: parts are assigned, sums are gathered, and each entry
becomes the floored mean of its parts.

A geometric near-neighbour access tree (GNAT) over the entries of a codebook answers the assignments. Each node has split
points; every other entry of the node goes to its nearest split point's child, and for every split point the node holds
the range of its distances to every child's entries. A block of parts walks down together: distances to the split points
are exact candidates, and a child is left out for those parts whose distance to some split point lies so far outside the
child's range that no entry there can be as near as the best one found so far. Ranges and distances are roots in floating
point, so they are widened by more than their rounding, and only strict excess eliminates; entries at equal distance stay
in the race. Squared distances are whole numbers that floating point holds exactly, and ties are settled on them.

Codebooks are small and bounded (parts x entries x width numbers); they go to the driver and to each task. Sums are added
up per task before they are shuffled, so a row per entry and task leaves it, however common a vector is.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those of another length
than the commonest (of equally common ones the longest); scaled components beyond 64 bits count as the largest or smallest
such number; rows whose numbers are too large for exact floating point are compared in whole numbers of any size; an
error beyond 64 bits is null; the first entries are the rows of the smallest ids, nulls last, equal ids by their vectors;
with fewer rows than entries there are as many entries as rows; lengths that parts don't divide give the first parts one
component more; an empty table gives no rows. Other columns are passed on; a clash of names is avoided by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.files import stored
from hexrisk.operators.joins import salted_join

#: Split points of a node, and entries up to which a node is a leaf, all of which are compared.
DEGREE, LEAF = 16, 64
#: Parts that walk down a tree together.
BLOCK = 4096
#: Numbers up to this size have squared distances that floating point holds exactly, for widths up to ``WIDTH``.
EXACT, WIDTH = 1 << 20, 1 << 10
#: Relative widening of distances; rounding errs by less than a thousandth of it.
SLACK = 1e-11


def whole(column: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component, as 64-bit numbers."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def complete(v: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, finite)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``; exact for whole numbers up to ``EXACT``."""
    return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)


@dataclass
class Node:
    """Split points (entry numbers), children, and the ranges of distances from each split point to each child's entries."""

    splits: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


class Gnat:
    """Nearest entries of a codebook; ``visited`` counts the distances worked out."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.degree, self.leaf, self.visited = entries.astype(np.float64), degree, leaf, 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, numbers: np.ndarray) -> Node:
        if len(numbers) <= max(self.leaf, self.degree):
            return Node(numbers, [], np.zeros((0, 0)), np.zeros((0, 0)))
        points = self.entries[numbers]
        # Split points far from each other: each next one is the entry farthest from those chosen.
        chosen = [0]
        away = squared(points, points[:1])[:, 0]
        while len(chosen) < self.degree and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(points, points[chosen[-1:]])[:, 0])
        if len(chosen) < 2:  # all entries are equal
            return Node(numbers, [], np.zeros((0, 0)), np.zeros((0, 0)))
        far = np.sqrt(squared(points, points[chosen]))
        rest = np.setdiff1d(np.arange(len(numbers)), chosen)
        home = far[rest].argmin(1)
        children, low, high = [], np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)
        for child in range(len(chosen)):
            own = rest[home == child]
            children.append(self._node(numbers[own]) if len(own) else None)
            if len(own):
                low[:, child], high[:, child] = far[own].min(0), far[own].max(0)
        return Node(numbers[chosen], children, low * (1 - SLACK), high * (1 + SLACK))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each part (of equal ones the smallest) and the squared distance."""
        parts = parts.astype(np.float64)
        # Distance and number in one key: the smaller number wins among equal distances.
        best = np.full(len(parts), np.iinfo(np.int64).max)
        self._walk(self.root, parts, np.arange(len(parts)), best)
        return best % len(self.entries), best // len(self.entries)

    def _walk(self, node: Node, parts: np.ndarray, rows: np.ndarray, best: np.ndarray) -> None:
        n = len(self.entries)
        exact = squared(parts[rows], self.entries[node.splits])
        self.visited += exact.size
        best[rows] = np.minimum(best[rows], (exact.astype(np.int64) * n + node.splits).min(1))
        if not node.children:
            return
        far = np.sqrt(exact)
        # Every part first sees the child of its nearest split point, which brings its best distance down for the others.
        home = far.argmin(1)
        for first in (True, False):
            for child, below in enumerate(node.children):
                if below is None:
                    continue
                some = np.flatnonzero((home == child) == first)
                reach = np.sqrt((best[rows[some]] // n).astype(np.float64))[:, None] * (1 + SLACK)
                d = far[some]
                out = (d > (node.high[:, child] + reach) * (1 + SLACK)) | (d < (node.low[:, child] - reach) * (1 - SLACK))
                some = some[~out.any(1)]
                if len(some):
                    self._walk(below, parts, rows[some], best)


def compared_whole(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The same for numbers of any size, entry by entry in whole numbers without a bound."""
    parts, entries = parts.astype(object), entries.astype(object)
    distance = [[sum((x - y) ** 2 for x, y in zip(p, e, strict=True)) for e in entries] for p in parts]
    code = [min(range(len(entries)), key=lambda i: (d[i], i)) for d in distance]
    return np.array(code, np.int64), [d[c] for d, c in zip(distance, code, strict=True)]


class Codebooks:
    """Entries of all parts, with a tree for each."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.exact = all(e.size == 0 or (np.abs(e.astype(object)).max() <= EXACT and e.shape[1] <= WIDTH) for e in entries)
        self.bounds = np.cumsum([0, *(e.shape[1] for e in entries)])
        self.trees = [Gnat(e) for e in entries] if self.exact else []

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Codes of all parts of each vector (a row of ``x``), and the error of the whole vector."""
        codes, errors = np.zeros((len(x), len(self.entries)), np.int64), np.zeros(len(x), np.int64)
        plain = (np.abs(x) <= EXACT).all(1) & (x > np.iinfo(np.int64).min).all(1) if self.exact else np.zeros(len(x), bool)
        for begin in range(0, len(x), BLOCK):
            rows = begin + np.flatnonzero(plain[begin : begin + BLOCK])
            for k, tree in enumerate(self.trees):
                codes[rows, k], distance = tree.nearest(x[rows, self.bounds[k] : self.bounds[k + 1]])
                errors[rows] += distance
        total: list[int | None] = errors.tolist()
        odd = np.flatnonzero(~plain)
        if len(odd):
            large = [0] * len(odd)
            for k, entries in enumerate(self.entries):
                codes[odd, k], distance = compared_whole(x[odd, self.bounds[k] : self.bounds[k + 1]], entries)
                large = [a + b for a, b in zip(large, distance, strict=True)]
            for i, error in zip(odd.tolist(), large, strict=True):
                total[i] = error if error < 1 << 63 else None
        return codes, total


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def task_sums(rows: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """Per task, part and entry with any parts: their count and componentwise sum (column ``v`` of ``rows`` is read)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, object) for e in books.entries]
        for batch in batches:
            x = numbers(batch.column("v"), width)
            codes, _ = books.assigned(x)
            for k in range(len(counts)):
                own = x[:, books.bounds[k] : books.bounds[k + 1]]
                counts[k] += np.bincount(codes[:, k], minlength=len(counts[k]))
                order = np.argsort(codes[:, k], kind="stable")
                used, first = np.unique(codes[order, k], return_index=True)
                # Halves are summed apart, so that no sum of a batch leaves 64 bits.
                for half, shift in ((own >> 32, 32), (own & 0xFFFFFFFF, 0)):
                    if len(used) and own.shape[1]:
                        sums[k][used] += np.add.reduceat(half[order], first, axis=0).astype(object) << shift
        for k, (count, total) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(count)
            values = [[str(v) for v in row] for row in total[used]]
            yield pa.RecordBatch.from_pydict({"part": [k] * len(used), "entry": used.tolist(), "n": count[used].tolist(), "sums": values}, types)

    types = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
    return rows.select("v").mapInArrow(add, "part int, entry int, n long, sums array<string>")


def refined(rows: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Codebooks whose used entries are the floored means of their parts."""
    sums = task_sums(rows, books, width)
    flat = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    means = flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    fresh = [e.copy() for e in books.entries]
    for r in means.collect():  # a row per component of a codebook
        fresh[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(fresh)


def first_entries(rows: DataFrame, entries: int, bounds: np.ndarray) -> Codebooks:
    """Codebooks of the rows with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    x = np.array([r["v"] for r in first], np.int64).reshape(len(first), int(bounds[-1]))
    return Codebooks([x[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def compress(
    embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id``, the columns ``keep`` under their names in ``kept``, ``codes`` by part and ``error``; and the codebooks."""
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("kept"), F.col(vector).alias("raw"))
    rows = rows.filter(complete(F.col("raw"))).select("vec_id", "kept", whole(F.col("raw"), scale).alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = length["d"] if length else 0
    rows = rows.filter(F.size("v") == width)
    bounds = np.cumsum([0, *(width // parts + (k < width % parts) for k in range(parts))])
    books = first_entries(rows, entries, bounds)
    for _ in range(rounds if length else 0):
        books = refined(rows, books, width)

    kept_field = rows.schema["kept"]
    names = ["vec_id", "kept", "codes", "error"]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assigned(numbers(batch.column("v"), width))
            codes = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel().astype(np.int32)), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("kept"), codes, pa.array(errors, pa.int64())], names)

    schema = f"vec_id long, kept {kept_field.dataType.simpleString()}, codes array<int>, error long"
    return rows.mapInArrow(assign, schema), books.entries


def _oracle(rounds: int = 4) -> str:
    """The same with one table of assignments and one of entries per round."""
    assigned = """a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, min_by(c.entry, (p.xx - 2 * list_inner_product(p.v, c.v) + c.vv) * 256 + c.entry) AS entry,
    min(p.xx - 2 * list_inner_product(p.v, c.v) + c.vv) AS error FROM parts p JOIN c{r} c ON c.part = p.part GROUP BY p.vec_id, p.part)"""
    moved = """m{n} AS MATERIALIZED (SELECT part, entry, list(value ORDER BY place) AS v FROM (SELECT part, entry, place, floor(sum(x) / count(*)) AS value
    FROM (SELECT a.part, a.entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS place FROM a{r} a JOIN parts p USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL),
    c{n} AS MATERIALIZED (SELECT part, entry, v, list_inner_product(v, v) AS vv FROM (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{n} m USING (part, entry)))"""
    steps = [assigned.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1), assigned.format(r=r + 1)]
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS (SELECT vec_id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS v FROM kept, range(4) t(part)),
    parts AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS xx FROM cut),
    c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v, xx AS vv FROM parts QUALIFY entry < 256),
    {", ".join(steps)},
    books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM c{rounds})),
    coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLE = _oracle()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 4 parts of 256 entries after 4 rounds, and the error by label."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    digit = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    label = F.col("kept.label")
    codes = stored(
        codes.select(
            "vec_id", F.array_join(F.transform("codes", digit), "").alias("code"), "error",
            label.isNull().alias("no_label"), F.coalesce(label.cast("string"), F.lit("")).alias("label"),
        ),
        "codes",
    )
    by_label = codes.groupBy("no_label", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select("no_label", "label", F.expr("try_cast(total AS bigint)").alias("label_error"))
    text = ",".join(str(v) for e in books for v in e.ravel().tolist())
    named = salted_join(codes, by_label, ["no_label", "label"])
    return named.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(text), 256).alias("codebooks_sha256"))
