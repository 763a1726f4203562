"""Approximate nearest neighbours by balanced posting lists with replicated boundaries.

Centroids come from hierarchical balanced clustering of a sample: a set of vectors is halved by two means, neither half
below a third, until the sets are small. Every vector is posted to its nearest centroid's list, and to others whose
distance is within a ratio of the nearest one, if the vector lies close to the boundary between the two: on the line from
the nearest centroid to the other it falls near the middle. A query finds its nearest centroids by best-first search in a
graph over the centroids, keeps all lists whose distance is within a ratio of the nearest one, and compares itself with
all vectors posted there, in double precision. Neighbouring lists are worked on together, so a query gets one short list
of the best from each group of them. That ratio has no set value: the neighbours of at most ``SAMPLE`` queries
are found by brute force, and the smallest ratio is taken whose lists hold the share ``RECALL`` of them.

The index is fitted on at most ``FIT_ROWS`` vectors (and ``FIT_NUMBERS`` numbers), those with the smallest hash, and has at most ``MAX_LISTS`` lists;
all vectors are posted. Lists have no cap: large ones, and those that many queries select, are dealt out to several tasks.
Equal vectors are posted once, with the smallest ids they have, as many as a result can name.

Defined results: null, zero and non-finite vectors take no part, nor do those of another length than the commonest (of
equally common ones the largest); rows with equal ids are candidates and queries each; ties go to the smaller id; with
fewer candidates than asked for, all are found; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from hexrisk.llm.files import stored

FIT_ROWS = 50_000
LIST_ROWS = 100
MAX_LISTS = 4096
REPLICAS, REPLICA_RATIO = 6, 1.12
#: How far before the middle of the way between two centroids the boundary begins, as a share of the way.
BOUNDARY = 0.03
#: Share of the neighbours that the lists read should hold, and queries that the ratio is taken from.
RECALL, SAMPLE = 0.95, 256
DEGREE, BEAM = 24, 128
NO_ID = -(1 << 63)
#: Lists are dealt out in at least so many groups of neighbouring ones, and groups in parts of at most so many numbers.
GROUPS, PART_NUMBERS = 16, 1 << 21
#: Numbers that the index is fitted on at most, beside the limit of rows.
FIT_NUMBERS = 1 << 24


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which vectors go to the second of two means; neither side gets less than a third."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        lean = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
        order = np.argsort(lean, kind="stable")
        cut = int(np.clip(np.searchsorted(lean[order], 0), len(x) // 3, len(x) - len(x) // 3))
        side = np.zeros(len(x), bool)
        side[order[cut:]] = True
        a, b = x[~side].mean(0), x[side].mean(0)
    return side


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Means of about ``lists`` sets of similar size, in the order of the tree of halves, so that neighbours stand together."""
    rng, done, open_sets = np.random.default_rng(seed), [], [(-len(x), "", x)]
    while open_sets and len(done) + len(open_sets) < lists:
        _, path, largest = heapq.heappop(open_sets)
        if len(largest) < 4:
            done.append((path, largest))
            continue
        side = halves(largest, rng)
        for step, part in (("0", largest[~side]), ("1", largest[side])):
            heapq.heappush(open_sets, (-len(part), path + step, part))
    sets = sorted([*done, *((path, s) for _, path, s in open_sets)], key=lambda s: s[0])
    return np.stack([s.mean(0) for _, s in sets]).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1), 0)


@dataclass
class Index:
    """Centroids and a graph of nearest ones, with a few far links for long ways."""

    centroids: np.ndarray
    links: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, degree: int = DEGREE, seed: int = 1) -> Index:
        n, rng = len(centroids), np.random.default_rng(seed)
        near = [np.argsort(squared(centroids[i : i + 256], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 256)]
        return Index(centroids, np.concatenate([np.concatenate(near), rng.integers(0, n, (n, 4))], axis=1))

    def nearest(self, q: np.ndarray, beam: int = BEAM, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """About the ``beam`` nearest centroids and all within ``ratio`` of the nearest, nearest first, and their distances."""
        seen = np.zeros(len(self.centroids), bool)
        start = np.unique(np.linspace(0, len(self.centroids) - 1, 8).astype(int))
        seen[start] = True
        distance = np.sqrt(((self.centroids[start] - q) ** 2).sum(1))
        found = list(zip(distance.tolist(), start.tolist(), strict=True))
        ahead, best, least = sorted(found), [-d for d, _ in found], float(distance.min())
        heapq.heapify(best)
        while ahead:
            d, c = heapq.heappop(ahead)
            if len(best) >= beam and d > max(-best[0], ratio * least):
                break
            new = np.unique(self.links[c][~seen[self.links[c]]])
            seen[new] = True
            for e, k in zip(np.sqrt(((self.centroids[new] - q) ** 2).sum(1)).tolist(), new.tolist(), strict=True):
                least = min(least, e)
                if len(best) < beam or e <= max(-best[0], ratio * least):
                    heapq.heappush(ahead, (e, k))
                    found.append((e, k))
                    heapq.heappush(best, -e)
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted(x for x in found if x[0] <= max(-best[0], ratio * least))
        return np.array([c for _, c in found]), np.array([d for d, _ in found])


def fit_index(vectors: DataFrame, n: int, rows: int = FIT_ROWS, list_rows: int = LIST_ROWS) -> Index:
    """Index from at most ``rows`` of ``n`` distinct vectors (column ``v``)."""
    width = len(vectors.select("v").first()["v"])
    x = matrix(vectors.orderBy(F.xxhash64("v"), "v").limit(max(1, min(rows, FIT_NUMBERS // width))).select("v").toArrow().column("v").combine_chunks())
    return Index.of(balanced_centroids(x, max(1, min(MAX_LISTS, n // list_rows))))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def posted(vectors: DataFrame, index: Index) -> DataFrame:
    """``list`` numbers of each vector (columns ``number``, ``v``): the nearest one, and others near the boundary."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = index.centroids
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                distance = np.sqrt(squared(matrix(part.column("v")), c))
                near = np.argsort(distance, axis=1, kind="stable")[:, : 4 * REPLICAS]
                rows, lists, firsts = [], [], []
                for i, (order, d) in enumerate(zip(near, np.take_along_axis(distance, near, 1), strict=True)):
                    chosen = [order[0]]
                    for k in range(1, len(order)):
                        if d[k] > REPLICA_RATIO * d[0] or len(chosen) == REPLICAS:
                            break
                        if d[k] ** 2 - d[0] ** 2 <= 2 * BOUNDARY * ((c[order[0]] - c[order[k]]) ** 2).sum():
                            chosen.append(order[k])
                    rows += [i] * len(chosen)
                    lists += chosen
                    firsts += [True] + [False] * (len(chosen) - 1)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.int32()), pa.array(firsts)], [*batch.schema.names, "list", "first"])

    return vectors.mapInArrow(post, T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("first", T.BooleanType())]))


def calibrated(queries: DataFrame, postings: DataFrame, index: Index, k: int) -> float:
    """Smallest ratio whose lists hold the share ``RECALL`` of the ``k`` nearest other vectors of at most ``SAMPLE`` queries."""
    sample = queries.select("v").distinct().orderBy(F.xxhash64("v", F.lit(1)), "v").limit(SAMPLE).collect()
    if not sample:
        return 1.0
    q = np.array([r[0] for r in sample], np.float64)

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, number = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                score = np.concatenate([score, squared(q, matrix(part.column("v")))], axis=1)
                number = np.concatenate([number, np.tile(part.column("number").to_numpy(), (len(q), 1))], axis=1)
                near = np.argsort(score, axis=1, kind="stable")[:, : k + 1]
                score, number = np.take_along_axis(score, near, 1), np.take_along_axis(number, near, 1)
        rows = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(number.ravel()), pa.array(score.ravel())], ["query", "number", "score"])

    near = postings.filter("first").select("number", "v").mapInArrow(brute, "query long, number long, score double")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "number")))
    near = near.filter(F.col("place").between(2, k + 1))  # the first is the query itself
    held = postings.select("number", "list").join(F.broadcast(near), "number")  # k rows of SAMPLE queries at most
    held = held.groupBy("query", "number").agg(F.collect_list("list").alias("lists")).collect()
    distance = np.sqrt(squared(q, index.centroids))
    first = np.maximum(distance.min(1), np.finfo(np.float64).tiny)
    with np.errstate(over="ignore"):
        need = np.array([max(1.0, distance[r["query"], r["lists"]].min() / first[r["query"]]) for r in held])
    return float(np.quantile(need, RECALL, method="higher")) * (1 + 1e-9) if len(need) else 1.0


def selected(queries: DataFrame, index: Index, sizes: np.ndarray, k: int, ratio: float) -> DataFrame:
    """Lists that each query (columns ``query``, ``v``) reads: all within the ratio, and enough of them to hold ``k`` vectors.

    A row for each group of lists, with those that are read in it (``lists``).
    """
    per_group = lists_per_group(len(index.centroids))

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, groups, lists = [], [], []

            def taken() -> pa.RecordBatch:
                some = batch.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*some.columns, pa.array(groups, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "group", "lists"])

            for i, q in enumerate(matrix(batch.column("v"))):
                order, d = index.nearest(q, ratio=ratio)
                n = int(np.searchsorted(d, ratio * d[0], side="right"))
                enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                if enough > len(order):  # the lists found hold too little: take them all in order
                    order = np.argsort(squared(q[None], index.centroids)[0], kind="stable")
                    enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                chosen = np.sort(order[: max(n, enough)])
                for group in np.unique(chosen // per_group).tolist():
                    rows.append(i)
                    groups.append(group)
                    lists.append(chosen[chosen // per_group == group].tolist())
                if len(rows) >= 10_000:
                    yield taken()
                    rows, groups, lists = [], [], []
            yield taken()

    return queries.mapInArrow(select, T.StructType([*queries.schema.fields, T.StructField("group", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))]))


def lists_per_group(lists: int) -> int:
    return max(1, lists // GROUPS)


def best_of(x: np.ndarray, least: np.ndarray, q: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` nearest rows of ``x`` that are allowed, nearest first and of equally near ones the smaller ``least``; and distances.

    The expanded formula leaves out what is too far beyond the error it can make; the rest is compared exactly.
    """
    at = np.flatnonzero(allowed)
    rough = squared(q[None], x[at])[0]
    if len(at) > k:
        bound = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * ((q**2).sum() + (x[at] ** 2).sum(1).max())
        at = at[~(rough > np.partition(rough, k - 1)[k - 1] + bound)]
    exact = np.sqrt(((x[at] - q) ** 2).sum(1))
    order = np.lexsort((least[at], exact))[:k]
    return at[order], exact[order]


def compared(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest ``k`` postings of each query in each cell (part of a group of lists, part of the queries), with exact distances."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            # A vector stands in several lists of the group; its rows are one.
            number, where = np.unique(left["number"].to_numpy(), return_index=True)
            x, least = np.stack(left["v"].to_numpy()[where]).astype(np.float64), left["least"].to_numpy()[where]
            lists, column = np.unique(left["list"].to_numpy(), return_inverse=True)
            row = np.searchsorted(number, left["number"].to_numpy())
            for query, v, read in zip(right["query"], right["v"], right["lists"], strict=True):
                allowed = np.zeros(len(number), bool)
                allowed[row[np.isin(lists, read)[column]]] = True
                if allowed.any():
                    at, score = best_of(x, least, np.asarray(v, np.float64), allowed, k)
                    found.append(pd.DataFrame({"query": query, "number": number[at], "score": score, "least": least[at]}))
        empty = {"query": pd.Series(dtype="int64"), "number": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "least": pd.Series(dtype="int64")}
        return pd.concat(found) if found else pd.DataFrame(empty)

    cell = ["group", "part", "query_part"]
    return postings.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(compare, "query long, number long, score double, least long")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest ``k`` rows of each row that ``is_query`` picks, itself excluded: query_id, rank, vec_id, score."""
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), is_query.alias("is_query")).filter(usable(F.col("v")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.filter(F.size("v") == length["d"])
    # Equal vectors as one, with their first ids; the rank is cut before the shuffle, so a very common vector is no hot key.
    by_id = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    groups = rows.withColumn("n", by_id).filter(F.col("n") <= k + 1).groupBy("v").agg(F.collect_list(F.struct("vec_id", "row")).alias("ids"))
    groups = stored(groups.withColumn("number", F.monotonically_increasing_id()), "groups")
    n = groups.count()
    index = fit_index(groups, n)
    # The smallest id of each vector settles ties; a missing one comes first, as in the final order.
    least = F.coalesce(F.array_min(F.transform("ids", lambda i: F.coalesce(i["vec_id"].cast("long"), F.lit(NO_ID)))), F.lit(NO_ID))
    postings = stored(posted(groups.select("number", "v", least.alias("least")), index), "postings")
    counts = {r["list"]: (r["n"], r["first"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("first")).collect()}
    sizes = np.array([counts.get(i, (0, 0))[1] for i in range(len(index.centroids))])  # MAX_LISTS numbers at most
    asking = rows.filter("is_query").select(F.col("row").alias("query"), "v")
    queries = stored(selected(asking, index, sizes, k + 1, calibrated(asking, postings, index, k)), "queries")

    grouped = postings.withColumn("group", F.floor(F.col("list") / lists_per_group(len(index.centroids))).cast("int"))
    part = max(1, PART_NUMBERS // length["d"])
    size_of = grouped.groupBy("group").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    asked = queries.groupBy("group").agg(F.ceil(F.count("*") / part).cast("int").alias("query_parts"))
    cells = F.broadcast(size_of.join(asked, "group"))  # a row per group, MAX_LISTS at most
    left = grouped.join(cells, "group").withColumn("part", F.pmod(F.hash("number"), "parts")).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    right = queries.join(cells, "group").withColumn("query_part", F.pmod(F.hash("query"), "query_parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = compared(left.select("group", "part", "query_part", "list", "number", "v", "least"), right.select("group", "part", "query_part", "query", "v", "lists"), k + 1)
    # A vector found in several groups is one; equal distances are settled by the smallest id before the ids are looked up.
    nearest_first = Window.partitionBy("query").orderBy("score", "least", "number")
    found = found.distinct().withColumn("place", F.row_number().over(nearest_first)).filter(F.col("place") <= k + 1)
    named = found.join(groups.select("number", F.explode("ids").alias("id")), "number").filter(F.col("id.row") != F.col("query"))
    best = Window.partitionBy("query").orderBy("score", "id.vec_id", "id.row")
    named = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    ids = rows.filter("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return named.join(ids, "query").select("query_id", "rank", F.col("id.vec_id").alias("vec_id"), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
