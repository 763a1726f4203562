"""Boosted trees by histograms, several models on the same rows at once.

Features are binned once to small whole numbers and written in blocks of rows, dealt evenly over all cores. Every level of a
round is one job for all models (lanes): tasks map the files of their blocks, add up gradients and curvatures by (lane, node,
feature, bin), and the sums come to the driver, which finds the best split of each node. Features with few bins are counted
in bundles, by all their bins at once, and told apart at the end of the task. Of two children only the lighter is added
up; what its parent has beyond it is its sibling's. Leaf values follow from the sums at the splits. Margins lie beside the
blocks; the first level of a round adds the last tree to them, a feature's column at a time, and writes them anew. Where all
blocks are one task's work (``TASK_BLOCKS``), nothing is left to merge, and that task goes through
the rounds by the same steps without a job for each; the trees are the same.

Gradients are rounded to multiples of a power of two chosen from the total weight, and added up as whole numbers, so the
trees do not depend on the order in which tasks finish. Which rows a round samples follows from the rows' numbers.
"""

from __future__ import annotations

import json
import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass, field
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.session import drop_scratch, scratch_path, stored

# Boosting settings; the regularisation is the usual default of such learners.
GBT_SETTINGS = {"maxIter": 400, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureShare": 0.8, "seed": 42}
LAMBDA, MIN_CURVATURE_SUM = 1.0, 1.0
# Focal settings.
FOCAL_GAMMA, FOCAL_ALPHA, PROBABILITY_FLOOR, MIN_CURVATURE = 2.0, 0.25, 1e-7, 1e-6
# Rounds without a better score on the stop rows that end the training.
PATIENCE = 30
#: Bins of a feature, rows of a block, blocks of a task, and rounds between stored margins.
BINS, BLOCK_ROWS, TASK_BLOCKS, STORE_ROUNDS = 64, 8192, 32, 1
#: Blocks that are added up at once, and times margins are stored before older ones are dropped.
JOINED_BLOCKS, CUT_STORES = 4, 1
#: Rows that values are counted in at once, and values of them that quantiles are taken from.
QUANTILE_ROWS, QUANTILE_POINTS = 1 << 17, 10_000
#: Bytes that arrays in a file begin at multiples of.
ALIGNED = 64
#: Tasks' work (``TASK_BLOCKS``) that a part of the dealt blocks may hold.
PART_TASKS = 4
#: Bytes of a level's sums, over all parts, that may come to the driver; beyond, they are merged by key before.
DIRECT_BYTES = 32 << 20
#: Pieces that a lane's sums are merged in.
PIECES = 16
#: Cells, over all counted nodes of a lane, that a bundle of features may have.
BUNDLE_CELLS = 2048
#: In place of a weight, marks a stop row.
STOP = -1.0
#: Ranges of the score that average precision on the stop rows is taken from.
WATCH_RANGES = 4096
#: Bits of the largest sum: whole numbers up to here are exact in doubles too, whatever the order they are added in.
SUM_BITS = 53


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, np.maximum(p * (1.0 - p), MIN_CURVATURE)


def focal(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, weighted by the focal weight at the current score."""
    p = np.clip(1.0 / (1.0 + np.exp(-margin)), PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    missed = np.where(y == 1, 1.0 - p, p)
    weight = np.where(y == 1, FOCAL_ALPHA, 1.0 - FOCAL_ALPHA) * missed**FOCAL_GAMMA
    return weight * (p - y), np.maximum(weight * p * (1.0 - p), MIN_CURVATURE)


LOSSES = {"logistic": logistic, "focal": focal}


@dataclass(frozen=True)
class Lane:
    """One model: its loss, which rows it learns from, their weights, and rows that only decide when to stop."""

    loss: str = "logistic"
    train: Column | None = None
    weight: Column | None = None
    stop: Column | None = None


@dataclass
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2 i + 1`` (at most the cut) and ``2 i + 2``; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, columns: np.ndarray, depth: int) -> np.ndarray:
        """Node of each row ``depth`` steps down, from a row of ``columns`` per feature."""
        node = np.zeros(columns.shape[1], np.uint8 if depth < 8 else np.int64)
        whole, bins = True, columns.dtype.kind == "u"
        for begin in [(1 << level) - 1 for level in range(depth)]:
            inner = begin + np.flatnonzero(self.feature[begin : 2 * begin + 1] >= 0)
            right = np.zeros(len(node), bool)
            for at in map(int, inner):
                # Compared in the columns' own type, so that bins are not widened; what is no number goes right.
                column, cut = columns[self.feature[at]], columns.dtype.type(self.cut[at])
                beyond = column > cut if bins else ~(column <= cut)
                if begin:
                    beyond &= node == at
                right |= beyond
            whole = whole and len(inner) == begin + 1
            if whole:
                node += node
                node += 1
            else:
                # Rows of a leaf stay where they are.
                following = np.arange(2 * begin + 1, dtype=node.dtype)
                following[inner] = 2 * inner + 1
                node = following.take(node)
            node += right
        return node


@dataclass
class BoostedTrees:
    """A trained model on raw feature values; ``cut`` holds values, so it needs no bins."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return max(((len(t.feature) + 1).bit_length() - 2 for t in self.trees), default=0)

    def margins(self, x: np.ndarray, binned: tuple[list[np.ndarray], list[Tree]] | None = None) -> np.ndarray:
        """Sums of the trees' values; ``binned``, where at hand, spares finding it again."""
        cuts, trees = binned or self.binned()
        columns, depth = np.zeros(x.shape[::-1], np.min_scalar_type(max(map(len, cuts), default=0))), self.depth
        for i, own in enumerate(cuts):
            if len(own):
                # What is no number comes last, and so goes right everywhere.
                columns[i] = np.searchsorted(own, x[:, i], side="left")
        out = np.zeros(len(x))
        for tree in trees:
            out += tree.value.take(tree.nodes(columns, depth))
        return out

    def binned(self) -> tuple[list[np.ndarray], list[Tree]]:
        """By feature the values that trees cut it at, and the trees with places among these as cuts."""
        if not self.trees:
            return [np.zeros(0)] * len(self.features), []
        feature, cut = (np.concatenate([getattr(t, c) for t in self.trees]) for c in ("feature", "cut"))
        place, cuts = np.zeros(len(cut), np.int64), []
        for i in range(len(self.features)):
            values, place[feature == i] = np.unique(cut[feature == i], return_inverse=True)
            cuts.append(values)
        places = np.split(place, np.cumsum([len(t.cut) for t in self.trees])[:-1])
        return cuts, [Tree(t.feature, own, t.value, t.gain) for t, own in zip(self.trees, places, strict=True)]

    def gains(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() > 0 else total

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per node, and one with the features' names (tree -1)."""
        rows = [(-1, 0, -1, 0.0, 0.0, 0.0, json.dumps(self.features))]
        for k, t in enumerate(self.trees):
            rows += [(k, i, int(f), float(c), float(v), float(g), None) for i, (f, c, v, g) in enumerate(zip(t.feature, t.cut, t.value, t.gain, strict=True))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, value double, gain double, features string")

    @staticmethod
    def of_table(table: DataFrame) -> BoostedTrees:
        rows = sorted(table.collect(), key=lambda r: (r["tree"], r["node"]))
        model, by_tree = BoostedTrees(json.loads(rows[0]["features"])), {}
        for r in rows[1:]:
            by_tree.setdefault(r["tree"], []).append(r)
        for nodes in by_tree.values():
            model.trees.append(Tree(np.array([r["feature"] for r in nodes], np.int64), *(np.array([r[c] for r in nodes], np.float64) for c in ("cut", "value", "gain"))))
        return model


# Blocks


@dataclass(frozen=True)
class Shape:
    """What a block holds: bins by feature, labels, and by lane weights (0: not learnt from) and stop flags."""

    features: int
    lanes: int

    def read(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"], np.uint8)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(self.features, len(y))
        weight, stop = (np.frombuffer(row[c], t).reshape(self.lanes, len(y)) for c, t in (("weight", np.float64), ("stop", np.uint8)))
        return bins, y, weight, stop


BLOCK = "block long, bins binary, y binary, weight binary, stop binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], BLOCK_NAMES)


def _points(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many of rising values, evenly by rank; each is counted with those left out before it."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    kept = np.unique(np.searchsorted(upto, np.ceil(upto[-1] * (np.arange(most) + 1.0) / most)))
    return values[kept], np.diff(upto[kept], prepend=0)


def feature_cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut values of each feature: approximate quantiles of what is not 0, and 0 itself, which most counts are.

    Values are counted in chunks of rows, of which up to ``QUANTILE_POINTS`` values go on; a chunk with fewer is exact.
    """
    shares = np.array([i / (bins - 2) for i in range(1, bins - 2)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            found = []
            for i in range(len(features)):
                x = np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in kept])
                found.append(_points(*np.unique(x[x != 0], return_counts=True), QUANTILE_POINTS))
            columns = [pa.array(range(len(features)), pa.int32()), pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["feature", "value", "n"])

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= QUANTILE_ROWS:
                yield chunk()
                kept.clear()
        if kept:
            yield chunk()

    def merge(chunks: pa.Table) -> pa.Table:
        value, n = (chunks.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("value", "n"))
        order = np.argsort(value, kind="stable")
        value, upto = value[order], np.cumsum(n[order])
        found = value[np.searchsorted(upto, np.ceil(shares * upto[-1]))] if len(value) else value
        return pa.table({"feature": chunks.column("feature").slice(0, 1), "cuts": pa.array([found], pa.list_(pa.float64()))})

    chunks = rows.select(*features).mapInArrow(count, "feature int, value array<double>, n array<long>")
    found = {r["feature"]: np.array(r["cuts"]) for r in chunks.groupBy("feature").applyInArrow(merge, "feature int, cuts array<double>").collect()}
    return [np.unique(np.array([0.0, *(v for v in found.get(i, ()) if math.isfinite(v))])) for i in range(len(features))]


def binned_blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray], lanes: int, tasks: int) -> DataFrame:
    """Rows (features, ``_y``, ``_w``: weights by lane, ``_s``: stop flags by lane) as blocks of bins."""

    def bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.searchsorted(cuts[i], batch.column(c).to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for i, c in enumerate(features)]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(len(features))
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.stack(columns, axis=1).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("_h"), bins, *(batch.column(c) for c in ("_y", "_w", "_s"))], ["_h", "_b", "_y", "_w", "_s"])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, kept = TaskContext.get().partitionId() << 40, 0, []

        def block(parts: list[tuple]) -> pa.RecordBatch:
            bins, y, weight, stop = (np.concatenate(p) for p in zip(*parts, strict=True))
            return _batch([(base + number, *(np.ascontiguousarray(a).tobytes() for a in (bins.T, y, weight.T, stop.T)))])

        for batch in batches:
            column = batch.column("_b").cast(pa.binary())
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1]
            bins = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, len(features))
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.uint8)
            weight = batch.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(-1, lanes)
            stop = batch.column("_s").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, lanes)
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = slice(begin, begin + BLOCK_ROWS)
                kept.append((bins[part], y[part], weight[part], stop[part]))
                if sum(len(k[1]) for k in kept) >= BLOCK_ROWS:
                    yield block(kept)
                    number, kept = number + 1, []
        if kept:
            yield block(kept)

    # In an order that doesn't depend on how tasks finish, as blocks and what a round samples follow from it.
    binned = rows.withColumn("_h", F.xxhash64(*features, "_y")).mapInArrow(bin_rows, "_h long, _b binary, _y int, _w array<double>, _s array<boolean>")
    return binned.repartition(tasks, "_h").sortWithinPartitions("_h").drop("_h").mapInArrow(build, BLOCK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sampled(block: int, n: int, seed: int, share: float) -> np.ndarray:
    """Which rows of a block a round uses."""
    if share >= 1:
        return np.ones(n, bool)
    key = _mixed(np.array([block, seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = _mixed(np.arange(n, dtype=np.uint64) + key[0] ^ key[1])
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


# One level


@dataclass
class Growing:
    """A lane's trees since the stored margins, and the tree that is growing."""

    lane: int
    loss: str
    unit: float
    pending: list[Tree]
    tree: Tree
    watch: bool


@dataclass
class Level:
    """All that a task needs to add up one level: among others the features to look at, and by lane the nodes to add up.

    ``sizes`` are the bins of each feature to look at, where some have fewer than ``bins``.
    """

    growing: list[Growing]
    depth: int
    max_depth: int
    columns: np.ndarray
    bins: int
    seed: int
    share: float
    counted: dict[int, list[int]]
    sizes: tuple[int, ...] | None = None

    def places(self, lane: int) -> np.ndarray:
        """By node in heap order, which of the counted nodes it is, or -1."""
        out = np.full((1 << (self.max_depth + 1)) - 1, -1, np.int32)
        nodes = self.counted[lane]
        out[np.array(nodes, np.int64) + (1 << self.depth) - 1] = np.arange(len(nodes))
        return out

    def by_column(self) -> list[int]:
        return list(self.sizes or [self.bins] * len(self.columns))

    def bundles(self) -> list[list[int]]:
        """Places of features whose bins are counted together: one pass over the rows serves all features of a bundle."""
        sizes, out, room = self.by_column(), [], []
        most = max(BUNDLE_CELLS // max([1, *map(len, self.counted.values())]), max(sizes))
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, left in enumerate(room) if left >= sizes[i]), len(out))
            if at == len(out):
                out.append([])
                room.append(most)
            out[at].append(i)
            room[at] //= sizes[i]
        return out

    def bytes(self) -> int:
        """Of the sums of one task, as they are sent."""
        nodes = sum(len(self.counted[g.lane]) for g in self.growing)
        return 16 * (nodes * sum(self.by_column()) + WATCH_RANGES * sum(g.watch for g in self.growing))

    def packed(self, sums: np.ndarray) -> np.ndarray:
        """Sums without the bins that a feature doesn't have: by gradient or curvature, node, and feature and bin."""
        has = np.arange(self.bins) < np.array(self.by_column())[:, None]
        return np.ascontiguousarray(sums.reshape(*sums.shape[:2], -1, self.bins).transpose(1, 2, 0, 3)[:, :, has])

    def unpacked(self, values: np.ndarray) -> np.ndarray:
        has = np.arange(self.bins) < np.array(self.by_column())[:, None]
        out = np.zeros((*values.shape[:2], *has.shape), np.int64)
        out[:, :, has] = values
        return np.ascontiguousarray(out.transpose(2, 0, 1, 3)).reshape(len(has), 2, -1)


class Block:
    """Rows of one block or a few: their numbers and lengths, bins by feature, labels, and by lane weights, stop flags and margins.

    Rows are kept in the order of the lanes they belong to, so that a lane looks at a stretch of them. Of each lane there are
    its stretch (``spans``), codes of what its rows weigh there (``STOP``: a stop row), the weights that codes stand for, and margins.
    """

    def __init__(self, numbers: list[tuple[int, int]], bins: np.ndarray, y: np.ndarray, weight: np.ndarray, stop: np.ndarray, margin: np.ndarray):
        weighs = np.where(stop > 0, STOP, np.maximum(weight, 0.0))
        self.numbers, self.order = numbers, np.lexsort(weighs == 0.0).astype(np.int32)
        self.bins, self.y = np.ascontiguousarray(bins[:, self.order]), y[self.order].astype(np.uint8)
        self.spans, self.codes, self.weights, self.margin = [], [], [], []
        for own, values in zip(weighs[:, self.order], margin[:, self.order], strict=True):
            inside = np.flatnonzero(own)
            begin, end = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)
            weights, codes = np.unique(own[begin:end], return_inverse=True)
            self.spans.append((begin, end))
            self.codes.append(codes.astype(np.min_scalar_type(len(weights))))
            self.weights.append(weights)
            self.margin.append(values[begin:end].copy())

    @staticmethod
    def joined(rows: list[dict], shape: Shape) -> Block:
        read = [shape.read(row) for row in rows]
        numbers = [(row["block"], len(r[1])) for row, r in zip(rows, read, strict=True)]
        bins, y, weight, stop = (np.concatenate(c, axis=-1) for c in zip(*read, strict=True))
        return Block(numbers, bins, y, weight, stop, np.zeros(weight.shape))

    def lane_bins(self, lane: int) -> np.ndarray:
        begin, end = self.spans[lane]
        return self.bins[:, begin:end]

    def moved(self, pending: dict[int, list[Tree]], depth: int) -> Block:
        """The block with margins that hold some more trees; lanes without any have ended and lose theirs."""
        out = copy(self)
        out.margin = [np.zeros(0)] * len(self.spans)
        for lane, trees in pending.items():
            out.margin[lane], bins = self.margin[lane], self.lane_bins(lane)
            for tree in trees:
                out.margin[lane] = out.margin[lane] + tree.value.take(tree.nodes(bins, depth))
        return out


def blocks_of(rows: Iterable[dict], shape: Shape) -> Iterator[Block]:
    rows = iter(rows)
    while some := list(islice(rows, JOINED_BLOCKS)):
        yield Block.joined(some, shape)


def bundled(bins: np.ndarray, level: Level, bundles: list[list[int]]) -> list[np.ndarray]:
    """By bundle a column that tells the bins of all its features."""
    sizes, out = level.by_column(), []
    for bundle in bundles:
        column = bins[level.columns[bundle[0]]].astype(np.min_scalar_type(math.prod(sizes[i] for i in bundle)))
        for i in bundle[1:]:
            column *= column.dtype.type(sizes[i])
            column += bins[level.columns[i]]
        out.append(column)
    return out


def unbundled(values: list[np.ndarray], level: Level, bundles: list[list[int]], nodes: int) -> np.ndarray:
    """Sums by feature, gradient or curvature, counted node and bin from those by bundle, counted node and cell."""
    sizes = level.by_column()
    out = np.zeros((len(sizes), 2, nodes, level.bins), np.int64)
    for bundle, own in zip(bundles, values, strict=True):
        cells = own.reshape(nodes, *[sizes[i] for i in bundle])
        for k, i in enumerate(bundle):
            found = cells.sum(axis=tuple(1 + j for j in range(len(bundle)) if j != k))
            # Whole numbers that doubles hold exactly.
            out[i, 0, :, : sizes[i]], out[i, 1, :, : sizes[i]] = found.real, found.imag
    return out.reshape(len(sizes), 2, -1)


def added(blocks: Iterable[Block], level: Level) -> dict[tuple[int, int], np.ndarray]:
    """Sums of some blocks by lane: (lane, 0) has those by feature, gradient or curvature, counted node and bin, (lane, -1) the counts of the watch."""
    nodes = {g.lane: len(level.counted[g.lane]) for g in level.growing if level.counted[g.lane]}
    places = {lane: level.places(lane) for lane in nodes}
    sizes, bundles = level.by_column(), level.bundles()
    cells = [math.prod(sizes[i] for i in bundle) for bundle in bundles]
    # Gradients and curvatures are added up as the two parts of one number.
    sums = {lane: [np.zeros(n * c, np.complex128) for c in cells] for lane, n in nodes.items()}
    watched = {g.lane: np.zeros((2, WATCH_RANGES), np.int64) for g in level.growing if g.watch}
    for b in blocks:
        chosen = np.concatenate([sampled(number, n, level.seed, level.share) for number, n in b.numbers]).take(b.order)
        columns = bundled(b.bins, level, bundles) if nodes else []
        for g in level.growing:
            (begin, end), weights, margin = b.spans[g.lane], b.weights[g.lane], b.margin[g.lane]
            if begin == end or g.lane not in nodes and not g.watch:
                continue
            bins, y, codes = b.lane_bins(g.lane), b.y[begin:end], b.codes[g.lane]
            for tree in g.pending:
                margin = margin + tree.value.take(tree.nodes(bins, level.max_depth))
            if g.watch:
                at = np.flatnonzero((weights == STOP).take(codes))
                place = np.minimum(WATCH_RANGES / (1.0 + np.exp(-margin[at])), WATCH_RANGES - 1).astype(np.int64)
                watched[g.lane] += np.stack([np.bincount(place, minlength=WATCH_RANGES), np.bincount(place, y[at], WATCH_RANGES).astype(np.int64)])
            if g.lane not in nodes:
                continue
            used = chosen[begin:end] & (weights > 0).take(codes)
            if level.depth:
                node = g.tree.nodes(bins, level.depth)
                used &= (places[g.lane] >= 0).take(node)
                rows = np.flatnonzero(used)
                place = places[g.lane].take(node.take(rows))
            else:
                rows, place = np.flatnonzero(used), None
            grad, curve = LOSSES[g.loss](margin.take(rows), y.take(rows).astype(np.float64))
            w = (weights * g.unit).take(codes.take(rows))
            both = np.empty(len(rows), np.complex128)
            both.real, both.imag = np.rint(grad * w), np.rint(curve * w)
            for own, column, n in zip(sums[g.lane], columns, cells, strict=True):
                at = column[begin:end].take(rows).astype(np.int64)
                if place is not None:
                    at += place * n
                np.add.at(own, at, both)
    found = {(lane, 0): unbundled(values, level, bundles, nodes[lane]) for lane, values in sums.items()}
    return found | {(lane, -1): values for lane, values in watched.items()}


def _average_precision(counts: np.ndarray) -> float:
    """From rows and positives by range of the score, ranges as one score each."""
    rows, hits = np.cumsum(counts[0][::-1]), np.cumsum(counts[1][::-1])
    return float((counts[1][::-1] * hits / np.maximum(rows, 1)).sum() / hits[-1]) if hits[-1] else 0.0


def whole_sums(values: np.ndarray, nodes: list[int], depth: int, above: np.ndarray | None) -> np.ndarray:
    """Sums of all nodes of a level from those of the counted ones: a node's sibling has what its parent has beyond it."""
    values = values.reshape(*values.shape[:2], len(nodes), -1)
    if above is None:
        return values
    out = np.zeros((*values.shape[:2], 1 << depth, values.shape[3]), np.int64)
    for i, node in enumerate(nodes):
        out[:, :, node] = values[:, :, i]
        out[:, :, node ^ 1] = above[:, :, node >> 1] - values[:, :, i]
    return out


def chosen_splits(sums: dict[tuple[int, int], np.ndarray], level: Level, whole: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple]:
    """The best split of each (lane, node) among the features of a level; node -1 has the watch.

    A split: lane, node, feature, bin, gain, sums of gradient and curvature on the left, and of all. ``whole`` holds the
    sums of all nodes of the level above by lane, and is left with those of this one.
    """
    best: dict[tuple[int, int], tuple] = {}
    for growing in level.growing:
        lane = growing.lane
        if growing.watch:
            best[lane, -1] = (lane, -1, -1, 0, _average_precision(sums[lane, -1]), 0.0, 0.0, 0.0, 0.0)
        if (lane, 0) not in sums:
            continue
        whole[lane] = whole_sums(sums[lane, 0], level.counted[lane], level.depth, whole[lane] if level.depth else None)
        # By feature, node and bin; a feature with fewer bins than others has nothing in the last ones, and no cut there.
        g, h = (whole[lane][:, i].astype(np.float64) / growing.unit for i in (0, 1))
        all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
        left_g, left_h = np.cumsum(g, 2), np.cumsum(h, 2)
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + LAMBDA) + right_g**2 / (right_h + LAMBDA) - all_g**2 / (all_h + LAMBDA)
        gain[(left_h < MIN_CURVATURE_SUM) | (right_h < MIN_CURVATURE_SUM)] = -1.0
        top = gain.max(2)
        feature = top.argmax(0)
        for node in np.flatnonzero(all_h[0, :, 0] > 0):
            f = feature[node]
            b = gain[f, node].argmax()
            found = (top[f, node], left_g[f, node, b], left_h[f, node, b], all_g[f, node, 0], all_h[f, node, 0])
            best[lane, int(node)] = (lane, int(node), int(level.columns[f]), int(b), *map(float, found))
    return best


def best_splits(blocks: RDD, level: Level, whole: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple]:
    """The same for all blocks, by one job.

    Where the sums of all parts are few (``DIRECT_BYTES``), they are added up on the driver, which spares a shuffle; else
    they are merged by key, in ``PIECES`` by lane, and come to the driver once.
    """
    parts = blocks.getNumPartitions()

    def summed(part: Iterable[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for (lane, kind), values in added(part, level).items():
            yield (lane, kind), values if kind else level.packed(values)

    total: dict[tuple[int, int], np.ndarray] = {}
    if parts * level.bytes() <= DIRECT_BYTES:
        for key, values in blocks.mapPartitions(summed).collect():
            total[key] = total[key] + values if key in total else values
    else:
        single = blocks.mapPartitions(summed).flatMap(lambda item: [((*item[0], i), values) for i, values in enumerate(np.array_split(item[1], PIECES, axis=-1))])
        pieces = dict(single.reduceByKey(add, min(parts, PIECES)).collect())
        total = {key: np.concatenate([pieces[*key, i] for i in range(PIECES)], axis=-1) for key in {k[:2] for k in pieces}}
    return chosen_splits({key: values if key[1] else level.unpacked(values) for key, values in total.items()}, level, whole)


# Files of blocks


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_arrays(uri: str, value: object) -> None:
    """Write an object with its arrays, so that they can be mapped; a repeated task replaces a file by equal bytes."""
    arrays: list[pickle.PickleBuffer] = []
    parts = [pickle.dumps(value, 5, buffer_callback=arrays.append), *(a.raw() for a in arrays)]
    system, path = _opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        sizes = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
        for part in (sizes, *parts):
            out.write(part)
            out.write(bytes(-len(part) % ALIGNED))
    try:
        system.move(draft, path)
    except OSError:
        # Some file systems don't replace what another attempt has written.
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(draft)


def read_arrays(uri: str) -> object:
    """What ``write_arrays`` wrote; on a mounted file system its arrays are views of the file."""
    system, path = _opened(uri)
    with pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path) as file:
        data = memoryview(file.read_buffer())
    sizes = np.frombuffer(data[: 8 * (1 + int(np.frombuffer(data[:8], np.int64)[0]))], np.int64)
    parts, at = [], 0
    for size in (8 * len(sizes), *sizes[1:].tolist()):
        parts.append(data[at : at + size])
        at += size + -size % ALIGNED
    return pickle.loads(parts[1], buffers=parts[2:])


class _Kept:
    """Blocks as files in the shared folder, and beside them the margins of the trees so far.

    Tasks map what they look at, so a level moves nothing but sums, and a lost executor costs nothing. Margins are
    written anew by the first level after a ``move``, on its way; those before go once that level is done.
    """

    def __init__(self, blocks: DataFrame, shape: Shape, parts: int, depth: int):
        self.spark, self.depth, self.stores = blocks.sparkSession, depth, 0
        self.path = path = scratch_path(self.spark, "blocks")

        def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = []
            for block in blocks_of((row for batch in batches for row in batch.to_pylist()), shape):
                # A name of its own for each attempt; the ones that count are those that a task ends with.
                names.append(uuid.uuid4().hex)
                block.margin = []
                write_arrays(f"{path}/{names[-1]}", block)
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], ["names"])

        found = [row["names"] for row in blocks.repartition(parts).mapInArrow(write, "names array<string>").collect()]
        self.names = [names for names in found if names]
        # Lanes that have margins, and where those are.
        self.lanes, self.at, self.old = list(range(shape.lanes)), None, []
        self.blocks = self._rows()

    def _rows(self, pending: dict[int, list[Tree]] | None = None, to: str | None = None) -> RDD:
        """The blocks with their margins, moved by some trees and written where asked."""
        path, depth, names, lanes, margins = self.path, self.depth, self.names, self.lanes, self.at

        def read(part: int, rows: Iterable[int]) -> Iterator[Block]:
            for name in names[part]:
                block = read_arrays(f"{path}/{name}")
                block.margin = [np.zeros(end - begin if margins is None else 0) for begin, end in block.spans]
                if margins is not None:
                    for lane, own in zip(lanes, read_arrays(f"{margins}/{name}"), strict=True):
                        block.margin[lane] = own
                if to is not None:
                    block = block.moved(pending, depth)
                    write_arrays(f"{to}/{name}", [block.margin[lane] for lane in sorted(pending)])
                yield block
            # Read last: a task needs not wait for it.
            list(rows)

        return self.spark.sparkContext.parallelize(range(len(names)), len(names)).mapPartitionsWithIndex(read)

    def move(self, pending: dict[int, list[Tree]]) -> None:
        """Add trees to the margins; lanes that have ended are not looked at any more."""
        self.stores += 1
        to = f"{self.path}/margins-{self.stores}"
        self.blocks = self._rows(pending, to)
        if self.at is not None:
            self.old.append(self.at)
        self.lanes, self.at = sorted(pending), to

    def splits(self, level: Level, whole: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple]:
        found = best_splits(self.blocks, level, whole)
        if level.depth == 0:
            self.blocks = self._rows()
            if len(self.old) >= CUT_STORES:
                for path in self.old:
                    drop_scratch(self.spark, path)
                self.old = []
        return found

    def close(self) -> None:
        drop_scratch(self.spark, self.path)


@dataclass(frozen=True)
class Settings:
    """What the rounds follow, beside the lanes' losses, units of their sums, and whether they have stop rows."""

    losses: tuple[str, ...]
    units: tuple[float, ...]
    has_stop: tuple[bool, ...]
    bins: tuple[int, ...]
    max_iter: int
    max_depth: int
    step_size: float
    share: float
    feature_share: float
    seed: int
    patience: int


def grown_rounds(s: Settings, splits: Callable[[Level, dict], dict], move: Callable[[dict[int, list[Tree]]], None], store_rounds: int) -> list[list[Tree]]:
    """Trees of each lane. ``splits`` finds the best splits of a level by the sums of the one above, ``move`` adds trees to the margins."""
    n = len(s.losses)
    done: dict[int, list[Tree]] = {i: [] for i in range(n)}
    pending: dict[int, list[Tree]] = {i: [] for i in range(n)}
    best = {i: (-1.0, 0) for i in range(n)}
    open_lanes = list(range(n))
    for at in range(s.max_iter + 1):
        # After the last round the stop rows are looked at once more; nothing grows.
        growing = {i: Growing(i, s.losses[i], s.units[i], pending[i], Tree.of_depth(s.max_depth), s.has_stop[i] and at > 0) for i in open_lanes}
        if at == s.max_iter:
            growing = {i: g for i, g in growing.items() if g.watch}
        if not growing:
            break
        rng = np.random.default_rng([s.seed, at])
        chosen = np.sort(rng.choice(len(s.bins), max(1, round(s.feature_share * len(s.bins))), replace=False))
        sizes, whole = tuple(s.bins[c] for c in chosen), {}
        # After the last round only the watch is asked for.
        counted = {i: [0] if at < s.max_iter else [] for i in growing}
        for depth in range(s.max_depth):
            found = splits(Level(list(growing.values()), depth, s.max_depth, chosen, max(s.bins), s.seed * 100_003 + at, s.share, counted, sizes), whole)
            for i in [i for i, g in growing.items() if g.watch]:
                score = found[i, -1][4] if (i, -1) in found else 0.0
                if score > best[i][0]:
                    best[i] = (score, at)
                if at - best[i][1] >= s.patience:
                    del growing[i]
                else:
                    growing[i].watch = False
            if at == s.max_iter:
                growing = {}
            counted = {i: [] for i in growing}
            for (i, node), (_, _, feature, cut, gain, left_g, left_h, all_g, all_h) in sorted(found.items()):
                if node < 0 or i not in growing:
                    continue
                tree, here = growing[i].tree, (1 << depth) - 1 + node
                if depth == 0:
                    tree.value[0] = -s.step_size * all_g / (all_h + LAMBDA)
                if gain > 0:
                    # Of the two children the lighter one.
                    counted[i].append(2 * node + int(left_h > all_h - left_h))
                    tree.feature[here], tree.cut[here], tree.gain[here] = feature, cut, gain
                    tree.value[2 * here + 1] = -s.step_size * left_g / (left_h + LAMBDA)
                    tree.value[2 * here + 2] = -s.step_size * (all_g - left_g) / (all_h - left_h + LAMBDA)
            if not any(counted.values()):
                break
        for i, g in growing.items():
            done[i].append(g.tree)
            pending[i].append(g.tree)
        open_lanes = list(growing)
        if open_lanes and len(pending[open_lanes[0]]) >= store_rounds and at + 1 < s.max_iter:
            move({i: pending[i] for i in open_lanes})
            pending = {i: [] for i in range(n)}
    return [done[i][: best[i][1]] if s.has_stop[i] and best[i][1] else done[i] for i in range(n)]


def _in_one_task(blocks: DataFrame, shape: Shape, settings: Settings) -> list[list[Tree]]:
    """All rounds where the blocks are; the trees come back in one row."""

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(blocks_of((row for batch in batches for row in batch.to_pylist()), shape))

        def move(pending: dict[int, list[Tree]]) -> None:
            kept[:] = [b.moved(pending, settings.max_depth) for b in kept]

        trees = grown_rounds(settings, lambda level, whole: chosen_splits(added(kept, level), level, whole), move, 1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])

    return pickle.loads(blocks.coalesce(1).mapInArrow(grow, "trees binary").first()["trees"])


def boost_lanes(
    df: DataFrame,
    features: list[str],
    lanes: dict[str, Lane],
    label: Column | None = None,
    maxIter: int = GBT_SETTINGS["maxIter"],
    maxDepth: int = GBT_SETTINGS["maxDepth"],
    stepSize: float = GBT_SETTINGS["stepSize"],
    subsamplingRate: float = GBT_SETTINGS["subsamplingRate"],
    featureShare: float = GBT_SETTINGS["featureShare"],
    seed: int = GBT_SETTINGS["seed"],
    patience: int = PATIENCE,
    at_hand: bool = False,
) -> dict[str, BoostedTrees]:
    """Train one model per lane, all on the rows of ``df`` and in the same jobs.

    A lane with stop rows ends after ``patience`` rounds without a better average precision on them, and keeps the trees
    up to its best round; the others run all rounds. Rows are looked at a few times and stored before, unless they are
    ``at_hand``: read from files as they are.
    """
    n, kinds = len(lanes), list(lanes.values())
    y = F.coalesce(label if label is not None else F.col("label"), F.lit(0)).cast("int")
    learnt = [F.coalesce(k.train, F.lit(False)) if k.train is not None else F.lit(True) for k in kinds]
    stops = [t & F.coalesce(k.stop, F.lit(False)) if k.stop is not None else F.lit(False) for t, k in zip(learnt, kinds, strict=True)]
    one = F.lit(1.0)
    weights = [F.when(t & ~s, F.coalesce((k.weight if k.weight is not None else one).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)) for t, s, k in zip(learnt, stops, kinds, strict=True)]
    columns = [f"f{i}" for i in range(len(features))]
    values = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(f) for c, f in zip(features, columns, strict=True)]
    rows = df.select(*values, y.alias("_y"), F.array(*weights).alias("_w"), F.array(*stops).alias("_s"))
    used = rows.filter(F.exists("_w", lambda w: w > 0) | F.exists("_s", lambda s: s))
    if not at_hand:
        used = stored(used, "rows")
    totals = used.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_w")[i]).alias(f"w{i}") for i in range(n)]).first()
    if not totals["n"] or not features:
        return {name: BoostedTrees(list(features)) for name in lanes}
    cuts = feature_cuts(used, columns)
    tasks = -(-totals["n"] // (TASK_BLOCKS * BLOCK_ROWS))
    units = tuple(2.0 ** (SUM_BITS - math.ceil(math.log2(max(totals[f"w{i}"] or 0.0, 1.0)))) for i in range(n))
    settings = Settings(
        tuple(k.loss for k in kinds), units, tuple(k.stop is not None for k in kinds), tuple(len(c) + 1 for c in cuts),
        maxIter, maxDepth, stepSize, subsamplingRate, featureShare, seed, patience,
    )
    shape, blocks = Shape(len(features), n), binned_blocks(used, columns, cuts, n, tasks)
    if tasks == 1:
        trees = _in_one_task(blocks, shape, settings)
    else:
        # As many parts as there are cores, a few where a part would be too long.
        cores = used.sparkSession.sparkContext.defaultParallelism
        parts = min(cores * -(-tasks // (PART_TASKS * cores)), -(-totals["n"] // BLOCK_ROWS))
        kept = _Kept(blocks, shape, parts, maxDepth)
        try:
            trees = grown_rounds(settings, kept.splits, kept.move, STORE_ROUNDS)
        finally:
            kept.close()
    return {name: BoostedTrees(list(features), [_valued(t, cuts) for t in own]) for name, own in zip(lanes, trees, strict=True)}


def _valued(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The tree with cut values in place of bin numbers."""
    cut = np.zeros(len(tree.cut))
    for node in np.flatnonzero(tree.feature >= 0):
        values = cuts[tree.feature[node]]
        cut[node] = values[int(tree.cut[node])] if int(tree.cut[node]) < len(values) else np.inf
    return Tree(tree.feature, cut, tree.value, tree.gain)
