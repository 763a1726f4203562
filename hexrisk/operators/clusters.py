"""Contiguous groups of cells of one tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hexrisk.functions.grid import cell_center, cell_id, cell_neighbors, pack_cell, unpack_cell, with_axes
from hexrisk.functions.numbers import stored_mean
from hexrisk.functions.risk import split_triggers
from hexrisk.operators.joins import salted_join
from hexrisk.session import cut_lineage

SEED_CLUSTER_CELLS = 30


def _runs(cells: DataFrame) -> DataFrame:
    """Add ``run``: the packed first cell of the unbroken same-tier stretch along a grid row that a cell lies in."""
    line = Window.partitionBy("strategic_tier", "r").orderBy("q")
    gaps = cells.withColumn("_island", F.col("q") - F.row_number().over(line))
    stretch = Window.partitionBy("strategic_tier", "r", "_island")
    return gaps.withColumn("run", pack_cell(F.min("q").over(stretch), F.col("r"))).drop("_island")


def _run_links(cells: DataFrame) -> DataFrame:
    """Pairs of runs of one tier that touch across neighbouring grid rows, in both directions."""
    up = F.array(F.col("q"), F.col("q") - 1)
    lower = cells.select(F.explode(up).alias("q"), (F.col("r") + 1).alias("r"), "strategic_tier", F.col("run").alias("a"))
    upper = cells.select("q", "r", "strategic_tier", F.col("run").alias("b"))
    pairs = lower.join(upper, ["q", "r", "strategic_tier"]).select("a", "b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node id reachable from every node: columns ``node``, ``root``.

    Each round, a node looks at its neighbours' roots, hands the smallest to itself and to its current root, and jumps to
    the root of its root, so the number of rounds grows with the logarithm of a group's extent. Only minima per
    node are grouped; the one join on root ids, which many nodes share, is salted.
    """
    links = cut_lineage(links)
    state = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    before = None
    while True:
        # Sum of all roots: it falls with every change, so an unchanged sum means done.
        total = state.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return state
        before = total
        jump = salted_join(state, state.select(F.col("node").alias("root"), F.col("root").alias("up")), ["root"])
        seen = links.join(jump.select(F.col("node").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("low"))
        known = jump.join(seen.withColumnRenamed("a", "node"), "node", "left")
        low = F.least("up", F.coalesce("low", "up"))
        offers = known.select("node", low.alias("root")).unionByName(
            known.filter("low is not null").select(F.col("root").alias("node"), F.col("low").alias("root"))
        )
        state = cut_lineage(offers.groupBy("node").agg(F.min("root").alias("root")))


def tier_clusters(scores: DataFrame) -> DataFrame:
    """Add ``cluster_id``, the first cell (by ``q``, then ``r``) of the contiguous same-tier group of a cell.

    Cells are first joined to stretches along grid rows, which leaves far fewer nodes and links to iterate on.
    """
    cells = cut_lineage(_runs(with_axes(scores)))
    groups = connected_groups(cells.select(F.col("run").alias("node")).distinct(), _run_links(cells))
    rooted = salted_join(cells, groups.withColumnRenamed("node", "run"), ["run"])
    q, r = unpack_cell(F.col("root"))
    return rooted.withColumn("cluster_id", cell_id(q, r)).drop("run", "root")


def seed_cluster(seeds: DataFrame, scores: DataFrame, cap: int = SEED_CLUSTER_CELLS) -> DataFrame:
    """Same-tier cells around each seed, nearest hops first, at most ``cap``; order inside a hop is ``(q, r)``.

    ``seeds`` has ``cell``. A seed without a score is its own cluster. All seeds advance together, one hop per round,
    and a seed stops when its cluster is full or has no further neighbour.
    """
    cells = cut_lineage(with_axes(scores).select("q", "r", "strategic_tier"))
    starts = with_axes(seeds.select("cell").distinct()).withColumnRenamed("cell", "seed")
    found = cut_lineage(
        starts.join(cells, ["q", "r"], "left").select("seed", "q", "r", "strategic_tier", F.lit(0).alias("hop"))
    )
    edge = found.filter("strategic_tier is not null")
    within = Window.partitionBy("seed").orderBy("hop", "q", "r")
    hop = 0
    while not edge.isEmpty():
        hop += 1
        around = edge.select("seed", "strategic_tier", F.explode(cell_neighbors(F.col("q"), F.col("r"))).alias("n"))
        reached = around.select("seed", "strategic_tier", "n.q", "n.r").distinct()
        fresh = reached.join(found, ["seed", "q", "r"], "left_anti")
        matching = salted_join(fresh, cells, ["q", "r", "strategic_tier"], "left_semi")
        grown = found.unionByName(matching.select("seed", "q", "r", "strategic_tier", F.lit(hop).alias("hop")))
        ranked = grown.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= cap)
        found = cut_lineage(ranked)
        full = found.filter(F.col("rank") == cap).select("seed")
        edge = found.filter(F.col("hop") == hop).join(full, "seed", "left_anti")
        found = found.drop("rank")
    ordered = found.withColumn("rank", F.row_number().over(within))
    return ordered.select("seed", cell_id(F.col("q"), F.col("r")).alias("cell"), "strategic_tier", "hop", "rank")


def cluster_triggers(clustered: DataFrame, k: int | None = None, key: str = "cluster_id") -> DataFrame:
    """Distinct signals of a cluster by text, as an array: all of them, or the first ``k``.

    Signals are made distinct, and cut to ``k``, per task before they meet.
    """
    signals = clustered.select(key, F.explode(split_triggers(F.col("tactical_triggers"))).alias("t")).distinct()
    first = signals
    if k is not None:
        first = signals.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("t"))).filter(F.col("_i") <= k)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("triggers"))


def cluster_summary(clustered: DataFrame, key: str = "cluster_id", k: int | None = None) -> DataFrame:
    """Size, tier, scores and signals (all, or the first ``k``) of every cluster."""
    numbers = clustered.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"),
        F.max("strategic_tier").alias("strategic_tier"),
        stored_mean(F.coalesce("strategic_score", F.lit(0.0)), 4).alias("avg_strategic_score"),
        F.max(F.coalesce("strategic_score", F.lit(0.0))).alias("max_strategic_score"),
        stored_mean(F.coalesce("tactical_score", F.lit(0.0)), 3).alias("avg_tactical_score"),
    )
    joined = numbers.join(cluster_triggers(clustered, k, key), key, "left")
    return joined.withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))


def cluster_center(clustered: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean of the centres of a cluster's cells."""
    lat, lng = cell_center(F.col("q"), F.col("r"))
    return with_axes(clustered).groupBy(key).agg(F.avg(lat).alias("center_lat"), F.avg(lng).alias("center_lng"))
