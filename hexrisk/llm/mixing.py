"""Mix sources to target weights with exact quotas, by a multivariate-hypergeometric splitting tree.

Every source gets a target in words: its weight's share of the mix, at most ``cap`` times what it has; what is over goes
to the others by weight. Its documents are cut into blocks of words, and the blocks stand in a permuted order, one
permutation for each pass. The source gives its leading blocks until its target is reached exactly (the last block may
be cut). The numbers of blocks given are split among the output shards by a binary tree: each node draws how many of
each source's blocks go to its left half, from the multivariate hypergeometric distribution (conditional draws source
by source, by inversion). A shard then takes the next blocks of each source's permuted order, as many as its quota says,
so shards are disjoint and quotas exact, and orders them by a hash of its own.

Ranks and running sums over a source are made by bucket of the permutation's hash plus offsets of buckets, so a source
that holds a third of all rows is spread over many tasks. All draws come from hashes of a seed, so reruns agree.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source, last in order; rows with equal
ids are mixed each, equal rows share what they are taken; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexrisk.llm.files import stored, whole_row
from hexrisk.operators.joins import salted_join

#: Fixed values of the production mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
BLOCK_WORDS = 1024
#: Sizes of the work: blocks in a bucket of the permutation, blocks in a shard, ranks looked up together.
BUCKET = 2000
SHARD = 8192
CHUNK = 512
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that joins like ``source``, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source (``key``) with its size, weight and target, from rows with ``source`` and ``size``.

    With sources ordered by ``cap * size / weight``, let level i be what is left for sources i and later per weight when
    those before stop at their cap. The largest level is the one at which none is above its cap.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    level = sizes.withColumn("level", (total - before) / rest)
    target = F.least("most", F.greatest(F.max("level").over(Window.partitionBy()), F.lit(0.0)) * F.col("weight"))
    return level.select(source_key(F.col("source")).alias("key"), "source", "source_size", "weight", target.alias("target"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_factorial(n: Column) -> Column:
    """ln n! for n >= 0 by Stirling's series at n + 8, shifted back."""

    def of(x: Column) -> Column:
        shift = (x - 7) * (x - 6) * (x - 5) * (x - 4) * (x - 3) * (x - 2) * (x - 1)
        series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
        return series - F.log(shift)

    return let(n.cast("double") + 8, of)


def hypergeometric(total: Column, hits: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` are among ``hits``: inverse of the distribution function at ``u`` in [0, 1).

    Sums the probabilities upward from ten standard deviations below the mean; what lies below has less than 1e-20.
    """
    given = F.struct(total.alias("t"), hits.alias("h"), draws.alias("d"), u.alias("u"), (hits / F.greatest(total, F.lit(1))).alias("share"))

    def moments(g: Column) -> Column:
        spread = F.sqrt(F.greatest(g["d"] * g["share"] * (1 - g["share"]) * (g["t"] - g["d"]) / F.greatest(g["t"] - 1, F.lit(1)), F.lit(0.0)))
        return F.struct(g["t"].alias("t"), g["h"].alias("h"), g["d"].alias("d"), g["u"].alias("u"), (g["d"] * g["share"]).alias("mean"), (10 * spread + 5).alias("reach"))

    def limits(g: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), g["d"] - (g["t"] - g["h"]), F.floor(g["mean"] - g["reach"]).cast("long"))
        high = F.least(g["h"], g["d"], F.ceil(g["mean"] + g["reach"]).cast("long"))
        return F.struct(g["t"].alias("t"), g["h"].alias("h"), g["d"].alias("d"), g["u"].alias("u"), low.alias("low"), high.alias("high"))

    def drawn(g: Column) -> Column:
        choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        first = F.exp(choose(g["h"], g["low"]) + choose(g["t"] - g["h"], g["d"] - g["low"]) - choose(g["t"], g["d"]))
        start = F.struct(first.alias("p"), F.lit(0.0).alias("below"), g["low"].alias("x"))

        def step(acc: Column, k: Column) -> Column:
            following = acc["p"] * (g["h"] - k) * (g["d"] - k) / ((k + 1.0) * (g["t"] - g["h"] - g["d"] + k + 1))
            more = F.when(acc["below"] + acc["p"] <= g["u"], 1).otherwise(0)
            return F.struct(following.alias("p"), (acc["below"] + acc["p"]).alias("below"), (acc["x"] + more).cast("long").alias("x"))

        found = F.aggregate(F.sequence(g["low"], g["high"] - 1), start, step, lambda acc: acc["x"])
        return F.when(g["low"] >= g["high"], g["low"]).otherwise(F.least(found, g["high"]))

    return let(let(let(given, moments), limits), drawn)


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that depends on ``of`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def split_quotas(counts: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """Quota of each source (``key``, ``blocks``) in each of 2**depth shards; both halves of a node differ by one block at most.

    The root holds one entry per source; each level splits all nodes, and every fourth level deals the nodes out again.
    """
    entry = F.struct(F.col("key"), F.col("blocks").cast("long").alias("blocks"))
    nodes = counts.agg(F.array_sort(F.collect_list(entry)).alias("has")).select(F.lit(1).cast("long").alias("node"), "has")
    for level in range(depth):
        total = F.aggregate("has", F.lit(0).cast("long"), lambda a, s: a + s["blocks"])
        start = F.struct(
            total.alias("total"), F.floor(total / 2).cast("long").alias("draws"),
            F.array().cast("array<struct<key:string,blocks:bigint>>").alias("left"),
        )

        def draw(acc: Column, s: Column) -> Column:
            x = hypergeometric(acc["total"], s["blocks"], acc["draws"], uniform(F.lit(seed), F.col("node"), s["key"]))
            after = lambda n: F.struct(
                (acc["total"] - s["blocks"]).alias("total"), (acc["draws"] - n).alias("draws"),
                F.concat(acc["left"], F.array(F.struct(s["key"].alias("key"), n.alias("blocks")))).alias("left"),
            )
            return let(x, after)

        halves = nodes.withColumn("left", F.aggregate("has", start, draw, lambda acc: acc["left"]))
        right = F.zip_with("has", "left", lambda a, b: F.struct(a["key"].alias("key"), (a["blocks"] - b["blocks"]).alias("blocks")))
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("has")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("has")))
        nodes = halves.select(F.explode(pair).alias("n")).select("n.node", "n.has")
        if level % 4 == 3:  # a plan of all levels would be very long
            nodes = stored(nodes.repartition("node"), "nodes")
    leaf = nodes.select((F.col("node") - F.lit(1 << depth)).alias("shard"), F.explode("has").alias("e"))
    return leaf.select("shard", "e.key", F.col("e.blocks").alias("quota"))


def numbered(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Id, source, key and size of each row; ``copy`` tells equal rows apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    return rows.select("doc_id", "source", source_key(F.col("source")).alias("key"), "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def taken_blocks(rows: DataFrame, targets: DataFrame, block_words: int | None = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The blocks that each source gives, with their rank in the source's permuted order over all passes.

    Without ``block_words`` a document is one block and is never cut, so the target is met to within a document.
    """
    size, width = F.col("size"), F.lit(block_words).cast("long") if block_words else F.col("size")
    blocks = rows.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(size / width).cast("long") - 1)).alias("block"))
    blocks = blocks.withColumn("words", F.least(width, size - F.col("block") * width))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    per_source = blocks.groupBy("key").agg(F.count("*").alias("n_blocks")).join(
        targets.select("key", "source_size", wanted.alias("wanted")), "key"
    )
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("wanted") / F.col("source_size")).cast("long") - 1)
    placed = salted_join(blocks.drop("source"), per_source.filter("wanted > 0"), ["key"]).withColumn("pass", F.explode(passes))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "pass", "doc_id", "size", "block", "copy"), 1)
    buckets = F.ceil(F.col("n_blocks") / BUCKET)
    bucket = F.least(F.floor(F.col("order") / F.lit(float(1 << 63)) * buckets), buckets - 1).cast("long")
    placed = stored(placed.withColumn("order", order).withColumn("bucket", bucket), "placed")
    sums = placed.groupBy("key", "pass", "bucket").agg(F.sum("words").alias("bw"), F.count("*").alias("bn"))
    earlier = Window.partitionBy("key", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "key", "pass", "bucket", F.coalesce(F.sum("bw").over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("blocks_before"),
    )
    inside = Window.partitionBy("key", "pass", "bucket").orderBy("order", "doc_id", "size", "block", "copy")
    ranked = placed.withColumn("upto", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(inside))
    ranked = ranked.join(sums, ["key", "pass", "bucket"])
    room = F.col("wanted") - F.col("pass") * F.col("source_size") - F.col("words_before") - (F.col("upto") - F.col("words"))
    taken = F.least("words", room) if block_words else F.when(room * 2 >= F.col("words"), F.col("words")).otherwise(F.lit(0))
    ranked = ranked.withColumn("taken", taken.cast("long")).filter("taken > 0")
    rank = F.col("pass") * F.col("n_blocks") + F.col("blocks_before") + F.col("n") - 1
    return ranked.select("doc_id", "key", "size", "copy", "pass", "block", "taken", rank.alias("rank"))


def mix(rows: DataFrame, targets: DataFrame, block_words: int | None = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Every block of the mix with its shard and its place there; ``rows`` from ``numbered``."""
    taken = stored(taken_blocks(rows, targets, block_words, seed), "taken")
    counts = taken.groupBy("key").agg(F.count("*").alias("blocks"))
    total = counts.agg(F.sum("blocks")).first()[0] or 0
    depth = max(0, (-(-total // SHARD) - 1).bit_length())
    quotas = split_quotas(counts, depth, seed).filter("quota > 0")
    upto = F.sum("quota").over(Window.partitionBy("key").orderBy("shard"))
    spans = quotas.select("key", "shard", (upto - F.col("quota")).alias("begin"), upto.alias("end"))
    chunks = F.sequence(F.floor(F.col("begin") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))
    spans = spans.select("key", "shard", "begin", F.explode(chunks).alias("chunk"))
    looked_up = spans.groupBy("key", "chunk").agg(F.collect_list(F.struct("begin", "shard")).alias("spans"))
    dealt = taken.withColumn("chunk", F.floor(F.col("rank") / CHUNK)).join(looked_up, ["key", "chunk"])
    shard = F.array_max(F.filter("spans", lambda s: s["begin"] <= F.col("rank")))["shard"]
    dealt = dealt.select("doc_id", "key", "size", "copy", "pass", "block", "taken", shard.alias("shard"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "shard", "key", "pass", "doc_id", "size", "block", "copy"), "doc_id", "pass", "block", "copy")
    return dealt.withColumn("position", F.row_number().over(local))


def mixed_documents(docs: DataFrame, block_words: int | None = BLOCK_WORDS) -> DataFrame:
    """Per row: its size, its source's size and target, and how many of its words the mix takes."""
    rows = stored(numbered(docs), "numbered")
    targets = stored(source_targets(rows), "targets")
    words = mix(rows, targets, block_words).groupBy("doc_id", "key", "size", "copy").agg(F.sum("taken").alias("taken"))
    missing = F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")
    words = words.select(*missing, "key", "size", "copy", "taken")
    with_words = rows.select("*", *missing).join(words, ["id", "no_id", "key", "size", "copy"], "left")
    return salted_join(with_words, targets.drop("source"), ["key"]).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, whole documents at a time: each row as often as it is drawn."""
    rows = stored(numbered(docs), "numbered")
    ids = lambda df: df.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    same = ["_id", "_none", "_key", "_size"]
    drawn = mix(rows, source_targets(rows), None).groupBy("doc_id", "key", "size").agg(F.count("*").alias("_uses"))
    drawn = ids(drawn.withColumnsRenamed({"key": "_key", "size": "_size"})).drop("doc_id")
    keyed = docs.select(whole_row(docs), "doc_id", "text", source_key(F.col("source")).alias("_key"), n_words(F.col("text")).alias("_size"))
    keyed = ids(keyed).join(drawn, same)
    # Rows that are equal but for their text share the draws; the window works on the join's own partitions.
    among = Window.partitionBy(*same)
    place = F.row_number().over(among.orderBy(F.xxhash64("text")))
    n = F.count("*").over(among)
    times = F.floor(F.col("_uses") / n) + (place <= F.col("_uses") % n).cast("long")
    return keyed.withColumn("_times", times).filter("_times > 0").select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("whole.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
