"""Join documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, by signature trees.

1. A first pass counts how common n-grams are, in a table of fixed size. A second one turns each document into its set's
   size, a fingerprint of the set, a token bitmap four to eight times as wide as the set, and a prefix: its rarest
   n-grams, so many that any two linked documents share one (prefix filter, exact for any order of n-grams).
2. Documents with equal sets become one. Documents that share a prefix n-gram form a bucket. Some rows of each bucket
   (centres) are compared with all others; links found are merged into components. A bucket answers for pairs whose rarest common
   n-gram may be its own: they share no more n-grams than come from there on in either (positional filter, exact).
3. Buckets that still hold several components are cut into ranges of sizes that may link. Where few documents are left,
   those without a partner there are dropped; of parts with equal documents one stays. In each a signature tree is built:
   nodes hold the OR of their documents' bitmaps, the range of sizes, and their component if there is one. Two nodes are
   walked down together unless their sizes can't fit, the largest overlap that the bitmaps allow is too small, or both lie
   in one component. Large parts are dealt out as pairs of blocks, each a task's work.
4. Pairs that the bitmaps let pass are verified on the full sets; links are merged into the final components.

No link between different sets is lost: buckets have no cap, and pairs are left out only inside one component or where
a bound rules them out. N-grams are compared by 64-bit hashes.

Defined results: null texts and texts without a word have an empty set, no links and themselves as component; with fewer
words than n the whole sequence is the only n-gram; documents with equal sets are linked; equal ids are one document's
id in several rows, each of which is returned; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.components import components
from hexrisk.llm.dedup import located
from hexrisk.llm.files import stored
from hexrisk.llm.text import LOWER, bytes_of, mixed, plain_strings, slices, span_hashes, word_bounds

SLOTS = 1 << 17
CENTRES = 2
#: Hash slots of the filter that keeps texts out of a shuffle; with far more documents in question it lets all pass.
NEEDED_SLOTS = 1 << 20
#: Documents of a bucket that one task compares with each other; larger buckets become pairs of blocks.
BLOCK = 4096
#: Up to so many documents of a bucket's part are compared by sizes and places before bitmaps are sent to them.
FEW = 64
LEAF, FAN = 8, 4
PAIRS = 200_000
_STEPS = mixed(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Documents link when ``100 * intersection >= percent * union`` of their sets of ``n`` words in a row."""

    n: int = 5
    percent: int = 80

    def fits(self, small, large):
        """Whether sizes allow a link."""
        return 100 * small >= self.percent * large

    def enough(self, overlap, sizes):
        """Whether an overlap is enough for two sets of ``sizes`` together."""
        return (100 + self.percent) * overlap >= self.percent * sizes

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """How many of a set's n-grams are enough to share one with any linked set."""
        return size + (-self.percent * size) // 100 + 1

    def band(self, size: Column) -> Column:
        """Number of a range of sizes; sizes that fit are in the same range or in neighbouring ones."""
        return F.floor(F.log(size) / F.lit(max(math.log(100 / self.percent), 0.01) * (1 + 1e-9))).cast("int")


def grams(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every n-gram (with repeats) of a block of texts."""
    raw = LOWER[raw]
    begin, end = word_bounds(raw, at)
    words = span_hashes(raw, begin, end)
    first = np.searchsorted(begin, at)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first[1:], count) - np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        h[: len(words) - k] += words[k:] * _STEPS[k] * (left[: len(words) - k] > k).astype(np.uint64)
    # A whole n-gram at each place that has n words left, and the first place of a shorter text.
    whole = (left >= n) | ((count[doc] < n) & (np.arange(len(words)) == first[doc]))
    return mixed(h[whole] + np.minimum(left[whole], n).astype(np.uint64)), doc[whole]


def distinct_grams(h: np.ndarray, doc: np.ndarray, n_docs: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by document, in order of ``rank`` of their slot if given, and where each document's begin."""
    order = np.lexsort((h, doc) if rank is None else (h, rank[(h % np.uint64(SLOTS)).astype(np.int64)], doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def blocks_of(batches: Iterable[pa.RecordBatch], n: int):
    """Slices of batches with their n-grams: batch, begin, end, hashes, documents."""
    for batch in batches:
        texts = plain_strings(batch.column("text"))
        for begin, end in slices(texts):
            yield batch, begin, end, *grams(*bytes_of(texts.slice(begin, end - begin)), n)


def commonness(docs: DataFrame, n: int) -> np.ndarray:
    """How many n-grams of all documents fall on each of a fixed number of slots. Only the order of prefixes hangs on it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, _, _, h, _ in blocks_of(batches, n):
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    found = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for slot, n_found in found:  # SLOTS rows at most
        out[slot] = n_found
    return out


def bitmap(h: np.ndarray) -> bytes:
    width = max(64, 1 << int(4 * len(h) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(h % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def profiles(docs: DataFrame, rule: Rule, rank: np.ndarray) -> DataFrame:
    """Per document: its other columns, size of its set, fingerprint of the set (fa, fb), bitmap, prefix."""
    others = [c for c in docs.columns if c != "text"]

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin, end, h, doc in blocks_of(batches, rule.n):
            h, at = distinct_grams(h, doc, end - begin, rank)
            size = np.diff(at)
            total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D))]), axis=1)], axis=1)
            fa, fb = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
            take = np.where(size > 0, rule.prefix(size), 0)
            sets = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            flat = np.concatenate([np.zeros(0, np.uint64), *(s[:k] for s, k in zip(sets, take.tolist(), strict=True))]).view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(flat))
            bits = pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(begin, end - begin) for c in others), pa.array(size), pa.array(fa), pa.array(fb), bits, prefix],
                [*others, "size", "fa", "fb", "bits", "prefix"],
            )

    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(profile, f"{kinds}, size long, fa long, fb long, bits binary, prefix array<long>")


def full_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: size, fingerprint and the whole set."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, begin, end, h, doc in blocks_of(batches, rule.n):
            h, at = distinct_grams(h, doc, end - begin)
            total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D))]), axis=1)], axis=1)
            fa, fb = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
            grams_of = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(fa), pa.array(fb), grams_of], ["size", "fa", "fb", "grams"])

    return docs.select("text").mapInArrow(sets, "size long, fa long, fb long, grams array<long>")


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as 64-bit words, ORed down to ``width`` bits."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 64), axis=0)


def may_link(rule: Rule, sizes_a, sizes_b, shared, slack) -> np.ndarray:
    """Whether a link is possible when bitmaps share so many bits and collisions hide ``slack`` n-grams at most."""
    return rule.enough(shared + slack, sizes_a + sizes_b) & rule.fits(np.minimum(sizes_a, sizes_b), np.maximum(sizes_a, sizes_b))


def passing(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs with sizes and bitmaps (a, b, size_a, size_b, bits_a, bits_b), those that may link."""

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (np.asarray(batch.column(c)) for c in ("size_a", "size_b"))
            ok = np.zeros(len(size_a), bool)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                width = 8 * min(len(x), len(y))
                p, q = folded(x, width), folded(y, width)
                slack = min(size_a[i] - np.bitwise_count(p).sum(dtype=np.int64), size_b[i] - np.bitwise_count(q).sum(dtype=np.int64))
                ok[i] = may_link(rule, size_a[i], size_b[i], np.bitwise_count(p & q).sum(dtype=np.int64), slack)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return pairs.mapInArrow(test, "a long, b long")


class Tree:
    """A signature tree over documents of one bitmap width; level 0 has the documents, in the given order."""

    def __init__(self, size: np.ndarray, component: np.ndarray, bits: np.ndarray):
        slack = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(size, size, component, bits, slack)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, comp, bits, slack = self.levels[-1]
            at = np.arange(0, len(low), fan)
            lo, hi = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(lo == hi, lo, -1), np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(slack, at)))
            fan = FAN

    def pairs(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents of different components that may link, by walking pairs of nodes down from the root."""
        work = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, i, j = work.pop()
            low, high, comp, bits, slack = self.levels[level]
            ok = (comp[i] != comp[j]) | (comp[i] < 0)
            ok &= rule.fits(high[i], low[j]) & rule.fits(high[j], low[i])
            i, j = i[ok], j[ok]
            shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            ok = rule.enough(shared + np.minimum(slack[i], slack[j]), low[i] + low[j])
            i, j = i[ok], j[ok]
            if level == 0:
                yield i[i != j], j[i != j]
                continue
            fan, n = (LEAF if level == 1 else FAN), len(self.levels[level - 1][0])
            step = max(1, PAIRS // (fan * fan))
            for k in range(0, len(i), step):
                a = (i[k : k + step, None, None] * fan + np.arange(fan)[:, None]).repeat(fan, axis=2).ravel()
                b = (j[k : k + step, None, None] * fan + np.arange(fan)).repeat(fan, axis=1).ravel()
                real = (a < n) & (b < n) & (a <= b)
                work.append((level - 1, a[real], b[real]))


def tree_pairs(rule: Rule, row: np.ndarray, size: np.ndarray, component: np.ndarray, bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that may link; trees by bitmap width, wider bitmaps folded where a narrower one may fit."""
    width = np.array([8 * len(b) for b in bits])
    _, number, n = np.unique(component, return_inverse=True, return_counts=True)
    many = n[number] > LEAF
    for w in np.unique(width):
        own = width == w
        reach = size[own].max() * 100 // rule.percent
        member = np.flatnonzero(own | ((width == 2 * w) & (size <= reach)))
        order = member[np.lexsort((size[member], np.where(many[member], component[member], -1)))]
        tree = Tree(size[order], component[order], np.stack([folded(bits[k], int(w)) for k in order]))
        for i, j in tree.pairs(rule):
            a, b = order[i], order[j]
            keep = own[a] | own[b]
            yield row[a[keep]], row[b[keep]]


def mixed_cells(labelled: DataFrame, rule: Rule) -> DataFrame:
    """Parts of buckets to be searched for links between components: cell, row, size, component.

    ``labelled`` has gram, row, size, component and ``most``, the n-grams of the row's set from this one on.
    """
    key = ["gram", "band"]
    band = rule.band(F.col("size"))
    banded = labelled.withColumn("band", F.explode(F.array(band - 1, band)))
    several = banded.groupBy(*key).agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    members = banded.join(several.select(*key, "n"), key)
    few = members.filter(F.col("n") <= FEW)
    other = few.select(*[F.col(c).alias(f"{c}_o") for c in (*key, "size", "most", "component")])
    partner = (F.col("gram") == F.col("gram_o")) & (F.col("band") == F.col("band_o")) & (F.col("component") != F.col("component_o"))
    partner &= rule.enough(F.least("most", "most_o"), F.col("size") + F.col("size_o"))
    kept = few.join(other, partner, "left_semi").unionByName(members.filter(F.col("n") > FEW))
    kept = stored(kept.select(*key, "row", "size", "component"), "kept")
    # Passages that documents share bring them together once for each n-gram; one of the equal parts is enough.
    alike = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"x{k}") for k in range(2)]
    parts = kept.groupBy(*key).agg(F.count("*").alias("n"), *alike)
    parts = parts.groupBy("n", "x0", "x1").agg(F.min(F.struct(*key)).alias("part")).select("part.*", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    cells = kept.join(parts, key).withColumn("blocks", blocks).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.concat_ws(":", F.col("gram").cast("string"), F.col("band").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    return cells.select(cell.alias("cell"), "row", "size", "component")


def residual_pairs(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs from buckets dealt out by ``cell``; ``members`` has cell, row, size, component, bits, sorted by cell in each task."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            _, row, size, component, bits = zip(*rows, strict=True)
            for a, b in tree_pairs(rule, np.array(row), np.array(size), np.array(component), list(bits)):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        open_cell: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "row", "size", "component", "bits")), strict=True):
                if open_cell and r[0] != open_cell[0][0]:
                    yield from finish(open_cell)
                    open_cell = []
                open_cell.append(r)
        yield from finish(open_cell)

    return members.mapInArrow(walk, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that link by their full sets, which are made anew for the documents in question only."""
    needed = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = stored(rows.select("row", "doc_id", "size", "fa", "fb").join(needed, "row"), "wanted")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_SLOTS))
    slots = F.broadcast(wanted.select(slot.alias("slot")).distinct())  # NEEDED_SLOTS rows at most
    texts = docs.select("doc_id", "text", slot.alias("slot")).join(slots, "slot", "left_semi").drop("slot")
    texts = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(texts.filter("doc_id is null"))
    sets = full_sets(texts, rule).join(wanted, ["size", "fa", "fb"]).groupBy("row").agg(F.first("grams").alias("grams"), F.first("size").alias("size"))
    sets = stored(sets, "sets")
    x, y = (sets.select(F.col("row").alias(s), F.col("grams").alias(f"grams_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("overlap", F.size(F.array_intersect("grams_a", "grams_b")).cast("long"))
    return stored(both.filter(rule.enough(F.col("overlap"), F.col("size_a") + F.col("size_b"))).select("a", "b"), "verified")


def joined(docs: DataFrame, rule: Rule, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Columns in ``also`` are passed on, and with them ``component``, a number of the component.
    """
    docs = docs.select("doc_id", "text", *also)
    spark = docs.sparkSession
    rank = commonness(docs, rule.n)
    rows = stored(profiles(docs, rule, rank).withColumn("row", F.monotonically_increasing_id()), "profiles")
    same = rows.filter("size > 0").groupBy("size", "fa", "fb").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    same = stored(same, "same")
    reps = rows.join(same.select(F.col("rep").alias("row")), "row", "left_semi")
    postings = reps.select("row", "size", F.posexplode("prefix").alias("place", "gram"))
    # A pair whose rarest common n-gram this is shares no more than what comes from here on.
    postings = postings.select("row", "size", (F.col("size") - F.col("place")).alias("most"), "gram")
    shared = postings.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(postings.join(shared, "gram"), "buckets")
    # Of a group of edited copies, the one nearest to what all have in common shares its n-grams with most; it is the first
    # centre, and the others are chosen by hash.
    weight = buckets.groupBy("row").agg(F.sum("n").alias("weight"))
    order = [F.struct(-F.col("weight"), "row"), *[F.xxhash64(F.lit(k), "row") for k in range(1, CENTRES)]]
    centres = buckets.join(weight, "row").groupBy("gram").agg(*[F.min_by(F.struct("row", "size", "most"), o).alias(f"c{k}") for k, o in enumerate(order)])
    buckets = stored(buckets.join(centres, "gram"), "centred")
    meta = rows.select("row", "size", "bits")

    stars = buckets.select("row", "size", "most", F.explode(F.array_distinct(F.array(*[F.col(f"c{k}") for k in range(CENTRES)]))).alias("c"))
    stars = stars.filter(F.col("row") != F.col("c.row")).filter(rule.enough(F.least("most", "c.most"), F.col("size") + F.col("c.size")))
    stars = stars.select(F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b")).distinct()
    x, y = (meta.select(F.col("row").alias(s), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    likely = stored(passing(stars.join(x, "a").join(y, "b"), rule), "likely")
    first = verified(likely, docs, rows, rule)
    part = stored(components(first), "part")

    # Buckets that still hold several components, without rows whose every pair there is settled (a centre's pairs are).
    labelled = buckets.join(part, "row", "left").withColumn("component", F.coalesce("component", "row"))
    labelled = labelled.filter(" and ".join(f"row <> c{k}.row" for k in range(CENTRES))).select("gram", "row", "size", "most", "component")
    labelled = stored(labelled, "labelled")
    cells = mixed_cells(labelled, rule).join(meta.select("row", "bits"), "row")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(tasks, "cell").sortWithinPartitions("cell")
    rest = stored(residual_pairs(dealt.select("cell", "row", "size", "component", "bits"), rule).distinct().join(likely, ["a", "b"], "left_anti"), "rest")
    second = verified(rest, docs, rows, rule) if not rest.isEmpty() else rest
    final = components(first.unionByName(second))

    tied = rows.join(same, ["size", "fa", "fb"], "left").withColumn("rep", F.coalesce("rep", "row"))
    tied = tied.select("doc_id", "size", "rep", *also).join(final.select(F.col("row").alias("rep"), "component"), "rep", "left")
    tied = stored(tied.select("doc_id", "size", F.coalesce("component", "rep").alias("component"), *also), "tied")
    least = tied.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return tied.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id", *also, *(["component"] if also else []))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one row of each group of linked ones: that with the smallest id, null last."""
    rows = located(docs, "doc_id", "text")
    groups = stored(joined(rows, rule, ("locator",)), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "locator")).alias("first")
    kept = groups.groupBy("component").agg(first, F.count("*").alias("n")).filter("n > 1").select("component", F.col("first.locator").alias("kept"))
    dropped = groups.join(kept, "component").filter("locator <> kept").select("locator")
    return rows.join(dropped, "locator", "left_anti").select("whole.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rule(3, 90))


ORACLE = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
    select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as grams from w
), g as (
    select doc_id, len(grams) as n, unnest(grams) as gram from s
), links as (
    select a.doc_id as x, b.doc_id as y from g as a join g as b on a.gram = b.gram and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach as (
    select doc_id, doc_id as other from documents
    union select r.doc_id, l.y from reach as r join links as l on l.x = r.other
)
select s.doc_id, cast(len(grams) as bigint) as n_shingles, c.component_id
from s join (select doc_id, min(other) as component_id from reach group by doc_id) as c using (doc_id)
"""
