"""Document fingerprints by a randomised edit embedding, and near copies by bands of them.

A walk reads a text character by character: at every step it notes the character it stands on, and a random bit shared by
all texts, chosen by the step and the character, says whether it goes on to the next one. Texts that differ by few edits
walk apart at an edit, but meet again soon after, and then stay together; so edit distance becomes Hamming distance of
what the walks note. A fingerprint samples ``SLOTS`` steps of the whole walk, four bits for the character noted at each.
The step of a slot is drawn uniformly from the walk's length in such a way that walks of lengths m < n have the same one
with probability m / n: it is the last of a shared list of records that lies within the walk. Likeness of two
fingerprints is the share of equal slots, less what chance equality of four bits gives, from 0 to 1.

Near copies: slots are dealt to bands of ``BAND`` slots; documents that agree in a whole band are candidates, and those
whose likeness is large enough are linked (verification on all slots). Documents with equal fingerprints become one
first. Large buckets are dealt out as pairs of blocks; a task compares a pair of blocks with each other and returns as many
links as tie together what belongs together, not all pairs. Bands find a pair of likeness 0.8 with a probability of 0.997.

``neighbour_fingerprints`` also compares each document with its successor in the order of ids, and with a text edited by
it. One shuffle deals the texts out by ranges of (id, hash of the text, row), so one id in very many rows is split too. The
last text of each range needs the first of the next; these few (two rows a range) are worked on in a second step.

Defined results: a null text is empty; the empty text has a fingerprint of its own, and so do short texts, whose steps are
sampled more than once; equal texts have equal fingerprints; rows with equal ids are treated each, in the order of their
texts' hashes; null ids come first; one document alone is its own successor; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexrisk.llm.components import components
from hexrisk.llm.files import range_tasks, stored
from hexrisk.llm.periodic import ranges
from hexrisk.llm.text import bytes_of, mixed, plain_strings, slices

SLOTS, BAND = 256, 8
#: Shared bits repeat after so many steps; characters are told apart by a hash into so many classes.
STEPS, CLASSES = 4096, 256
BLOCK_BYTES = 6_000_000
#: Documents of a bucket that one task compares with as many others.
BLOCK = 1024
_rng = np.random.default_rng(20240203)


def _waits() -> np.ndarray:
    """Steps that a walk stays on a character of each class, by the step at which it comes there."""
    bits = _rng.integers(0, 2, (STEPS, CLASSES)).astype(bool)
    bits[-1] = True
    out = np.empty((2 * STEPS, CLASSES), np.uint8)
    wait = np.zeros(CLASSES, np.uint8)
    for step in reversed(range(2 * STEPS)):
        wait = np.where(bits[step % STEPS], 1, wait + 1).astype(np.uint8)
        out[step] = wait
    return out[:STEPS].ravel()


def _records(limit: int = 1 << 60) -> np.ndarray:
    """For each slot steps of new records: a walk's step is the last one below its length, which is uniform in it."""
    rows = []
    for _ in range(SLOTS):
        row = [0]
        while row[-1] < limit:
            row.append(min(limit, int((row[-1] + 1) / (1 - _rng.random()))))
        rows.append(row)
    return np.array([r + [limit] * (max(map(len, rows)) - len(r)) for r in rows])


WAITS, RECORDS = _waits(), _records()
#: Four bits for each slot and class of characters; the last class stands for the empty text.
NIBBLES = _rng.integers(0, 16, (SLOTS, CLASSES + 1)).astype(np.uint8)


def classes_of(raw: np.ndarray) -> np.ndarray:
    """Class of every character of UTF-8 bytes."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return (mixed(points.astype(np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)


def walked(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step at which each character is reached, and the length of each text's walk; all texts walk side by side."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    place, step = first[:-1][order].copy(), np.zeros(len(order), np.int64)
    reached = np.zeros(len(classes), np.int64)
    falling = -size[order]
    # Between two lengths the same texts are on their way.
    done = 0
    for length in np.unique(size[size > 0]):
        n = int(np.searchsorted(falling, -length, side="right"))
        at, now = place[:n], step[:n]
        for _ in range(int(length) - done):
            reached[at] = now
            now += WAITS[((now & (STEPS - 1)) << 8) | classes[at]]
            at += 1
        done = int(length)
    total = np.zeros(len(size), np.int64)
    total[order] = step
    return reached, total


def sampled(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slots of each text's fingerprint, a number of four bits each; ``first`` has the first character of each text and the end."""
    reached, total = walked(classes, first)
    before = np.cumsum(total) - total
    reached += np.repeat(before, np.diff(first))
    slots = np.empty((len(total), SLOTS), np.uint8)
    full = total > 0
    slots[~full] = NIBBLES[:, CLASSES]
    for s in range(SLOTS):
        step = RECORDS[s][np.searchsorted(RECORDS[s], total[full], side="left") - 1]
        noted = classes[np.searchsorted(reached, step + before[full], side="right") - 1]
        slots[full, s] = NIBBLES[s][noted]
    return slots


def packed(slots: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in slots[:, 0::2] << 4 | slots[:, 1::2]]


def unpacked(fingerprints: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(fingerprints), np.uint8).reshape(len(fingerprints), SLOTS // 2)
    return np.stack([data >> 4, data & 15], axis=2).reshape(len(fingerprints), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots (last axis) beyond chance equality of four bits."""
    return np.maximum((16 * (a == b).mean(-1) - 1) / 15, 0.0)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (binary) of every text, without a shuffle."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_strings(batch.column("text"))
            for low, high in slices(texts, 2 * BLOCK_BYTES):
                raw, at = bytes_of(texts.slice(low, high - low))
                begins = np.flatnonzero((raw & 0xC0) != 0x80)
                found = packed(sampled(classes_of(raw), np.searchsorted(begins, at)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, "doc_id long, fingerprint binary")


# Near copies


def spanning(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie together what all links between places 0 to ``size`` do, no more than needed."""
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def links(found: DataFrame, least: float) -> DataFrame:
    """Verified links ``a``, ``b`` between distinct fingerprints (columns ``number``, ``fingerprint``) that agree in a band."""
    width = BAND // 2
    bands = F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda b: F.struct(b.alias("band"), F.substring("fingerprint", b * width + 1, F.lit(width)).alias("key")))
    posted = found.select("number", F.explode(bands).alias("b")).select("number", "b.band", "b.key")
    shared = posted.groupBy("band", "key").count().filter("count > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    members = posted.join(shared, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("number", "band"), "blocks").cast("int"))
    # A block meets itself and all others: each pair of blocks is one group.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    members = members.withColumn("cell", F.explode(meets)).select("number", "band", "key", "block", "cell.low", "cell.high")
    members = members.join(found, "number")

    def compare(group):
        import pandas as pd

        left, right = group[group.block == group.low.iloc[0]], group[group.block == group.high.iloc[0]]
        both = pd.concat([left, right]) if group.low.iloc[0] != group.high.iloc[0] else left
        x, y = unpacked(list(left.fingerprint)), unpacked(list(right.fingerprint))
        shift = len(left) if len(both) > len(left) else 0
        a, b = [], []
        for begin in range(0, len(x), 64):
            i, j = np.nonzero(likeness(x[begin : begin + 64, None], y[None]) >= least)
            a.append(i + begin)
            b.append(j + shift)
        kept = spanning(len(both), np.concatenate(a), np.concatenate(b))
        numbers = both.number.to_numpy()
        return pd.DataFrame({"a": numbers[[p for p, _ in kept]], "b": numbers[[q for _, q in kept]]}, dtype="int64")

    return members.groupBy("band", "key", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``fingerprint`` and ``component_id``, the smallest id of those tied to it by links."""
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")).withColumn("number", F.monotonically_increasing_id()), "distinct")
    tied = components(links(distinct.select("number", "fingerprint"), least))
    numbered = distinct.join(tied.withColumnRenamed("row", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    smallest = numbered.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = stored(numbered.join(smallest, "component").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


# Documents, their edited texts and their successors

RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
ENDS = [("ranged", pa.int32()), ("side", pa.int8()), ("text", pa.string())]


def compared(texts: pa.Array) -> list[pa.Array]:
    """The result's columns but the id, for every text but the last; each one's successor is the next."""
    raw, at = bytes_of(texts)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.searchsorted(begins, at)
    byte_of = np.append(begins, len(raw))
    size = np.diff(first)
    n = len(texts) - 1
    half = size[:-1] // 2
    kept, taken = size[:-1] - half, np.minimum(half, size[1:])
    # Characters of all texts, then those of the edited ones: the kept part and the successor's.
    classes = classes_of(raw)
    edited = ranges(np.stack([first[:-2], first[1:-1]], 1).ravel(), np.stack([kept, taken], 1).ravel())
    ends = np.concatenate([first, first[-1] + np.cumsum(kept + taken)])
    slots = sampled(np.concatenate([classes, classes[edited]]), ends)
    own, changed = slots[: n + 1], slots[n + 1 :]
    view, digests = memoryview(raw.tobytes()), []
    for i in range(n):
        h = hashlib.sha256(view[at[i] : byte_of[first[i] + kept[i]]])
        h.update(view[at[i + 1] : byte_of[first[i + 1] + taken[i]]])
        digests.append(h.digest())
    return [
        pa.array(size[:-1], pa.int64()), pa.array(digests, pa.binary()), pa.array(packed(own[:-1]), pa.binary()), pa.array(packed(changed), pa.binary()),
        pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:])),
    ]


def _inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a range but the last, and both end rows with their texts (side 1: first, side 2: last)."""
    schema, number = pa.schema(FIELDS + ENDS), TaskContext.get().partitionId()

    def end(doc_id: pa.Array, side: int, text: pa.Array) -> pa.RecordBatch:
        values = [doc_id, *(pa.nulls(1, t) for _, t in FIELDS[1:]), pa.array([number], pa.int32()), pa.array([side], pa.int8()), text.cast(pa.string())]
        return pa.RecordBatch.from_arrays(values, schema=schema)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column("doc_id"), plain_strings(batch.column("text"))
        if last is None:
            yield end(ids[:1], 1, texts[:1])
        else:
            ids, texts = pa.concat_arrays([last[0], ids]), pa.concat_arrays([last[1], texts])
        last = ids[-1:], texts[-1:]
        for low, high in slices(texts[:-1], BLOCK_BYTES):
            if high > low:
                rows = high - low
                nothing = [pa.nulls(rows, t) for _, t in ENDS]
                yield pa.RecordBatch.from_arrays([ids[low:high], *compared(texts[low : high + 1]), *nothing], schema=schema)
    if last is not None:
        yield end(last[0], 2, last[1])


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that hold their successor's text."""
    for batch in batches:
        for i in range(batch.num_rows):
            texts = pa.concat_arrays([plain_strings(batch.column(c))[i : i + 1] for c in ("text", "next_text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i : i + 1], *compared(texts)], schema=pa.schema(FIELDS))


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit by the next one (the last floor(n / 2) characters become the next text's first)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = ["doc_id", "tie", "row"]
    ordered = keyed.repartitionByRange(range_tasks(docs), *keys).sortWithinPartitions(*keys)
    found = stored(ordered.select("doc_id", "text").mapInArrow(_inner, f"{RESULT}, ranged int, side byte, text string"), "fingerprints")
    first = found.filter("side = 1").select("ranged", F.col("text").alias("next_text"))
    # Two rows a range from here on; the window sees numbers only.
    following = first.select("ranged").withColumn("following", F.lead("ranged").over(Window.orderBy("ranged")))
    following = following.withColumn("following", F.coalesce("following", F.min("ranged").over(Window.partitionBy())))
    last = found.filter("side = 2").select("doc_id", "ranged", "text").join(following, "ranged")
    pairs = last.join(first.withColumnRenamed("ranged", "following"), "following").select("doc_id", "text", "next_text")
    names = [name for name, _ in FIELDS]
    return found.filter("side IS NULL").select(*names).unionByName(pairs.mapInArrow(_paired, RESULT))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their successors by id."""
    found = neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text(c: str) -> Column:
        return F.lower(F.hex(c)).alias(c)

    return found.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
