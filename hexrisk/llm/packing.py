"""Pack examples into sequences of bounded length by vector bin packing with the dot-product heuristic.

Each sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. It is filled with the example
whose demand vector has the largest dot product with what is left of the limits; if none fits whole, the largest one is
cut so that the sequence gets full. A sequence that closes short (segment or loss limit, end of a task's input) ends at a
power of two, where no padding is due, and what is over goes back to the pool. Every id lies in exactly one piece.

Packing is local to a task: examples are encoded and packed from the task's own input in pools of bounded size, with no
shuffle and no group to gather; ``sequence_id`` has the task's number in its upper half.

Defined results: a null text is empty (its ids are the end id alone); equal rows and equal document ids are packed each;
null ids stay null; an empty table gives no pieces; other columns are not read. Of a long text the pieces of full length
are cut first, the rest goes to the pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexrisk.llm.records import tokenizer_path
from hexrisk.llm.text import plain_strings, slices
from hexrisk.llm.tokens import encoder

LENGTH = 2048
SEGMENTS = 256
#: A pool is packed when it holds so many tokens or examples; what doesn't fill a sequence waits for the next pool.
POOL_TOKENS = 2_000_000
POOL_ITEMS = 8_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
TYPES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


@dataclass
class Item:
    """What is still to be placed of a document: ids from ``start`` on; ``loss`` has the loss-bearing ids up to each place, if not all are."""

    key: int | None
    ids: np.ndarray
    start: int = 0
    loss: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.ids) - self.start

    def losses(self, n: int) -> int:
        return n if self.loss is None else int(self.loss[self.start + n] - self.loss[self.start])

    def prefix(self, tokens: int, losses: int) -> int:
        """Longest cut from the start within both limits."""
        n = min(tokens, self.size)
        if self.loss is None:
            return min(n, losses)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + losses, side="right")) - 1 - self.start)


@dataclass
class Packer:
    """Packs the items it is given; ``rows`` gathers the pieces."""

    task: int
    length: int = LENGTH
    segments: int = SEGMENTS
    losses: int = LENGTH
    pool: list[Item] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    made: int = 0
    tokens: int = 0

    def add(self, item: Item) -> None:
        while item.size >= self.length and (n := item.prefix(self.length, self.losses)) == self.length:
            self._emit([(item, n)])
        if item.size:
            self.pool.append(item)
            self.tokens += item.size
        if self.tokens >= POOL_TOKENS or len(self.pool) >= POOL_ITEMS:
            self.pack(False)

    def _emit(self, pieces: list[tuple[Item, int]]) -> None:
        """Place the next ids of each item one after the other in a new sequence."""
        at = 0
        for item, n in pieces:
            own = item.ids[item.start : item.start + n]
            self.rows.append((item.key, item.start, n, zlib.crc32(own.astype("<u4").tobytes()), len(item.ids), (self.task << 32) + self.made, at, item.losses(n)))
            item.start += n
            at += n
        self.made += 1

    def pack(self, all_of_it: bool) -> None:
        """Form sequences while the pool fills them, and from the rest too if ``all_of_it``."""
        items = self.pool
        size = np.array([x.size for x in items], np.int64)
        loss = np.array([x.losses(x.size) for x in items], np.int64)
        left, limits = int(size.sum()), np.array([self.length, self.segments, self.losses], float)
        while left and (all_of_it or left >= self.length):
            room, chosen = limits.copy(), []
            while room[0] > 0 and room[1] >= 1:
                # Dot product of demand and what is left, both as shares of the limits; the segments' share is the same for all.
                fits = (size > 0) & (size <= room[0]) & (loss <= room[2])
                if fits.any():
                    i = int(np.argmax(np.where(fits, size * (room[0] / limits[0] ** 2) + loss * (room[2] / limits[2] ** 2), -1.0)))
                    n = int(size[i])
                else:
                    i = int(np.argmax(size))
                    n = items[i].prefix(int(room[0]), int(room[2])) if size[i] > 0 else 0
                    if n <= 0:
                        break
                chosen.append((i, n))
                room -= (n, 1, items[i].losses(n))
                if n < size[i]:  # cut: the sequence is full, or its loss limit reached
                    size[i] = 0
                    break
                size[i] = 0
            total = sum(n for _, n in chosen)
            if not total:  # a single id above the loss limit: it gets a sequence of its own
                i = int(np.argmax(size))
                chosen, total = [(i, 1)], 1
            if total < self.length:
                keep, cut = 1 << (total.bit_length() - 1), []
                for i, n in chosen:
                    if keep > 0:
                        cut.append((i, min(n, keep)))
                        keep -= n
                    else:
                        size[i] = n
                chosen = cut
            self._emit([(items[i], n) for i, n in chosen])
            left -= sum(n for _, n in chosen)
            for i, _ in chosen:
                size[i] = items[i].size
                loss[i] = items[i].losses(items[i].size)
        self.pool = [x for x in items if x.size]
        self.tokens = left

    def batches(self, least: int = 20_000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=TYPES)
            self.rows = []


def pack_examples(
    docs: DataFrame, tokenizer: str, end_id: int, spaced: bool, length: int = LENGTH, segments: int = SEGMENTS, losses: int | None = None,
    doc_id: str = "doc_id", text: str = "text", prompt: str | None = None,
) -> DataFrame:
    """Pieces of all rows' ids in sequences. ``prompt`` names a column whose ids come first and bear no loss (instruction data).

    ``length`` is a power of two; ``losses`` (default: ``length``) limits the loss-bearing tokens of a sequence.
    """
    if length & (length - 1) or segments < 1:
        raise ValueError("length must be a power of two, segments positive")
    most = length if losses is None else losses
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    columns += [F.col(prompt).alias("prompt")] if prompt else []

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId(), length, segments, most), encoder(tokenizer, spaced).encode
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), plain_strings(batch.column("text"))
            prompts = plain_strings(batch.column("prompt")) if prompt else None
            for begin, end in slices(texts):
                ids, at = encode(texts.slice(begin, end - begin))
                small = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
                first = encode(prompts.slice(begin, end - begin)) if prompt else None
                for i in range(end - begin):
                    own, loss = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)), None
                    if first:
                        before = first[0][first[1][i] : first[1][i + 1]]
                        loss = np.concatenate([np.zeros(len(before) + 1, np.int64), np.arange(1, len(own) + 1)])
                        own = np.concatenate([before, own])
                    packer.add(Item(keys[begin + i], own.astype(small) if own.max() < 1 << 16 else own, 0, loss))
                yield from packer.batches()
        packer.pack(True)
        yield from packer.batches(1)

    return docs.select(*columns).mapInArrow(pack, PIECES)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_examples(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), 1, False)
