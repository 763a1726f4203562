"""Token ids of a corpus as length-delimited binary records in order of document id, with an offset index for shuffled reads.

A shard holds records one after the other: length (8 bytes), masked checksum of the length (4), the sequence, masked
checksum of the sequence (4), all little-endian. A sequence is the document id (8 bytes, and a byte that says whether it
is null), the width of an id in bytes (1), then the ids. The checksum is CRC-32, rotated by 15 bits and shifted by a
constant, so that a checksum stored inside checked data doesn't weaken the check. The index of a shard has the begin of
every record and the count of its ids (8 bytes each).

Defined results: a null text is the empty text (its sequence is the end id alone); documents with equal or null ids are
kept, null first, equal ids by text; an empty table gives no shards; columns other than id and text are not read. Very
long texts are encoded whole. A task holds one slice of texts at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hexrisk.llm.files import Written, opened, stored
from hexrisk.llm.text import plain_strings, slices
from hexrisk.llm.tokens import encoder
from hexrisk.session import scratch_path

#: Fixed value of the format.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
DOCUMENT = struct.Struct("<q?B")
BLOCK = 4 << 20
MANIFEST = "shard long, path string, n_records long, n_ids long"
READ = "shard long, position long, doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(sequence: bytes) -> bytes:
    length = len(sequence).to_bytes(8, "little")
    return length + masked_crc(length).to_bytes(4, "little") + sequence + masked_crc(sequence).to_bytes(4, "little")


def unframed(stream) -> Iterator[bytes]:
    """The sequences of an open shard; raises ValueError where a checksum or the end doesn't fit."""
    while head := stream.read(12):
        yield _rest(head, stream.read)


def _rest(head: bytes, read) -> bytes:
    if len(head) < 12:
        raise ValueError("a record is cut off")
    length, crc = HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("the length of a record is damaged")
    body = read(length + 4)
    if len(body) < length + 4:
        raise ValueError("a record is cut off")
    sequence = body[:length]
    if masked_crc(sequence) != int.from_bytes(body[length:], "little"):
        raise ValueError("a record is damaged")
    return sequence


def sequence_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return DOCUMENT.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def ids_of(sequence: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = DOCUMENT.unpack_from(sequence)
    return None if null else doc_id, np.frombuffer(sequence, f"<u{width}", offset=DOCUMENT.size).astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaced: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to shards in ``folder``, ascending over the shards; returns the manifest, one row per shard.

    One shuffle deals the texts out by ranges of (id, hash of the text), so one id in many rows is split too. The manifest
    is stored, so the shards are written once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer, spaced).encode, TaskContext.get().partitionId()
        path = f"{folder}/shard-{number:08d}"
        out, index, n, total = None, None, 0, 0
        for batch in batches:
            texts, keys = plain_strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for begin, end in slices(texts):
                if out is None:
                    out, index = Written(path + ".rec"), Written(path + ".idx")
                ids, at = encode(texts.slice(begin, end - begin))
                parts, entries, place = [], [], out.size
                for i in range(begin, end):
                    own = np.append(ids[at[i - begin] : at[i - begin + 1]], np.uint32(end_id))
                    parts.append(framed(sequence_of(keys[i], own)))
                    entries.append((place, len(own)))
                    place += len(parts[-1])
                out.write(b"".join(parts))
                index.write(np.array(entries, "<i8").tobytes())
                n, total = n + len(parts), total + sum(k for _, k in entries)
        if out is not None:
            out.done()
            index.done()
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "n_records": [n], "n_ids": [total]}, MANIFEST_TYPES)

    return stored(ordered.select("doc_id", "text").mapInArrow(shard, MANIFEST), "manifest")


MANIFEST_TYPES = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
READ_TYPES = pa.schema([(c.split()[0], pa.int64()) for c in READ.split(", ")])


def read_index(path: str) -> np.ndarray:
    """Begin of the record and count of ids, for each record of a shard."""
    system, at = opened(path + ".idx")
    with system.open_input_stream(at) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 2)


def read_at(path: str, positions: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a shard in any order, each found through the index."""
    begins = read_index(path)[:, 0]
    system, at = opened(path + ".rec")
    with system.open_input_file(at) as f:
        for p in positions:
            f.seek(int(begins[p]))
            yield ids_of(_rest(f.read(12), f.read))


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of all shards: where it stands, its document, its ids' count and checksum (CRC-32 of 4-byte ids).

    ``start`` counts on from the manifest's ``ids_before``.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "ids_before")), strict=True):
                system, at = opened(path + ".rec")
                index, found = read_index(path), []
                with system.open_input_stream(at, buffer_size=BLOCK) as f:
                    for p, sequence in enumerate(unframed(f)):
                        doc_id, ids = ids_of(sequence)
                        if len(ids) != index[p, 1]:
                            raise ValueError(f"index and records of {path} differ")
                        found.append((number, p, doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(found) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=READ_TYPES)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=READ_TYPES)

    # A task per shard, as far as there are partitions.
    dealt = manifest.select("shard", "path", "ids_before").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return dealt.mapInArrow(rows, READ)


def corpus_records(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, folder: str | None = None) -> DataFrame:
    """Write the corpus, read it back, and place each document in the stream of all ids (``start``)."""
    manifest = write_records(docs, folder or scratch_path(docs.sparkSession, "records"), tokenizer, end_id, spaced)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return read_records(placed).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "position")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file on this machine; every executor has the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus_records(docs, tokenizer_path("byte_bpe_50k.json"), 0).select("doc_id", "start", "n_tokens", "ids_crc32")
