"""Packing and binary records against plain encoding of each text."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from hexrisk.llm import packing, records, tokens
from hexrisk.llm.files import opened
from hexrisk.session import scratch_path

ODD = [
    "", " ", "a  b\n\n c  d  e", "don't  stop\t\tx ", "é  à  b", "　 x 　", "日本 語", "a\r\nb  ",
    "\x1c x\x0by", "<|endoftext|> hi", "Σ ΑΣ", "é ́x", "x" * 5000, "1 22 333", "a | b|c ||", "c\u0085 d", "|", "\n", "A Word " * 3000,
]
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name, text, end):
    ids = tokens.load(records.tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


@pytest.mark.parametrize("name,spaced", [(BYTE, True), (WORD, False)])
def test_pieces_give_the_ids_of_the_whole_text(name, spaced):
    encoder, whole = tokens.Encoder(records.tokenizer_path(name), spaced), tokens.load(records.tokenizer_path(name))
    for texts in (ODD, list(reversed(ODD))):
        ids, at = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id here", None), (3, "again", "y"), (3, "again", "y"), (40, None, None)]
    rows += [(100 + i, f"w{i} some words " * (i % 37 + 1), "z") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)


def test_packing_places_every_id_once(spark, docs):
    rows = packing.pack_examples(docs, records.tokenizer_path(WORD), 1, False).toPandas()
    want = sorted((r.doc_id if r.doc_id is not None else -1, plain(WORD, r.text, 1).tobytes()) for r in docs.collect())
    pieces, got = rows.fillna(-1).sort_values(["doc_id", "start"]), []
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | (sizes & (sizes - 1) == 0)).all()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    crcs = {}
    for doc_id, ids in want:
        crcs.setdefault(doc_id, []).append(ids)
    for doc_id, g in pieces.groupby("doc_id"):
        possible = crcs.pop(doc_id)
        assert g.length.sum() == sum(len(x) // 4 for x in possible)
        for r in g.itertuples():
            cut = [x for x in possible if len(x) // 4 == r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
            assert cut
    assert not crcs and not got


def test_packing_keeps_all_limits_on_instruction_data(spark):
    rows = spark.createDataFrame([(i, "ask me " * (i % 9 * 20), "an answer " * (i % 11 * 15)) for i in range(400)], "doc_id long, prompt string, text string")
    out = packing.pack_examples(rows, records.tokenizer_path(WORD), 1, False, length=512, segments=4, losses=256, prompt="prompt").toPandas()
    per = out.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"))
    assert (per.n <= 512).all() and (per.k <= 4).all() and (per.loss <= 256).all()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_packing_of_nothing(spark, docs):
    assert packing.pack_examples(docs.limit(0), records.tokenizer_path(WORD), 1, False).count() == 0


def test_records_come_back_in_order(spark, docs):
    rows = records.corpus_records(docs, records.tokenizer_path(BYTE), 0).orderBy("start").collect()
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    by_id = {r.doc_id: r for r in rows if r.doc_id != 3}
    for r in want:
        if r.doc_id != 3:
            ids = plain(BYTE, r.text, 0)
            assert (by_id[r.doc_id].n_tokens, by_id[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_records_are_found_by_index_and_damage_is_seen(spark, docs):
    manifest = records.write_records(docs, scratch_path(spark, "t"), records.tokenizer_path(BYTE), 0)
    shard = manifest.orderBy("shard").first()
    order = list(range(shard.n_records))[::-1]
    back = list(records.read_at(shard.path, order))
    assert sum(len(ids) for _, ids in back) == shard.n_ids
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 3}
    for doc_id, ids in back:
        if doc_id in texts:
            assert ids.tolist() == plain(BYTE, texts[doc_id], 0).tolist()
    system, path = opened(shard.path + ".rec")
    data = bytearray(system.open_input_stream(path).read())
    data[30] ^= 1
    import io

    with pytest.raises(ValueError):
        list(records.unframed(io.BytesIO(bytes(data))))
    with pytest.raises(ValueError):
        list(records.unframed(io.BytesIO(bytes(data[:20]))))


def test_records_of_nothing(spark, docs):
    assert records.corpus_records(docs.limit(0), records.tokenizer_path(BYTE), 0).count() == 0
