"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of its own embedding and the mean embedding of its character n-grams (3 and 5 bytes, those at
the word's start marked), both found by hashing, so the vocabulary has no bound to set. A text is cut into overlapping
windows; in each, recurrent units run both ways, attention pools their states, and a linear unit gives a logit. All
windows of a text are scored; the largest logit is the text's. Training takes labelled texts: at first every window of a
toxic text counts as toxic, then only the one that the network finds most toxic. A quarter of the labelled texts is kept
out of training to place the threshold at score 0.5.

The only bounded part is the training sample: at most ``TRAIN_ROWS`` labelled texts of each class, those with the
smallest hash of their id, none longer than ``TRAIN_CHARS`` characters and ``TRAIN_TOTAL`` together, and of several for
one id the one with the smallest hash. One task learns from it. Scores never see ids, labels, languages or sources.

Defined results: null and empty texts, and texts without a word, get the score of a window without words; equal texts get
equal scores; rows with equal or null ids are scored each; labels that are null don't count, and of several for one
document the largest does; with labels of one class only, all scores are 0 or 1 as that class, without any 0.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hexrisk.llm.files import give_back_memory, whole_row
from hexrisk.llm.text import _TABLE, LOWER, PUNCTUATION, bytes_of, coded, mixed, plain_strings, slices, span_hashes, word_bounds

WINDOW, STRIDE = 32, 24
WORDS, GRAMS, SIZE, UNITS = 1 << 15, 1 << 15, 8, 8
GRAM_LENGTHS = (3, 5)
EPOCHS, BATCH = 7, 256
#: Small samples are gone through more often, for so many steps.
STEPS = 1200
TRAIN_ROWS = 2000
#: Texts of the sample that a table entry must occur in to be trained.
SUPPORT = 4
TRAIN_CHARS = 60_000
#: Characters of the sample in each class.
TRAIN_TOTAL = 20_000_000
#: Words whose inputs a task remembers (about 50 bytes each), and windows that run together.
REMEMBERED = 1_000_000
TOGETHER = 2048
#: The weights of a network, and steps between two that enter their average.
WEIGHTS = ("word", "gram", "inp", "bias", "rec", "att", "out")
AVERAGED = 4
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gram_places(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the gram table of every character n-gram of the given words, and how many each word has."""
    length = end - begin
    first = np.cumsum(length) - length
    total = int(length.sum())
    place = np.arange(total)
    values = _TABLE[raw[place + np.repeat(begin - first, length)]]
    left = np.repeat(first + length, length) - place
    word = np.repeat(np.arange(len(begin)), length)
    starts = np.zeros(total, bool)
    starts[first] = True
    places, words = [], []
    for n in GRAM_LENGTHS:
        if total < n:
            continue
        h = values[: total - n + 1].copy()
        for k in range(1, n):
            h = h * _GRAM_BASE + values[k : total - n + 1 + k]
        whole = left[: total - n + 1] >= n
        h = mixed(h[whole] + np.where(starts[: total - n + 1][whole], np.uint64(n * 2 + 1), np.uint64(n * 2)))
        places.append((h & np.uint64(GRAMS - 1)).astype(np.int64))
        words.append(word[: total - n + 1][whole])
    places, words = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *words])
    order = np.argsort(words, kind="stable")
    return places[order], np.bincount(words, minlength=len(begin))


def mean_rows(table: np.ndarray, places: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean of the table's rows at the next ``count`` places, for each word; 0 where there is none."""
    out = np.zeros((len(count), table.shape[1]), table.dtype)
    some = count > 0
    if some.any():
        first = (np.cumsum(count) - count)[some]
        out[some] = np.add.reduceat(table[places], first, axis=0) / count[some, None]
    return out


def windows_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each window of texts with ``n`` words; the last window of a long text ends with it."""
    over = np.maximum(n - WINDOW, 0)
    count = 1 + -(-over // STRIDE)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.minimum(k * STRIDE, over[text])


@dataclass
class Network:
    """Weights: word and gram tables, inputs to gates of both directions, recurrent weights, attention, output."""

    word: np.ndarray
    gram: np.ndarray
    inp: np.ndarray  # SIZE x 6 UNITS: forward update, reset, candidate, then backward
    bias: np.ndarray
    rec: np.ndarray  # 2 x UNITS x 3 UNITS
    att: np.ndarray
    out: np.ndarray  # 2 UNITS and a bias
    scale: float = 1.0
    cut: float = 0.0

    @staticmethod
    def new(seed: int) -> Network:
        g = np.random.default_rng(seed)
        f = lambda s, *n: g.normal(0, s, n).astype(np.float32)
        return Network(f(0.05, WORDS, SIZE), f(0.05, GRAMS, SIZE), f(0.4, SIZE, 6 * UNITS), np.zeros(6 * UNITS, np.float32), f(0.3, 2, UNITS, 3 * UNITS), f(0.3, 2 * UNITS), np.append(f(0.3, 2 * UNITS), np.float32(0)))

    def inputs(self, keys: np.ndarray, places: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.word[(keys & np.uint64(WORDS - 1)).astype(np.int64)] + mean_rows(self.gram, places, count)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of each word, and of no word in the last row."""
        return np.concatenate([x @ self.inp + self.bias, np.zeros((1, 6 * UNITS), np.float32)])

    def run(self, gates: np.ndarray, index: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, ...]:
        """Logits of windows, given as rows of word numbers (the last number: no word). ``keep`` gathers what training needs."""
        n, steps = index.shape
        here = index < len(gates) - 1
        full = here.all()
        states = np.zeros((steps, n, 2 * UNITS), np.float32)
        for way in (0, 1):
            own = np.ascontiguousarray(gates[:, way * 3 * UNITS : (way + 1) * 3 * UNITS])
            h, rec = np.zeros((n, UNITS), np.float32), self.rec[way]
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, u = own[index[:, t]], h @ rec
                zr = sigmoid(x[:, : 2 * UNITS] + u[:, : 2 * UNITS])
                z, r = zr[:, :UNITS], zr[:, UNITS:]
                c = np.tanh(x[:, 2 * UNITS :] + r * u[:, 2 * UNITS :])
                new = c + z * (h - c)
                if not full:
                    new *= here[:, t : t + 1]
                if keep is not None:
                    keep.append((way, t, h, z, r, c, u[:, 2 * UNITS :]))
                h = new
                states[t, :, way * UNITS : (way + 1) * UNITS] = h
        e = states @ self.att
        if not full:
            e = np.where(here.T, e, np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnd->nd", a, states)
        return pooled @ self.out[:-1] + self.out[-1], pooled, a, states, here

    def logits(self, gates: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest window logit of each text; ``first`` has the first word of each text and the end."""
        n = np.diff(first)
        text, start = windows_of(n)
        place = start + first[:-1][text]
        end = first[1:][text]
        best = np.full(len(n), -np.inf, np.float32)
        padded = np.append(codes, len(gates) - 1)
        short = end - place < WINDOW
        for group in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(group), TOGETHER):
                w = group[i : i + TOGETHER]
                index = place[w, None] + np.arange(WINDOW)
                index = padded[np.where(index < end[w, None], index, len(codes))]
                np.maximum.at(best, text[w], self.run(gates, index)[0])
        return best

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (logits.astype(np.float64) - self.cut))


class Words:
    """Turns texts into numbers of distinct words, and remembers the words' inputs between batches."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows, self.x = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gate inputs of the distinct words, the number of each word, and each text's first word."""
        raw, at = bytes_of(texts)
        raw = LOWER[raw]
        begin, end = word_bounds(raw, at, PUNCTUATION)
        first = np.searchsorted(begin, at)
        keys, codes, where = coded(span_hashes(raw, begin, end))
        if len(self.keys) > REMEMBERED:
            self._forget()
        found = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[found] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            x = self.net.inputs(keys[new], *gram_places(raw, begin[where[new]], end[where[new]]))
            order = np.argsort(keys[new])
            place = np.searchsorted(self.keys, keys[new][order])
            self.keys, self.rows = np.insert(self.keys, place, keys[new][order]), np.insert(self.rows, place, len(self.x) + order)
            self.x = np.concatenate([self.x, x])
        x = self.x[self.rows[np.searchsorted(self.keys, keys)]] if len(keys) else np.zeros((0, SIZE), np.float32)
        return self.net.gates(x), codes, first


def _read(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of all texts, begin, end and hash of all words, and each text's first word; worked out slice by slice."""
    raws, begins, ends, firsts, hashes, n_bytes, n_words = [], [], [], [np.zeros(1, np.int64)], [], 0, 0
    for i, j in slices(texts):
        raw, at = bytes_of(texts.slice(i, j - i))
        raw = LOWER[raw]
        begin, end = word_bounds(raw, at, PUNCTUATION)
        raws.append(raw)
        begins.append(begin + n_bytes)
        ends.append(end + n_bytes)
        firsts.append(np.searchsorted(begin, at)[1:] + n_words)
        hashes.append(span_hashes(raw, begin, end))
        n_bytes, n_words = n_bytes + len(raw), n_words + len(begin)
    return tuple(np.concatenate(x) for x in (raws, begins, ends, firsts, hashes))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Network:
    """Fit a network to labelled texts (both classes present); ``weight`` of a text is how many of its class it stands for."""
    net, g = Network.new(seed), np.random.default_rng(seed)
    raw, begin, end, first, hashes = _read(plain_strings(pa.array(texts, pa.large_string())))
    keys, codes, where = coded(hashes)
    parts = [gram_places(raw, begin[where[i : i + 20_000]], end[where[i : i + 20_000]]) for i in range(0, len(where), 20_000)]
    places, count = np.concatenate([np.zeros(0, np.int32), *(p.astype(np.int32) for p, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    gram_at = np.concatenate([[0], np.cumsum(count)])
    text, start = windows_of(np.diff(first))
    place, stop = start + first[:-1][text], first[1:][text]
    padded = np.append(codes, len(keys))
    kept_out = np.zeros(len(texts), bool)
    for c in (0, 1):
        own = g.permutation(np.flatnonzero(toxic == c))
        kept_out[own[: len(own) // 4]] = True
    # Only words and n-grams of several texts carry an embedding; what one text has alone can't be learned from.
    words_in, grams_in = np.zeros(WORDS, np.int64), np.zeros(GRAMS, np.int64)
    word_slot = (keys & np.uint64(WORDS - 1)).astype(np.int64)
    for i in range(len(texts)):
        own = np.unique(codes[first[i] : first[i + 1]])
        words_in[np.unique(word_slot[own])] += 1
        n = count[own]
        if n.any():
            grams_in[np.unique(places[np.repeat(gram_at[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])] += 1
    known_word, known_gram = words_in >= SUPPORT, grams_in >= SUPPORT
    net.word[~known_word] = 0
    net.gram[~known_gram] = 0
    known_of = {"word": known_word, "gram": known_gram}
    dense = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("inp", "bias", "rec", "att", "out")}
    seen = {k: np.zeros(len(getattr(net, k)), np.float32) for k in ("word", "gram")}
    step = 0

    def rows(w: np.ndarray) -> np.ndarray:
        index = place[w, None] + np.arange(WINDOW)
        return padded[np.where(index < stop[w, None], index, len(codes))]

    def all_logits() -> np.ndarray:
        step = 20_000
        parts = [net.inputs(keys[i : i + step], places[gram_at[i] : gram_at[min(i + step, len(keys))]], count[i : i + step]) for i in range(0, len(keys), step)]
        gates = net.gates(np.concatenate([np.zeros((0, SIZE), np.float32), *parts]))
        return np.concatenate([net.run(gates, rows(np.arange(i, min(i + TOGETHER, len(text)))))[0] for i in range(0, len(text), TOGETHER)])

    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(text))))
    # Weights are averaged over the last third: the average depends little on the order of the last batches.
    averaged = {k: np.zeros_like(getattr(net, k)) for k in WEIGHTS}
    n_averaged = 0
    for epoch in range(epochs):
        use = ~kept_out[text]
        positive = toxic[text] == 1
        if epoch * EPOCHS >= 2 * epochs:  # of a toxic text its most toxic window, of a clean one that and a share of the others
            logit = all_logits()
            order = np.lexsort((-logit, text))
            top = np.zeros(len(text), bool)
            top[order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]] = True
            use &= top | (~positive & (g.random(len(text)) < 0.3))
        chosen = g.permutation(np.flatnonzero(use))
        balance = max(1.0, (~positive[chosen]).sum() / max(1, positive[chosen].sum())) ** 0.5
        for i in range(0, len(chosen), BATCH):
            w = chosen[i : i + BATCH]
            y = positive[w].astype(np.float32)
            used, index = np.unique(rows(w), return_inverse=True)
            index = index.reshape(len(w), WINDOW)
            real = used < len(keys)
            used, step = used[real], step + 1
            n_grams = count[used]
            gram_rows = np.repeat(gram_at[used] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(int(n_grams.sum()))
            x = net.inputs(keys[used], places[gram_rows], n_grams)
            kept: list = []
            gates = net.gates(x)
            logit, pooled, a, states, here = net.run(gates, index, kept)
            d = (sigmoid(logit) - y) * np.where(y > 0, balance, 1.0).astype(np.float32) / len(w)
            grad = {k: np.zeros_like(getattr(net, k)) for k in dense}
            grad["out"][:-1], grad["out"][-1] = pooled.T @ d, d.sum()
            dp = d[:, None] * net.out[:-1]
            da = np.einsum("nd,tnd->tn", dp, states)
            de = a * (da - (a * da).sum(0))
            grad["att"] = np.einsum("tn,tnd->d", de, states)
            ds = a[:, :, None] * dp + de[:, :, None] * net.att
            dg = np.zeros((len(gates), 6 * UNITS), np.float32)
            dh = np.zeros((len(w), UNITS), np.float32)
            last = None
            for way, t, h, z, r, c, uc in reversed(kept):
                if way != last:
                    dh, last = np.zeros((len(w), UNITS), np.float32), way
                dh = (dh + ds[t, :, way * UNITS : (way + 1) * UNITS]) * here[:, t : t + 1]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(dg[:, way * 3 * UNITS : (way + 1) * 3 * UNITS], index[:, t], np.concatenate([dz, dr, dc], axis=1))
                grad["rec"][way] += h.T @ du
                dh = dh * z + du @ net.rec[way].T
            dg = dg[: len(used)]
            grad["inp"], grad["bias"] = x.T @ dg, dg.sum(0)
            dx = dg @ net.inp.T
            for k, (m, v) in dense.items():  # Adam
                m *= 0.9
                m += 0.1 * grad[k]
                v *= 0.99
                v += 0.01 * grad[k] ** 2
                getattr(net, k)[...] -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            for k, at_rows, gradient in (
                ("word", (keys[used] & np.uint64(WORDS - 1)).astype(np.int64), dx),
                ("gram", places[gram_rows], np.repeat(dx / np.maximum(n_grams, 1)[:, None], n_grams, axis=0)),
            ):  # Adagrad, by row
                known = known_of[k][at_rows]
                r, back = np.unique(at_rows[known], return_inverse=True)
                total = np.zeros((len(r), SIZE), np.float32)
                np.add.at(total, back, gradient[known])
                seen[k][r] += (total**2).mean(1)
                getattr(net, k)[r] -= 0.2 * total / (np.sqrt(seen[k][r]) + 1e-6)[:, None]
            if 3 * epoch >= 2 * epochs and step % AVERAGED == 0:
                n_averaged += 1
                for k, mean in averaged.items():
                    mean += (getattr(net, k) - mean) / n_averaged
    if n_averaged:
        for k, mean in averaged.items():
            setattr(net, k, mean)
    logit = all_logits()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, logit)
    judged = kept_out if kept_out.any() and len(set(toxic[kept_out])) == 2 else np.ones(len(texts), bool)
    net.cut, net.scale = threshold(best[judged], toxic[judged], weight[judged])
    return net


def threshold(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The cut with the best F1, a third of the way from the text below it to the one above, and a slope that spreads scores around it.

    The texts seen bound clean ones better than toxic ones, of which a single word in any place should be enough.
    """
    order = np.argsort(-logit, kind="stable")
    l, t, w = logit[order], toxic[order], weight[order]
    hit, picked = np.cumsum(t * w), np.cumsum(w)
    f1 = 2 * hit / (picked + (t * w).sum())
    f1[:-1][l[:-1] == l[1:]] = -1
    k = int(np.argmax(f1))
    cut = float(l[k + 1] + (l[k] - l[k + 1]) / 3) if k + 1 < len(l) else float(l[k] - 1)
    return cut, 1.0


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Labelled texts to learn from: at most ``rows`` of each class; ``weight`` is how many of the class each stands for."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("weight", F.lit(float(max(1.0, n / rows)))) for c, n in sorted(sizes.items())]
    if not picked:
        return docs.select("doc_id", "text", F.lit(0).alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", "text").filter(F.char_length("text") <= chars)
    found = texts.join(F.broadcast(chosen), "doc_id")  # 2 * rows ids at most
    # An id may stand in very many rows: one text for each is left, by task before the shuffle.
    return found.groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic", "weight")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fitted(sample: list[dict], chars: int = TRAIN_TOTAL) -> Network | float:
    """The network learnt from labelled texts, or the one class that they have.

    Texts are taken in the order of their ids' and texts' hashes until ``chars`` characters are reached in their class.
    """
    rows, taken = [], {0: 0, 1: 0}
    for r in sorted(sample, key=lambda r: zlib.crc32(f"{r['doc_id']} {r['text']}".encode())):
        taken[r["toxic"]] += len(r["text"] or "")
        if taken[r["toxic"]] <= chars:
            rows.append(r)
    rows.sort(key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return float(toxic[0]) if len(toxic) else 0.0
    return train([r["text"] or "" for r in rows], toxic, np.array([r["weight"] for r in rows]))


def learned(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The same by one task of the cluster: only the weights come to the driver, and a lost task is repeated."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        model = pickle.dumps(fitted(rows))
        del rows
        give_back_memory()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    sample = training_sample(docs, labels).repartition(1)  # 2 * TRAIN_ROWS texts of TRAIN_CHARS at most
    found = sample.mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else 0.0


def scored(docs: DataFrame, model: Network | float, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score for each row's whole text."""
    if not isinstance(model, Network):
        return docs.withColumn(into, F.lit(model))

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            texts, found = plain_strings(batch.column(text)), []
            for begin, end in slices(texts):
                gates, codes, first = words.read(texts.slice(begin, end - begin))
                found.append(model.score(model.logits(gates, codes, first)))
            own = [batch.column(i) for i in range(batch.num_columns)]
            score = pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())
            yield pa.RecordBatch.from_arrays([*own, score], [*batch.schema.names, into])
        del words
        give_back_memory()

    return docs.mapInArrow(scores, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    slim = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return slim.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    rows = docs.select(whole_row(docs), "text")
    return scored(rows, learned(docs, labels)).filter("score < 0.5").select("whole.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
