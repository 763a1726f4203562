"""Periodic runs of words: maximal stretches in which every word equals the one a period before.

A run of period q is a stretch whose smallest period is q, that is long enough, and that no neighbouring word extends
keeping q. All are found by the Lyndon words in them:

1. Words become numbers. Each text is cut at words whose nearest copy lies too far off for any run of the piece they are
   in (a run holds each of its words again within a period); what is left are pieces that may hold runs. No run is lost.
2. The first phase of Baier's suffix sorter groups the places of each piece, highest group first: the places of a group
   leave the chain of open places, and each place just before them moves to a new group right above its own, its word
   longer by what left behind it. When a group's turn comes, its places share the longest Lyndon word that begins there.
   All pieces of a block of texts go through it side by side, once with the order of words and once with the reverse.
3. Every run of two periods or more has such a Lyndon word of its period as root, under one of the two orders. From each
   root the period is extended to both sides by longest common extensions, which compare blocks of doubling length by
   exact names. Roots of one run give the same run.

A task holds a slice of whole texts; nothing is shuffled, and memory grows with the longest text only. Steps of phase two
grow with the number of groups of the largest piece.

Defined results: a null text has no words; texts with fewer words than a run needs have no runs; rows with equal ids are
treated each; null ids stay null; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.text import bytes_of, plain_strings, slices, word_bounds, words_per_text

#: Texts that go through the sorter side by side, in bytes.
BLOCK_BYTES = 8_000_000
#: Rounds of cutting; more would cut little, and what is left uncut costs time only.
CUTS = 16
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """A run has at least ``words`` words and ``times`` periods (2 or more)."""

    words: int = 6
    times: int = 4

    def long_enough(self, length, period):
        return (length >= self.words) & (length >= self.times * period)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, …`` with ``count[i]`` numbers each, one after the other."""
    upto = np.cumsum(count)
    return np.repeat(first - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Places where any of the keys differs from the place before; the first is one."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def numbered_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    length = end - begin
    at = np.concatenate([[0], np.cumsum(length)])
    data = raw[ranges(begin, length)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def pieces(codes: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that may hold runs; ``first`` has the first word of each text and the end."""
    begin, end = first[:-1], first[1:]
    values = int(codes.max()) + 1 if len(codes) else 1
    for _ in range(CUTS):
        large = end - begin >= max(rule.words, rule.times)
        begin, end = begin[large], end[large]
        size = end - begin
        place, piece = ranges(begin, size), np.repeat(np.arange(len(size)), size)
        key = piece * values + codes[place]
        order = np.argsort(key, kind="stable")
        gap = np.where(key[order][1:] == key[order][:-1], np.diff(place[order]), np.iinfo(np.int64).max // rule.times)
        nearest = np.full(len(place), np.iinfo(np.int64).max // rule.times)
        nearest[order[1:]] = gap
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
        kept = nearest * rule.times <= size[piece]
        if kept.all():
            break
        place, piece = place[kept], piece[kept]
        if not len(place):
            return place, place
        edge = changes(piece, place - np.arange(len(place)))
        begin, end = place[edge], place[np.append(edge[1:], len(place)) - 1] + 1
    return begin, end


def lyndon_lengths(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place, in several sequences (``sizes``) side by side.

    Slots hold the open places of each sequence in order of their groups; the highest group is taken from the end.
    """
    n, lane = len(codes), np.repeat(np.arange(len(sizes)), sizes)
    base = np.cumsum(sizes) - sizes
    # Chain of open places; each sequence begins with a stop, and one more stands at the end.
    node = np.arange(n) + lane + 1
    total = n + len(sizes) + 1
    left, right = np.arange(-1, total - 1), np.arange(1, total + 1)
    stop = np.ones(total, bool)
    stop[node] = False
    length, moved = np.ones(total, np.int64), np.zeros(total, bool)
    order = np.lexsort((codes, lane))
    member = node[order]
    slot, group, close = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(n + 1, np.int64)
    slot[member] = np.arange(n)
    begins = changes(lane[order], codes[order]) if n else np.zeros(0, np.int64)
    close[begins] = np.append(begins[1:], n)[: len(begins)]
    group[member] = np.repeat(begins, close[begins] - begins)
    top = base + sizes
    base, top = base[sizes > 0], top[sizes > 0]
    while len(top):
        lower = group[member[top - 1]]
        nodes = np.sort(member[ranges(lower, top - lower)])
        before = left[nodes]
        heads = np.ones(len(nodes), bool)
        heads[1:] = before[1:] != nodes[:-1]
        heads = np.flatnonzero(heads)
        many = np.diff(np.append(heads, len(nodes)))
        ahead, after = before[heads], right[nodes[heads + many - 1]]
        right[ahead], left[after] = after, ahead
        real = ~stop[ahead]
        if real.any():
            ahead, many, own = ahead[real], many[real], length[nodes[heads[real]]]
            length[ahead] += many * own
            by = np.lexsort((many, group[ahead]))
            ahead, many = ahead[by], many[by]
            old_group, old_slot = group[ahead], slot[ahead]
            per_group = changes(old_group)
            count = np.diff(np.append(per_group, len(ahead)))
            owner = old_group[per_group]
            edge = close[owner] - count  # the upper end of each old group is where its movers go
            target = ranges(edge, count)
            moved[ahead] = True
            there = member[target]
            there = there[~moved[there]]
            moved[ahead] = False
            free = old_slot[old_slot < np.repeat(edge, count)]
            member[free], slot[there] = there, free
            member[target], slot[ahead] = ahead, target
            new = changes(old_group, many)
            n_new = np.diff(np.append(new, len(ahead)))
            close[owner] = edge
            close[target[new]] = target[new] + n_new
            group[ahead] = np.repeat(target[new], n_new)
        still = lower > base
        base, top = base[still], lower[still]
    return length[node]


class Extensions:
    """Longest common extensions of places in one sequence; blocks of 1, 2, 4, … values get exact names."""

    def __init__(self, values: np.ndarray, longest: int):
        self.names = [values]
        for level in range(max(0, int(longest).bit_length() - 1)):
            have, half = self.names[-1], 1 << level
            name = -np.arange(1, len(values) + 1)  # blocks that would reach beyond the end equal none
            if len(values) >= 2 * half:
                inside = len(values) - 2 * half + 1
                a, b = have[:inside], have[half : half + inside]
                name[:inside] = np.unique(a * (len(values) + int(values.max()) + 1) + b, return_inverse=True)[1]
            self.names.append(name)

    def _grow(self, a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
        out, n = np.zeros(len(a), np.int64), len(self.names[0])
        for level in reversed(range(len(self.names))):
            width, names = 1 << level, self.names[level]
            x, y = (a - out - width, b - out - width) if backwards else (a + out, b + out)
            fits = (x >= 0) & (y + width <= n)
            fits[fits] = names[x[fits]] == names[y[fits]]
            out[fits] += width
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values from ``a`` on equal those from ``b`` on (``a`` before ``b``)."""
        return self._grow(a, b, False)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values before ``a`` equal those before ``b``."""
        return self._grow(a, b, True)


def runs_of(codes: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of several sequences that stand one after the other in ``codes``."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none
    both = lyndon_lengths(np.concatenate([codes, -codes]), np.concatenate([sizes, sizes]))
    root = np.tile(np.arange(len(codes)), 2)
    lane = np.repeat(np.arange(len(sizes)), sizes)
    possible = both * rule.times <= np.tile(sizes[lane], 2)
    root, period = root[possible], both[possible]
    if not len(root):
        return none, none, none
    # Behind each sequence stands a value of its own, which ends all extensions.
    dense = np.unique(codes, return_inverse=True)[1]
    values = np.empty(len(codes) + len(sizes), np.int64)
    values[np.arange(len(codes)) + lane] = dense
    values[np.cumsum(sizes) + np.arange(len(sizes))] = int(dense.max()) + 1 + np.arange(len(sizes))
    place = root + lane[root]
    extensions = Extensions(values, int(sizes.max()))
    before = extensions.left(place, place + period)
    length = before + period + extensions.right(place, place + period)
    good = rule.long_enough(length, period)
    start, length, period = (root - before)[good], length[good], period[good]
    order = np.lexsort((period, start))
    order = order[changes(start[order], period[order])] if len(order) else order
    return start[order], length[order], period[order]


@dataclass
class Found:
    """Runs of a slice of texts, by text; ``first_run`` has the first run of each text and the end."""

    n_words: np.ndarray
    first_run: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray
    collapsed: pa.Array


def found_in(texts: pa.Array, rule: Rule) -> Found:
    """Runs of every text, and the texts without what repeats: of each run the first period stays."""
    raw, at = bytes_of(texts)
    begin, end = word_bounds(raw, at)
    first = words_per_text(begin, at)
    codes = numbered_words(raw, begin, end)
    low, high = pieces(codes, first, rule)
    start, length, period = runs_of(codes[ranges(low, high - low)], high - low, rule)
    lows = np.cumsum(high - low) - (high - low)
    if len(start):
        start = start + (low - lows)[np.searchsorted(lows, start, side="right") - 1]
    text = np.searchsorted(first, start, side="right") - 1
    repeated = np.zeros(len(codes) + 1, np.int64)
    np.add.at(repeated, start + period, 1)
    np.add.at(repeated, start + length, -1)
    kept = np.flatnonzero(np.cumsum(repeated)[:-1] == 0)
    return Found(np.diff(first), np.searchsorted(text, np.arange(len(texts) + 1)), start - first[text], length, period, joined(raw, begin, end, kept, first))


def joined(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, kept: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each text with one blank between them."""
    text = np.searchsorted(first, kept, side="right") - 1
    inner = kept[:-1][text[1:] == text[:-1]]  # words that another one follows
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[begin[kept]] += 1
    edges[end[kept]] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    data = raw.copy()
    data[end[inner]] = 0x20
    mask[end[inner]] = True
    size = np.bincount(text, end[kept] - begin[kept] + 1, len(first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(data[mask]))


def word_runs(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``n_words``, its ``runs`` by start and period, and ``collapsed``, its words without the repetitions."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN_TYPE), ("collapsed", pa.string())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_strings(batch.column("text"))
            for low, high in slices(texts, BLOCK_BYTES):
                found = found_in(texts.slice(low, high - low), rule)
                spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (found.start, found.length, found.period)], fields=list(RUN_TYPE.value_type))
                runs = pa.ListArray.from_arrays(pa.array(found.first_run, pa.int32()), spans)
                columns = [batch.column("doc_id").slice(low, high - low), pa.array(found.n_words, pa.int64()), runs.cast(RUN_TYPE), found.collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact ratio of length to period; of equal ones the first. Null without runs."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, run: F.when(better(best, run), run).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """Texts of which, for a tenth of all ids, the end is a repetition of its first words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        rest = n - a
        p = F.lit(1) + F.floor(rest / (F.lit(3) + g % 8))
        times = F.floor((rest + p - 1) / p).cast("int")
        turns = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
        ends = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(turns, F.lit(1), rest.cast("int")))
        return F.when(n > 0, F.array_join(ends, " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))
    once = F.element_at(F.transform(F.array(words), repeated), 1)  # words are cut out once
    return F.when(h % 10 == 0, once).otherwise(text)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 6 words and 4 periods in all documents, after the planting of repetitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = word_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: All pairs of equal words a possible period apart, joined to stretches; of equal stretches the smallest period.
ORACLE = r"""WITH coded AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h FROM documents),
    docs AS (SELECT row, doc_id, words, len(words) AS n, h % 10 = 0 AS planted, (h // 10) % greatest(len(words), 1) AS a, (h // 10) % 8 AS e FROM coded),
    words AS MATERIALIZED (SELECT row, n, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + e)) ELSE i END] AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM docs)),
    equal AS (SELECT x.row, y.i - x.i AS q, x.i FROM words x JOIN words y ON y.row = x.row AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS part FROM equal)
      GROUP BY row, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS MATERIALIZED (SELECT * FROM stretches QUALIFY row_number() OVER (PARTITION BY row, start, length ORDER BY q) = 1),
    gone AS (SELECT DISTINCT row, unnest(range(start + q, start + length)) AS i FROM runs),
    texts AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row, i) GROUP BY row),
    digests AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY row),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length / q DESC, start, q) = 1)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
    FROM docs LEFT JOIN digests USING (row) LEFT JOIN best USING (row) LEFT JOIN texts USING (row)"""
