"""Token ids of whole texts by a public tokenizer, with every distinct word encoded once.

Both BPE vocabularies used here split a text before they merge, and no split piece reaches from a visible character into
the white space after it. A text can therefore be cut there, the pieces encoded apart, and the ids strung together; they
equal those of the whole text. Pieces repeat a lot, so the tokenizer only sees each distinct one (tests compare both ways).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from hexrisk.llm.text import SPACE, bytes_of, coded, span_hashes, word_bounds

#: Pieces a task remembers between batches (about 60 bytes each); beyond it the memory is emptied.
REMEMBERED = 1_000_000
#: New pieces are encoded in lines of so many, as a call for each costs more than the encoding.
LINE = 256


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # text that spells a special token stays ordinary text
    return tokenizer


def piece_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that keep all bytes: each begins at a text's start or where white space follows a visible character.

    A few characters beyond ASCII are white space too; after any that might be one, no cut is made.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = space[1:] & ~space[:-1]
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), raw[:-k]]) for k in (1, 2, 3))
    cut &= ~((one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
    cut[at[:-1][at[:-1] < at[1:]]] = True
    begin = np.flatnonzero(cut)
    return begin, np.concatenate([begin[1:], [len(raw)]])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this Python process; it lives on between tasks."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


class Encoder:
    """``encode`` gives the ids of several texts at once. ``spaced`` says that the vocabulary encodes white space."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer, self.spaced = load(path), spaced
        # Between the pieces of a line stands a mark that is always a token of its own.
        self.mark = "\n" if spaced else " | "
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys, and where their ids are
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one_by_one(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _in_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and how many each has; no piece may hold the mark."""
        lines = [pieces[i : i + LINE] for i in range(0, len(pieces), LINE)]
        flat, counts = [], []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([self.mark.join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == len(line) - 1:
                counts.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                flat.append(np.delete(ids, marks))
            else:
                apart = self._one_by_one(line)
                counts.append(np.array([len(x) for x in apart], np.int64))
                flat.append(np.array([i for x in apart for i in x], np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        mark = self.mark.strip(" ")
        # A piece that starts with one blank or none and has no other white space can stand in a line.
        odd = [mark in p or (self.spaced and (p[:2].isspace() or p[-1:].isspace() or len(p.split()) != 1)) for p in pieces]
        alone = self._one_by_one([p for p, o in zip(pieces, odd, strict=True) if o])
        flat, count = self._in_lines([p for p, o in zip(pieces, odd, strict=True) if not o])
        odd = np.array(odd, bool)
        keys = np.concatenate([keys[~odd], keys[odd]])
        count = np.concatenate([count, np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
        flat = np.concatenate([flat, np.array([i for x in alone for i in x], np.uint32)])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, flat])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        slots = len(self.slots) + order
        self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry for the end). No text is null."""
        raw, at = bytes_of(texts)
        begin, end = piece_bounds(raw, at) if self.spaced else word_bounds(raw, at)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        distinct, codes, where = coded(span_hashes(raw, begin, end))
        if len(self.keys) > REMEMBERED:
            self._forget()
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = self.keys[place] != distinct
        if new.any():
            spans = zip(begin[where[new]].tolist(), end[where[new]].tolist(), strict=True)
            data = raw.tobytes()
            self._learn(distinct[new], [data[b:e].decode("utf-8", "replace") for b, e in spans])
        slot = self.slots[np.searchsorted(self.keys, distinct)][codes]
        count = self.count[slot]
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[slot] - (upto - count), count) + np.arange(int(upto[-1]))]
        return ids, np.concatenate([[0], upto])[np.searchsorted(begin, at)]
