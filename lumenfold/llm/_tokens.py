"""Token ids of whole texts by a public tokenizer file, over the buffers of Arrow string columns.

Both tokenizers cut texts at white space before anything else looks at them, so a text's ids are those of its units
in turn.  Where the tokenizer drops white space, a unit is a run of bytes other than white space.  Where it keeps it, a unit is
such a run with the space before it, and what else there is of white space makes units of its own: all of a run but its last
character, and the last character if it is no space (at the end of a text the whole run).  Both cut between a letter or digit and
ASCII punctuation behind it, and between such punctuation, the apostrophe apart, and a letter or digit behind it; so do units.

Units recur, texts don't.  A unit's hash leads to its ids in a table of bounded size; the tokenizer itself is asked for units
that the table lacks.  Texts with signs of special tokens, and where white space is kept those with other than ASCII white
space, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from lumenfold.llm._text import CHUNK, SPACE, kept, mix, tenant, word_hashes, words

#: Units whose ids are kept at most (about 60 bytes each, in a table half full).
CACHE = 400_000
#: Longer units (bytes) aren't kept.
CACHE_BYTES = 64

#: Unicode's White_Space beyond ASCII, which the tokenizers' patterns call \\s.
_SIGN = re.compile("<\\|")
_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
#: First bytes of those characters and the first sign of special tokens.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = True
#: ASCII letters and digits 1, punctuation 2, the apostrophe 3.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 3
_U = np.uint64

_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself where it prints, else one from U+0100 on in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def _inner_cuts(data: np.ndarray) -> np.ndarray:
    """Places between a letter or digit and punctuation, as the module's text says; letters are ASCII and Latin-1 here."""
    kind = _KIND[data]
    letter = kind[:-1] == 1
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1  # the second byte of a Latin-1 letter, but for the signs of multiplication and division
    wide = wide[(data[wide] != 0x97) & (data[wide] != 0xB7) & (wide < len(data) - 1)]
    letter[wide] = True
    return np.flatnonzero((letter & (kind[1:] > 1)) | ((kind[:-1] == 2) & (kind[1:] == 1))) + 1


class Table:
    """64-bit keys to numbers from 0, by open addressing in NumPy arrays."""

    def __init__(self, most: int) -> None:
        self.bits = max(4, (2 * most - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where there is none; no key is 0."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot, mask = np.arange(len(keys)), self._slots(keys), (1 << self.bits) - 1
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet; the table must stay at most half full."""
        slot, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several for one slot one stays
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & mask


class Encoder:
    """ids of texts; ``keep_space``: the tokenizer turns white space into ids, else it drops it."""

    def __init__(self, path: str, keep_space: bool, most: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.keep_space, self.most = keep_space, most
        # units that are one word of Latin letters go to the model as they are: nothing before it would change or cut them
        self.simple = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+" if keep_space else "[a-zß-öø-ÿ]+").fullmatch
        self._forget()

    def _forget(self) -> None:
        self.table, self.pool = Table(self.most), np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)  # where each kept unit's ids begin in the pool

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts by the tokenizer, one after another, and where each one's begin."""
        found = []
        for t in texts:
            if not self.keep_space and t.isascii():
                t = t.lower()
            if self.simple(t):
                found.append([x.id for x in self.model.tokenize(t.encode().decode("latin-1").translate(self.letters))])
            else:
                found.append(self.tokenizer.encode(t, add_special_tokens=False).ids)
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all units in order, and for each row where its units begin."""
        starts, ends, at = words(data, offsets)
        inner = _inner_cuts(data) if len(data) > 1 else np.zeros(0, np.int64)
        if len(inner):
            begins = np.zeros(len(data) + 1, bool)
            begins[starts] = True  # a word of the next row may begin right behind one
            inner = inner[~begins[inner]]
        if not self.keep_space:
            s = np.sort(np.concatenate([starts, inner]))
            return s, np.sort(np.concatenate([ends, inner])), np.searchsorted(s, offsets)
        # the white space before each word and at each row's end: from the end of the word before it, or the row's start
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        before = np.empty(len(starts), np.int64)
        before[1:] = ends[:-1]
        first = at[:-1][at[1:] > at[:-1]]
        before[first] = offsets[rows[first]]
        tail = np.where(at[1:] > at[:-1], ends[at[1:] - 1] if len(ends) else 0, offsets[:-1])
        white = starts > before
        space = white.copy()
        space[white] = data[starts[white] - 1] == 32
        own = starts - space  # words with the space before them
        last = white & ~space
        rest_end = starts - white  # all of the run but its last character
        rest = rest_end > before
        end = tail < offsets[1:]
        s = np.concatenate([np.sort(np.concatenate([own, inner])), starts[last] - 1, before[rest], tail[end]])
        e = np.concatenate([np.sort(np.concatenate([ends, inner])), starts[last], rest_end[rest], offsets[1:][end]])
        order = np.argsort(s, kind="stable")
        s = s[order]
        return s, e[order], np.searchsorted(s, offsets)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that must not be cut."""
        at = np.flatnonzero(_MAYBE[data])
        rows = np.unique(np.searchsorted(offsets, at, side="right") - 1)
        return [int(r) for r in rows if (_WHITE if self.keep_space else _SIGN).search(data[offsets[r] : offsets[r + 1]].tobytes().decode())]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e, at = self._units(data, offsets)
        h = word_hashes(data, s, e, lower=not self.keep_space)
        h[h == 0] = _U(1)
        known = self.table.find(h)
        missing = np.flatnonzero(known < 0)
        pool, begin = self.pool, self.begin
        if len(missing):
            keys, first = np.unique(h[missing], return_index=True)
            one = missing[first]
            raw = data.tobytes()
            ids, where = self._ids([raw[a:b].decode() for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)])
            number = len(begin) - 1 + np.arange(len(keys))
            pool, begin = np.concatenate([pool, ids]), np.concatenate([begin, len(pool) + where[1:]])
            known[missing] = number[np.searchsorted(keys, h[missing])]
            keep = e[one] - s[one] <= CACHE_BYTES
            if len(begin) - 1 > self.most or not keep.all():
                # what is too long or too much serves this call alone
                if len(self.begin) - 1 + int(keep.sum()) > self.most:
                    self._forget()
                room = np.flatnonzero(keep)[: self.most]
                sizes = np.diff(where)[room]
                spots = np.repeat(where[:-1][room] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(room) else np.zeros(0, np.int64)
                self.table.add(keys[room], (len(self.begin) - 1 + np.arange(len(room))).astype(np.int32))
                self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
                self.pool = np.concatenate([self.pool, ids[spots]])
            else:
                self.table.add(keys, number.astype(np.int32))
                self.pool, self.begin = pool, begin
        size = np.diff(begin)[known]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(begin[:-1][known] - until[:-1], size) + np.arange(until[-1])]
        return ids, until[at]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (bytes and row offsets of a string column), and for each row where its ids begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        whole = self._whole(data, offsets)
        extra = [np.zeros(0, np.int64)]
        for r in np.flatnonzero(np.diff(offsets) > CHUNK):  # a long row is worked on in parts, cut before a single space
            lone = data[offsets[r] : offsets[r + 1]]
            at = np.flatnonzero((lone[1:-1] == 32) & ~SPACE[lone[:-2]] & ~SPACE[lone[2:]]) + 1 + offsets[r]
            if len(at):
                extra.append(at[np.unique(np.searchsorted(at, np.arange(offsets[r] + CHUNK, offsets[r + 1], CHUNK)).clip(max=len(at) - 1))])
        inner = np.concatenate(extra)
        cuts = np.sort(np.concatenate([offsets, inner]))
        parts, until = [], [np.zeros(1, np.int64)]
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + CHUNK, side="right")) - 1)
            ids, begin = self._encode(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
            parts.append(ids)
            until.append(begin[1:] + until[-1][-1])
            lo = hi
        ids = np.concatenate(parts)
        begin = np.concatenate(until)[np.arange(len(offsets)) + np.searchsorted(inner, offsets)]
        if whole:
            mine, where = self._ids([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in whole])
            rows = [ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            for k, r in enumerate(whole):
                rows[r] = mine[where[k] : where[k + 1]]
            ids, begin = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, begin


def encoder(path: str, keep_space: bool, most: int = CACHE) -> Encoder:
    """This worker's encoder for a tokenizer file, until a task of another kind runs here."""
    tenant(path)
    kept[path] = _encoders.clear
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = Encoder(path, keep_space, most)
    return _encoders[path, keep_space]
