"""Token ids of whole texts, with each distinct unit of text encoded once per worker.

A text is cut at places where no token can cross whatever stands around them (before a single
space or a line break between two visible characters, and before an ASCII sign other than an apostrophe
after a letter), so its ids are those of its units, one after another. Units are found on the bytes with numpy; each
distinct one is encoded by the ``tokenizers`` library and kept in a bounded cache of the worker process.

Most units are words or signs that a byte-level tokenizer does not split before its merges. These go to the
library's model at once, which gives the same ids for a quarter of the time; all others, and all units of
other kinds of tokenizer, go through its whole encoding.

Strings of the tokenizer's added tokens are taken for those tokens wherever a text holds them, as the file says. They
are units of their own, and the text between them is cut like a row; a file whose added tokens also take the space
around them, or look at a normalised text, has whole rows as units.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerlens.llm.words import _BYTE_CODE, flat, mix, rolling

CACHE_UNITS = 400_000
LONG_UNIT = 64  # longer units are encoded each time
ENCODED_AT_ONCE = 2_000  # units; an encoding takes some hundred times the memory of its ids

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: First bytes of characters that are certainly not white space (white space starts with C2, E1, E2 or E3).
_VISIBLE_LEAD = _VISIBLE.copy()
_VISIBLE_LEAD[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xEE), *range(0xF0, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Signs that end a word; an apostrophe may belong to it.
_SIGN = _VISIBLE & ~_LETTER
_SIGN[[0x27, *range(0x30, 0x3A)]] = False
#: First bytes of characters of two bytes that are letters, all but C3 97 and C3 B7 (the signs of times and division).
_LETTER_LEAD = np.zeros(256, bool)
_LETTER_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: One piece for a byte-level tokenizer: a word of the letters above, digits, or signs, with at most a space before it.
ONE_PIECE = re.compile(rb" ?(?:(?:[A-Za-z]++|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC9\xD0\xD1][\x80-\xBF])++|[0-9]++|[!-&(-/:-@\[-`{-~]++)")


def _byte_names() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which units start; every row starts one."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 2:
        before, two_before, after = np.r_[np.uint8(0), data[:-1]], np.r_[np.uint8(0), np.uint8(0), data[:-2]], np.r_[data[1:], np.uint8(0)]
        two_byte = ((before & 0xC0) == 0x80) & (two_before >= 0xC3) & (two_before < 0xE0)
        solid = _VISIBLE[before] | two_byte
        gap = solid & _VISIBLE_LEAD[after]
        line = gap & (data == 0x0A)
        letter_pair = ((before & 0xC0) == 0x80) & _LETTER_LEAD[two_before] & ~((two_before == 0xC3) & ((before == 0x97) | (before == 0xB7)))
        start[:-1] = gap & (data == 0x20) | line | _SIGN[data] & (_LETTER[before] | letter_pair)
        start[1:] |= line
        # the first and last byte of a row have no neighbours in it
        begins = at[:-1][np.diff(at) > 0]
        start[at[1:] - 1] = False
        start[np.minimum(begins + 1, n)] = False
    start[at[:-1]] = True
    start[n] = False
    return np.flatnonzero(start)


class Encoder:
    """Ids of Arrow string columns; one per worker process and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in added)
        longest_first = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.model = self._one_piece_model(longest_first)
        self.clear()

    def _one_piece_model(self, added: list[bytes]):
        """The model, if it alone gives the ids of a unit that is ``ONE_PIECE``."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        splitter, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        alone = (isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space and not self.tokenizer.normalizer
                 and isinstance(model, BPE) and not model.dropout and not any(map(ONE_PIECE.fullmatch, added)))
        return model if alone else None

    def clear(self) -> None:
        self.known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted keys, first id, number of ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _units(self, data: np.ndarray, raw: bytes, at: np.ndarray) -> np.ndarray:
        """Start of each unit of the rows that begin at ``at``."""
        if not self.plain:
            return np.unique(at[:-1])
        spans, pos = [], 0
        while self.added and (m := self.added.search(raw, pos)):
            row = np.searchsorted(at, m.start(), "right")
            if m.end() <= at[row]:
                spans.append(m.span())
                pos = m.end()
            else:  # put together from two rows
                pos = m.start() + 1
        if not spans:
            return unit_starts(data, at)
        starts = unit_starts(data, np.union1d(at, np.ravel(spans)))
        first, last = np.array(spans).T
        around = np.searchsorted(first, starts, "left") - 1  # the last added token before each start
        within = (around >= 0) & (starts < last[np.maximum(around, 0)])
        return starts[~within]

    def _encode(self, units: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(units)
        if self.model:
            tokenize, fits = self.model.tokenize, ONE_PIECE.fullmatch
            out = [[t.id for t in tokenize(u.decode("latin-1").translate(_BYTE_NAMES))] if fits(u) else None for u in units]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([units[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _store(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each unit, encoded and kept."""
        n = np.zeros(len(units), np.int64)
        begin = self.used
        for lo in range(0, len(units), ENCODED_AT_ONCE):
            encoded = self._encode(units[lo:lo + ENCODED_AT_ONCE])
            own = np.fromiter(map(len, encoded), np.int64, len(encoded))
            total = int(own.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
            n[lo:lo + len(encoded)] = own
            self.used += total
        return begin + np.cumsum(n) - n, n

    def _lookup(self, keys: np.ndarray, units) -> tuple[np.ndarray, np.ndarray]:
        first, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for have, at, count in self.known:
            slot = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[slot] == keys
            first[hit], n[hit] = at[slot[hit]], count[slot[hit]]
        missing = np.flatnonzero(n < 0)
        if len(missing):
            first[missing], n[missing] = self._store([units(i) for i in missing])
            self.known.append((keys[missing], first[missing], n[missing]))
            while len(self.known) > 1 and len(self.known[-2][0]) < 2 * len(self.known[-1][0]):
                both = [np.concatenate(x) for x in zip(*self.known[-2:], strict=True)]
                order = np.argsort(both[0], kind="stable")  # two sorted runs, merged
                self.known[-2:] = [tuple(x[order] for x in both)]
        return first, n

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the bounds of the rows."""
        if sum(len(k) for k, _, _ in self.known) > CACHE_UNITS:
            self.clear()
        data, at = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        starts = self._units(data, raw, at)
        starts = starts[starts < len(data)]
        ends = np.r_[starts[1:], len(data)]
        first, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(ends - starts <= LONG_UNIT)
        hashes = mix(rolling(_BYTE_CODE[data], starts[short], ends[short], 0))
        keys, example, place = np.unique(hashes, return_index=True, return_inverse=True)
        example = short[example]
        a, b = self._lookup(keys, lambda i: raw[starts[example[i]]:ends[example[i]]])
        first[short], n[short] = a[place], b[place]
        long = np.flatnonzero(ends - starts > LONG_UNIT)
        mark = self.used
        if len(long):
            first[long], n[long] = self._store([raw[starts[i]:ends[i]] for i in long])
        total = np.cumsum(n)
        out = self.ids[np.arange(total[-1]) - np.repeat(total - n - first, n)]
        self.used = mark  # the long ones are not kept
        return out, np.r_[0, total][np.searchsorted(starts, at)]
