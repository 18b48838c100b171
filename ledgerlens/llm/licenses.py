"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds all templates (base phrases, notices, whole short licences, openings of long ones: see
``notices``). A text streams through it and leaves matching statistics: at each word, the longest run of words
ending there that occurs in some template. From them

* base places: a phrase ends at a word if the phrase is a suffix of the match there, read off the
  state's suffix links;
* spans: where the match has at least ``min_match`` words, the state tells every place of a template that ends so.
  Followed from word to word, they give the matches that neither side can grow, per template. These are chained in
  template order, with at most ``max_gap`` words between two of them in the text (a name in place of "the copyright
  holder"). Of the chains that share their first match the one that covers most words counts. From a share of
  ``min_cover`` of the template's words on, a chain is a span.

Licences quote each other, so spans overlap. A span inside another one yields to it if that one covers more words, or as
many and more of its template: the two-clause text inside the three-clause one, version 2 where the text says 3. Where
templates of different labels are equal in both (a notice without its version) the text does not decide, and
neither labels it.

Only runs of words whose neighbours stand next to each other in some template can match, so numpy finds
those first (by 64-bit hashes of the words) and the automaton walks just them: the rest of a text costs no step.
Each document is scanned alone; there is no shuffle. The automaton grows with the templates (a parameter), not
with the corpus: the standard ones have some 3,000 words and take about 26 MB of a worker, which builds it once.

``score`` is the largest covered share of a template, 1 where a base phrase stands. ``labels`` are the
base labels and those of the spans; a span's label may equal a base label.

Defined cases: a null or empty text has no words, no labels, null first and last word, and score 0;
overlapping places all count; repeated rows and null ids are passed on; an empty table gives no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.notices import standard
from ledgerlens.llm.shared import slices
from ledgerlens.llm.words import ALPHANUMERIC, words

# Phrases and labels of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
MIN_MATCH = 3
MAX_GAP = 8
MIN_COVER = 0.8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences; words are small ints."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (template, end) per state

    def _state(self, size: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _grow(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def add(self, template: int, sequence: list[int]) -> None:
        last = 0
        for end, word in enumerate(sequence, 1):
            last = self._grow(last, word)
            self.ends[last].add((template, end))

    def close(self) -> None:
        """Hand the end positions down the suffix links."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = n = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            yield state, n


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.base = [label for label in base.values()]
        phrases = [template_words(p) for p in [*base, *notices]]
        self.labels = list(base.values()) + list(notices.values())
        vocabulary = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = words(pa.array([" ".join(vocabulary)]), ALPHANUMERIC).hashes()
        order = np.argsort(hashes)
        self.known, self.number = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known & np.uint64(0xFFFF)] = True
        pairs = {number[a] * len(number) + number[b] for p in phrases for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.lengths = [len(p) for p in phrases]
        self.shortest = min(min_match, *self.lengths)
        self.automaton = Automaton()
        for t, p in enumerate(phrases):
            self.automaton.add(t, [number[w] for w in p])
        self.automaton.close()
        auto = self.automaton
        # per state the base phrases that end where its match ends: (words, template)
        self.phrase_ends = [sorted({(self.lengths[t], t) for t, end in ends if t < len(base) and end == self.lengths[t]})
                            for ends in auto.ends]
        # per state the ancestor of its suffixes of min_match words, whose places are all that end so
        self.anchor = [0] * len(auto.next)
        for state in sorted(range(1, len(auto.next)), key=auto.size.__getitem__):
            if auto.size[state] >= min_match:
                self.anchor[state] = state if auto.size[auto.link[state]] < min_match else self.anchor[auto.link[state]]

    def known_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words and their numbers."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        slot = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        real = self.known[slot] == hashes[at]
        return at[real], self.number[slot[real]]

    def runs(self, at: np.ndarray, number: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bounds of runs of template words of one row in which every two neighbours are neighbours in a template."""
        if not len(at):
            return
        pair = number[:-1].astype(np.int64) * len(self.known) + number[1:]
        cut = (np.diff(at) != 1) | (np.diff(row) != 0) | ~np.isin(pair, self.pairs)
        cuts = np.flatnonzero(np.r_[True, cut, True])
        long = np.flatnonzero(np.diff(cuts) >= self.shortest)
        yield from zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True)

    def scan(self, run: list[int], start: int, places: list, matches: list) -> None:
        """Collect base places (start, phrase) and matches (template, start, end, end in it) of a run of words."""
        auto = self.automaton
        open_: dict[tuple[int, int], int] = {}  # place of a template -> where its match starts
        for i, (state, n) in enumerate(auto.statistics(run), start):
            s = state
            while s > 0:
                for length, t in self.phrase_ends[s]:
                    # in the state itself the match may be shorter than the state's longest word sequence
                    if length <= (n if s == state else auto.size[s]) and length > auto.size[auto.link[s]]:
                        places.append((i + 1 - length, t))
                s = auto.link[s]
            now = auto.ends[self.anchor[state]] if n >= self.min_match else ()
            if open_ or now:
                grown = {(t, at): open_.pop((t, at - 1), i + 1 - self.min_match) for t, at in now}
                matches.extend((t, first, i, at) for (t, at), first in open_.items())
                open_ = grown
        matches.extend((t, first, start + len(run), at) for (t, at), first in open_.items())

    def chains(self, entries: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Best chain per first match of one template: (first word, end, covered words).

        An entry is a match (start, end) in the text and its end in the template, in order of ``end``.
        """
        worth: list[int] = []
        origin: list[int] = []
        best: dict[int, tuple[int, int]] = {}  # first entry -> covered words, end
        for i, (start, end, at) in enumerate(entries):
            most, root = end - start, i
            for j in range(i - 1, -1, -1):
                _, before, at_before = entries[j]
                if start - before > self.max_gap:
                    break
                if before < end and at_before < at:
                    # words shared with the match before, in the text or in the template, count once
                    total = worth[j] + min(end - start, end - before, at - at_before)
                    if total > most:
                        most, root = total, origin[j]
            worth.append(most)
            origin.append(root)
            if most > best.get(root, (0, 0))[0]:
                best[root] = (most, end)
        return [(entries[root][0], end, most) for root, (most, end) in best.items()]

    def found(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains of all templates: (template, first word, end, covered words)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, *match in sorted(matches, key=lambda m: (m[2], m[1], m[3])):
            by_template.setdefault(t, []).append(tuple(match))
        return [(t, *chain) for t, entries in by_template.items() for chain in self.chains(entries)]

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains that cover enough and yield to no other: (label, first word, end, covered share)."""
        good: dict[tuple[int, float, int, int], set[str]] = {}
        for t, first, end, covered in found:
            share = min(1.0, covered / self.lengths[t])
            if share >= self.min_cover:
                good.setdefault((covered, share, first, end), set()).add(self.labels[t])
        kept: list[tuple[str, int, int, float]] = []
        places: list[tuple[int, int]] = []  # reach further right the further left they start
        for (_, share, first, end), labels in sorted(good.items(), key=lambda g: (-g[0][0], -g[0][1], g[0][2:])):
            near = bisect.bisect_right(places, (first, math.inf))
            if near and places[near - 1][1] >= end:
                continue
            while near < len(places) and places[near][1] <= end:
                del places[near]
            places.insert(near, (first, end))
            if len(labels) == 1:
                kept.append((*labels, first, end, share))
        return sorted(kept, key=lambda k: (k[1], k[2]))


@functools.lru_cache(maxsize=1)
def _scanner(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], min_match: int, max_gap: int,
             min_cover: float) -> Scanner:
    return Scanner(dict(base), dict(notices), min_match, max_gap, min_cover)


def licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
             min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    rule = (tuple((BASE if base is None else base).items()), tuple((standard() if notices is None else notices).items()),
            min_match, max_gap, min_cover)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>")
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*rule)
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), ALPHANUMERIC, lower=True)
            rows = batch.num_rows
            places: list[list] = [[] for _ in range(rows)]
            matches: list[list] = [[] for _ in range(rows)]
            at, number = scanner.known_words(w.hashes())
            row = np.searchsorted(w.first, at, side="right") - 1
            for lo, hi in scanner.runs(at, number, row):
                r = int(row[lo])
                scanner.scan(number[lo:hi].tolist(), int(at[lo] - w.first[r]), places[r], matches[r])
            out: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for r in range(rows):
                found = scanner.found(matches[r])
                good = scanner.spans(found)
                starts = [p for p, _ in places[r]]
                own = {scanner.labels[t] for _, t in places[r]}
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {label for label, *_ in good})))
                out["score"].append(1.0 if starts else max((min(1.0, c / scanner.lengths[t]) for t, *_, c in found), default=0.0))
                out["spans"].append([{"label": label, "first": a, "last": b - 1, "cover": c} for label, a, b, c in good])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(out["n_base"], pa.int64()),
                 pa.array(out["first_word"], pa.int64()), pa.array(out["last_word"], pa.int64()),
                 pa.array(out["base_labels"], pa.string()), pa.array(out["labels"], pa.string()),
                 pa.array(out["score"], pa.float64()), pa.array(out["spans"], span_type)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
