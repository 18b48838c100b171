"""Substring dedup with fixed-block anchors.

A repeat of ``window`` words holds one whole block of ``block = (window + 1) // 2`` words that
starts at a multiple of ``block`` in the one text, and the same words at any place in the other. So

1. index: the non-overlapping blocks of every text; probe: every rolling window of ``block``
   words of every text. Both go to hash buckets (``exchange``): a chunk sends its distinct hashes with
   two bits, "is an indexed block here" and "more than once here". A bucket marks hashes
   that are indexed somewhere and occur at least twice: the anchors.
2. extension: an anchor is extended to the windows of ``window`` words that contain it and lie
   in its text. Their 128-bit hashes (96 bits travel) go to buckets, which confirm those that
   occur at least twice anywhere. Runs of confirmed windows are the maximal exact repeats.
3. every word of a confirmed window is removed; windows are judged on the input.

Hashes of the first step only nominate (a false one costs a window that step 2 refutes), and
no pair of occurrences is ever formed: a passage in thousands of texts is one entry per chunk.
Chunks of text are written once and read three times.

Defined cases: a null or empty text has no words, and its kept text is empty; texts shorter than
``window`` words lose nothing; repeated rows are repeats of each other; a text may repeat itself
(overlapping occurrences count); null ids are passed on; an empty table gives no rows. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import exchange as X
from ledgerlens.llm.shared import materialize
from ledgerlens.llm.words import Words, mix, rolling, windows, words

WINDOW = 35
REMAINDER = 40  # bits of an anchor hash that travel besides its bucket


def _anchor_keys(w: Words, hashes: np.ndarray, window: int, block: int, bits: int):
    """Places of rolling windows in texts of at least ``window`` words, their keys, and whether they are blocks."""
    at, h = windows(hashes, w.first, block)
    size, begin = np.diff(w.first)[w.row[at]], w.first[:-1][w.row[at]]
    long = size >= window
    at, h, begin = at[long], h[long], begin[long]
    return at, h >> np.uint64(64 - bits - REMAINDER), (at - begin) % block == 0


def _distinct(keys: np.ndarray):
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    begins = np.flatnonzero(head)
    counts = np.diff(np.r_[begins, len(keys)])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return ordered[begins], counts, inverse, begins, order


def _anchor_entries(remainders: np.ndarray, indexed: np.ndarray, many: np.ndarray) -> bytes:
    n = len(remainders)
    return (np.uint32(n).tobytes() + remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :REMAINDER // 8].tobytes()
            + np.packbits(indexed).tobytes() + np.packbits(many).tobytes())


def _read_anchor_entries(data: bytes):
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    wide = np.zeros((n, 8), np.uint8)
    step = REMAINDER // 8
    wide[:, :step] = np.frombuffer(data, np.uint8, step * n, 4).reshape(n, step)
    rest = np.frombuffer(data, np.uint8, offset=4 + step * n)
    half = (n + 7) // 8
    return (wide.view("<u8").ravel(), np.unpackbits(rest[:half], count=n).astype(bool),
            np.unpackbits(rest[half:2 * half], count=n).astype(bool))


def _spread(marked: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(marked, np.cumsum(sizes)[:-1])]


def _find_anchors(entries: list[bytes]) -> list[bytes]:
    parts = [_read_anchor_entries(e) for e in entries]
    keys, counts, inverse, begins, order = _distinct(np.concatenate([p[0] for p in parts]))
    indexed, many = (np.concatenate([p[i] for p in parts])[order] for i in (1, 2))
    hit = np.logical_or.reduceat(indexed, begins) & ((counts > 1) | np.logical_or.reduceat(many, begins))
    return _spread(hit[inverse], [len(p[0]) for p in parts])


def _confirm(entries: list[bytes]) -> list[bytes]:
    """Entries: n, then n hashes of 64 bits, n of 32 bits, n bits "more than once in this chunk"."""
    sizes = [int(np.frombuffer(e, np.uint32, 1)[0]) for e in entries]
    one = np.concatenate([np.frombuffer(e, "<u8", n, 4) for e, n in zip(entries, sizes, strict=True)])
    two = np.concatenate([np.frombuffer(e, "<u4", n, 4 + 8 * n) for e, n in zip(entries, sizes, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8, offset=4 + 12 * n), count=n).astype(bool)
                           for e, n in zip(entries, sizes, strict=True)])
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    begins = np.flatnonzero(head)
    hit = (np.diff(np.r_[begins, len(a)]) > 1) | np.logical_or.reduceat(many[order], begins)
    marked = np.empty(len(a), bool)
    marked[order] = hit[np.cumsum(head) - 1]
    return _spread(marked, sizes)


def _candidates(w: Words, hashes: np.ndarray, window: int, block: int, bits: int, answer: list[bytes]):
    """Windows that contain an anchor: places, first and second hash."""
    at, keys, _ = _anchor_keys(w, hashes, window, block, bits)
    distinct, _, inverse, _, _ = _distinct(keys)
    counts = np.unique(distinct >> np.uint64(REMAINDER), return_counts=True)[1]
    hit = X.bits_of(answer, counts.tolist())[inverse]
    anchors = np.zeros(len(hashes) + 1, np.int64)
    anchors[1:][at[hit]] = 1
    anchors = np.cumsum(anchors)
    places, one = windows(hashes, w.first, window)
    reach = window - block  # an anchor starts at most so far behind the window's start
    inside = anchors[np.minimum(places + reach + 1, len(hashes))] > anchors[places]
    places, one = places[inside], one[inside]
    if not len(places):
        return places, one, one
    two = mix(rolling(mix(hashes, 2), places, places + window, 2), 2)
    return places, one, two


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text, kept_sha256."""
    block = (window + 1) // 2
    chunked = X.chunks(docs.select("doc_id", "text"), "repeat-chunks")
    # about six bytes a word and one key a word
    bits = X.bucket_bits(chunked, X.total(chunked, "bytes") / 6)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0), batch.column(1), strict=True):
                w = words(X.unseal(payload.as_py()).column("text"))
                _, keys, indexed = _anchor_keys(w, w.hashes(), window, block, bits)
                distinct, counts, _, begins, order = _distinct(keys)
                blocks = np.logical_or.reduceat(indexed[order], begins) if len(keys) else indexed
                rest = distinct & np.uint64((1 << REMAINDER) - 1)
                yield X.by_bucket(chunk.as_py(), distinct, bits,
                                  lambda lo, hi, r=rest, b=blocks, c=counts: _anchor_entries(r[lo:hi], b[lo:hi], c[lo:hi] > 1),
                                  bits + REMAINDER)

    anchors = materialize(X.answers(chunked.select("chunk", "payload").mapInArrow(probe, X.ASKED_SQL), _find_anchors), "anchors")

    def extend(chunk: int, payload: bytes, answer: pa.Table) -> pa.Table:
        w = words(X.unseal(payload).column("text"))
        _, one, two = _candidates(w, w.hashes(), window, block, bits, answer.column("answer").to_pylist())
        keys, counts, _, begins, order = _distinct(one)
        check = two[order][begins].astype("<u4") if len(one) else two
        return pa.Table.from_batches([X.by_bucket(chunk, keys, bits, lambda lo, hi: (
            np.uint32(hi - lo).tobytes() + keys[lo:hi].astype("<u8").tobytes() + check[lo:hi].tobytes()
            + np.packbits(counts[lo:hi] > 1).tobytes()))])

    confirmed = materialize(X.answers(X.told(chunked, anchors, extend, X.ASKED_SQL), _confirm), "confirmed")

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string"

    def remove(chunk: int, payload: bytes, answer: pa.Table) -> pa.Table:
        batch = X.unseal(payload)
        w = words(batch.column("text"))
        rows = list(zip(answer.column("step").to_pylist(), answer.column("answer").to_pylist(), strict=True))
        places, one, _ = _candidates(w, w.hashes(), window, block, bits, [a for s, a in rows if s == 1])
        keys, _, inverse, _, _ = _distinct(one)
        counts = np.unique(keys >> np.uint64(64 - bits), return_counts=True)[1]
        repeated = places[X.bits_of([a for s, a in rows if s == 2], counts.tolist())[inverse]] if len(places) else places
        edge = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        lost = np.diff(np.r_[0, np.cumsum(gone)][w.first])
        texts, digests = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = (text or "").encode().split()
            if lost[i]:
                own = compress(own, ~gone[w.first[i]:w.first[i + 1]])
            kept = b" ".join(own)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        return pa.table({"doc_id": batch.column("doc_id"), "n_words": np.diff(w.first).astype(np.int64),
                         "n_removed": lost.astype(np.int64), "kept_text": texts, "kept_sha256": digests})

    both = anchors.withColumn("step", F.lit(1)).unionByName(confirmed.withColumn("step", F.lit(2)))
    return X.told(chunked, both, remove, out)
