"""LM scoring with a probabilistic suffix tree over words.

Counts come from all training documents and stay in tables that are hash-partitioned; nothing that grows with the
corpus is collected or broadcast. Each chunk of documents asks hash buckets and gets answers in order (``exchange``).
Texts are cut into words once: a chunk holds its distinct word hashes and the place of every token among them.

1. Words: each chunk sends its distinct words (64-bit hashes) with their training counts; the answers are
   the counts over all chunks and the words' vocabulary numbers (place in the bucket by falling count, then the
   bucket, so that the numbers of frequent words are small and compress well).
   They give the base score, the number of known words, and the probability without context.
2. For each depth, a context is a run of that many words that training documents hold at least
   ``min_count`` times, known from the answers of the depth before. A chunk sends the distinct pairs of such
   a context and the word (or end) after it, with their training counts and the probability that the longest
   retained suffix of the context gives (without a suffix, the count that gives it). The buckets, by context, add up the counts and test the context.
   Every continuation counts, also one seen once.
3. A context is retained if the divergence (Kullback-Leibler, in nats) of its next-word distribution from the
   one of its longest retained suffix is at least ``min_divergence``. Its distribution is smoothed
   towards that suffix's: ``(count + smoothing * suffix) / (context count + smoothing)``, which sums to 1.
   The answers are the counts of the pairs and the result of the test.
4. Scoring reads all answers of a chunk; each word is predicted by its longest retained suffix.

Skew: a pair is one entry per chunk. A context with more training occurrences than the average bucket is
dealt to several buckets by its next words; their parts of the divergence (at most two per bucket) are added up on the
driver, which tells the chunks which of these contexts fail.

Defined cases: a null or empty text is the end token alone; without training documents nothing is known
and the end token has probability 1 in the base; null ids take the fold of the empty text; repeated
rows count as often as they occur; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import exchange as X
from ledgerlens.llm.shared import materialize, paths_written, remove, shuffles_deleted
from ledgerlens.llm.words import mix, words

FOLDS = 10
MIN_COUNT = 2
DEPTH = 3
MIN_DIVERGENCE = 0.01
SMOOTHING = 10.0
ADD = 0.1  # fixed by the contract's base score
CHUNK_BYTES = 8 << 20

END_HASH = np.uint64(0x5BD1E9955BD1E995)
NUMBER = np.uint64(32)  # bits of a vocabulary number beside a local context number

COUNTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("answer", pa.binary()),
                    ("tokens", pa.int64()), ("known", pa.int64()), ("size", pa.int64())])
COUNTS_SQL = "bucket int, chunk long, answer binary, tokens long, known long, size long"


def in_training(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds != 0 for i in ids], bool)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, where each appears first, and the place of every value among them; by hashing."""
    import pandas as pd

    place, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[place[::-1]] = np.arange(len(values))[::-1]
    return found, first, place


def _tokens(batch: pa.RecordBatch, folds: int):
    """Distinct token hashes of a chunk, place of each token among them, training counts, row bounds."""
    w = words(batch.column("text"), lower=True)
    rows = batch.num_rows
    n = np.diff(w.first)
    train = in_training(batch.column("doc_id").to_pylist(), folds)
    found, _, at = distinct(np.r_[w.hashes(), np.full(rows, END_HASH)])
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, place = found[order], rank[at]
    counts = np.bincount(place, np.r_[np.repeat(train, n), train].astype(float), len(keys)).astype(np.int64)
    return keys, place[:len(w.starts)], place[len(w.starts):], counts, w.first, train


def sealed(batch: pa.RecordBatch, folds: int) -> tuple[bytes, bytes]:
    """The ids and tokens of a chunk; its distinct tokens and their training counts.

    Tokens are written by falling frequency, so most are small numbers, which compress well.
    """
    keys, place, ends, counts, first, train = _tokens(batch, folds)
    order = np.argsort(-np.bincount(np.r_[place, ends], minlength=len(keys)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = X.seal(pa.RecordBatch.from_arrays([batch.column("doc_id")], names=["doc_id"]))
    tokens = _zip(order.astype("<u4"), rank[place].astype("<u4"), rank[ends].astype("<u4"), first.astype("<i8"), train.astype("u1"))
    return np.array([len(ids), len(keys), len(place), len(train)], "<i8").tobytes() + ids + tokens, _pack(keys, counts)


def unsealed(payload: bytes) -> tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids, the number of distinct tokens, and place, ends, first and train as in ``_tokens``."""
    size, k, n, rows = np.frombuffer(payload, "<i8", 4).tolist()
    order, place, ends, first, train = _unzip(payload[32 + size:], ("<u4", k), ("<u4", n), ("<u4", rows), ("<i8", rows + 1), ("u1", rows))
    return X.unseal(payload[32:32 + size]), k, order[place].astype(np.int64), order[ends].astype(np.int64), first, train.astype(bool)


def _zip(*parts: np.ndarray) -> bytes:
    """Compressed with the first bytes of all numbers first, as most numbers are small."""
    import zstandard

    planes = [np.ascontiguousarray(np.ascontiguousarray(p).view(np.uint8).reshape(len(p), p.itemsize).T) for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unzip(data: bytes, *parts: tuple[str, int | None]) -> list[np.ndarray]:
    """The arrays of ``_zip``, by type and length; without lengths, all have the same."""
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    alike = len(raw) // sum(np.dtype(kind).itemsize for kind, _ in parts)
    for kind, n in parts:
        n, width = alike if n is None else n, np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _zip(keys.astype("<u8"), counts.astype("<i8"))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = _unzip(data, ("<u8", None), ("<i8", None))
    return keys, counts


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]):
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, np.concatenate([c for _, c in parts]))
    return keys, sums, place


def word_counts(chunked: DataFrame, bits: int) -> DataFrame:
    """Answers per chunk and bucket: training count and place in the bucket, by falling count, of each of the chunk's distinct tokens.

    One more row per bucket (chunk -1) has its number of training tokens, known words and words.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, listed in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = _unpack(listed.as_py())
                yield X.by_bucket(chunk.as_py(), keys, bits, lambda lo, hi, k=keys, c=counts: _pack(k[lo:hi], c[lo:hi]))

    def group(table: pa.Table) -> pa.Table:
        parts = [_unpack(e) for e in table.column("entries").to_pylist()]
        keys, sums, place = _add_up(parts)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-sums, kind="stable")] = np.arange(len(keys))
        answers = [_zip(sums[x].astype("<i8"), rank[x].astype("<i8")) for x in np.split(place, np.cumsum([len(k) for k, _ in parts])[:-1])]
        bucket, none = table.column("bucket")[0].as_py(), [0] * len(parts)
        return pa.table({"bucket": [bucket] * (len(parts) + 1), "chunk": [*table.column("chunk").to_pylist(), -1],
                         "answer": [*answers, None], "tokens": [*none, int(sums.sum())],
                         "known": [*none, int((sums > 0).sum())], "size": [*none, len(keys)]}, schema=COUNTS)

    return chunked.select("chunk", "words").mapInArrow(ask, X.ASKED_SQL).groupBy("bucket").applyInArrow(group, COUNTS_SQL)


@dataclass
class Rules:
    """What chunks and buckets need besides answers; a few numbers per bucket."""

    folds: int
    bits: int            # of the buckets of pairs
    word_bits: int       # of the buckets of words
    tokens: int
    known: int
    min_count: int
    min_divergence: float
    smoothing: float
    failed: list[np.ndarray] = field(default_factory=list)  # per depth, sorted keys of the widely dealt contexts that fail

    @property
    def wide(self) -> int:
        """Training occurrences beyond which a context is dealt to several buckets."""
        return max(self.min_count, self.tokens >> self.bits)

    @property
    def counted(self) -> str:
        """Type of a training count, which is at most the number of tokens."""
        return "<u4" if self.tokens < 1 << 32 else "<i8"

    def alone(self, count: np.ndarray) -> np.ndarray:
        """The probability of a token without context, by its training count."""
        return (count + ADD) / (self.tokens + ADD * (self.known + 1))


@dataclass
class Asked:
    """Distinct pairs of one depth of a chunk, in the order in which they are sent."""

    at: np.ndarray       # positions that a context stands before
    key: np.ndarray      # of the context, per position
    n: np.ndarray        # training occurrences of the context, per position
    place: np.ndarray    # the pair, per position
    bucket: np.ndarray   # per pair
    context: np.ndarray  # per pair
    contexts: np.ndarray
    totals: np.ndarray   # per context
    number: np.ndarray   # vocabulary number of the next word, per pair
    example: np.ndarray  # a position, per pair

    def runs(self) -> np.ndarray:
        """Where the pairs of a context begin in a bucket, and the number of pairs."""
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.context[1:] != self.context[:-1])
        return np.flatnonzero(np.r_[True, new, True]) if len(self.bucket) else np.zeros(1, np.int64)


def pairs(rules: Rules, at: np.ndarray, key: np.ndarray, n: np.ndarray, number: np.ndarray) -> Asked:
    """The distinct pairs of the contexts ``key`` and the words ``number`` at positions ``at``."""
    contexts, first, which = distinct(key)
    totals = n[first]
    both, example, place = distinct((which.astype(np.uint64) << NUMBER) | number[at])
    context, word = (both >> NUMBER).astype(np.int64), both & np.uint64((1 << 32) - 1)
    parts = -(-totals // rules.wide)
    part = mix(word, 21) % np.maximum(parts, 1).astype(np.uint64)[context]
    bucket = (mix(contexts[context] + part, 22) >> np.uint64(64 - rules.bits)).astype(np.int64)
    order = by_bucket_and_context(bucket, context)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Asked(at, key, n, rank[place], bucket[order], context[order], contexts, totals, word[order], at[example[order]])


def by_bucket_and_context(bucket: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Order by bucket, then context; in passes of 16 bits, which numpy sorts without comparisons."""
    order = np.arange(len(bucket))
    for values in (context, bucket):
        for shift in range(0, int(values.max(initial=0)).bit_length(), 16):
            order = order[np.argsort((values[order] >> shift).astype(np.uint16), kind="stable")]
    return order


class Walk:
    """The tokens of a chunk and their probabilities given ever longer contexts."""

    def __init__(self, payload: bytes, answers: pa.Table, rules: Rules):
        self.rules = rules
        self.batch, size, place, ends, self.first, self.train = unsealed(payload)
        own = np.r_[0, np.cumsum(np.diff(self.first) + 1)]  # with the end token of each row
        token = np.empty(own[-1], np.int64)
        inside = np.ones(own[-1], bool)
        inside[own[1:] - 1] = False
        token[inside], token[~inside] = place, ends
        self.own, self.inside = own, inside
        self.train_at = np.repeat(self.train, np.diff(own))
        sums, number = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        done = 0
        for bucket, answer in self._level(answers, 0):
            counts, places = _unzip(answer, ("<i8", None), ("<i8", None))
            k = len(counts)
            sums[done:done + k] = counts
            number[done:done + k] = ((places << rules.word_bits) | bucket).astype(np.uint64)
            done += k
        self.count = sums[token]
        self.number = number[token]
        self.p = rules.alone(self.count)
        # contexts of one word
        at = np.flatnonzero(inside) + 1
        at = at[self.count[at - 1] >= rules.min_count]
        self.ahead = at, mix(self.number[at - 1], 11), self.count[at - 1]
        for depth in range(1, len(rules.failed) + 1):
            self._step(answers, depth)

    @staticmethod
    def _level(answers: pa.Table, depth: int) -> Iterator[tuple[int, bytes]]:
        own = answers.filter(pc.equal(answers.column("depth"), depth))
        return zip(own.column("bucket").to_pylist(), own.column("answer").to_pylist(), strict=True)

    def asked(self) -> Asked:
        return pairs(self.rules, *self.ahead, self.number)

    def _step(self, answers: pa.Table, depth: int) -> None:
        """Use the answers for contexts of ``depth`` words, and find the contexts of one more."""
        a, rules = self.asked(), self.rules
        runs = a.runs()
        sums, kept = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        cuts = np.flatnonzero(np.r_[True, a.bucket[1:] != a.bucket[:-1], True]) if len(a.bucket) else np.zeros(1, int)
        for lo, hi, (_, answer) in zip(cuts[:-1], cuts[1:], self._level(answers, depth), strict=True):
            n_runs = int(np.searchsorted(runs, hi) - np.searchsorted(runs, lo))
            counts, keep = _unzip(answer, (rules.counted, hi - lo), ("u1", n_runs))
            sums.append(counts.astype(np.int64))
            kept.append(keep.astype(bool))
        sums = np.concatenate(sums)
        keep = np.repeat(np.concatenate(kept), np.diff(runs))
        keep &= ~np.isin(a.contexts, rules.failed[depth - 1])[a.context]
        c = sums[a.place]
        longer = (c + rules.smoothing * self.p[a.at]) / (a.n + rules.smoothing)
        self.p[a.at] = np.where(keep[a.place], longer, self.p[a.at])
        on = self.inside[a.at] & (c >= rules.min_count)
        self.ahead = a.at[on] + 1, mix(a.key[on] ^ mix(self.number[a.at[on]], 12), 13), c[on]


def ask_pairs(walk: Walk, chunk: int) -> pa.Table:
    a = walk.asked()
    runs = a.runs()
    trained = np.bincount(a.place, walk.train_at[a.at], len(a.bucket)).astype("<u4")
    suffix = walk.p[a.example].astype("<f4") if walk.rules.failed else walk.count[a.example].astype(walk.rules.counted)

    def pack(lo: int, hi: int) -> bytes:
        own = runs[np.searchsorted(runs, lo):np.searchsorted(runs, hi) + 1]
        context = a.context[own[:-1]]
        return np.array([len(context), hi - lo], "<u4").tobytes() + _zip(
            a.contexts[context].astype("<u8"), a.totals[context].astype(walk.rules.counted), np.diff(own).astype("<u4"),
            a.number[lo:hi].astype("<u4"), trained[lo:hi], suffix[lo:hi])

    return pa.Table.from_batches([X.by_bucket(chunk, a.bucket.astype(np.uint64), walk.rules.bits, pack, walk.rules.bits)])


def read_pairs(rules: Rules, entries: bytes) -> tuple[np.ndarray, ...]:
    """Contexts, their counts and numbers of pairs; next words, training counts and suffix probabilities of the pairs."""
    k, n = np.frombuffer(entries, "<u4", 2).tolist()
    *read, suffix = _unzip(entries[8:], ("<u8", k), (rules.counted, k), ("<u4", k), ("<u4", n), ("<u4", n), ("<f4" if rules.failed else rules.counted, n))
    return *read, suffix if rules.failed else rules.alone(suffix).astype("<f4")


def held_against_suffix(rules: Rules, entries: list[bytes]) -> tuple[list[bytes], bytes | None]:
    """The answer to each chunk's pairs, and this bucket's share of the contexts that are dealt to several."""
    parts = [read_pairs(rules, e) for e in entries]
    contexts, first, which = distinct(np.concatenate([p[0] for p in parts]))
    totals = np.concatenate([p[1] for p in parts])[first].astype(float)
    context = np.repeat(which, np.concatenate([p[2] for p in parts])).astype(np.uint64)
    both = (context << NUMBER) | np.concatenate([p[3] for p in parts])
    keys, example, place = distinct(both)
    sums = np.bincount(place, np.concatenate([p[4] for p in parts]), len(keys))
    suffix = np.concatenate([p[5] for p in parts])[example].astype(float)
    of = (keys >> NUMBER).astype(np.int64)
    listed = sums > 0
    of, c, q = of[listed], sums[listed], suffix[listed]
    k = len(contexts)
    p = (c + rules.smoothing * q) / (totals[of] + rules.smoothing)
    gain, mass = np.bincount(of, p * np.log(p / q), k), np.bincount(of, q, k)
    wide = totals > rules.wide
    keep = wide | (gain + others(mass, totals, rules.smoothing) >= rules.min_divergence)
    answers, n, m = [], 0, 0
    for e in parts:
        answers.append(_zip(sums[place[n:n + len(e[3])]].astype(rules.counted), keep[which[m:m + len(e[0])]].astype(np.uint8)))
        n, m = n + len(e[3]), m + len(e[0])
    share = np.stack([contexts[wide].view("<f8"), totals[wide], gain[wide], mass[wide]]).tobytes() if wide.any() else None
    return answers, share


def others(mass: np.ndarray, totals: np.ndarray, smoothing: float) -> np.ndarray:
    """Part of the divergence of what a context never precedes; ``mass``: suffix probability of what it does."""
    scale = smoothing / (totals + smoothing)
    return np.clip(1 - mass, 0, 1) * scale * np.log(scale)


PAIRS_SQL = "bucket int, chunk long, answer binary, depth int"


def level(chunked: DataFrame, answered: DataFrame, depth: int, rules: Rules) -> DataFrame:
    """Answers for the contexts of ``depth`` words; notes in ``rules`` which of the widely dealt ones fail."""

    def use(chunk: int, payload: bytes, answer: pa.Table) -> pa.Table:
        return ask_pairs(Walk(payload, answer, rules), chunk)

    def group(table: pa.Table) -> pa.Table:
        answers, share = held_against_suffix(rules, table.column("entries").to_pylist())
        bucket, chunk = table.column("bucket").to_pylist(), table.column("chunk").to_pylist()
        if share is not None:
            answers, bucket, chunk = [*answers, share], [*bucket, bucket[0]], [*chunk, -1]
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(chunk, pa.int64()),
                         "answer": pa.array(answers, pa.binary()), "depth": pa.array([depth] * len(chunk), pa.int32())})

    answers_of = X.told(chunked, answered, use, X.ASKED_SQL).groupBy("bucket").applyInArrow(group, PAIRS_SQL)
    with shuffles_deleted(answers_of.sparkSession):
        out = materialize(answers_of, "pairs", "none")
    # a context has at most as many shares as its count is multiples of the average bucket, so all have two per bucket
    shares = [np.frombuffer(r[0], "<f8").reshape(4, -1) for r in out.where("chunk = -1").select("answer").collect()]
    rules.failed.append(failing(np.concatenate(shares, axis=1) if shares else np.zeros((4, 0)), rules))
    return out.where("chunk >= 0")


def failing(shares: np.ndarray, rules: Rules) -> np.ndarray:
    key, first, place = np.unique(np.ascontiguousarray(shares[0]).view(np.uint64), return_index=True, return_inverse=True)
    gain, mass = np.bincount(place, shares[2], len(key)), np.bincount(place, shares[3], len(key))
    return key[gain + others(mass, shares[1][first], rules.smoothing) < rules.min_divergence]


def lm_scores(docs: DataFrame, folds: int = FOLDS, min_count: int = MIN_COUNT, depth: int = DEPTH,
              min_divergence: float = MIN_DIVERGENCE, smoothing: float = SMOOTHING) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with paths_written() as listed:
        chunked = X.chunks(docs.select("doc_id", "text"), "lm-chunks", CHUNK_BYTES, lambda batch: sealed(batch, folds), ("payload", "words"))
    size = X.total(chunked, "bytes")
    bits = X.bucket_bits(chunked, size / 25)
    with shuffles_deleted(docs.sparkSession):
        counts = materialize(word_counts(chunked, bits), "word-counts", "none")
    chunked = materialize(chunked.select("chunk", "payload"), "lm-tokens", "none")  # the lists of words are not needed again
    remove(docs.sparkSession, listed)
    stats = {r[0]: r[1:] for r in counts.where("chunk = -1").select("bucket", "tokens", "known", "size").collect()}
    assert max((s[2] for s in stats.values()), default=0) << bits <= 1 << int(NUMBER), "more words than vocabulary numbers"
    rules = Rules(folds, X.bucket_bits(chunked, size / 6), bits, sum(s[0] for s in stats.values()),
                  sum(s[1] for s in stats.values()), max(1, min_count), min_divergence, smoothing)
    answered = counts.where("chunk >= 0").select("bucket", "chunk", "answer", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        answered = answered.unionByName(level(chunked, answered, d, rules))

    base = np.log10(rules.tokens + ADD * (rules.known + 1))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(chunk: int, payload: bytes, answer: pa.Table) -> pa.Table:
        walk = Walk(payload, answer, rules)
        n, first = np.diff(walk.own), walk.own[:-1]
        return pa.table(
            [walk.batch.column("doc_id"), pa.array(~walk.train), pa.array(n.astype(np.int64)),
             pa.array(np.add.reduceat((walk.count > 0).astype(np.int64), first)), pa.array(np.full(len(n), rules.tokens, np.int64)),
             pa.array(np.add.reduceat(np.log10(walk.count + ADD), first) - n * base), pa.array(np.add.reduceat(np.log10(walk.p), first))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return X.told(chunked, answered, score, schema)


# The same model in one process, for small corpora. Words are numbers from FIRST to 65,535.

FIRST = 2


def _context(symbols: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``depth`` words before them in their row, all symbols of their own, and those words as one key."""
    at = np.flatnonzero(place >= depth)
    key = np.zeros(len(at), np.uint64)
    own = np.ones(len(at), bool)
    for d in range(depth, 0, -1):
        x = symbols[at - d]
        own &= x >= FIRST
        key = (key << np.uint64(16)) | x
    return at[own], key[own]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return slot, sorted_keys[slot] == keys


@dataclass
class Level:
    contexts: np.ndarray      # sorted keys of the retained contexts
    backoff: np.ndarray       # log10 of the scale for what they do not list
    entries: np.ndarray       # sorted keys context << 16 | symbol
    probability: np.ndarray   # log10


@dataclass
class Tree:
    root: np.ndarray          # log10 probability of each symbol
    levels: list[Level] = field(default_factory=list)

    def predict(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol given the longest retained suffix of what precedes it."""
        out = self.root[symbols.astype(np.int64)]
        for depth, level in enumerate(self.levels, 1):
            at, key = _context(symbols, place, depth)
            out[at] = self._step(level, key, symbols[at], out[at])
        return out

    @staticmethod
    def _step(level: Level, key: np.ndarray, symbol: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        slot, kept = _find(level.contexts, key)
        entry, listed = _find(level.entries, (key << np.uint64(16)) | symbol)
        if not len(level.contexts):
            return shorter
        out = np.where(kept, shorter + level.backoff[slot], shorter)
        return np.where(kept & listed, level.probability[entry], out) if len(level.entries) else out

    def given(self, context: np.ndarray, depth: int, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of ``symbol`` after ``context``, a key of ``depth`` words."""
        out = self.root[symbol.astype(np.int64)]
        for d, level in enumerate(self.levels[:depth], 1):
            out = self._step(level, context & np.uint64((1 << (16 * d)) - 1), symbol, out)
        return out

    def grow(self, entries: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray,
             depth: int, min_divergence: float, smoothing: float) -> None:
        """Add the contexts of ``depth`` words that pass the divergence test."""
        which, known = _find(contexts, entries >> np.uint64(16))
        entries, counts, which = entries[known], counts[known].astype(float), which[known]
        symbol = entries & np.uint64(0xFFFF)
        parent = 10 ** self.given(contexts[which] & np.uint64((1 << (16 * (depth - 1))) - 1), depth - 1, symbol) if len(entries) else counts
        n = totals[which].astype(float)
        p = (counts + smoothing * parent) / (n + smoothing)
        k = len(contexts)
        rest, parent_rest = (np.clip(1 - np.bincount(which, x, k), 1e-9, 1) for x in (p, parent))
        gain = np.bincount(which, p * np.log(p / parent), k) + rest * np.log(rest / parent_rest)
        keep = gain >= min_divergence
        listed = keep[which]
        self.levels.append(Level(contexts[keep], np.log10(rest / parent_rest)[keep], entries[listed], np.log10(p[listed])))
