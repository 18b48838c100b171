"""Toxicity with a linear-chain conditional random field over words.

Training works on a bounded, documented sample of the labelled rows (``max_toxic`` + ``max_clean``
whole documents, the first by CRC-32 of the id), from the training fold only:

1. words of the sample are labelled: in a toxic document, a word (or its beginning) is toxic if the
   smoothed share of toxic documents among those that hold it is at least ``WORD_SHARE``, at the label
   frequencies of all training rows, and at least ``WORD_SUPPORT`` of the toxic ones hold it; every
   other word is clean;
2. a two-state chain (clean, toxic) with hashed features of the word, its beginnings and end and
   its neighbours is fitted by Adagrad on the exact gradient (forward-backward);
3. a logistic regression maps the marginals of a document (largest, sum, mean, number above one half) to
   its score, weighted back to the label frequencies of all training rows.

Scoring is one map over all documents: the model (a table of 2 ** ``bits`` weights and a
few numbers, 1 MB) is broadcast; forward-backward marginals are exact over whole texts. The chain
is evaluated as products of 2 x 2 matrices over parallel segments, which join exactly, so one very
long text costs as much per word as many short ones.

Nothing but the text enters a score. Defined cases: null and empty texts have no words and get the
score of a document without toxic words; labels without a document, null labels and null ids teach
nothing; an id with several labels counts as toxic if one says so; without any toxic or any clean
training row there is nothing to learn and every score is the smoothed share of toxic labels; an empty table
gives no rows. Repeated rows are scored alike. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import slices, small_batches
from ledgerlens.llm.words import ALPHANUMERIC, Words, mix, rolling, words, _BYTE_CODE

FOLDS = 5
MAX_TOXIC = 2000
MAX_CLEAN = 3000
WORD_SHARE = 0.6
WORD_SUPPORT = 0.01
MIN_SUPPORT = 3
PRIOR_DOCS = 4.0
BITS = 18
ROUNDS = 25
RATE = 0.5
L2 = 1e-3
SEGMENTS = 1024
MARKED = (0, 3)  # keys that can mark toxic documents: the word, and its first 8 bytes


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def keys(w: Words) -> np.ndarray:
    """Hashes of a word, of its first 4, 6 and 8 bytes, and of its last 3; one column per word."""
    code = _BYTE_CODE[w.data]
    out = [mix(rolling(code, w.starts, w.ends, 0))]
    for i, n in enumerate((4, 6, 8)):
        out.append(mix(rolling(code, w.starts, np.minimum(w.starts + n, w.ends), 0), 1 + i))
    out.append(mix(rolling(code, np.maximum(w.ends - 3, w.starts), w.ends, 0), 4))
    return np.stack(out)


def features(k: np.ndarray, begins: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the weights of each word: its own keys, and the words before and after in its text."""
    n = k.shape[1]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    before = np.r_[np.uint64(0), k[0, :-1]] if n else k[0]
    before = np.where(edge[:-1], np.uint64(1), before)
    after = np.r_[k[0, 1:], np.uint64(0)] if n else k[0]
    after = np.where(edge[1:], np.uint64(2), after)
    return (np.vstack([k, mix(before, 5)[None], mix(after, 6)[None]]) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Chain:
    """Two states, 0 clean and 1 toxic; ``moves[i, j]`` and ``start`` are log potentials."""

    weights: np.ndarray
    bias: float = -3.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, slots: np.ndarray) -> np.ndarray:
        total = np.full(slots.shape[1], self.bias)
        for row in slots:
            total += self.weights[row]
        return np.clip(total, -30, 30)

    def messages(self, score: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward vectors of every word, each scaled to sum 1, shape (2, n)."""
        n = len(score)
        t = np.exp(self.moves)
        lift = np.exp(score)
        is_first = np.zeros(n, bool)
        is_first[begins] = True
        is_last = np.r_[is_first[1:], True]
        # forward: v' = M v with M = diag(1, lift) t^T; at the first word of a text, v' = (1, lift)
        forward = np.empty((2, 2, n))
        for j in (0, 1):
            gain = lift if j else 1.0
            for i in (0, 1):
                forward[j, i] = np.where(is_first, gain, gain * t[i, j])
        # backward, words reversed: v' = t diag(1, lift of the next word) v; at the last word, v' = (1, 1)
        after = np.r_[lift[1:], 1.0]
        backward = np.empty((2, 2, n))
        for i in (0, 1):
            for j in (0, 1):
                backward[i, j] = np.where(is_last, 1.0, t[i, j] * (after if j else 1.0))
        return _run(forward), _run(backward[:, :, ::-1])[:, ::-1]

    def marginals(self, slots: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if not slots.shape[1]:
            return np.zeros(0)
        a, b = self.messages(self.scores(slots), begins)
        p = a * b
        return p[1] / p.sum(axis=0)


def _run(m: np.ndarray) -> np.ndarray:
    """v_t = M_t v_(t-1), scaled to sum 1, for all t, over parallel segments that are then joined."""
    n = m.shape[2]
    k = min(SEGMENTS, max(1, n // 16))
    steps = -(-n // k)
    pad = np.zeros((2, 2, k * steps))
    pad[0, 0], pad[1, 1] = 1.0, 1.0
    pad[:, :, :n] = m
    pad = np.ascontiguousarray(pad.reshape(2, 2, k, steps).transpose(3, 0, 1, 2))
    # the product of each segment
    p = np.zeros((2, 2, k))
    p[0, 0] = p[1, 1] = 1.0
    for s in range(steps):
        p = np.einsum("ijk,jlk->ilk", pad[s], p)
        p /= p.sum(axis=(0, 1))
    into = np.empty((2, k))
    v = np.array([0.5, 0.5])
    for i in range(k):
        into[:, i] = v
        v = p[:, :, i] @ v
        v /= v.sum()
    out = np.empty((steps, 2, k))
    for s in range(steps):
        x = pad[s]
        v0 = x[0, 0] * into[0] + x[0, 1] * into[1]
        v1 = x[1, 0] * into[0] + x[1, 1] * into[1]
        z = v0 + v1
        into = np.stack([v0 / z, v1 / z])
        out[s] = into
    return out.transpose(1, 2, 0).reshape(2, k * steps)[:, :n]


@dataclass
class Shard:
    """A few hundred thousand words of the training sample; training never holds more than one expanded."""

    texts: pa.Array
    keys: dict[int, np.ndarray]  # by number, those that tell the marks
    first: np.ndarray
    toxic: np.ndarray
    slots: np.ndarray = None
    tags: np.ndarray = None

    @property
    def begins(self) -> np.ndarray:
        return np.unique(self.first[:-1][np.diff(self.first) > 0])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def fit_chain(shards: list[Shard], bits: int = BITS, rounds: int = ROUNDS) -> Chain:
    chain = Chain(np.zeros(1 << bits))
    seen_w, seen_m, seen_b = np.full(1 << bits, 1e-8), np.full((2, 2), 1e-8), 1e-8
    scale = 1.0 / max(1.0, sum(float(s.tags.sum()) for s in shards))
    for _ in range(rounds):
        grad, grad_m, grad_b = L2 * chain.weights, np.zeros((2, 2)), 0.0
        for s in shards:
            begins, tags = s.begins, s.tags
            if not len(tags):
                continue
            score = chain.scores(s.slots)
            a, b = chain.messages(score, begins)
            p = a * b
            off = p[1] / p.sum(axis=0) - tags
            for row in s.slots:
                grad += np.bincount(row, off, 1 << bits)
            grad_b += off.sum()
            inner = np.ones(len(tags), bool)
            inner[begins] = False
            inner = np.flatnonzero(inner)
            t = np.exp(chain.moves)
            lift = np.exp(score[inner])
            pair = np.stack([a[i, inner - 1] * t[i, j] * (lift if j else 1.0) * b[j, inner] for i in (0, 1) for j in (0, 1)])
            grad_m += (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
            np.add.at(grad_m, (tags[inner - 1].astype(int), tags[inner].astype(int)), -1)
        grad, grad_m, grad_b = grad * scale, grad_m * scale, grad_b * scale
        seen_w += grad ** 2
        seen_m += grad_m ** 2
        seen_b += grad_b ** 2
        chain.weights -= RATE * grad / np.sqrt(seen_w)
        chain.moves -= RATE * grad_m / np.sqrt(seen_m)
        chain.bias -= RATE * grad_b / np.sqrt(seen_b)
    return chain


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest marginal, log of their sum, mean, log of the number of toxic words; one row per text."""
    n = np.diff(first)
    filled = np.flatnonzero(n)
    out = np.zeros((len(n), 4))
    if len(filled):
        begins = first[:-1][filled]
        total = np.add.reduceat(p, begins)
        out[filled] = np.stack([np.maximum.reduceat(p, begins), np.log1p(total), 10 * total / n[filled],
                                np.log1p(np.add.reduceat((p >= 0.5).astype(float), begins))], axis=1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def tag_words(shards: list[Shard], clean_weight: float, share: float = WORD_SHARE, support: float = WORD_SUPPORT) -> None:
    """Tag the words of toxic documents whose own hash or first 8 bytes mark toxic documents.

    A mark stands in at least ``support`` of the toxic documents, and they are ``share`` of all
    documents with it, where a clean document of the sample counts ``clean_weight`` times.
    """
    toxic = np.concatenate([s.toxic for s in shards])
    least = max(MIN_SUPPORT, support * toxic.sum())
    base = toxic.sum() / (toxic.sum() + clean_weight * (~toxic).sum())

    def distinct(key: np.ndarray, other: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((other, key))
        k, o = key[order], other[order]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])] if len(k) else np.zeros(0, bool)
        return k[fresh], of[order][fresh]

    marks = []
    for key in MARKED:
        held = [distinct(s.keys[key], s.row, s.toxic[s.row]) for s in shards]  # each word once per document
        word, bad = (np.concatenate(x) for x in zip(*held, strict=True))
        # and once per word before it in toxic documents: copies of a document add no support
        pairs = [(s.keys[key][1:][of], s.keys[0][:-1][of]) for s in shards if len(s.row) > 1 for of in [s.toxic[s.row][1:]]]
        places, before = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (word[:0],) * 2
        where, _ = distinct(places, before, places)
        names, place = np.unique(word, return_inverse=True)
        in_toxic = np.bincount(place, bad.astype(float), len(names))
        in_clean = np.bincount(place, 1.0 - bad, len(names))
        in_toxic = np.minimum(in_toxic, np.bincount(np.searchsorted(names, where), minlength=len(names)))
        shared = (in_toxic + PRIOR_DOCS * base) / (in_toxic + clean_weight * in_clean + PRIOR_DOCS)
        marks.append(names[(shared >= share) & (in_toxic >= least)])
    for s in shards:
        s.tags = ((np.isin(s.keys[0], marks[0]) | np.isin(s.keys[3], marks[1])) & s.toxic[s.row]).astype(float)


@dataclass
class Model:
    chain: Chain | None
    beta: np.ndarray
    bits: int = BITS

    def score(self, column: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
        w = words(column, ALPHANUMERIC, lower=True)
        if self.chain is None:
            return np.full(len(column), self.beta[0]), w, np.zeros(len(w.starts))
        begins = np.unique(w.first[:-1][np.diff(w.first) > 0])
        p = self.chain.marginals(features(keys(w), begins, self.bits), begins)
        x = document_features(p, w.first)
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30))), w, p


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most ``max_toxic`` + ``max_clean`` documents of the training fold, collected to the driver."""
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold(F.col("doc_id"), folds) != 0))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    order = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = (marks.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic)
              .unionByName(marks.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean)))
    # at most max_toxic + max_clean ids: small enough to broadcast, so the texts are not shuffled
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .dropDuplicates(["doc_id"]).toArrow())
    y = sample.column("toxic").to_numpy().astype(bool)
    if not y.any() or y.all():
        n = counts.get(0, 0) + counts.get(1, 0)
        return Model(None, np.array([(counts.get(1, 0) + 0.5) / (n + 1)]))
    shards = []
    for piece in slices(iter(sample.to_batches()), "text", 1 << 20):
        w = words(piece.column("text"), ALPHANUMERIC, lower=True)
        k = keys(w)
        shards.append(Shard(piece.column("text"), {i: k[i].copy() for i in MARKED}, w.first, piece.column("toxic").to_numpy().astype(bool)))
    clean_weight = (counts.get(0, 0) / (~y).sum()) / (counts.get(1, 0) / y.sum())
    tag_words(shards, clean_weight)
    if not any(s.tags.any() for s in shards):
        return Model(None, np.array([counts.get(1, 0) / (counts.get(0, 0) + counts.get(1, 0))]))
    for s in shards:  # the other keys are made again rather than held
        s.keys = None
        s.slots = features(keys(words(s.texts, ALPHANUMERIC, lower=True)), s.begins, BITS)
    chain = fit_chain(shards)
    chain.weights = chain.weights.astype(np.float32)
    x = np.concatenate([document_features(chain.marginals(s.slots, s.begins), s.first) for s in shards])
    y = np.concatenate([s.toxic for s in shards])
    weight = np.where(y, counts.get(1, 0) / y.sum(), counts.get(0, 0) / (~y).sum())
    return Model(chain, fit_logistic(x, y.astype(float), weight / weight.mean()))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, **bounds) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, n_toxic_words, spans (character offsets)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, **bounds))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, held_out boolean, score double, predicted int, n_toxic_words long, "
              "spans array<struct<begin:long,end:long>>")
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", 2 << 20):
            value, w, p = model.score(batch.column("text"))
            hot = p >= 0.5
            rows = batch.num_rows
            spans: list[list] = [[] for _ in range(rows)]
            if hot.any():
                chars = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]  # characters before each byte
                at = np.flatnonzero(hot)
                row = np.searchsorted(w.first, at, side="right") - 1
                joined = np.r_[False, (np.diff(at) == 1) & (np.diff(row) == 0)]
                heads = np.flatnonzero(~joined)
                tails = np.r_[heads[1:] - 1, len(at) - 1]
                starts = np.r_[0, np.cumsum([len(t.encode()) if t else 0 for t in batch.column("text").to_pylist()])]
                for r, lo, hi in zip(row[heads].tolist(), w.starts[at[heads]].tolist(), w.ends[at[tails]].tolist(), strict=True):
                    zero = chars[starts[r]]
                    spans[r].append({"begin": int(chars[lo] - zero), "end": int(chars[hi] - zero)})
            ids = batch.column("doc_id").to_pylist()
            out = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i in ids]
            n_hot = np.diff(np.r_[0, np.cumsum(hot)][w.first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out), pa.array(value), pa.array((value >= 0.5).astype(np.int32)),
                 pa.array(n_hot.astype(np.int64)), pa.array(spans, span_type)],
                names=["doc_id", "held_out", "score", "predicted", "n_toxic_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged; no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield batch.filter(pa.array(shared.value.score(batch.column("text"))[0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)
