"""Document operators against plain restatements, on edge cases and on whole test tables."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import exact_dedup, exchange, licenses, lm_scoring, mixing, near_dedup, notices, packing, repeats, toxicity
from ledgerlens.llm.shared import materialize, paths_written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- exact dedup --------------------------------------------------------------------------

def check_exact(rows, out):
    flat = [(r[0], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest()) for r in rows]
    groups: dict = {}
    for i, h in flat:
        groups.setdefault(h, []).append(i)
    want = []
    for i, h in flat:
        ids = [x for x in groups[h] if x is not None]
        first = min(ids, default=None)
        want.append((i, first, len(groups[h]), i == first, h))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_exact_dedup_edges(edge_docs, edge_rows, no_docs):
    check_exact(edge_rows, exact_dedup.exact_dedup(edge_docs))
    check_exact(edge_rows, exact_dedup.exact_dedup(edge_docs, max_cells=1))
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_bloom_filter_counts_saturate_at_two(spark):
    hashes = spark.createDataFrame([(7,), (7,), (9,)], "h long").repartition(3)
    _, twice = exact_dedup.build_filter(hashes, exact_dedup.BLOCK_CELLS)
    at = exact_dedup._cells(np.array([7, 9], np.uint64), exact_dedup.BLOCK_CELLS).astype(np.int64)
    hit = ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    assert hit.tolist() == [True, False]


def test_filters_per_range_keep_rows_that_are_alone_from_the_shuffle(spark):
    """More rows than one filter holds: several filters, few false positives, the same rows."""
    rows = [(i, f"text {i % 17000}") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cells = exact_dedup.BLOCK_CELLS
    assert exact_dedup.filter_size(len(rows), cells) == (cells, 3) and exact_dedup.filter_size(0, cells) == (cells, 1)
    assert exact_dedup.filter_size(10 ** 9, exact_dedup.MAX_CELLS) == (1 << 28, 30)
    probed = exact_dedup._in_ranges(docs, cells)
    assert probed.count() == len(rows)
    assert 6000 <= probed.where("maybe").count() <= 8500 and probed.where("NOT maybe").join(docs.where("doc_id < 3000 OR doc_id >= 17000"), "doc_id").isEmpty()
    check_exact(rows, exact_dedup.exact_dedup(docs, max_cells=cells))


def test_settled_deletes_what_it_passed_over(spark):
    import os

    from ledgerlens.llm import shared

    inner = []

    def make():
        inner.append(shared.materialize(spark.range(5), "inner"))
        return shared.settled(lambda: shared.materialize(inner[0].where("id > 1"), "innermost"), "middle")

    out = shared.settled(make, "outer")
    assert sorted(r.id for r in out.collect()) == [2, 3, 4] and all(os.path.exists(f.removeprefix("file:")) for f in out.inputFiles())
    assert not any(os.path.exists(f.removeprefix("file:")) for f in inner[0].inputFiles())
    assert not shared._open.scopes


def test_unique_keeps_one_row_of_each_text(edge_docs, no_docs):
    out = exact_dedup.unique(edge_docs)
    assert out.columns == edge_docs.columns
    ids = sorted(r.doc_id or 0 for r in out.collect())
    assert ids == [0, 1, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
    assert exact_dedup.unique(no_docs).count() == 0


# -- substring dedup -------------------------------------------------------------------------

def check_repeats(rows, out, window):
    want = []
    for r, gone in zip(rows, brute.repeated_words([r[1] for r in rows], window), strict=True):
        kept = " ".join(w for w, g in zip(brute.space_words(r[1]), gone, strict=True) if not g)
        want.append((r[0], len(gone), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("window", [35, 4])
def test_repeats_edges(edge_docs, edge_rows, no_docs, window):
    check_repeats(edge_rows, repeats.repeats(edge_docs, window), window)
    if window == 35:
        assert repeats.repeats(no_docs).count() == 0


def test_repeats_whole_table(documents):
    check_repeats([(r.doc_id, r.text) for r in documents.collect()], repeats.repeats(documents), 35)


# -- mixing --------------------------------------------------------------------------------

def test_mixing_edges(edge_docs, edge_rows, no_docs):
    out = mixing.mixing(edge_docs).collect()
    size = {}
    for r in edge_rows:
        size[r[3]] = size.get(r[3], 0) + len(brute.space_words(r[1]))
    total = sum(size.values())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # stop at the cap, reshare the excess
        left = 1.5 * total - sum(2 * size[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target = {s: share[s] if s in open_ else 2.0 * size[s] for s in order}
            break
        open_ -= full
    by_id = {r[0]: r[3] for r in edge_rows}
    taken: dict = {}
    for r in out:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert len(out) == len(edge_rows)
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in order)
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert mixing.mixing(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_reruns_of_the_mix_agree(edge_docs, documents):
    for docs in (edge_docs, documents):
        first, again = (sorted(map(str, mixing.mixing(docs.repartition(n)).collect())) for n in (3, 7))
        assert first == again


def test_mix_keeps_columns_and_texts(edge_docs, edge_rows):
    out = mixing.mix(edge_docs)
    assert out.columns == edge_docs.columns
    assert {r.text for r in out.collect()} <= {r[1] for r in edge_rows}


def test_mix_takes_every_row_by_its_own_schedule(spark):
    """Rows without an id, rows that share one, and more than two passes."""
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else 100 + i, f"{'abc'[i % 3]}{i} " * (1 + i % 5), "st"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for rule in ({}, {"total_share": 3.5, "max_passes": 4, "weights": (9, 1)}):
        targets = {r.source: r.target for r in mixing.schedule(docs, **rule).select("source", "target").distinct().collect()}
        words: Counter = Counter()
        copies = Counter(r.text for r in mixing.mix(docs, **rule).collect())
        for _, text, source in rows:
            words[source] += copies[text] * len(text.split())
        assert all(abs(words[s] - targets[s]) <= 3 for s in "st")  # half a document of five words
        assert max(copies.values()) == rule.get("max_passes", 2)
        assert {text[0] for text in copies} == set("abc")


def test_schedule_integrates_to_the_target(documents):
    """Words due in a slice of time are the integral of the source's weight over it."""
    rows = [r for r in mixing.schedule(documents, slopes=(1.0,)).collect() if r.position is not None]
    source = max({r.source for r in rows}, key=lambda s: sum(r.size for r in rows if r.source == s))
    own = [r for r in rows if r.source == source]
    early = sum(r.size for r in own if r.position < 0.5) + sum(r.size for r in own if (r.second_position or 1) < 0.5)
    assert early / own[0].target == pytest.approx(0.25, abs=0.1)  # slope 1: t^2


# -- toxicity ---------------------------------------------------------------------------------

def test_chain_marginals_are_exact():
    rnd = np.random.default_rng(1)
    chain = toxicity.Chain(rnd.normal(size=64), bias=-0.3, moves=rnd.normal(size=(2, 2)))
    slots = rnd.integers(0, 64, (3, 9)).astype(np.int32)
    begins = np.array([0, 5])
    got = chain.marginals(slots, begins)
    score = chain.scores(slots)
    for lo, hi in ((0, 5), (5, 9)):
        total, hot = 0.0, np.zeros(hi - lo)
        for path in np.ndindex(*(2,) * (hi - lo)):
            v = sum(score[lo + i] for i, y in enumerate(path) if y) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))
            total += math.exp(v)
            hot += math.exp(v) * np.array(path)
        assert np.allclose(got[lo:hi], hot / total)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(edge_docs, labels).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    assert toxicity.toxicity(no_docs, labels.limit(0)).count() == 0
    assert toxicity.clean(edge_docs, labels).count() == edge_docs.count()


def test_toxicity_held_out_and_spans(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    shown = {r.text[s.begin:s.end].lower() for r in toxic for s in r.spans}
    assert "idiot" in shown and all(w == w.strip() for w in shown)


# -- licence scan -----------------------------------------------------------------------------

def test_license_scan_edges(spark, documents, no_docs, edge_docs):
    texts = ["Under the MIT license", "under the the mit license", "Released UNDER THE MIT LICENSE, cc by nc cc-by-nc",
             "permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation", "apache license version 22", "GNU General Public License version 3", None, "", "under the mit"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.licenses(docs).collect()
    assert len(out) == len(rows)
    by_text = Counter()
    for r, (i, t) in zip(out, rows, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t))
        found, names = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            found += at
            names |= {label} if at else set()
        assert (r.doc_id, r.n_words, r.n_base, r.base_labels) == (i, len(w), len(found), ",".join(sorted(names)))
        assert (r.first_word, r.last_word) == ((min(found), max(found)) if found else (None, None))
        assert names <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        by_text.update(r.labels.split(","))
    assert out[3].labels == "mit" and out[3].base_labels == "" and out[5].score > 0.4 and out[1].n_base == 0
    assert licenses.licenses(no_docs).count() == 0 and licenses.licenses(edge_docs).count() == edge_docs.count()


def test_every_standard_notice_is_labelled(spark):
    texts = list(notices.standard().items())
    rows = []
    for i, (text, _) in enumerate(texts):
        body = "\n".join(f" * {line}" for line in text.upper().splitlines())
        rows.append((i, f"/* Copyright (c) 2019-2021 Some Body and others\n{body}\n */ import os"))
    out = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a base phrase in the notice (cc by nc) keeps its label
    wrong = {text: (label, out[i].labels) for i, (text, label) in enumerate(texts)
             if set(out[i].labels.split(",")) - set(out[i].base_labels.split(",")) | {label} != {label} or label not in out[i].labels.split(",")}
    assert not wrong
    assert all(r.score == 1.0 for r in out.values())
    for i, (text, label) in enumerate(texts):
        w, n = out[i].n_words, len(licenses.template_words(text))
        span = max(out[i].spans, key=lambda s: s.last - s.first)
        assert (span.label, span.last - span.first + 1, span.cover) == (label, n, 1.0) and span.last == w - 3


def test_changed_notices(spark):
    bodies = dict((label, text) for label, text in notices.BODIES if label in ("bsd-2", "bsd-3", "isc", "mit"))
    gpl = "This program is under the terms of the GNU General Public License as published by the Free Software Foundation"
    cases = [
        (bodies["bsd-3"].replace("copyright holder nor", "Regents of the University of California nor"), "bsd-3"),
        (bodies["bsd-2"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR"), "bsd-2"),
        (bodies["isc"].replace("modify, and/or distribute", "modify, and distribute"), "isc"),
        (bodies["isc"] + "\n---\n" + bodies["mit"] + "\n---\n" + bodies["isc"], "isc,mit"),
        (bodies["bsd-2"] + "\n" + bodies["bsd-3"], "bsd-2,bsd-3"),
        (gpl + ", either version 3 of the License", "gpl-3"),
        (gpl + "; either version 2 of the License, or (at your option) any later version", "gpl-2"),
        (gpl, ""),  # no version, so nothing decides between them
        (gpl.replace("General", "Lesser General") + "; either version 2.1 of the License", "lgpl-2.1"),
        ("SPDX-License-Identifier: something", ""),
        ("in the software the copyright holders of this software and the license of the software", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.labels for r in licenses.licenses(docs).orderBy("doc_id").collect()] == [label for _, label in cases]


@pytest.mark.parametrize("seed", range(40))
def test_chains_match_exhaustive_search(seed):
    rng = random.Random(seed)
    templates = {" ".join(rng.choices("abcde", k=rng.randint(4, 12))): f"t{i}" for i in range(3)}
    scanner = licenses.Scanner({"b c d": "base"}, templates, 2, 2, 0.5)
    sequences = [["b", "c", "d"], *(t.split() for t in templates)]
    text = []
    while len(text) < 16:
        s = rng.choice(sequences)
        k = rng.randrange(len(s))
        text += s[k:k + rng.randint(2, 6)] + rng.choices(["x", *"abcde"], k=rng.randint(0, 2))

    want: dict = {}
    for t, s in enumerate(sequences):
        matches = [(a, b, x) for a in range(len(text)) for b in range(a + 2, len(text) + 1) for x in range(b - a, len(s) + 1)
                   if s[x - b + a:x] == text[a:b] and (a == 0 or x == b - a or text[a - 1] != s[x - b + a - 1])
                   and (b == len(text) or x == len(s) or text[b] != s[x])]

        def extend(chain, covered, t=t, matches=matches):
            first, (_, end, at) = chain[0], chain[-1]
            want[t, first[0]] = max(want.get((t, first[0]), 0), covered)
            for a, b, x in matches:
                if b > end and a - end <= 2 and x > at:
                    extend([*chain, (a, b, x)], covered + min(b - a, b - end, x - at))

        for m in matches:
            extend([m], m[1] - m[0])
    number = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
    at = np.array([i for i, w in enumerate(text) if w in number])
    coded = np.array([number[text[i]] for i in at])
    places, matches = [], []
    for lo, hi in scanner.runs(at, coded, np.zeros(len(at), int)):
        scanner.scan(coded[lo:hi].tolist(), int(at[lo]), places, matches)
    found: dict = {}
    for t, first, _, covered in scanner.found(matches):
        found[t, first] = max(found.get((t, first), 0), covered)
    # equal chains may start at different matches: compared is the best cover of each template
    assert {t: max(v for (u, _), v in want.items() if u == t) for t, _ in want} == \
           {t: max(v for (u, _), v in found.items() if u == t) for t, _ in found}
    assert all(v <= want[k] for k, v in found.items())
    assert sorted(p for p, _ in places) == [k for k in range(len(text) - 2) if text[k:k + 3] == ["b", "c", "d"]]


def test_automaton_finds_every_substring():
    auto = licenses.Automaton()
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4], [3, 1, 2, 5]]
    for t, s in enumerate(sequences):
        auto.add(t, s)
    auto.close()
    text = [9, 2, 3, 4, 1, 2, 3, 1, 2, 5, 3, 1, 1]
    for i, (_, n) in enumerate(auto.statistics(text)):
        want = max((k for k in range(i + 2) if any(s[j:j + k] == text[i + 1 - k:i + 1] for s in sequences for j in range(len(s)))), default=0)
        assert n == want


# -- LM scoring ---------------------------------------------------------------------------------

def check_base(rows, out):
    tokens = [[*brute.space_words(brute.lower(t)), None] for _, t in rows]
    key = ["" if i is None else str(i) for i, _ in rows]
    c = Counter(w for k, ws in zip(key, tokens, strict=True) if zlib.crc32(k.encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((k, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
                  for k, ws in zip(key, tokens, strict=True))
    got = sorted(("" if r.doc_id is None else str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_lm_scores(spark, documents, edge_docs, edge_rows, no_docs):
    check_base([(r[0], r[1]) for r in edge_rows], lm_scoring.lm_scores(edge_docs).collect())
    out = lm_scoring.lm_scores(documents).collect()
    check_base([(r.doc_id, r.text) for r in documents.collect()], out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts and symbols help on unseen texts
    assert lm_scoring.lm_scores(no_docs).count() == 0


def suffix_tree_scores(rows, depth=3, min_count=2, min_divergence=0.01, smoothing=10.0):
    """Scores by plain counters over all training rows; a text's end is None."""
    texts = [[*brute.space_words(brute.lower(t)), None] for _, t in rows]
    train = [ws for (i, _), ws in zip(rows, texts, strict=True) if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for ws in train for w in ws)
    n, v = sum(words.values()), len(words)
    after: dict = {}
    for ws in train:
        for d in range(1, depth + 1):
            for i in range(d, len(ws)):
                after.setdefault(tuple(ws[i - d:i]), Counter())[ws[i]] += 1
    kept: dict = {}

    def p(context, w):
        if not context:
            return (words[w] + 0.1) / (n + 0.1 * (v + 1))
        shorter = p(context[1:], w)
        if not kept.get(context):
            return shorter
        c = after[context]
        return (c[w] + smoothing * shorter) / (sum(c.values()) + smoothing)

    for context in sorted(after, key=len):
        c, total = after[context], sum(after[context].values())
        if total >= min_count:
            q = {w: p(context[1:], w) for w in c}
            new = {w: (c[w] + smoothing * q[w]) / (total + smoothing) for w in c}
            scale = smoothing / (total + smoothing)
            gain = sum(new[w] * math.log(new[w] / q[w]) for w in c) + max(0, 1 - sum(q.values())) * scale * math.log(scale)
            kept[context] = gain >= min_divergence
    return [sum(math.log10(p(tuple(ws[max(0, i - depth):i]), ws[i])) for i in range(len(ws))) for ws in texts], kept


def test_lm_rare_contexts_count_in_any_corpus(spark, monkeypatch):
    """A phrase that two training texts hold is learned, however many other words there are."""
    import random

    rnd = random.Random(8)
    often = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(often) for _ in range(rnd.randint(0, 400)))) for i in range(700)]
    rows += [(i, "the of " * rnd.randint(1, 40) + rnd.choice(often)) for i in range(700, 1000)]  # a widely dealt context
    held = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 10 == 0)
    taught = [i for i in range(3000, 3100) if zlib.crc32(str(i).encode()) % 10][:2]
    rows += [(i, "zorp quix blat vimmy") for i in [*taught, held]]
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 50_000)
    out = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want, kept = suffix_tree_scores(rows)
    assert out[held].train_tokens > 100_000 and ("zorp",) in kept and ("zorp", "quix", "blat") in kept
    assert out[held].score > out[held].base_score + 5
    assert len(set(kept.values())) == 2  # the divergence test decides both ways
    for (i, _), score in zip(rows, want, strict=True):
        assert out[i].score == pytest.approx(score, abs=1e-5)


def test_next_symbol_probabilities_sum_to_one():
    tree = lm_scoring.Tree(np.log10(np.array([0.4, 0.1, 0.3, 0.2])))
    entries = np.array([(2 << 16) | 3, (3 << 16) | 1], np.uint64)
    tree.grow(entries, np.array([50, 30]), np.array([2, 3], np.uint64), np.array([60, 40]), 1, 0.001, 10.0)
    pair = np.array([(2 << 32) | (3 << 16) | 2], np.uint64)
    tree.grow(pair, np.array([25]), np.array([(2 << 16) | 3], np.uint64), np.array([30]), 2, 0.001, 10.0)
    for before in ([], [2], [3], [2, 3], [3, 2], [2, 2, 3]):
        total = 0.0
        for s in range(4):
            seq = np.array([*before, s], np.uint64)
            total += 10 ** tree.predict(seq, np.arange(len(seq)))[-1]
        assert total == pytest.approx(1.0)
    assert len(tree.levels[1].contexts) == 1


# -- packing --------------------------------------------------------------------------------------

def test_packing(spark, documents, edge_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.packing(documents, with_ids=True).collect()
    by_doc: dict = {}
    bins: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert [x for r in parts for x in r.ids] == ids
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
        assert len(parts) == -(-len(ids) // 1024)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.005 * (sum(r.length for r in rows) / 1024) + 1
    edge = packing.packing(edge_docs).collect()
    assert sum(1 for r in edge if r.piece == 0) == edge_docs.count()
    assert packing.packing(no_docs).count() == 0


def test_packing_plan_places_every_piece_once():
    rnd = np.random.default_rng(3)
    for capacity, top in ((100, 101), (64, 20), (10, 11)):
        counts = {int(k): int(n) for k, n in zip(*np.unique(rnd.integers(1, top, 500), return_counts=True), strict=True)}
        fixed, rest = packing.reduce_histogram(counts, capacity)
        patterns = fixed + packing.best_fit(rest, capacity)
        used = Counter()
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= capacity
            for k in lengths:
                used[k] += n
        assert dict(used) == counts
        length, first, n, _, _ = packing.places(patterns)
        for k in counts:
            own = sorted(zip(first[length == k], n[length == k], strict=True))
            assert [a for a, _ in own] == list(np.cumsum([0, *[b for _, b in own]])[:-1])


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endof", "text|>", "end. <|endoftext|>,\n<|endoftext|> the", None,
             "<|endoftext|<|endoftext|>", " <|endoftext|>" * 600]
    rows = packing.packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, t in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [2]


def exact_sequences(pieces: tuple[int, ...], capacity: int) -> int:
    """Fewest sequences, by trying every place of every piece."""
    best = [len(pieces)]

    def put(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms)}.values():
            if rooms[j] >= pieces[i]:
                put(i + 1, rooms[:j] + [rooms[j] - pieces[i]] + rooms[j + 1:])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_reduction_keeps_the_fewest_sequences():
    rnd = np.random.default_rng(11)
    threes = 0
    for trial in range(400):
        capacity = int(rnd.integers(10, 40))
        low = capacity // 4 + 1 if trial % 2 else 1  # sets of four cannot fit, so sets of three are tried
        pieces = rnd.integers(low, capacity + 1, int(rnd.integers(1, 9))).tolist()
        if trial % 3 == 0:
            pieces = [max(low, p // 2) for p in pieces]
        fixed, rest = packing.reduce_histogram(dict(Counter(pieces)), capacity)
        used = Counter(rest)
        for n, members in fixed:
            assert n > 0 and sum(members) <= capacity
            threes += len(members) == 3
            for x in members:
                used[x] += n
        assert used == Counter(pieces)
        left = tuple(sorted((x for x, n in rest.items() for _ in range(n)), reverse=True))
        assert sum(n for n, _ in fixed) + exact_sequences(left, capacity) == exact_sequences(tuple(sorted(pieces, reverse=True)), capacity), (pieces, capacity)
    assert threes > 20


def test_units_are_encoded_like_whole_texts():
    import random

    from tokenizers import Tokenizer

    from ledgerlens.llm.tokens import Encoder

    plain = Tokenizer.from_file(packing.default_tokenizer())
    rnd = random.Random(1)
    alphabet = ["a", "b", "The", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "1", "22", "é", "ß", " ", "中", "\t", "\r\n",
                "!?", "-", "<|endoftext|>", "x" * 70, "👍", "\x7f", "\x01", " ", "　", "\x85"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + [None, "", " ", "\n"]
    encoder = Encoder(packing.default_tokenizer())
    for _ in range(2):  # filled and warm
        ids, at = encoder.rows(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_words_go_to_the_model_at_once(tmp_path):
    """Units that no byte-level tokenizer splits skip the whole encoding; ids are those of whole texts all the same."""
    import json
    import random

    from tokenizers import Tokenizer

    from ledgerlens.llm.tokens import Encoder

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    rnd = random.Random(2)
    parts = ["a", "Zq", "é", "ß", "Ñ", "×", "÷", "ɿ", "ʰ", "Ж", "ҁ", "ω", "中", "\u0301", "7", "٣", "²", "-", "_", "***", "'", "'ll", "’", "<|", "|>", "<|endoftext|>", " ", "  ", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    encoder, whole = Encoder(path), []
    encode, encoder.tokenizer = encoder.tokenizer.encode_batch, type("Counting", (), {
        "encode_batch": staticmethod(lambda units, **kw: whole.extend(units) or encode(units, **kw))})
    ids, at = encoder.rows(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
    whole.clear()
    encoder.rows(pa.array([" ".join(f"{a}{b}ü{c}***" for a in "abc" for b in ("Über", "слово") for c in ("", "x", "ñ"))]))
    assert whole == []

    spec = json.load(open(path))  # not byte-level words: the library's whole encoding for every unit
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefixed.json").write_text(json.dumps(spec))
    spec["pre_tokenizer"]["add_prefix_space"] = False
    spec["added_tokens"].append(dict(spec["added_tokens"][0], id=50257, content="Zq"))
    (tmp_path / "added.json").write_text(json.dumps(spec))
    assert Encoder(path).model and not Encoder(str(tmp_path / "prefixed.json")).model and not Encoder(str(tmp_path / "added.json")).model


# -- near dedup -------------------------------------------------------------------------------------

@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_edges(edge_docs, edge_rows, no_docs, width):
    out = near_dedup.near_dedup(edge_docs, width).collect()
    texts = {r[0]: r[1] for r in edge_rows if r[0] is not None}
    sets = {i: brute.shingles(t, width) for i, t in texts.items()}
    want = brute.smallest_reachable(sets, brute.near_links(sets))
    assert len(out) == len(edge_rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    if width == 5:
        left = near_dedup.representatives(edge_docs)
        assert left.columns == edge_docs.columns
        assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(
            i or 0 for i, *_ in edge_rows if i is None or want[i] == i)
        assert near_dedup.near_dedup(no_docs).count() == 0


def test_near_dedup_whole_table(documents):
    sets = {r.doc_id: brute.shingles(r.text, 2) for r in documents.collect()}
    want = brute.smallest_reachable(sets, brute.near_links(sets))
    for r in near_dedup.near_dedup(documents, 2).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_further_pairs_reach_members_that_the_first_one_does_not(spark):
    """A chain of texts, each near the next but far from the first, is one component."""
    words = [f"v{i}" for i in range(400)]
    rows = [(k, " ".join(words[12 * k:12 * k + 200])) for k in range(12)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.component_id for r in out} == {0}


def test_near_dedup_at_other_thresholds(spark):
    """Pairs of texts just above the threshold are found, just below it not, whatever the threshold."""
    for percent in (40, 60):
        rows, want = [], {}
        for k in range(60):
            # two sets of 1,000 shingles each that share ``same``: the similarity is same / (2000 - same)
            same = math.ceil(2000 * percent / (100 + percent)) + (3 if k % 2 else -3)
            words = [f"p{k}w{i}" for i in range(2000 - same)]
            rows += [(2 * k, " ".join(words[:1000])), (2 * k + 1, " ".join(words[-1000:]))]
            want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (0 if k % 2 else 1)}
        out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()
        assert {r.doc_id: r.component_id for r in out} == want
    with pytest.raises(ValueError):
        near_dedup.matches(5)


def test_lm_chunks_hold_tokens_and_unpack_to_them():
    texts = [None, "", "A a b", *(" ".join(f"w{(i * j) % 91}" for j in range(300)) for i in range(60))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [None, *range(1, len(texts))], "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    keys, place, ends, counts, first, train = lm_scoring._tokens(batch, 10)
    assert (np.diff(keys.astype(object)) > 0).all()
    payload, listed = lm_scoring.sealed(batch, 10)
    ids, size, *got = lm_scoring.unsealed(payload)
    assert ids.column(0).equals(batch.column(0)) and size == len(keys) and len(payload) < len(exchange.seal(batch)) * 2
    for a, b in zip([*got, *lm_scoring._unpack(listed)], [place, ends, first, train, keys, counts], strict=True):
        assert np.array_equal(a, b)


def test_pairs_of_a_context_stand_together_in_its_bucket():
    rnd = np.random.default_rng(3)
    bucket, context = rnd.integers(0, 70_000, 5000), rnd.integers(0, 200_000, 5000)
    order = lm_scoring.by_bucket_and_context(bucket, context)
    assert np.array_equal(order, np.lexsort((context, bucket)))
    found, first, place = lm_scoring.distinct(context.astype(np.uint64))
    assert np.array_equal(found[place], context) and np.array_equal(context[first], found) and (np.diff(first) > 0).all()


def test_toxicity_training_keeps_two_keys_of_a_word(monkeypatch):
    """While words are tagged, a shard of the sample holds 16 bytes a word; the other keys are made again afterwards."""
    seen = []

    def tag(shards, weight):
        seen.extend(sum(k.nbytes for k in s.keys.values()) / len(s.row) for s in shards)
        for s in shards:
            s.tags = np.zeros(len(s.row))

    class Sample:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def collect(self):
            return [{"toxic": 0, "n": 5}, {"toxic": 1, "n": 5}]

        def toArrow(self):
            return pa.table({"doc_id": range(10), "text": ["some words here"] * 10, "toxic": [0, 1] * 5})

    monkeypatch.setattr(toxicity, "tag_words", tag)
    monkeypatch.setattr(toxicity, "F", Sample())
    monkeypatch.setattr(toxicity, "fold", lambda *a: 0)
    toxicity.train(Sample(), Sample())
    assert seen == [16.0]


def test_lm_leaves_no_shuffle_behind_and_numbers_words_by_count(spark, monkeypatch):
    """Only the last join's shuffle is still to be made when the scores are asked for; frequent words have small numbers."""
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(400))) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    seen = []
    monkeypatch.setattr(lm_scoring, "word_counts", lambda chunked, bits, make=lm_scoring.word_counts: seen.append(materialize(make(chunked, bits), "seen")) or seen[0])
    before = files()
    with paths_written() as written:
        lm_scoring.lm_scores(documents)
    assert [p for p in written if os.path.exists(p) and "words" in spark.read.parquet(p).columns] == []
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert sum(os.path.getsize(f) for f in left if os.path.exists(f)) < 10_000  # sums over tables, no exchange of pairs
    for r in seen[0].where("chunk >= 0").select("answer").collect():
        counts, places = lm_scoring._unzip(r[0], ("<i8", None), ("<i8", None))
        assert (np.diff(counts[np.argsort(places)]) <= 0).all()
