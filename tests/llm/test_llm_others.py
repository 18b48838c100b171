"""Vectors, archives, components, the pipeline, and the registered queries with SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import components, embedding_dedup, queries, shared, warc

SF = "/root/testdata/sf0.01"


# -- embeddings -----------------------------------------------------------------------------

def check_vectors(rows, out):
    own = {}
    for i, v in rows:
        if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            own.setdefault((i, tuple(v)), []).append(np.array(v, np.float32).astype(float))
    keys = list(own)
    flat = [(k, u / np.linalg.norm(u)) for k in keys for u in own[k]]
    links, n = [], [0] * len(flat)
    for a in range(len(flat)):
        for b in range(a + 1, len(flat)):
            if len(flat[a][1]) == len(flat[b][1]) and flat[a][1] @ flat[b][1] >= 0.9:
                links.append((flat[a][0][0], flat[b][0][0]))
                n[a] += 1
                n[b] += 1
    want = brute.smallest_reachable({i for i, _ in rows if i is not None}, links)
    expect = sorted([(k[0], n[j], want[k[0]]) for j, (k, _) in enumerate(flat)])
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.n_links or (r.vec_id in {k[0] for k in keys}))
    assert [g for g in got if g in expect] == expect
    assert all(r.kept == (r.vec_id == r.component_id) for r in out) and len(out) == len(rows)


def test_embedding_edges(spark):
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=8)
    rows = [(i, (centre + 0.1 * rnd.normal(size=8)).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(200, rows[0][1]), (201, [0.0] * 8), (202, None), (203, []), (204, [1.0, None] + [0.0] * 6),
             (205, [float("nan")] * 8), (206, [float("inf")] * 8), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [-0.0, 1.0]), (210, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("raw", df_lit()).repartition(3)
    check_vectors(rows, embedding_dedup.embedding_dedup(df).collect())
    nothing = embedding_dedup.embedding_dedup(df.limit(0)).collect()
    assert nothing == []


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_embedding_tiles_and_cells(spark, monkeypatch):
    """Many small tiles, cells and balls give the same links."""
    for name, value in (("TILE", 16), ("CELL_ROWS", 25), ("STRIP", 8), ("SAMPLE", 60), ("DENSE", 3)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rnd = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rnd.normal(size=6)
        rows += [(len(rows) + i, (centre + s * rnd.normal(size=6)).astype(np.float32).tolist()) for i, s in enumerate([0.05] * 12 + [0.4] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    check_vectors(rows, embedding_dedup.embedding_dedup(df).collect())


# -- components --------------------------------------------------------------------------------

def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    out = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = brute.smallest_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert {r.node: r.component for r in out} == want and len(out) == len(nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- WARC ---------------------------------------------------------------------------------------

PAGES = [(1, "http://a/ b", "<p>é</p>" * 40), (2, None, "<p>é</p>" * 40), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
         (None, "u", "<p>é</p>" * 40), (7, "u", "x" * 100), (8, "u", "x" * 100), (7, "u", "x" * 100), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (10, "u", "y" * 3_000_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(2)
    archives = warc.write_archives(pages, archive_bytes=5000)
    rows = warc.read_archives(archives).collect()
    assert len(rows) == len(PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id])
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id] and r.refers_to is None
        else:
            assert r.payload is None and html[r.refers_to] == html[r.page_id]
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds[2] == ("revisit", 1) and kinds[8] == ("revisit", 7) and kinds[6] == ("response", None) and kinds[None] == ("response", None)
    # the same through files
    assert warc.export(archives, str(tmp_path)) == archives.count()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.zst")
    assert sorted(str((r.page_id, r.payload_digest)) for r in warc.read_archives(files).collect()) == sorted(str((r.page_id, r.payload_digest)) for r in rows)
    assert warc.warc(pages.limit(0)).count() == 0


def test_warc_reader_rejects_broken_archives():
    good = warc.record(1, "u", b"payload", None)
    content = warc.pack([good, warc.record(2, "u", b"other", None)])
    assert [warc.parse(x)[1] for x in warc.unpack(content)] == [b"payload", b"other"]
    for broken in (content[:-3], b"", b"\0" * 20, content[4:]):
        with pytest.raises(Exception):
            list(warc.unpack(broken))
    for record in (good.replace(b"payload\r\n", b"payloae\r\n"), good.replace(b"Content-Length: 7", b"Content-Length: 6"),
                   good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 7\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse(record)


# -- queries with SQL, pipeline -------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    from tools.oracle_check import TABLES, digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    res = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()], True) == digest(columns, res.fetchall(), True)


def test_pipeline(spark, edge_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    for docs in (edge_docs, no_docs):
        given = docs
        for n, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            if n != names[-1]:
                assert out.columns == docs.columns
            given = shared.materialize(out, "test-stage")
        assert (given.count() > 0) == (docs is edge_docs)


def test_pipeline_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = shared.materialize(stages["toxicity"](spark, docs, SF), "test-stage")
    texts = {r.doc_id: r.text for r in clean.collect()}
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    distinct = shared.materialize(stages["exact_dedup"](spark, clean, SF), "test-stage")
    assert {r.doc_id for r in distinct.collect()} == set(first.values())
    sets = {i: brute.shingles(texts[i], 5) for i in first.values()}
    root = brute.smallest_reachable(sets, brute.near_links(sets))
    apart = shared.materialize(stages["minhash_near_dedup"](spark, distinct, SF), "test-stage")
    assert {r.doc_id for r in apart.collect()} == {i for i in sets if root[i] == i}
    mixed = shared.materialize(stages["mixing"](spark, apart, SF), "test-stage")
    total = sum(len(brute.space_words(r.text)) for r in mixed.collect())
    before = sum(len(brute.space_words(r.text)) for r in apart.collect())
    assert total == pytest.approx(1.5 * before, rel=0.05)
    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    assert sum(1 for r in packed if r.piece == 0) == mixed.count()


def test_texts_that_are_alone_pass_the_filter(spark, edge_docs):
    """The filter lets every repeated text through to the join, and few others."""
    from ledgerlens.llm import exact_dedup

    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 10 = 0, concat('twin ', id div 20), concat('alone ', id)) AS text", "id AS __x")
    twins = docs.where("doc_id % 10 = 0").select(exact_dedup.text_digest().alias("text_sha256")).distinct()
    rest, near = exact_dedup._by_filter(docs, twins)
    assert near.where("doc_id % 10 = 0").count() == 300 and rest.count() + near.count() == 3000
    assert near.count() < 300 + 2700 / 8 and rest.columns == docs.columns
    kept = sorted(r.doc_id for r in exact_dedup.unique(docs).collect())
    assert kept == [i for i in range(3000) if i % 20 != 10]


@pytest.mark.parametrize("rows_per_block", [1, 5, 1000])
def test_running_sums_in_levels(spark, rows_per_block):
    # one key holds most rows, so that blocks of one row take three levels; a null key is a group
    rows = [("a" if i % 4 else None if i % 8 else "b", hashlib.md5(str(i).encode()).hexdigest(), i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, h string, v long")
    out = shared.running_sum(df, ["k"], ["h"], "v", "before", rows_per_block)
    assert out.columns == ["k", "h", "v", "before"]
    want, total = [], Counter()
    for k, h, v in sorted(rows, key=lambda r: r[1]):
        want.append((str(k), h, v, total[k]))
        total[k] += v
    assert sorted((str(r.k), r.h, r.v, r.before) for r in out.collect()) == sorted(want)
    assert shared.running_sum(df.limit(0), ["k"], ["h"], "v", "before", rows_per_block).count() == 0
