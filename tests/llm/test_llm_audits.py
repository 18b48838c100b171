"""Prefix trie, source divergence and nearest neighbours against SQL and brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import ann, divergence, prefix_trie, ranks

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, n long, low string, place string, key string"


def by_sql(sql: str, **tables) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    return [c[0] for c in found.description], sorted(found.fetchall(), key=repr)


def same_as_sql(out, sql: str, **tables) -> int:
    columns, want = by_sql(sql, **tables)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=repr) == want
    return len(want)


def turn(conv, at, role, text):
    return (conv, at, role, text, 1, "x", "y", "z")


@pytest.fixture(scope="module")
def talks(spark):
    rnd = random.Random(3)
    rows = [turn(None, 0, "user", "nobody's"), turn(-3, 0, None, None), turn(-3, None, "user", "first of all"), turn(-3, 1, "", "")]
    rows += [turn(0, i, "user", t) for i, t in enumerate("abcdefgh")] + [turn(0, 2, "user", "tie"), turn(0, 2, "user", "tie")]
    for conv in range(1, 14):
        rows += [turn(conv, i, rnd.choice(["user", "assistant", None]), rnd.choice(["é", "yes", "", None, "no " * 50])) for i in range(rnd.randint(1, 12))]
    rows += [turn(c, i, "user", t) for c in range(100, 160, 5) for i, t in enumerate(["same", "start", "and end"])]  # copies
    rows += [turn(777, i, "user", "x" * 20000) for i in range(40)]
    return spark.createDataFrame(rows, TURNS).repartition(4)


@pytest.mark.parametrize("rule", [{}, {"strip": 3}, {"strip": 2, "shard_turns": 5}])
def test_trie_of_edge_conversations(talks, rule):
    assert same_as_sql(prefix_trie.prefix_trie(talks, **rule), prefix_trie.ORACLE_SQL, conversations=talks) > 60


def test_trie_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    out = prefix_trie.prefix_trie(table).collect()
    convs = table.select("conv_id").distinct().count()
    root = [r for r in out if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == convs and root[0].parent_conv_id is None
    assert root[0].n_leaves == sum(r.n_children == 0 for r in out)
    assert sum(r.n_children for r in out) == len(out) - 1
    assert len({(r.conv_id, r.depth) for r in out}) == len(out)


def test_trie_without_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [turn(c, 0, "user", "only") for c in range(1, 5)]  # no base, and nothing of their own after the shared turns
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    same_as_sql(out, prefix_trie.ORACLE_SQL, conversations=spark.createDataFrame(rows, TURNS))
    assert [r for r in out.collect() if r.depth == 0][0].n_convs == 4


def test_members_are_hashed_over_several_pieces(spark, monkeypatch):
    import hashlib

    strips = spark.range(1000).selectExpr("id AS conv_id", "IF(id < 3, 'a', 'b') AS key", "true AS last").repartition(3)
    got = {r.sequence: r.ends_sha256 for r in prefix_trie.ends(strips).collect()}
    want = {k: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for k, m in (("a", range(3)), ("b", range(3, 1000)))}
    assert got == want


def test_median_insertion_balances_the_search_trees():
    trie = prefix_trie.TernaryTrie()
    for i in prefix_trie._median_first(1000):
        trie.insert([i], [1], 1, i)

    def height(at):
        return 0 if at < 0 else 1 + max(height(trie.low_link[at]), height(trie.high_link[at]))

    assert height(trie.root) == 10 and sorted(trie.symbol) == list(range(1000))


def test_places_of_a_group_over_many_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).selectExpr("IF(id < 4000, NULL, id % 7) AS g", "hash(id) AS v", "id AS place_of").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.ranked(rows, ["g"], [F.col("v"), F.col("place_of")], "ranked").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups: dict = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for rows_ in groups.values():
        ordered = sorted(rows_, key=lambda r: (r.v, r.place_of))
        assert [r.place for r in ordered] == list(range(len(ordered)))


# -- source divergence ---------------------------------------------------------------------------


def test_divergence_of_edge_documents(spark, edge_docs):
    more = spark.createDataFrame(
        [(i, f"Common WORD number {i} É é common d{i % 3}x word", ["en", None, "de"][i % 3], ["s", "t", None, "u"][i % 4], 1, *("x",) * 7) for i in range(60)]
        + [(99, "12 34 !", "zz", "only", 1, *("x",) * 7), (98, None, "zz", "other", 1, *("x",) * 7)], edge_docs.schema)
    docs = edge_docs.unionByName(more)
    assert same_as_sql(divergence.divergence(docs), divergence.ORACLE_SQL, documents=docs) > 20


def test_divergence_in_small_blocks_and_tiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert same_as_sql(divergence.divergence(docs, levels=4, tile=3), divergence.ORACLE_SQL, documents=docs) > 500


@pytest.mark.parametrize("broadcast", [0, 100])
def test_rows_of_one_id_are_one_document(spark, monkeypatch, broadcast):
    """A term of nine documents is not kept when some come twice; its occurrences count in every row."""
    monkeypatch.setattr(divergence, "BROADCAST_IDS", broadcast)
    rows = [(i, "kept Kept", "en", "st"[i % 2]) for i in range(10)] + [(i, "nine", "en", "s") for i in range(20, 29)]
    rows += [(20, "nine", "en", "s"), (21, "nine", "en", "t"), (0, "kept", "en", "s"), (5, "nine", "de", "s")]
    rows += [(None, "bare", "en", "t")] * 10  # without an id each row is a document
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value").collect()}
    s, t, both = (1 + 10 ** 9 * 13 // 15, 1 + 10 ** 9 * 2 // 15), (1 + 10 ** 9 * 12 // 24, 1 + 10 ** 9 * 12 // 24), (1 + 10 ** 9 * 23 // 35, 1 + 10 ** 9 * 12 // 35)
    price = [sum((p - q) ** 2 // (p + q) for p, q in zip(a, b, strict=True)) for a, b in ((s, t), (t, s))]
    assert got == {("en", "s", "pair", "t", price[0]), ("en", "t", "pair", "s", price[1]),
                   ("en", "s", "term", "kept", (s[0] - both[0]) ** 2 // (s[0] + both[0])),
                   ("en", "t", "term", "bare", (t[1] - both[1]) ** 2 // (t[1] + both[1]))}


def test_divergence_without_rows(spark, no_docs):
    assert divergence.divergence(no_docs).collect() == []


def test_equal_subtrees_are_one_node_and_prices_are_exact():
    rnd = np.random.default_rng(5)
    counts = rnd.integers(0, 2, (4, 64)) * rnd.integers(0, 3, (4, 64))
    counts[:, 61:] = divergence.NO_LEAF
    counts[3] = counts[2]
    trees = divergence.Trees(counts)
    assert trees.roots[2] == trees.roots[3] and all(c.shape[1] <= 4 * 64 for c in trees.children)
    big = 8_000_000_000_000_000
    for totals in (np.array([200, 300, 7, 7]), np.array([big, 99, big - 1, 12345678901])):
        for a in range(4):
            for b in range(4):
                want = 0
                for m, n in zip(counts[a].tolist(), counts[b].tolist(), strict=True):
                    if m != divergence.NO_LEAF:
                        p, q = (1 + 10 ** 9 * (c + 2) // int(t) for c, t in ((m, totals[a]), (n, totals[b])))
                        want += (p - q) ** 2 // (p + q)
                assert trees.price(a, b, totals) == want


# -- nearest neighbours ----------------------------------------------------------------------------


def neighbours(rows, k=5, every=50):
    """query position -> candidates (score, -vec_id), best first."""
    out = {}
    usable = [i for i, (vec_id, v) in enumerate(rows) if vec_id is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i in usable:
        if rows[i][0] % every == 0:
            q = np.array(rows[i][1], float)
            found = []
            for j in usable:
                if j != i and len(rows[j][1]) == len(q):
                    x = np.array(rows[j][1], float)
                    found.append((float((q * x).sum() / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum()))), rows[j][0]))
            out[i] = sorted(found, key=lambda f: (-round(f[0], 12), f[1]))[:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_with_edge_vectors(spark, kind):
    rnd = np.random.default_rng(1)
    vectors = [rnd.standard_normal(16).astype(np.float32).tolist() for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(i, vectors[7]) for i in range(400, 420)] + [(450, vectors[7]), (450, vectors[7]), (None, vectors[3])]
    rows += [(500, None), (550, []), (600, [0.0] * 16), (650, [1.0] * 15 + [None]), (700, [float("nan")] * 16), (750, [float("inf")] + [1.0] * 15)]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 1.0]), (850, [3.0])]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, score string, code string")
    got = ann.nearest(df.repartition(3)).collect()
    by_query: dict = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    want = neighbours(rows)
    assert set(by_query) == {rows[i][0] for i, found in want.items() if found}
    for i, found in want.items():
        same = [i2 for i2 in want if rows[i2][0] == rows[i][0]]
        have = sorted(by_query.get(rows[i][0], []), key=lambda r: (r.rank, r.vec_id))
        assert len(have) == sum(len(want[j]) for j in same)
        assert [r.vec_id for r in have[::len(same)]] == [v for _, v in found]
        assert np.allclose([r.score for r in have[::len(same)]], [s for s, _ in found], atol=1e-12, rtol=0)


def test_huge_and_tiny_components_keep_their_cosine(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [2e-308, 1e-308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 9)) for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 1.0), (3, round(3 / np.sqrt(10), 9)), (2, 0.0)]


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    found: dict = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        hits.append(len(found[ids[i]] & set(ids[np.lexsort((ids, -np.round(score, 12)))[:5]].tolist())) / 5)
    assert np.mean(hits) >= 0.97


def test_neighbours_in_blocks_are_those_of_one_block(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(tuple(r) for r in ann.nearest(df).collect())
    monkeypatch.setattr(ann, "BLOCK_BYTES", 16 * 1024)
    monkeypatch.setattr(ann, "GROUP_BYTES", 1024)
    assert sorted(tuple(r) for r in ann.nearest(df).collect()) == want


def test_estimates_stay_within_their_bounds():
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((2000, 64))
    bits, scalar = ann.codes(x)
    signs = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
    q = rnd.standard_normal(64)
    q /= np.sqrt((q * q).sum())
    estimate = signs @ (q @ ann.rotation(64)) / scalar
    true = (x / ann.norms(x)[:, None]) @ q
    bound = ann.EPSILON * np.sqrt(1 - scalar ** 2) / scalar / np.sqrt(63)
    assert (np.abs(estimate - true) <= bound).mean() > 0.995
    assert abs((estimate - true).mean()) < 0.01


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
