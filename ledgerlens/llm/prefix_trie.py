"""Prefix trie of rebuilt conversations: what a prompt cache over shared first turns would save.

1. Turns are dictionary-encoded: each distinct (role, text) gets a 64-bit id by way of its SHA-256; texts are read
   once and never shuffled.
2. A conversation is rebuilt from the first turns of its block's base conversation and its own later turns, and cut
   into strips of ``strip`` turns (longer where needed to keep it to ``STRIPS`` strips), so no row
   holds an unbounded conversation. A strip is named by the digest of all turns before it (``top``).
3. Equal strips collapse to one sequence with a count. The sequences of one strip are range-sorted by (top, ids)
   into shards of bounded size. A shard inserts its sequences into a ternary search tree, median first, so
   that the search trees of a level are balanced; an iterative traversal then accumulates, from the
   leaves up, members, children, leaves and savings of every trie node.
4. Only nodes on the path of a shard's first or last sequence can also lie in other shards. These boundary nodes leave the
   shard as partial sums, keyed by the digest of their path, and are merged; there are at most two paths a shard.
5. Strips are done from the deepest up; a strip hands the sums of its tops to the sequences that end there in the
   strip above.
6. The members that end at a node are range-sorted, joined to pieces of text, and hashed piece by piece in order, so a
   node at which a third of all conversations end needs no list in memory.

What is broadcast: groups that cross a partition border (``ranks``), at most one a partition.

Defined cases: rows with a null conv_id belong to no conversation and are left out; null roles and texts are empty; turns
are ordered with null first, equal turns by role and then by the SHA-256 of the turn, repeated rows count each; remainders of negative ids
keep the sign (-3 belongs to base 0); a conversation that is rebuilt without turns is a member of the root only; an
empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.ranks import ranked
from ledgerlens.llm.shared import materialize, partitions

BLOCK = 5          # conversations that share the first turns of one (fixed value of the contract)
MOST_SHARED = 9    # shared turns are 0 to MOST_SHARED - 1 (fixed value of the contract)
STRIP = 256
STRIPS = 32
SHARD_TURNS = 200_000
PIECE = 1 << 17    # members joined into one piece of text
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

TRIE = ("level long, edge boolean, node binary, parent binary, path array<binary>, n long, low long, parent_low long, "
        "bytes long, kids long, leaves long, saved long, sequence string, top string")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), id (of the distinct turn), size (UTF-8 bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = materialize(conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size")), "turns")
    ids = materialize(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    placed = ranked(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "turns-in-order")
    return materialize(placed.join(ids, "digest").select("conv_id", "place", "id", "size"), "coded-turns")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def segments(turns: DataFrame, strip: int = STRIP) -> tuple[DataFrame, int]:
    """The rebuilt conversations in strips: conv_id, k, ids, sizes, top, key, last; and the strip's length.

    ``top`` names the turns before the strip, ``key`` those up to its end, so a strip's key is the next one's top.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    heads = (turns.where(F.col("place") < MOST_SHARED - 1).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("head")))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<place:long,id:long,size:long>>")), F.lit(1), F.col("h").cast("int"))
    facts = materialize(convs.join(heads, "base", "left").withColumn("taken", taken)
                        .select("conv_id", "h", "taken", F.size("taken").cast("long").alias("n_head"),
                                F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("n_own")), "rebuilt")
    longest = facts.agg(F.max(F.col("n_head") + F.col("n_own"))).first()[0] or 0
    strip = max(strip, -(-longest // STRIPS))
    head = facts.select("conv_id", F.posexplode("taken").alias("pos", "t")).select("conv_id", F.col("pos").cast("long"), "t.id", "t.size")
    own = (turns.join(facts.select("conv_id", "h", "n_head"), "conv_id").where("place >= h")
           .select("conv_id", (F.col("place") - F.col("h") + F.col("n_head")).alias("pos"), "id", "size"))
    rows = head.unionByName(own).withColumn("k", F.expr(f"pos div {strip}"))
    cut = rows.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))
    bare = facts.where("n_head + n_own = 0").select("conv_id", F.lit(0).cast("long").alias("k"),
                                                    F.array().cast("array<struct<pos:long,id:long,size:long>>").alias("t"))
    cut = cut.unionByName(bare).select("conv_id", "k", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    cut = cut.withColumn("own", F.sha2(F.array_join("ids", ","), 256))
    order = Window.partitionBy("conv_id").orderBy("k")  # at most STRIPS rows a conversation, and one for rounding
    prior = F.collect_list("own").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = (cut.withColumn("prior", prior).withColumn("last", F.lead("k").over(order).isNull())
           .withColumn("top", F.sha2(F.array_join("prior", ","), 256))
           .withColumn("key", F.sha2(F.array_join(F.array_append("prior", F.col("own")), ","), 256)))
    return materialize(cut.select("conv_id", "k", "ids", "sizes", "top", "key", "last"), "strips"), strip


def ends(strips: DataFrame) -> DataFrame:
    """sequence (key of a last strip), ends_sha256 (of its members' ids, ascending, joined by commas)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, members = None, 0, []
        out: tuple[list, list, list] = ([], [], [])

        def close():
            if members:
                for column, value in zip(out, (key, first, ",".join(map(str, members))), strict=True):
                    column.append(value)
                members.clear()

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(members) == PIECE:
                    close()
                    key, first = k, conv
                members.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                             names=["key", "first", "members"])
            for column in out:
                column.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                         names=["key", "first", "members"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["sequence", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["sequence", "ends_sha256"])

    members = strips.where("last").select("key", "conv_id")
    joined = materialize(members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                         .mapInArrow(pieces, "key string, first long, members string"), "members")
    return materialize(joined.repartition("key").sortWithinPartitions("key", "first")
                       .mapInArrow(digests, "sequence string, ends_sha256 string"), "ends")


def _median_first(n: int) -> Iterator[int]:
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(lo, mid), (mid + 1, hi)]


class TernaryTrie:
    """A ternary search tree over sequences of numbers; every node is one trie node."""

    def __init__(self) -> None:
        self.symbol: list[int] = []
        self.low_link: list[int] = []
        self.next_link: list[int] = []
        self.high_link: list[int] = []
        self.n: list[int] = []       # members below
        self.low: list[int] = []     # smallest of them
        self.size: list[int] = []    # bytes of the last text
        self.root = -1

    def insert(self, symbols: list[int], sizes: list[int], n: int, low: int) -> list[int]:
        """Add a sequence; returns its nodes."""
        path: list[int] = []
        holder, link, at = -1, None, self.root
        for symbol, size in zip(symbols, sizes, strict=True):
            while at >= 0 and self.symbol[at] != symbol:
                holder, link = at, self.low_link if symbol < self.symbol[at] else self.high_link
                at = link[at]
            if at < 0:
                at = len(self.symbol)
                for column, value in ((self.symbol, symbol), (self.low_link, -1), (self.next_link, -1), (self.high_link, -1),
                                      (self.n, 0), (self.low, low), (self.size, size)):
                    column.append(value)
                if link is None:
                    self.root = at
                else:
                    link[holder] = at
            self.n[at] += n
            self.low[at] = min(self.low[at], low)
            path.append(at)
            holder, link, at = at, self.next_link, self.next_link[at]
        return path

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent or -1, depth), every parent before its descendants."""
        order, todo = [], [(self.root, -1, 0)] if self.root >= 0 else []
        while todo:
            at, parent, depth = todo.pop()
            order.append((at, parent, depth))
            for link in (self.low_link[at], self.high_link[at]):
                if link >= 0:
                    todo.append((link, parent, depth))
            if self.next_link[at] >= 0:
                todo.append((self.next_link[at], at, depth + 1))
        return order


def _names(top: str, ids: list[int]) -> list[bytes]:
    """Digest of every prefix of a sequence, the top's first."""
    out = [hashlib.sha256(top.encode()).digest()[:16]]
    for i in ids:
        out.append(hashlib.sha256(out[-1] + i.to_bytes(8, "little", signed=True)).digest()[:16])
    return out


def _shard(rows: list[dict], base: int) -> dict[str, list]:
    """Trie nodes of one shard of sorted sequences; ``base`` is the depth of the strip's tops."""
    trie = TernaryTrie()
    rank = {top: i for i, top in enumerate(sorted({r["top"] for r in rows}))}
    last = {}
    named: dict[int, tuple[list[bytes], int]] = {}
    for i in _median_first(len(rows)):
        r = rows[i]
        path = trie.insert([rank[r["top"]], *r["ids"]], [0, *r["sizes"]], r["n"], r["low"])
        trie.low[path[0]] = min(trie.low[path[0]], r["top_low"])
        last[path[-1]] = i
        if i in (0, len(rows) - 1):
            names = _names(r["top"], r["ids"])
            named |= {at: (names, d) for d, at in enumerate(path)}
    tops = {rank[t]: t for t in rank}
    count = len(trie.symbol)
    kids, leaves, saved = [0] * count, [0] * count, [0] * count
    order = trie.walk()
    for at, parent, depth in reversed(order):
        if at in last:
            r = rows[last[at]]
            kids[at] += r["below_kids"]
            leaves[at] += r["below_leaves"]
            saved[at] += r["below_saved"]
        if at not in named and (depth or not base):
            leaves[at] += kids[at] == 0
            saved[at] += (trie.n[at] - 1) * trie.size[at]
        if parent >= 0:
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
            kids[parent] += at not in named
    out: dict[str, list] = {c.split()[0]: [] for c in TRIE.split(", ")}
    for at, parent, depth in order:
        edge = at in named
        names, d = named.get(at, ([], 0))
        end = last.get(at)
        row = {
            "level": base + depth, "edge": edge, "node": names[d] if edge else None,
            "parent": named[parent][0][named[parent][1]] if parent in named else None,
            "path": names[:d] if edge else None, "n": trie.n[at], "low": trie.low[at],
            "parent_low": trie.low[parent] if parent >= 0 and parent not in named else None, "bytes": trie.size[at],
            "kids": kids[at], "leaves": leaves[at], "saved": saved[at],
            "sequence": rows[end]["key"] if end is not None and rows[end]["ends"] else None,
            "top": tops[trie.symbol[at]] if not depth else None}
        for name, value in row.items():
            out[name].append(value)
    return out


_ARROW = pa.schema([("level", pa.int64()), ("edge", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()),
                    ("path", pa.list_(pa.binary())), *[(c, pa.int64()) for c in ("n", "low", "parent_low", "bytes", "kids", "leaves", "saved")],
                    ("sequence", pa.string()), ("top", pa.string())])


def _strip_nodes(sequences: DataFrame, base: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one strip (whole), and the sums of its tops: key, below_kids, below_leaves, below_saved."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pydict(_shard(rows, base), _ARROW)

    sums = ["kids", "leaves", "saved"]
    trie = materialize(sequences.repartitionByRange(shards, "top", "ids").sortWithinPartitions("top", "ids").mapInArrow(build, TRIE), "trie")
    edges = materialize(trie.where("edge").groupBy("node").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("level").alias("level"), F.max("bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in sums], F.max("sequence").alias("sequence"), F.max("top").alias("top"),
        F.max("parent").alias("parent"), F.first("path").alias("path")), "edges")
    inner = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    counted = F.lit(True) if not base else F.col("level") > base
    merged = edges.join(inner, "node", "left").withColumn("kids", F.col("kids") + F.coalesce("inner", F.lit(0)))
    merged = materialize(merged.withColumn("leaf", F.when(counted & (F.col("kids") == 0), 1).otherwise(0).cast("long"))
                         .withColumn("own", F.when(counted, (F.col("n") - 1) * F.col("bytes")).otherwise(F.lit(0)).cast("long")).drop("inner"), "edges")
    above = (merged.select(F.explode("path").alias("node"), "leaf", "own").groupBy("node")
             .agg(F.sum("leaf").alias("up_leaves"), F.sum("own").alias("up_saved")))
    lows = edges.select(F.col("node").alias("parent"), F.col("low").alias("edge_low"))
    columns = ["level", "n", "low", "parent_low", *sums, "sequence", "top"]
    whole = (merged.join(above, "node", "left").join(lows, "parent", "left")
             .withColumn("leaves", F.col("leaves") + F.col("leaf") + F.coalesce("up_leaves", F.lit(0)))
             .withColumn("saved", F.col("saved") + F.col("own") + F.coalesce("up_saved", F.lit(0)))
             .withColumnRenamed("edge_low", "parent_low").select(*columns))
    inside = trie.where("NOT edge")
    hanging = inside.where("parent IS NOT NULL").drop("parent_low").join(lows, "parent").withColumnRenamed("edge_low", "parent_low")
    nodes = (inside.where("parent IS NULL").select(*columns).unionByName(hanging.select(*columns)).unionByName(whole))
    below = nodes.where(F.col("top").isNotNull()).select(F.col("top").alias("key"), *[F.col(c).alias(f"below_{c}") for c in sums])
    return (nodes if not base else nodes.where("top IS NULL")), below


def prefix_trie(conversations: DataFrame, strip: int = STRIP, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    strips, strip = segments(turns_of(conversations), strip)
    sequences = materialize(strips.groupBy("k", "top", "key", "ids", "sizes").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.sum(F.col("last").cast("long")).alias("ends")), "sequences")
    volume = {r["k"]: r["turns"] for r in  # one row per strip
              sequences.groupBy("k").agg(F.sum(F.size("ids") + 1).alias("turns")).collect()}
    below, parts = None, []
    for k in sorted(volume, reverse=True):
        part = sequences.where(F.col("k") == k)
        if below is None:
            part = part.withColumns({f"below_{c}": F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
        else:
            part = part.join(materialize(below, "below"), "key", "left").fillna(0, [f"below_{c}" for c in ("kids", "leaves", "saved")])
        if k:  # members that end at a top are not in its strip
            lows = sequences.where(F.col("k") == k - 1).groupBy(F.col("key").alias("top")).agg(F.min("low").alias("top_low"))
            part = part.join(lows, "top")
        else:
            part = part.withColumn("top_low", F.col("low"))
        nodes, below = _strip_nodes(part.drop("k"), k * strip, max(partitions(spark), -(-volume[k] // shard_turns)))
        parts.append(nodes)
    if not parts:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    empty = nodes.where("sequence IS NULL").withColumn("ends_sha256", F.lit(NO_MEMBERS))
    ended = nodes.where("sequence IS NOT NULL").join(ends(strips), "sequence")
    return empty.unionByName(ended).select(
        F.col("low").alias("conv_id"), F.col("level").alias("depth"), F.col("parent_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256")


#: h is the CRC-32 of the decimal id, bit by bit.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
l AS (
  SELECT conv_id, count(*) OVER w AS depth, strlen(text) AS bytes,
         list({'role': role, 'text': text}) OVER w AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (
  SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, prefix) AS low FROM l
  UNION ALL
  SELECT conv_id, 0, 0, min(conv_id) OVER () FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (
  SELECT m.low, m.depth, max(bytes) AS bytes, count(*) AS n_convs,
         sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM m LEFT JOIN e ON e.conv_id = m.conv_id AND e.depth = m.depth GROUP BY m.low, m.depth),
p AS (
  SELECT n.*, u.low AS parent FROM n LEFT JOIN m u ON u.conv_id = n.low AND u.depth = n.depth - 1),
k AS (
  SELECT p.*, coalesce(x.kids, 0) AS kids
  FROM p LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS kids FROM p WHERE depth > 0 GROUP BY ALL) x
    ON x.parent = p.low AND x.depth = p.depth),
s AS (
  SELECT a.low, a.depth, CAST(sum(CASE WHEN k.kids = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves,
         CAST(sum((k.n_convs - 1) * k.bytes) AS BIGINT) AS saved
  FROM k JOIN m a ON a.conv_id = k.low AND a.depth <= k.depth GROUP BY a.low, a.depth)
SELECT k.low AS conv_id, CAST(k.depth AS BIGINT) AS depth, k.parent AS parent_conv_id, k.n_convs, k.kids AS n_children,
       s.leaves AS n_leaves, s.saved AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.low = k.low AND s.depth = k.depth
"""
