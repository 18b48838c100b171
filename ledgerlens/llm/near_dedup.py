"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every document becomes its set of distinct word shingles (64-bit hashes), a digest of the set and a
   signature of ``COORDINATES`` minima. Documents with equal sets are linked by their digest; one of
   them represents them from here on.
2. A representative is posted under (coordinate, value) pairs. Two sets whose similarity reaches the
   threshold agree in at least ``matches(percent)`` coordinates but for a chance below ``MISSED``. Prefix: with the
   pairs in one global order, rarest first, such sets share one of their first ``COORDINATES - matches + 1``
   pairs, so only those are posted. Skip: pairs that no other signature has are left out,
   and the frequent lists at the end of the order are never merged but looked up in the signatures, which
   the postings carry (one byte a coordinate).
3. Each list first compares its members with its leader only, the member that agrees most with the commonest
   value of each coordinate, which is the text that copies stem from: collisions are counted over all
   coordinates, and document pairs that reach ``matches`` are confirmed on their full sets. Then lists whose
   members are still in several components compare all members of different ones, and return a forest of
   components that may be linked. In each such cluster, members outside the largest component are held
   against all its members by exact intersection counts. So no link between components is lost, a list of
   g copies costs about g comparisons, and pairs that turn out to be no links never leave their task.
4. Confirmed links and their components decide.

Skew: frequencies come from ``exchange`` (one entry per chunk and pair); a frequent list is a skewed join key in
the first comparison, and is dealt to tiles in the second one.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; one word is
one shingle; rows with a null id link with nothing and have a null component; rows that repeat an id
are one document whose links add up; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import exchange as X
from ledgerlens.llm.components import components
from ledgerlens.llm.shared import materialize, settled, slices, small_batches
from ledgerlens.llm.words import mix, windows, words

SHINGLE = 5
COORDINATES = 128
MISSED = 1e-6
TILE = 4096
BLOCK = 1024
SET_BYTES = 6
REMAINDER = 40
_SLOPES = np.random.default_rng(7).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """The most coordinates in which sets at the threshold agree but for a chance below ``MISSED`` (binomial tail)."""
    p = percent / 100
    least, below = 0, (1 - p) ** COORDINATES
    while below < MISSED and least < COORDINATES:
        least += 1
        below += math.comb(COORDINATES, least) * p ** least * (1 - p) ** (COORDINATES - least)
    if not least:
        raise ValueError(f"{COORDINATES} coordinates do not find sets that are {percent} % alike")
    return least


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and their bounds."""
    w = words(column, lower=True)
    hashes = w.hashes()
    n = np.diff(w.first)
    at, value = windows(hashes, w.first, width)
    row = w.row
    of = row[at]
    for short in range(1, width):  # the whole sequence of a short row is its shingle
        rows = np.flatnonzero(n == short)
        if len(rows):
            at, all_ = windows(hashes, w.first, short)
            whole = np.isin(row[at], rows)
            of, value = np.r_[of, row[at][whole]], np.r_[value, mix(all_[whole], 10 + short)]
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])] if len(of) else np.zeros(0, bool)
    return value[fresh], np.searchsorted(of[fresh], np.arange(len(n) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the smallest product per coordinate; rows without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        begins = bounds[:-1][filled]
        for j, slope in enumerate(_SLOPES):
            out[filled, j] = (np.minimum.reduceat(values * slope, begins) >> np.uint64(32)).astype(np.uint32)
    return out


def _set_table(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    schema = f"doc_id {id_type}, n_shingles long, digest binary, signature binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingle_sets(batch.column("text"), width)
            n = np.diff(bounds)
            sums = [np.diff(np.r_[np.uint64(0), np.cumsum(mix(values, 20 + i), dtype=np.uint64)][bounds]) for i in (0, 1)]
            digest = np.stack([*sums, n.astype(np.uint64)], axis=1)
            sig = signatures(values, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)),
                 pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"])

    return materialize(docs.select("doc_id", "text").mapInArrow(sets, schema), "sets")


def _tokens(sig: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the (coordinate, value) pairs of signatures."""
    x = (sig.astype(np.uint64) << np.uint64(8)) | np.arange(COORDINATES, dtype=np.uint64)
    return mix(x.ravel(), 3) >> np.uint64(64 - bits - REMAINDER)


def _frequencies(entries: list[bytes]) -> list[bytes]:
    """Entries: n, n keys of five bytes, n counts (a byte, saturated). Answers: bits of the total count, 1 for a single."""
    keys, counts, sizes = [], [], []
    for e in entries:
        n = int(np.frombuffer(e, np.uint32, 1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(e, np.uint8, 5 * n, 4).reshape(n, 5)
        keys.append(wide.view("<u8").ravel())
        counts.append(np.frombuffer(e, "<u4", n, 4 + 5 * n))
        sizes.append(n)
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(float))
    grade = (np.floor(np.log2(total)) + 1).astype(np.uint8)[place]
    return [g.tobytes() for g in np.split(grade, np.cumsum(sizes)[:-1])]


def postings(reps: DataFrame, id_type: str, least: int) -> DataFrame:
    """token, grade (bits of the pair's frequency), doc, n, coarse (a byte of each coordinate)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                piece = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_pydict({"chunk": [(task << 32) + made], "n": [piece.num_rows], "payload": [X.seal(piece)]},
                                                 pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]))
                made += 1

    chunked = materialize(reps.mapInArrow(pack, "chunk long, n long, payload binary"), "signature-chunks", "none")
    bits = X.bucket_bits(chunked, X.total(chunked, "n") * COORDINATES)

    def signature_rows(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = np.unique(_tokens(signature_rows(X.unseal(payload.as_py())), bits), return_counts=True)
                rest = keys & np.uint64((1 << REMAINDER) - 1)
                yield X.by_bucket(chunk.as_py(), keys, bits, lambda lo, hi, r=rest, c=counts: (
                    np.uint32(hi - lo).tobytes() + r[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    + c[lo:hi].astype("<u4").tobytes()), bits + REMAINDER)

    graded = materialize(X.answers(chunked.select("chunk", "payload").mapInArrow(ask, X.ASKED_SQL), _frequencies), "grades")

    def post(chunk: int, payload: bytes, answer: pa.Table) -> pa.Table:
        batch = X.unseal(payload)
        sig = signature_rows(batch)
        tokens = _tokens(sig, bits)
        _, place = np.unique(tokens, return_inverse=True)
        grade = np.frombuffer(b"".join(answer.column("answer").to_pylist()), np.uint8)[place].reshape(sig.shape)
        tokens = tokens.reshape(sig.shape)
        # rarest first, ties by key: the same order everywhere
        rank = (grade.astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(max(0, bits + REMAINDER - 58)))
        prefix = np.argpartition(rank, COORDINATES - least, axis=1)[:, :COORDINATES - least + 1]
        rows = np.repeat(np.arange(len(sig)), prefix.shape[1])
        columns = prefix.ravel()
        shared = grade[rows, columns] > 1
        rows, columns = rows[shared], columns[shared]
        coarse = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
        return pa.table({"token": tokens[rows, columns].astype(np.int64), "grade": grade[rows, columns].astype(np.int32),
                         "doc": batch.column("doc").take(pa.array(rows)), "coarse": coarse.take(pa.array(rows))})

    return materialize(X.told(chunked, graded, post, f"token long, grade int, doc {id_type}, coarse binary"), "postings")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDINATES)


def _leader(coarse: np.ndarray) -> int:
    """The member that agrees most with the commonest value of each coordinate: the text that copies stem from."""
    if len(coarse) <= 2:
        return 0
    if len(coarse) <= 16:
        return int((coarse[:, None] == coarse[None]).sum(axis=(1, 2)).argmax())
    cells = coarse.astype(np.int64) + np.arange(COORDINATES) * 256
    common = np.bincount(cells.ravel(), minlength=256 * COORDINATES).reshape(COORDINATES, 256).argmax(axis=1)
    return int((coarse == common).sum(axis=1).argmax())


def _with_leader(component: np.ndarray, coarse: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the leader of one list with the members of other components that agree in ``least`` coordinates.

    The leader is one of the members outside the largest component (all of them, at first)."""
    _, place, sizes = np.unique(component, return_inverse=True, return_counts=True)
    free = np.flatnonzero(place != sizes.argmax()) if sizes.max() > 1 else np.arange(len(doc))
    leader = free[_leader(coarse[free])]
    others = np.flatnonzero(place != place[leader])
    hit = others[(coarse[others] == coarse[leader]).sum(axis=1) >= least]
    return [(doc[hit], np.full(len(hit), doc[leader]))] if len(hit) else []


def _candidate_forest(component: np.ndarray, coarse: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which components of one list may be linked: a forest over those with members that agree in ``least`` coordinates."""
    names, place, sizes = np.unique(component, return_inverse=True, return_counts=True)
    root = np.arange(len(names))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    largest = sizes.argmax()
    # members outside the largest component against all members of other components
    for i in np.flatnonzero(place != largest):
        others = np.flatnonzero((place != place[i]) & ((place == largest) | (np.arange(len(place)) > i)))
        for other in np.unique(place[others[(coarse[others] == coarse[i]).sum(axis=1) >= least]]):
            x, y = top(place[i]), top(other)
            if x != y:
                root[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(names))])
    moved = tops != np.arange(len(names))
    return [(names[moved], names[tops[moved]])] if moved.any() else []


def compare_lists(named: DataFrame, id_type: str, every: bool, least: int) -> DataFrame:
    """Candidates from the lists that are not one component yet.

    Each list, or each block of a frequent one, compares its members with its leader: pairs of documents. With
    ``every`` it compares all members of different components, a frequent list in tiles of pairs of
    blocks: pairs of components that may be linked, at most one per component and list.
    """
    mixed = (named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
             .where("lo <> hi").select(F.col("token").alias("t"), "size"))
    mixed = materialize(mixed, "mixed-lists")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("doc"), tiles).cast("int")
    rows = named.join(mixed, F.col("token") == F.col("t")).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), tiles - 1)) if every else F.col("own")
    rows = (rows.withColumn("other", other)
            .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "component", "coarse"))
    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "component")
    pairs_of = _candidate_forest if every else _with_leader

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
            component, doc = table.column("component").to_numpy(), table.column("doc").to_numpy()
            coarse = _matrix(table.column("coarse").combine_chunks())
            # most lists have two members: all at once
            two = cuts[:-1][(np.diff(cuts) == 2)]
            near = two[(component[two] != component[two + 1]) & ((coarse[two] == coarse[two + 1]).sum(axis=1) >= least)]
            name = component if every else doc
            pairs = [(name[near], name[near + 1])]
            longer = np.flatnonzero(np.diff(cuts) > 2)
            for lo, hi in zip(cuts[longer].tolist(), cuts[longer + 1].tolist(), strict=True):
                if component[lo] != component[hi - 1]:
                    pairs += pairs_of(component[lo:hi], coarse[lo:hi], doc[lo:hi], least)
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            keep = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keep[0]), pa.array(keep[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = [batch.column(c).to_numpy() for c in ("token", "i", "j")]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            if len(last):  # all but the last tile are whole
                cut = int(last[-1]) + 1
                yield from run(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from run(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, f"a {id_type}, b {id_type}").distinct()


def set_members(docs: DataFrame, wanted: DataFrame, width: int, id_type: str) -> DataFrame:
    """id, members (sorted shingle hashes, SET_BYTES each) of the wanted documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingle_sets(batch.column("text"), width)
            # sorted by the bits that are kept, so that sets can be merged
            low = (values & np.uint64((1 << (8 * SET_BYTES)) - 1))
            order = np.lexsort((low, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
            raw = low[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([raw[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                names=["id", "members"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    return materialize(texts.mapInArrow(sets, f"id {id_type}, members binary"), "members", "none")


def _wide(data: bytes) -> np.ndarray:
    n = len(data) // SET_BYTES
    x = np.zeros((n, 8), np.uint8)
    x[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(n, SET_BYTES)
    return x.view("<u8").ravel()


def confirm(pairs: DataFrame, members: DataFrame, percent: int, id_type: str) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    both = (pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("left")), "a")
            .join(members.select(F.col("id").alias("b"), F.col("members").alias("right")), "b").select("a", "b", "left", "right"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            real = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = _wide(x.as_py()), _wide(y.as_py())
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                real.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(real, pa.bool_()))

    return materialize(both.mapInArrow(check, f"a {id_type}, b {id_type}").distinct(), "confirmed-links")


def links_within(named: DataFrame, clusters: DataFrame, members: DataFrame, percent: int, id_type: str) -> DataFrame:
    """All links between different components of a cluster of components, by exact intersection counts.

    Members outside a cluster's largest component are held against all its members, in tiles of
    ``BLOCK`` x ``BLOCK`` documents; a tile returns links, never its pairs.
    """
    inside = materialize(named.select("doc", "component").distinct()
                         .join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component"), "clustered")
    sizes = inside.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    facts = materialize(sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                                     (F.sum("n") - F.max("n")).alias("free"), F.sum("n").alias("all")), "clusters")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spread = lambda c: F.sequence(F.lit(0), F.greatest(blocks(c), F.lit(1)) - 1)
    own = lambda c: F.pmod(F.xxhash64("doc"), F.greatest(blocks(c), F.lit(1))).cast("int")
    rows = inside.join(facts, "cluster")
    right = rows.select("cluster", "doc", "component", own("all").alias("j"), F.explode(spread("free")).alias("i"), F.lit(1).alias("side"))
    left = (rows.where("component <> largest")
            .select("cluster", "doc", "component", own("free").alias("i"), F.explode(spread("all")).alias("j"), F.lit(0).alias("side")))
    dealt = (left.unionByName(right).join(members.select(F.col("id").alias("doc"), "members"), "doc"))

    def check(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        doc, component = table.column("doc").to_numpy(), table.column("component").to_numpy()
        raw = table.column("members").to_pylist()
        lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs: list[tuple] = []
        if len(lefts) and len(rights):
            sets = [_wide(raw[k]) for k in rights]
            size = np.array([len(x) for x in sets])
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(rights)), size)[order]
            for k in lefts:
                mine = _wide(raw[k])
                lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
                n = hi - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
                same = np.bincount(owner[at], minlength=len(rights))
                hit = np.flatnonzero((100 * same >= percent * (len(mine) + size - same)) & (component[rights] != component[k]))
                pairs += [(max(doc[k], d), min(doc[k], d)) for d in doc[rights[hit]]]
        a, b = zip(*set(pairs), strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.from_numpy_dtype(doc.dtype)), "b": pa.array(b, pa.from_numpy_dtype(doc.dtype))})

    return materialize(dealt.groupBy("cluster", "i", "j").applyInArrow(check, f"a {id_type}, b {id_type}").distinct(), "cluster-links")


def near_links(docs: DataFrame, posted: DataFrame, width: int, percent: int, id_type: str) -> DataFrame:
    """node, component over all confirmed links: first links to leaders, then what they leave apart."""
    named = posted.withColumn("component", F.col("doc"))
    pairs = materialize(compare_lists(named, id_type, False, matches(percent)), "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    members = set_members(docs, wanted, width, id_type)
    links = confirm(pairs, members, percent, id_type)
    found = settled(lambda: components(links), "components")

    named = materialize(posted.join(found.withColumnRenamed("node", "doc"), "doc", "left")
                        .withColumn("component", F.coalesce("component", "doc")), "named-postings")
    clusters = settled(lambda: components(compare_lists(named, id_type, True, matches(percent))), "candidate-clusters")
    if clusters.isEmpty():
        return found
    inside = named.select("doc", "component").distinct().join(clusters.select(F.col("node").alias("component")), "component", "left_semi")
    more = materialize(inside.select(F.col("doc").alias("id")).join(members.select("id"), "id", "left_anti"), "wanted")
    members = members.unionByName(set_members(docs, more, width, id_type))
    late = links_within(named, clusters, members, percent, id_type)
    return found if late.isEmpty() else settled(lambda: components(links.unionByName(late)), "components")


def near_dedup(docs: DataFrame, width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sets = _set_table(docs, width, id_type)
    linked = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("rep")), "equal-sets")
    reps = (linked.join(equal, (F.col("doc_id") == F.col("rep")) & (linked["digest"] == equal["digest"]))
            .dropDuplicates(["rep", "signature"]).select(F.col("rep").alias("doc"), "signature"))
    posted = postings(reps, id_type, matches(percent))
    final = near_links(docs, posted, width, percent, id_type)
    members = (linked.join(equal, "digest").select("doc_id", "n_shingles", "rep")
               .join(final.withColumnRenamed("node", "rep"), "rep", "left")
               .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    rest = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near-duplicates, unchanged."""
    small_batches(docs.sparkSession)
    gone = settled(lambda: near_dedup(docs, width, percent).where("doc_id IS NOT NULL")
                   .groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("__gone")), "near-copies")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
