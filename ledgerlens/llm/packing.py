"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

1. Every document is encoded, ended with ``END``, and cut into pieces only if it is longer than a
   sequence. Pieces are written as rows of facts (length, checksum), without texts.
2. Packing depends on the lengths alone, so it is decided on their histogram, which has at most ``CAPACITY``
   entries whatever the corpus: first the reduction permanently fixes sets that dominate every other set
   with their largest piece (a piece that fits with no other; a pair that fills a sequence; the
   largest partner where no three pieces fit; a set of three that covers every other pair where no four fit), then best-fit decreasing places what remains. The
   result is a list of patterns with multiplicities.
3. Each piece gets its rank among the pieces of its length (two-level prefix sums, so a length that a third of all
   pieces have is many tasks), and the rank names the sequence and offset through the patterns.

The driver holds the histogram and the patterns (a few thousand entries); every piece stays on the executors.
All pieces are packed together, not per partition.

Defined cases: a null or empty text is one piece that holds the end id alone; rows that repeat an id are packed
each; null ids are passed on; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import materialize, running_sum, slices, small_batches
from ledgerlens.llm.tokens import Encoder

CAPACITY = 1024
END = 2
PATTERN = tuple[int, list[int]]  # number of sequences, lengths in them


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; all but the first are full."""
    head = n - (n - 1) // capacity * capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def reduce_histogram(counts: dict[int, int], capacity: int) -> tuple[list[PATTERN], dict[int, int]]:
    """Fix dominating sets; returns their patterns and what remains."""
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)
    fixed: list[PATTERN] = []

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.remove(length)

    def smallest(without: int, k: int) -> list[int]:
        """The k smallest pieces besides one of length ``without``."""
        out: list[int] = []
        for x in lengths:
            out += [x] * min(k - len(out), left[x] - (x == without))
            if len(out) == k:
                break
        return out

    def triple(big: int, partner: int, room: int) -> int | None:
        """The third piece of a dominating set of three: at most two pieces fit with ``big``, ``partner`` is the largest that fits alone,
        and every pair that fits has its smaller piece covered by the third (or all of it by the partner)."""
        three = smallest(big, 3)
        if len(three) == 3 and sum(three) <= room:
            return None  # sets of four
        free = {x: left[x] - (x == big) for x in lengths}
        free[partner] -= 1
        third = max((x for x in lengths if x <= room - partner and free[x] > 0), default=None)
        if third is None:
            return None
        free[partner] += 1
        for i, y in enumerate(lengths):  # y: the smaller piece of a pair, with the smallest partner at least as large
            if not free[y] or 2 * y > room:
                continue
            x = y if free[y] > 1 else next((z for z in lengths[i + 1:] if free[z] > 0), None)
            if x is not None and x + y <= room and y > third and largest_pair(free, i, y, room) > partner:
                return None
        return third

    def largest_pair(free: dict[int, int], i: int, y: int, room: int) -> int:
        """The largest total of a pair that fits and whose smaller piece is ``y``."""
        for x in reversed(lengths[i + 1:]):
            if free[x] and x + y <= room:
                return x + y
        return 2 * y

    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while left.get(big):
                room = capacity - big
                least = smallest(big, 2)
                if not least or least[0] > room:  # fits with nothing else
                    fixed.append((left[big], [big]))
                    take(big, left[big])
                    changed = True
                    break
                at = bisect_left(lengths, room + 1) - 1
                while at >= 0 and lengths[at] == big and left[big] < 2:
                    at -= 1
                partner = lengths[at]
                alone = len(least) < 2 or sum(least) > room  # no third piece fits with it
                if partner != room and not alone:
                    third = triple(big, partner, room)
                    if third is None:
                        break
                    members = Counter([big, partner, third])
                    # decisions hang on which lengths there are, and which of them twice: alike until one runs out
                    n = max(1, min((left[x] - 2) // m for x, m in members.items()))
                    fixed.append((n, [big, partner, third]))
                    for x, m in members.items():
                        take(x, n * m)
                    changed = True
                    continue
                n = left[big] // 2 if partner == big else min(left[big], left[partner])
                fixed.append((n, [big, partner]))
                take(big, n)
                take(partner, n)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[PATTERN]:
    """Best-fit decreasing on a histogram: sequences that are filled alike stay one group."""
    groups: dict[int, list[list]] = {}  # room -> [number of sequences, lengths]
    rooms: list[int] = []

    def put(room: int, n: int, lengths: list[int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([n, lengths])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            group = groups[room][-1] if at < len(rooms) else [n, []]
            each = min(room // length, n)  # a sequence stays the best fit until it is too full
            many = min(group[0], n // each)
            put(room - each * length, many, group[1] + [length] * each)
            n -= many * each
            if at < len(rooms) and group in groups.get(room, []):
                group[0] -= many
                if not group[0]:
                    groups[room].remove(group)
                    if not groups[room]:
                        del groups[room]
                        rooms.remove(room)
    return [(n, lengths) for g in groups.values() for n, lengths in g if n]


def places(patterns: list[PATTERN]) -> tuple[np.ndarray, ...]:
    """Per slot of a pattern: length, first rank, number of ranks, first sequence, offset; sorted by length and rank."""
    rank: dict[int, int] = {}
    base = 0
    rows = []
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, rank.get(length, 0), n, base, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of all pieces."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches, "text", 1 << 20):
            ids, bounds = encoder.rows(batch.column("text"))
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for r in range(batch.num_rows):
                whole = np.append(ids[bounds[r]:bounds[r + 1]], END).astype("<u4")
                for k, (s, n) in enumerate(cut(len(whole), capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(whole[s:s + n].tobytes()))
                    if with_ids:
                        own.append(whole[s:s + n].astype(np.int64))
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(own, pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    small_batches(docs.sparkSession)
    cut_up = materialize(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    fixed, rest = reduce_histogram(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(places(fixed + best_fit(rest, capacity)))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ranked = running_sum(cut_up.withColumn("_h", order).withColumn("_n", F.lit(1).cast("long")), ["length"], ["_h", "piece", "ids_crc32"], "_n", "_rank")
    ranked = ranked.drop("_h", "_n")
    fields = ranked.drop("_rank").schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, base, offset = shared.value
        key = (length << 44) + first
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            slot = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(base[slot] + rank - first[slot]), pa.array(offset[slot])],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
