"""Exact dedup with two-pass Bloom filtering.

Pass 1 hashes every normalised text and sets the hashes in a counting Bloom filter whose
cells saturate at two. Pass 2 probes it: a hash that occurs twice finds all its cells at two,
so a row with a smaller cell is certainly alone and passes straight through. Only the
other rows (true repeats and the filter's false positives) shuffle, as (digest, id) without their
texts, and are grouped exactly. A false positive costs a shuffled row, never a wrong result.

A filter is built per task as lists of cells, merged in Spark over two levels (cell blocks x shards of tasks, then
cell blocks), and the plane that tells repeats is broadcast. It has 16 cells per row and at most ``max_cells``
cells, so what the driver holds is at most ``max_cells / 4`` bytes (64 MB by default) and what is broadcast half of that. More rows than
that suits are dealt to ranges by another hash of the digest, and each range has a filter of its own, one after another:
rows that are alone pass straight through whatever the size of the corpus.

Defined cases: a null text counts as empty, so null and empty texts are equal. Rows that share both
``doc_id`` and text are one document: each gets ``kept`` = true if the document stays. A null
``doc_id`` is never the smallest; a group of null ids only has a null ``keep_id`` and stays.
An empty table gives no rows. Extra columns of the input are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import SPACE_CLASS, materialize, settled

PROBES = 4
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
BLOCK_CELLS = 1 << 16
MERGE_SHARDS = 32


def text_digest(text: str = "text") -> F.Column:
    """Hex SHA-256 of the text with every run of white space replaced by one space."""
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+", " ")
    return F.sha2(flat.cast("binary"), 256)


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cell numbers, one row per probe; double hashing on the two halves of the hash."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(cells - 1) for i in range(PROBES)])


def _gather(once: list[bytes], twice: list[bytes]) -> tuple[bytes, bytes]:
    """The two bit planes of a block, from lists of the cells that tasks saw, and saw more than once."""
    a, b = np.zeros(BLOCK_CELLS, bool), np.zeros(BLOCK_CELLS, bool)
    for x, y in zip(once, twice, strict=True):
        x = np.frombuffer(x, "<u2")
        b[x[a[x]]] = True
        b[np.frombuffer(y, "<u2")] = True
        a[x] = True
    return np.packbits(a).tobytes(), np.packbits(b).tobytes()


def _merge(once: list[bytes], twice: list[bytes]) -> tuple[bytes, bytes]:
    """Saturating sum of two-bit cells held as two bit planes."""
    a, b = np.zeros(BLOCK_CELLS // 8, np.uint8), np.zeros(BLOCK_CELLS // 8, np.uint8)
    for x, y in zip(once, twice, strict=True):
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        b |= y | (a & x)
        a |= x
    return a.tobytes(), b.tobytes()


def build_filter(hashes: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit planes of the filter over the long column ``h``."""
    schema = "block int, shard int, once binary, twice binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % MERGE_SHARDS
        for batch in batches:
            # a hash may meet itself in one cell; count each cell once per row
            at = np.sort(_cells(batch.column(0).to_numpy().view(np.uint64), cells), axis=0)
            fresh = np.ones(at.shape, bool)
            fresh[1:] = at[1:] != at[:-1]
            cell, n = np.unique(at[fresh], return_counts=True)
            rows: dict[str, list] = {"block": [], "shard": [], "once": [], "twice": []}
            block = (cell // np.uint64(BLOCK_CELLS)).astype(np.int64)
            bounds = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                inside = (cell[lo:hi] % np.uint64(BLOCK_CELLS)).astype("<u2")
                rows["block"].append(int(block[lo]))
                rows["shard"].append(shard)
                rows["once"].append(inside.tobytes())
                rows["twice"].append(inside[n[lo:hi] > 1].tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([
                ("block", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def joined(planes):
        def merge(pdf):
            import pandas as pd

            a, b = planes(list(pdf["once"]), list(pdf["twice"]))
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "shard": [pdf["shard"].iloc[0]],
                                 "once": [a], "twice": [b]})

        return merge

    merged = (hashes.select("h").mapInArrow(count, schema)
              .groupBy("block", "shard").applyInPandas(joined(_gather), schema)
              .withColumn("shard", F.lit(0)).groupBy("block").applyInPandas(joined(_merge), schema))
    once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
    width = BLOCK_CELLS // 8
    for row in merged.collect():  # cells / 4 bytes at most
        once[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["once"], np.uint8)
        twice[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["twice"], np.uint8)
    return once, twice


def filter_size(rows: int, max_cells: int) -> tuple[int, int]:
    """Cells of one filter (a power of two), and number of filters, for so many rows."""
    cells = BLOCK_CELLS
    while cells < rows * CELLS_PER_ROW and cells * 2 <= max_cells:
        cells *= 2
    return cells, max(1, -(-rows * CELLS_PER_ROW // (2 * cells)))


def _probed(hashed: DataFrame, cells: int) -> DataFrame:
    """The rows of ``hashed`` with ``maybe``: false if no other row of it has the same hash."""
    _, twice = build_filter(hashed, cells)
    shared = hashed.sparkSession.sparkContext.broadcast(twice.tobytes())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = _cells(batch.column("h").to_numpy().view(np.uint64), cells).astype(np.int64)
            hit = np.all((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1, axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_sha256"), pa.array(hit)],
                names=["doc_id", "text_sha256", "maybe"])

    id_type = hashed.schema["doc_id"].dataType.simpleString()
    out = hashed.select("doc_id", "text_sha256", "h").mapInArrow(probe, f"doc_id {id_type}, text_sha256 string, maybe boolean")
    out = materialize(out, "probed")
    shared.destroy()
    return out


def _in_ranges(docs: DataFrame, max_cells: int) -> DataFrame:
    """doc_id, text_sha256 and ``maybe`` of every row, one filter per range of digests."""
    digests = materialize(docs.select("doc_id", text_digest().alias("text_sha256"))
                          .withColumn("h", F.xxhash64("text_sha256")), "digests")
    cells, ranges = filter_size(digests.count(), max_cells)
    if ranges == 1:
        return _probed(digests, cells)
    # sorted inside each file, so that a range reads its own pages only; nothing shuffles
    part = F.pmod(F.crc32(F.col("text_sha256").cast("binary")), F.lit(ranges)).cast("int")
    dealt = materialize(digests.withColumn("part", part).sortWithinPartitions("part"), "digest-ranges")
    return functools.reduce(DataFrame.unionByName, [_probed(dealt.where(F.col("part") == r), cells) for r in range(ranges)])


def exact_dedup(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    probed = _in_ranges(docs, max_cells)
    maybe = probed.where("maybe").drop("maybe")
    # a table of its own, so that both sides of the join are plain exchanges and a hot key can be split
    groups = materialize(maybe.groupBy("text_sha256")
                         .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = maybe.join(groups, "text_sha256")
    alone = (probed.where("NOT maybe")
             .select("text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    return (repeated.select("text_sha256", "doc_id", "keep_id", "group_size").unionByName(alone)
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def unique(docs: DataFrame, **bounds) -> DataFrame:
    """One row of ``docs`` for each distinct text: the one with the smallest id, unchanged.

    Texts that a filter over the repeated ones rules out pass straight through; only the others move, for
    joins with the rows that go. Rows that repeat both id and text are reduced to one.
    """
    found = settled(lambda: exact_dedup(docs, **bounds).where("group_size > 1"), "equal-texts")
    pair = [F.col("doc_id").alias("__equal_id"), F.col("text_sha256").alias("__equal_sha")]
    gone = found.where("NOT kept").select(*pair).distinct()
    twice = materialize(found.where("kept").select(*pair).groupBy("__equal_id", "__equal_sha").count().where("count > 1").drop("count"), "repeated-rows")
    here = F.col("doc_id").eqNullSafe(F.col("__equal_id")) & (F.col("__equal_digest") == F.col("__equal_sha"))
    rest, near = _by_filter(docs, found.select("text_sha256").distinct())
    left = near.join(gone, here, "left_anti")
    if not twice.isEmpty():
        one = left.join(twice, here, "left_semi").dropDuplicates(["doc_id", "__equal_digest"])
        left = left.join(twice, here, "left_anti").unionByName(one)
    return rest.unionByName(left.drop("__equal_digest"))


def _by_filter(docs: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose text is certainly not among ``digests``, and the others, with their digest.

    The filter has one bit a cell in blocks of 4 KB, at most ``MAX_CELLS`` / 8 bytes in all, and is broadcast; texts stay in the scan.
    """
    digests = materialize(digests.withColumnRenamed("text_sha256", "__equal_digest"), "repeated-digests")
    cells, n = BLOCK_CELLS, digests.count()
    while cells < n * CELLS_PER_ROW and cells < MAX_CELLS:
        cells *= 2
    cell = F.pmod(F.xxhash64("__equal_digest"), F.lit(cells)) + 1
    blocks = (digests.select(cell.alias("__equal_cell")).groupBy(F.bitmap_bucket_number("__equal_cell").alias("__equal_block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__equal_cell")).alias("__equal_bits")))
    keyed = (docs.withColumn("__equal_digest", text_digest()).withColumn("__equal_cell", cell)
             .withColumn("__equal_at", F.bitmap_bit_position("__equal_cell"))
             .withColumn("__equal_block", F.bitmap_bucket_number("__equal_cell")))
    byte = "conv(hex(substring(__equal_bits, CAST(__equal_at div 8 AS INT) + 1, 1)), 16, 10)"
    marked = (keyed.join(F.broadcast(blocks), "__equal_block", "left")
              .withColumn("__equal_maybe", F.expr(f"coalesce(getbit(CAST({byte} AS INT), CAST(__equal_at % 8 AS INT)) = 1, false)")))
    return (marked.where("NOT __equal_maybe").select(*docs.columns),
            marked.where("__equal_maybe").select(*docs.columns, "__equal_digest"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
