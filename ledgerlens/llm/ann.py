"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

1. Unit vectors are rotated by a random orthogonal matrix (of a fixed seed) and coded by the signs of their components,
   one bit a dimension, packed into bytes. The correction scalar is the inner product of the rotated vector with its
   own code, the unit vector of those signs.
2. For a rotated query q, ``<q, code> / scalar`` is an unbiased estimate of the cosine; its error is below
   ``EPSILON * sqrt(1 - scalar^2) / scalar / sqrt(dimensions - 1)`` but for a chance that falls exponentially in
   ``EPSILON`` squared.
3. Queries (a stated set of rows) meet all rows in blocks: the codes of a block of rows and a group of queries give all
   estimates of the block as one matrix product over the unpacked bits. The best estimates of a query are computed
   exactly; the k-th best of them is its threshold, and every row whose upper bound reaches it is
   computed exactly as well. So the codes choose the rows, and scores are always those of the original vectors.
4. Each block returns k rows a query; the best k of all blocks are ranked.

Every row is coded; nothing is fitted, so there is no sample. Rows are dealt to blocks by the hash of their place, not their
id or content, so many equal vectors or ids are spread evenly. Of a query group, one packed row goes to each block; a
block of rows goes to each query group. Nothing is broadcast.

Defined cases: null, zero and empty vectors and vectors with null or non-finite elements take no part, nor do rows with a null id;
vectors of different lengths are not compared; a row is not its own neighbour, but other rows with its id or vector are, and
every query row of a repeated id gets its own ranks; ties go to the smaller vec_id; fewer than k candidates are all returned;
an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.shared import materialize

NEIGHBOURS = 5
EVERY = 50          # queries are the rows whose id it divides (fixed value of the contract)
EPSILON = 3.0
BLOCK_BYTES = 4 << 20   # vectors of a block, as doubles
GROUP_BYTES = 2 << 20   # vectors of a query group, as doubles
STRIP = 64          # queries estimated at once
SEED = 20240613


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def flat_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements as doubles (null is NaN), start and length of each vector of a list column (null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    elements = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    return elements, offsets[:-1], length


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that keeps their squares in range; rows that cannot take part become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        top = np.abs(x).max(axis=1, initial=0.0)
        usable = np.isfinite(top) & (top > 0)
        return np.ldexp(np.where(usable[:, None], x, np.nan), -np.frexp(np.where(usable, top, 1.0))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and their correction scalars."""
    rotated = (x / norms(x)[:, None]) @ rotation(x.shape[1])
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(x.shape[1])


def _index(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim, raw (scaled doubles), code, scalar of every vector that takes part."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, start, length = flat_vectors(batch.column("embedding"))
            for dim in np.unique(length[length > 0]):
                at = np.flatnonzero(length == dim)
                x = scaled(elements[start[at][:, None] + np.arange(dim)[None]])
                fine = np.isfinite(x).all(axis=1)
                at, x = at[fine], x[fine]
                if not len(at):
                    continue
                bits, scalar = codes(x)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("vec_id"), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([v.tobytes() for v in x], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(scalar)],
                    names=["row", "vec_id", "dim", "raw", "code", "scalar"])

    kind = T.ArrayType(T.DoubleType())
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return materialize(rows.mapInArrow(code, "row long, vec_id long, dim int, raw binary, code binary, scalar double"), "codes")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``x``: equal rows give equal scores wherever they stand."""
    return (q * x).sum(axis=1) / (norms(q) * norms(x))


def search(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, bits: np.ndarray, scalar: np.ndarray,
           k: int, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, vector number, cosine) of the k best rows of a block for each query, strip by strip of queries."""
    dim = q.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))
    error = (epsilon * np.sqrt(np.maximum(0, 1 - scalar * scalar)) / scalar / np.sqrt(max(1, dim - 1)) + 1e-5).astype(np.float32)
    rotated = ((q / norms(q)[:, None]) @ rotation(dim)).astype(np.float32)
    weight = (1 / scalar).astype(np.float32)
    for lo in range(0, len(q), STRIP):
        rows = np.arange(lo, min(lo + STRIP, len(q)))
        estimate = (rotated[rows] @ signs.T) * weight[None]
        estimate[q_row[rows][:, None] == x_row[None]] = -np.inf  # not its own neighbour
        n = min(k, len(x))
        best = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
        score = exact(np.repeat(q[rows], n, axis=0), x[best.ravel()]).reshape(-1, n)
        score[np.isneginf(np.take_along_axis(estimate, best, axis=1))] = -np.inf
        least = score.min(axis=1) if n == k else np.full(len(rows), -np.inf)
        a, b = np.nonzero((estimate + error[None] >= least[:, None].astype(np.float32) - np.float32(1e-6)) & np.isfinite(estimate))
        for first in range(0, len(a), 1 << 16):  # bounded memory however many are chosen
            part = slice(first, first + (1 << 16))
            found = exact(q[rows[a[part]]], x[b[part]])
            order = np.lexsort((x_id[b[part]], -found, a[part]))
            at = a[part][order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = order[place < k]
            yield rows[a[part][keep]], b[part][keep], found[keep]


def _pack(table: pa.Table) -> pa.Table:
    """One row of a query group."""
    columns = [table.column("grp")[:1].combine_chunks(), *[
        pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("row", "vec_id")],
        pa.array([b"".join(table.column("raw").to_pylist())], pa.binary())]
    return pa.table(columns, names=["grp", "rows", "ids", "raws"])


def _meeting(dim: int, k: int, epsilon: float):
    """The search of one query group in one block of rows, for vectors of one length."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = [(none, none, none, np.zeros(0))]
        if left.num_rows:
            x = np.frombuffer(b"".join(left.column("raw").to_pylist())).reshape(-1, dim)
            bits = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            x_row, x_id, scalar = (left.column(c).to_numpy() for c in ("row", "vec_id", "scalar"))
            for rows, ids, raws in zip(*(right.column(c).to_pylist() for c in ("rows", "ids", "raws")), strict=True):
                q_row, q_id = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
                queries = np.frombuffer(raws).reshape(-1, dim)
                out += [(q_row[a], q_id[a], x_id[b], s) for a, b, s in search(queries, q_row, x, x_row, x_id, bits, scalar, k, epsilon)]
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["row", "query_id", "vec_id", "score"])

    return meet


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, epsilon: float = EPSILON) -> DataFrame:
    """The ``k`` nearest rows found for each row whose vec_id ``every`` divides: query_id, rank, vec_id, score."""
    index = _index(vectors)
    sizes = {r["dim"]: (r["n"], r["q"]) for r in index.groupBy("dim").agg(  # one row per length of vectors
        F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()}
    parts = []
    for dim, (n, q) in sorted(sizes.items()):
        if not q:
            continue
        blocks, groups = -(-n * dim * 8 // BLOCK_BYTES), -(-q * dim * 8 // GROUP_BYTES)
        own = index.where(F.col("dim") == dim)

        dealt = (own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
                 .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
        packed = (own.where(F.col("vec_id") % every == 0).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
                  .select("grp", "row", "vec_id", "raw").groupBy("grp").applyInArrow(_pack, "grp int, rows binary, ids binary, raws binary"))
        asked = materialize(packed, "queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts.append(dealt.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp"))
                     .applyInArrow(_meeting(dim, k, epsilon), "row long, query_id long, vec_id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = materialize(functools.reduce(DataFrame.unionByName, parts), "found")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id")))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
