"""Embedding near-dedup as an exact metric range join.

Vectors are compared by cosine in double precision. On the unit sphere the angle is a metric, and so is the
chord ``sqrt(2 - 2 cos)``, so a cosine threshold is a range ``theta`` (angle) or ``r`` (chord).

1. Equal vectors collapse to one representative with a weight.
2. Pivots come from a bounded sample. Where it is dense (near copies), a pivot owns the ball of the vectors within
   ``theta / 2``: by the triangle inequality all of them are linked with each other, so they
   are counted and tied to one member without a comparison, however many they are. All other
   vectors go to the nearest of the remaining pivots (a Voronoi cell).
3. Boundary replication: a vector can only reach a ball if its angle to the pivot is at most
   ``theta + theta / 2``, and only reach cell j from cell i if ``d_j - d_i <= 2 r`` and its distance from the
   plane between the pivots is at most ``r``. It is copied to those. Each pair of cells copies one way only.
4. Cells join independently, in tiles of at most ``TILE`` x ``TILE`` rows, as blocks of a matrix product. A
   tile returns link counts and a spanning forest of its links, never its pairs; components
   of the forests are those of all links.

Evenly spread vectors of many dimensions have nearly equal distances to all pivots, and are then copied to most
cells: the join is exact, but degrades towards comparing all blocks of ``CELL_ROWS`` vectors.

What is broadcast: at most ``MAX_PIVOTS`` pivots per dimension.

Defined cases: null, zero, empty vectors and vectors with null or non-finite elements link with nothing, as do rows with
a null id; vectors of different lengths are not compared; equal vectors and repeated rows are linked and
count each; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.components import components
from ledgerlens.llm.shared import materialize

THRESHOLD = 0.9
SAMPLE = 2048
MAX_PIVOTS = 1024
MAX_BALLS = 256
DENSE = 6          # neighbours in the sample that make a ball
CELL_ROWS = 16384
TILE = 8192
STRIP = 1024       # rows of a tile multiplied at once
SLACK = 1e-7


def _floats(element: str) -> type:
    return np.float64 if element == "double" else np.float32


def _prepare(vectors: DataFrame, element: str, id_type: str) -> DataFrame:
    """vec_id, raw (bytes of a vector that can link, else null)."""
    kind = _floats(element)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                x = v.as_py()
                if i.as_py() is None or not x or any(e is None for e in x):
                    out.append(None)
                    continue
                a = np.array(x, kind) + kind(0)  # minus zero becomes zero
                norm = math.sqrt(float((a.astype(np.float64) ** 2).sum())) if np.isfinite(a).all() else 0.0
                out.append(a.tobytes() if norm > 0 and math.isfinite(norm) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return materialize(vectors.select("vec_id", "embedding").mapInArrow(raw, f"vec_id {id_type}, raw binary"), "vectors")


def _units(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Pivots:
    """Balls and cells over unit vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        self.theta = math.acos(cosine)
        self.r = math.sqrt(2 - 2 * cosine)
        near = sample @ sample.T >= math.cos(self.theta / 2 - SLACK)
        crowd = near.sum(axis=1)
        balls: list[int] = []
        free = np.ones(len(sample), bool)
        for i in np.argsort(-crowd, kind="stable"):
            if crowd[i] < DENSE or len(balls) == MAX_BALLS:
                break
            if free[i]:
                balls.append(int(i))
                free &= ~near[i]
        wanted = min(MAX_PIVOTS - MAX_BALLS, max(1, math.ceil(n / CELL_ROWS)))
        rest = np.flatnonzero(free)[:wanted]
        self.balls = sample[balls]
        self.cells = sample[rest if len(rest) else [0]]
        between = self.cells @ self.cells.T
        self.apart = np.sqrt(np.maximum(1e-18, 2 - 2 * between))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home (ball number, or number of balls + cell), and the replicas as (row, cell) pairs."""
        k = len(self.balls)
        angle = np.arccos(np.clip(x @ self.balls.T, -1, 1)) if k else np.zeros((len(x), 0))
        d = np.sqrt(np.maximum(0, 2 - 2 * (x @ self.cells.T)))
        cell = d.argmin(axis=1)
        home = cell + k
        rows, to = [], []
        if k:
            ball = angle.argmin(axis=1)
            inside = angle[np.arange(len(x)), ball] <= self.theta / 2 - SLACK
            home = np.where(inside, ball, home)
            reach = angle <= 1.5 * self.theta + SLACK
            # a vector outside all balls is copied to a ball; between balls, the lower copies to the higher
            reach &= np.where(inside[:, None], np.arange(k)[None] > ball[:, None], True)
            a, b = np.nonzero(reach)
            rows.append(a)
            to.append(b)
            outside = ~inside
        else:
            outside = np.ones(len(x), bool)
        own = d[np.arange(len(x)), cell]
        plane = (d * d - (own * own)[:, None]) / (2 * self.apart[cell])
        reach = (d - own[:, None] <= 2 * self.r + SLACK) & (plane <= self.r + SLACK) & outside[:, None]
        other = np.arange(len(self.cells))[None]
        low, high = np.minimum(other, cell[:, None]), np.maximum(other, cell[:, None])
        sender = np.where((low + high) % 2 == 0, low, high)  # spreads the copies over all cells
        reach &= (other != cell[:, None]) & (sender == cell[:, None])
        a, b = np.nonzero(reach)
        rows.append(a)
        to.append(b + k)
        return home, np.concatenate(rows), np.concatenate(to)


def _join(left: np.ndarray, right: np.ndarray, weights: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray],
          same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, linked weight, smallest id of its part of the links) of the rows of a tile that link, strip by strip."""
    for lo in range(0, len(left), STRIP):
        first = lo if same else 0
        mask = left[lo:lo + STRIP] @ right[first:].T >= cosine
        if same:  # each pair once: columns after the row
            mask &= np.arange(mask.shape[1])[None] > np.arange(mask.shape[0])[:, None]
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if not len(rows):
            continue
        sub = mask[np.ix_(rows, columns)]
        id_rows, id_columns = ids[0][lo + rows], ids[1][first + columns]
        by_row, by_column = id_rows.copy(), id_columns.copy()
        while True:
            new_row = np.minimum(by_row, np.where(sub, by_column[None], np.iinfo(np.int64).max).min(axis=1))
            new_column = np.minimum(by_column, np.where(sub, new_row[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (new_row == by_row).all() and (new_column == by_column).all():
                break
            by_row, by_column = new_row, new_column
        yield id_rows, sub @ weights[1][first + columns], by_row
        yield id_columns, sub.T @ weights[0][lo + rows], by_column


def embedding_dedup(vectors: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType
    kind = _floats(element.elementType.simpleString() if isinstance(element, T.ArrayType) else "float")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    prepared = _prepare(vectors, element.elementType.simpleString(), id_type)
    equal = materialize(prepared.where("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
                        .withColumn("dim", F.length("raw")), "equal-vectors")

    pivots = {}
    for row in equal.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length of vectors
        chosen = equal.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").collect()
        pivots[row["dim"]] = Pivots(_units([r[0] for r in chosen], kind), row["n"], cosine)
    shared = spark.sparkContext.broadcast(pivots)
    schema = "dim int, cell int, replica boolean, rep long, weight long, raw binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for lo in range(0, part.num_rows, 2048):
                    piece = part.slice(lo, 2048)
                    home, row, to = shared.value[int(dim)].place(_units(piece.column("raw").to_pylist(), kind))
                    take = np.r_[np.arange(piece.num_rows), row]
                    out = piece.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("dim"), pa.array(np.r_[home, to].astype(np.int32)), pa.array(np.arange(len(take)) >= piece.num_rows),
                         out.column("rep").cast(pa.int64()), out.column("weight"), out.column("raw")],
                        names=["dim", "cell", "replica", "rep", "weight", "raw"])

    assigned = materialize(equal.select("dim", "rep", "weight", "raw").mapInArrow(assign, schema), "cells")
    sizes = {(r["dim"], r["cell"], r["replica"]): r["n"] for r in
             assigned.groupBy("dim", "cell", "replica").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
    blocks = {k: -(-n // TILE) for k, n in sizes.items()}
    balls = {dim: len(p.balls) for dim, p in pivots.items()}
    plan = spark.sparkContext.broadcast((blocks, balls))
    dealt_schema = "dim int, cell int, inner boolean, i int, j int, side int, rep long, weight long, raw binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_, balls_ = plan.value
        for batch in batches:
            take, inner, i, j, side = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("dim", "cell", "replica", "rep")]
            for n, (dim, cell, replica, rep) in enumerate(zip(*columns, strict=True)):
                base, guests = blocks_.get((dim, cell, False), 0), blocks_.get((dim, cell, True), 0)
                own = hash((rep, 11)) % max(1, guests if replica else base)
                tiles = []
                if replica:
                    tiles = [(False, o, own, 1) for o in range(base)]
                else:
                    tiles = [(False, own, o, 0) for o in range(guests)]
                    if cell >= balls_[dim]:  # the members of a ball are linked without a comparison
                        tiles += [(True, min(own, o), max(own, o), 0 if own <= o else 1) for o in range(base)]
                for a, b, c, d in tiles:
                    take.append(n)
                    inner.append(a)
                    i.append(b)
                    j.append(c)
                    side.append(d)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [out.column("dim"), out.column("cell"), pa.array(inner, pa.bool_()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(side, pa.int32()), out.column("rep"), out.column("weight"), out.column("raw")],
                names=["dim", "cell", "inner", "i", "j", "side", "rep", "weight", "raw"])

    def join(table: pa.Table) -> pa.Table:
        x = _units(table.column("raw").to_pylist(), kind)
        rep, weight, side = (table.column(c).to_numpy() for c in ("rep", "weight", "side"))
        same = bool(table.column("inner")[0].as_py()) and table.column("i")[0] == table.column("j")[0]
        a, b = (np.arange(len(x)), np.arange(len(x))) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out = list(_join(x[a], x[b], (weight[a], weight[b]), (rep[a], rep[b]), same, cosine)) if len(a) and len(b) else []
        ids, n, root = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"rep": ids, "n": n.astype(np.int64), "root": root})

    links = materialize(assigned.mapInArrow(deal, dealt_schema).groupBy("dim", "cell", "inner", "i", "j")
                        .applyInArrow(join, "rep long, n long, root long"), "cell-links")
    ball = F.col("cell") < F.element_at(F.create_map(*[F.lit(x) for kv in balls.items() for x in kv]), F.col("dim")) if balls else F.lit(False)
    core = assigned.where(~F.col("replica") & ball).select("dim", "cell", "rep", "weight")
    tie = materialize(core.groupBy("dim", "cell").agg(F.sum("weight").alias("all"), F.min("rep").alias("root")), "balls")
    tied = core.join(tie, ["dim", "cell"]).select("rep", (F.col("all") - F.col("weight")).alias("n"), "root")
    links = links.unionByName(tied)
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    facts = materialize(equal.select("rep", "raw", "weight").join(counts, "rep", "left")
                        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
                        .select(F.col("raw").alias("key"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                                F.coalesce("component", "rep").cast(id_type).alias("component_id")), "vector-facts")
    linked = prepared.where("raw IS NOT NULL").join(facts, F.col("raw") == F.col("key")).select("vec_id", "n_links", "component_id")
    alone = prepared.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
