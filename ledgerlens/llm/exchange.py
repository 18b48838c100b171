"""Questions of text chunks to a hash-partitioned index, and its answers.

Documents are packed into chunks of a few MB (one row each, compressed) and written once. A chunk
reduces its 64-bit keys to the sorted distinct ones, so a key that a third of all rows
hold is one entry per chunk, and sends them as one packed row per bucket of the key space. A
bucket sees every chunk's entries for its keys, so it can count or compare them exactly, and
answers each chunk in the order of its entries; answers need no keys. Buckets are even
because keys are hashes and distinct per chunk; their number grows with the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import materialize, partitions, slices

CHUNK_BYTES = 4 << 20
#: Entries of one bucket, so that sorting it stays near 100 MB.
BUCKET_ENTRIES = 1 << 20

ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("entries", pa.binary())])
ASKED_SQL = "bucket int, chunk long, entries binary"
ANSWER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("answer", pa.binary())])
ANSWER_SQL = "bucket int, chunk long, answer binary"


def seal(batch: pa.RecordBatch | pa.Table) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unseal(payload: bytes) -> pa.RecordBatch:
    import zstandard

    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)) as stream:
        table = stream.read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def chunks(docs: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES, sealed: Callable[[pa.RecordBatch], tuple[bytes, ...]] | None = None,
           parts: tuple[str, ...] = ("payload",)) -> DataFrame:
    """Write ``docs`` (with a column ``text``) as chunk rows: chunk, bytes (of text), and ``parts``, which ``sealed`` makes of the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, piece in enumerate(slices(batches, "text", chunk_bytes)):
            made = sealed(piece) if sealed else (seal(piece),)
            yield pa.RecordBatch.from_pydict(
                {"chunk": [(task << 32) + n], "bytes": [int(piece.column("text").nbytes)], **{p: [x] for p, x in zip(parts, made, strict=True)}},
                pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), *[(p, pa.binary()) for p in parts]]))

    return materialize(docs.mapInArrow(pack, "chunk long, bytes long, " + ", ".join(f"{p} binary" for p in parts)), name, "none")


def bucket_bits(df: DataFrame, entries: float) -> int:
    """Bits of the key that name the bucket: enough buckets for ``entries`` and to keep all tasks busy."""
    want = max(2.0 * partitions(df.sparkSession), entries / BUCKET_ENTRIES)
    return min(30, max(1, int(np.ceil(np.log2(want)))))


def by_bucket(chunk: int, keys: np.ndarray, bits: int, pack: Callable[[int, int], bytes], width: int = 64) -> pa.RecordBatch:
    """One row per bucket of sorted ``keys`` of ``width`` bits; ``pack(lo, hi)`` makes its entries."""
    bucket = (keys >> np.uint64(width - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(0, int)
    rows = {"bucket": [], "chunk": [], "entries": []}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows["bucket"].append(int(bucket[lo]))
        rows["chunk"].append(chunk)
        rows["entries"].append(pack(int(lo), int(hi)))
    return pa.RecordBatch.from_pydict(rows, ASKED)


def answers(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Answer every bucket; ``reply`` gets the entries of all chunks and returns one answer for each."""

    def group(table: pa.Table) -> pa.Table:
        return pa.table([table.column("bucket"), table.column("chunk"),
                         pa.array(reply(table.column("entries").to_pylist()), pa.binary())], schema=ANSWER)

    return asked.groupBy("bucket").applyInArrow(group, ANSWER_SQL)


def told(chunked: DataFrame, answered: DataFrame, use: Callable[[int, bytes, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Give each chunk its answers, sorted by bucket; ``use(chunk, payload, answers)`` returns rows."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left.column("chunk")[0].as_py(), left.column("payload")[0].as_py(),
                   right.sort_by("bucket"))

    return (chunked.select("chunk", "payload").groupBy("chunk")
            .cogroup(answered.groupBy("chunk")).applyInArrow(group, schema))


def bits_of(answer: list[bytes], counts: list[int]) -> np.ndarray:
    """Join answers of one bit per entry; ``counts``: entries of each."""
    if not answer:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in zip(answer, counts, strict=True)])


def total(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
