"""Documents as rows of some megabytes each, so that blocks of them can be asked and answered.

A chunk holds the texts of some documents end to end, with their ids and lengths. Chunks are written
once; a question goes from a chunk to buckets of a hash range, sorted and free of repeats, and
the answer comes back in the same order. So what many documents share is sent once a chunk, and no
task gets a key's occurrences one by one.

Every chunk may ask every bucket. Both grow with the root of the input, so that such rows grow with the input, not with its
square, up to CHUNKS bytes; a chunk takes some forty times its bytes of memory, so CHUNKS can grow with the executors'.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Bytes of text that end a chunk, at least and at most; a longer document is a chunk of its own.
CHUNK, CHUNKS = 3 << 20, 12 << 20
#: Stands for a null id: larger than all others.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "chunk string, n_bytes bigint, data binary, ids binary, sizes binary"


def grown(total: int, least: int, most: int) -> int:
    """Bytes of a chunk or a bucket of so many bytes in all: least up to a gigabyte, then with the root."""
    return int(min(most, max(least, least * (total / (1 << 30)) ** 0.5)))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of SCHEMA; ids and sizes are 64-bit, data is compressed, as it is shuffled more than once. Null text counts as empty."""
    size = grown(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0, CHUNK, CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, total = [], [], 0

        def row() -> pa.RecordBatch:
            values = [uuid.uuid4().hex], [total], [packed(b"".join(texts))], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "n_bytes", "data", "ids", "sizes"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.append(t or b"")
                ids.append(NO_ID if i is None else i)
                total += len(texts[-1])
                if total >= size or len(texts) >= 50_000:
                    yield row()
                    texts, ids, total = [], [], 0
        if texts:
            yield row()

    return materialize(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SCHEMA), "chunks")


def packed(data: bytes | np.ndarray) -> bytes:
    return pa.compress(data if isinstance(data, bytes) else data.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    """n numbers of a kind."""
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, packed byte by byte of their weight: small ones take little."""
    return packed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T))


def unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8, n * np.dtype(kind).itemsize).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, ids and sizes of a chunk."""
    cell = lambda c: batch.column(c)[i].as_py()
    return unpacked(cell("data"), np.uint8, cell("n_bytes")), np.frombuffer(cell("ids"), np.int64), np.frombuffer(cell("sizes"), np.int64)


def buckets(total: int, per: int) -> int:
    """A power of two: so many buckets that each gets `per` of total."""
    return 1 << max(4, int(np.ceil(np.log2(max(1, total / per)))))


def split(hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Bucket and range of sorted 64-bit hashes; a bucket is a range of hashes."""
    top = (hashes >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)
    edge = np.flatnonzero(np.diff(top, prepend=-1, append=n))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(top[a]), slice(int(a), int(b))


def record(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Most bytes of answers that are broadcast, so that the texts needn't be shuffled for them.
BROADCAST_BYTES = 32 << 20


def answered(chunks: DataFrame, answers: DataFrame, size: str | None = None) -> DataFrame:
    """chunks with `said`: an array of the answers' structs. size: the column of a table of answers whose bytes decide whether they are broadcast."""
    said = answers.groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "chunk"))).alias("said"))
    if size and (answers.agg(F.sum(F.octet_length(size) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        said = F.broadcast(said)
    return chunks.join(said, "chunk", "left")
