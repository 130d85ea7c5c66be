"""Best-two-fit packing of tokenized documents into sequences of bounded length.

How documents pack depends on their lengths alone, and of lengths there are at most `size`. So the
plan is made on the histogram of lengths: a bin is filled greedily with the longest that fit;
then its smallest document gives way to two unpacked ones that fill the expanded gap more
tightly; the bin is repeated for as long as there are documents of its lengths. Each document then finds
its place from its rank among those of its length, which needs no group in one task.

Null text counts as empty: a document of the end id alone. Repeated rows are packed each; null ids are kept.
Only the id and the text are read, so extra columns, of any name, don't matter; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, parts

#: Words whose ids a worker keeps, twice: the newer ones, and those before them.
CACHED_WORDS = 250_000

#: Words of these characters, whose lower case and normal form are plain, go to the model without the tokenizer's own passes.
_PLAIN = re.compile("[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u012F]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u012F]+")


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (256 + k for k in range(256))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


class _Words(dict):
    """Ids (little-endian, 32 bits) by word. A word is found out when asked for; the newest are kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.before = self.tokenizer.model, _byte_letters(), {}
        self.alike = self._alike()
        self.apart = self._apart()

    def _apart(self) -> bool:
        """Whether words can be encoded one by one: whether white space of any kind, anywhere, gives no id and joins nothing."""
        words = ["Don't", "it's", "\u00c9t\u00e9,", "a1b22", "W\u00f6rter-buch...", "x", "!!", "\u4e2d\u6587", "the", "\u00a0", "2048", "a<|endoftext|>"]
        encode = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        alone = sum(map(encode, words), [])
        texts = [f"{lead}{space.join(words)}{lead}" for space in (" ", "  ", "\n", "\t", "\r\n", " \n \n ", "\x0b", "\x0c") for lead in ("", space)]
        return all(encode(t) == alone for t in texts) and not any(encode(t) for t in ("", " ", "\n\n", "\t \r"))

    def _alike(self) -> bool:
        """Whether the short way gives the tokenizer's own ids; if this isn't so for its kind, it isn't taken."""
        words = ["Don't", "it's", "\u00c9t\u00e9,", "a1b22", "W\u00f6rter-buch...", "'re", "x", "!!", "\u0111\u012e_9"]
        return all(self._short(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in words)

    def _short(self, word: str) -> list[int]:
        out = []
        for part in _PART.findall(word.lower()):
            shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            out += [t.id for t in self.model.tokenize(shown)]
        return out

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            short = self.alike and "<|" not in text and _PLAIN.fullmatch(text)
            ids = array("I", self._short(text) if short else self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHED_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


_encoders: dict[str, _Words] = {}


def ids_of(path: str, texts: list[bytes | None], end: int) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, then the end id.

    If the tokenizer drops white space and joins nothing across it, words are encoded once and
    remembered; else texts are encoded whole.
    """
    if path not in _encoders:
        _encoders[path] = _Words(path)
    words, last = _encoders[path], array("I", [end]).tobytes()
    of = words.__getitem__
    for text in texts:
        if words.apart:
            yield b"".join(map(of, (text or b"").split())) + last
        else:
            ids = words.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
            yield array("I", ids).tobytes() + last


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if kept, ids (binary, little-endian 32 bits)."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(ids_of(tokenizer, batch.column(1).cast(pa.binary()).to_pylist(), end)):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *[pa.array(kept, pa.binary())] * keep_ids]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


@dataclass(frozen=True)
class Bin:
    """counts: how many of each length; times: how often the bin occurs."""

    counts: tuple[tuple[int, int], ...]
    times: int


def plan(lengths: dict[int, int], size: int) -> list[Bin]:
    """Bins that hold each length as often as it occurs."""
    left = Counter({n: c for n, c in lengths.items() if c})
    open_ = sorted(left)
    bins = []
    while open_:
        used, gap = Counter(), size
        i = len(open_)
        while gap and (i := bisect_right(open_, gap, 0, i)):
            n = open_[i - 1]
            if take := min(left[n] - used[n], gap // n):
                used[n] += take
                gap -= take * n
            i -= 1
        if gap:
            small = min(used)
            if two := _tightest_two(open_, left, used, gap + small, small):
                used[small] -= 1
                used.update(two)
        used = +used
        times = min(left[n] // k for n, k in used.items())
        bins.append(Bin(tuple(sorted(used.items(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del open_[bisect_right(open_, n) - 1]
    return bins


def _tightest_two(open_: list[int], left: Counter, used: Counter, room: int, small: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over small and within room."""
    free = [n for n in open_[: bisect_right(open_, room)] if left[n] > used[n]]
    best, found, i, j = small, None, 0, len(free) - 1
    while i <= j:
        a, b = free[i], free[j]
        if a + b > room or i == j and left[a] - used[a] < 2:
            j -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
        i += 1
    return found


def pack(frame: DataFrame, size: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """frame (a table, read twice) with sequence_id and offset of each row; lengths are from 1 to size."""
    histogram = {r[0]: r[1] for r in frame.groupBy(length).count().collect()}  # at most size rows
    begin, sequence = Counter(), 0
    ranges: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    for b in plan(histogram, size):
        at = 0
        for n, k in b.counts:
            ranges[n].append((begin[n], sequence, k, at))
            begin[n] += k * b.times
            at += n * k
        sequence += b.times
    places = {n: np.array(r, np.int64) for n, r in ranges.items()}

    key = F.pmod(F.xxhash64(*order), F.lit(4 * parts(frame.sparkSession))).alias("_bucket")
    keyed = frame.select("*", key)
    counts = keyed.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(length, "_bucket", (F.sum("_n").over(Window.partitionBy(length).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order))).join(before, [length, "_bucket"])
    ranked = ranked.select(*frame.columns, (F.col("_before") + F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    width, names = len(frame.columns), ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in (length, "sequence_id"))
            where, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for one in np.unique(n):
                own, table = n == one, places[int(one)]
                r = rank[own]
                first, base, k, at = table[np.searchsorted(table[:, 0], r, "right") - 1].T
                where[own], offset[own] = base + (r - first) // k, at + (r - first) % k * one
            columns = batch.columns[:width] + [pa.array(where), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(place, ranked.schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """All pieces of docs with their places."""
    return pack(materialize(pieces(docs, tokenizer, size, end, keep_ids=keep_ids), "pieces"), size)
