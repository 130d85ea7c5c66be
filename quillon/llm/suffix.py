"""Removal of repeated strings by suffix arrays of shards.

A byte goes if a string of `span` bytes over it also starts in a document with a smaller id. Every such string
holds an anchor: a gram that is the least by hash among the string's grams. Anchors that one document alone
has can't lie in a repeat; chunks learn by bucket which others there are. The contexts of those, all that
a string around the anchor can cover, form the shards' texts, each distinct context once. A shard's suffix
array is made by induced sorting: suffixes are classified, leftmost-smaller substrings sorted (recursively where
their names repeat), and the rest induced from them, in waves of what is already placed. Permuted common prefixes follow:
only where a suffix and its neighbour come after different bytes are they compared. Neighbours that agree for the whole span make a class; its least document id goes back
to every chunk that has the context. The strings around an anchor with more than `crowd` contexts are dealt by their own hashes
over the shards of all buckets, each distinct string of a chunk once, so that no anchor makes a shard large.

Null text counts as empty. Null ids count as larger than any: such rows lose what documents with ids hold, and
cost none a byte. Rows that share an id don't affect each other. Matches never cross documents. Ids must fit 64 bits. Only the
id and the text are read: extra columns of any name don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import chunks as C
from quillon.llm.common import materialize


@dataclass(frozen=True)
class Repeats:
    span: int = 50
    gram: int = 26
    #: Contexts of an anchor, of all chunks, over which its strings are dealt one by one.
    crowd: int = 1 << 16

    @property
    def window(self) -> int:
        """Grams of a span."""
        return self.span - self.gram + 1

    @property
    def context(self) -> int:
        return self.span + self.window - 1


# --- suffix arrays by induced sorting


def _waves(slots: np.ndarray, heads: np.ndarray, text: np.ndarray, takes: np.ndarray) -> None:
    """Scans slots in order; each entry puts the suffix before it, if of the type that takes says, at its bucket's head.

    All entries up to the first free slot are scanned at once: what they put lies behind them.
    """
    at, n, step = 0, len(slots), 1024
    while at < n:
        free = slots[at : at + step] < 0
        end = at + (int(free.argmax()) if (some := free.any()) else len(free))
        if not some:
            step = min(2 * step, 1 << 22)
        before = slots[at:end] - 1
        before = before[before >= 0]
        before = before[takes[before]]
        at = end
        if some:
            step = max(1024, step // 2)
        if len(before):
            key = text[before]
            order = key.argsort(kind="stable")
            key, before = key[order], before[order]
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = new.nonzero()[0]
            letter = key[first]
            place = heads[key]
            place += np.arange(len(key))
            place -= first[new.cumsum() - 1]
            slots[place] = before
            heads[letter] += np.append(first[1:], len(key)) - first


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Of text, int32 with values from 1 up to letters - 1 and one 0, at its end."""
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    less = np.empty(n, bool)  # the type: smaller than the next suffix
    differs = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    rises = np.append(text[:-1] < text[1:], True)
    less[:] = rises[following]
    left = np.flatnonzero(less[1:] & ~less[:-1]) + 1  # leftmost smaller
    small = text if letters > 1 << 15 else text.astype(np.int16)
    all_less, all_more = np.bincount(text[less], minlength=letters), np.bincount(text[~less], minlength=letters)
    of_left = np.bincount(text[left], minlength=letters)

    def induce(sorted_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all larger and all smaller suffixes, each in order."""
        sizes = all_more + of_left
        begin = np.cumsum(sizes) - sizes
        slots = np.full(sizes.sum(), -1, np.int32)
        letter = text[sorted_left]
        slots[begin[letter] + all_more[letter] + np.arange(len(letter)) - (np.cumsum(of_left) - of_left)[letter]] = sorted_left
        _waves(slots, begin.copy(), small, ~less)
        more = slots[_within(begin, all_more)]
        # The second scan runs from the end: the buckets backwards, in each the smaller suffixes first.
        sizes = (all_less + all_more)[::-1]
        begin = (np.cumsum(sizes) - sizes)[::-1]
        slots = np.full(n, -1, np.int32)
        letter = text[more]
        slots[begin[letter] + all_less[letter] + all_more[letter] - 1 - (np.arange(len(letter)) - (np.cumsum(all_more) - all_more)[letter])] = more
        if all_less[0]:
            slots[n - 1] = n - 1
        heads = begin.copy()
        heads[0] += 1
        _waves(slots, heads, small, less)
        return slots[::-1], slots

    def _within(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())

    by_letter = left[np.argsort(small[left], kind="stable")]
    whole, _ = induce(by_letter)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = whole[is_left[whole]]
    names, count = _names(text, left, order)
    if count < len(left):
        reduced = np.append(names[left] + 1, 0).astype(np.int32)
        order = left[suffix_array(reduced, count + 1)[1:]]
    return induce(order)[0]


def _names(text: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for the leftmost-smaller substring at each place, equal for equal ones, in their order; and how many there are."""
    n = len(text)
    size = np.zeros(n, np.int32)
    size[left] = np.diff(left, append=n - 1) + 1
    a, b = order[:-1], order[1:]
    new = size[a] != size[b]
    open_ = np.flatnonzero(~new)
    k = 0
    while len(open_):
        x, y = a[open_], b[open_]
        unlike = text[x + k] != text[y + k]
        new[open_[unlike]] = True
        k += 1
        open_ = open_[~unlike & (k < size[x])]
    rank = np.concatenate(([0], np.cumsum(new)))
    names = np.zeros(n, np.int32)
    names[order] = rank
    return names, int(rank[-1]) + 1


def common_prefixes(data: np.ndarray, array: np.ndarray) -> np.ndarray:
    """How many bytes each suffix of the array has in common with the one before it. data: bytes, whose suffixes, and the empty one, the array orders.

    They are found in the order of the text (permuted). Where a suffix and its neighbour follow the same byte, so do those that begin
    with this byte: they are neighbours with one byte more in common. So only the others, the irreducible ones, are compared.
    """
    n = len(array)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    both = np.flatnonzero((before > 0) & (place > 0))
    reducible = np.zeros(n, bool)
    reducible[both] = data[both - 1] == data[before[both] - 1]
    words = np.ndarray((n,), "<u8", np.append(data, np.zeros(9, np.uint8)).tobytes(), strides=(1,))
    common, open_, at = np.zeros(n, np.int64), np.flatnonzero(~reducible & (before >= 0)), 0
    most = n - 1 - np.maximum(place, before)  # up to the end of the text
    while len(open_):
        open_ = open_[most[open_] > at]
        unlike = words[place[open_] + at] ^ words[before[open_] + at]
        ends = unlike != 0
        own = unlike[ends]
        common[open_[ends]] = at + np.bitwise_count((own & (~own + np.uint64(1))) - np.uint64(1)) // 8
        open_ = open_[~ends]
        at += 8
        common[open_] = at
    np.minimum(common, most, out=common)
    last = np.maximum.accumulate(np.where(reducible, 0, place))
    return (common[last] - (place - last))[array]


def least_of_classes(contexts: np.ndarray, least: np.ndarray, p: Repeats) -> np.ndarray:
    """contexts: rows of p.context bytes, 255 beyond a document. For each and each start of a span in it, the least id of all contexts with that span; NO_ID where there is none."""
    out = np.full((len(contexts), p.window), C.NO_ID, np.int64)
    empty = contexts == 255
    whole = ~(empty[:, : p.window] | empty[:, p.span - 1 :])
    # All strings around an anchor whose only context this is are in its documents and in no others: there is nothing to sort.
    _, anchor = distinct_rows(np.ascontiguousarray(contexts[:, p.window - 1 : p.window - 1 + p.gram]))
    alone = np.bincount(anchor)[anchor] == 1
    out[alone] = np.where(whole[alone], least[alone, None], C.NO_ID)
    if not alone.all():
        out[~alone] = _sorted_classes(contexts[~alone], whole[~alone], least[~alone], p)
    return out


def _sorted_classes(contexts: np.ndarray, whole: np.ndarray, least: np.ndarray, p: Repeats) -> np.ndarray:
    rows, width = contexts.shape
    joined = np.full((rows, width + 1), 255, np.uint8)
    joined[:, :width] = contexts
    text = np.append(joined.ravel().astype(np.int32) + 1, 0).astype(np.int32)
    array = suffix_array(text, 257)
    out = np.full((rows, p.window), C.NO_ID, np.int64)
    row, at = np.divmod(array, width + 1)
    inside = (row < rows) & (at < p.window)
    inside[inside] = whole[row[inside], at[inside]]
    kept = np.flatnonzero(inside)
    if not len(kept):
        return out
    # Of two spans that aren't next to each other in the array, all between them have as much in common.
    common = np.minimum.reduceat(common_prefixes(joined.ravel(), array)[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
    row, at = row[kept], at[kept]
    first = np.flatnonzero(np.append(True, common[1:] < p.span))
    out[row, at] = np.repeat(np.minimum.reduceat(least[row], first), np.diff(first, append=len(row)))
    return out


# --- anchors

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_table: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_table[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            _table[i] = np.full(n, base)
            _table[i][0] = 1
            np.cumprod(_table[i], out=_table[i])
    return _table[0][:n], _table[1][:n]


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of each n neighbours."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * _powers(len(raw))[0])))


def anchors(raw: np.ndarray, sizes: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of documents that lie end to end."""
    if len(raw) < p.span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = _sums(raw)
    n = len(raw) - p.gram + 1
    h = (sums[p.gram :] - sums[:-p.gram]) * _powers(n)[1]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = ((h ^ (h >> np.uint64(27))) * _M2) | np.uint64(1)
    least = _sliding(h, p.window, np.minimum)
    stop = np.cumsum(sizes)
    last = np.repeat(stop - p.span, sizes)[: len(least)]  # the last start of a span in each place's document
    least[np.arange(len(least)) > last] = 0
    around = np.concatenate((np.zeros(p.window - 1, np.uint64), least, np.zeros(p.window - 1, np.uint64)))
    place = np.flatnonzero(_sliding(around, p.window, np.maximum)[:n] == h)
    # Anchors have small hashes; buckets are ranges of hashes, so they get new ones.
    chosen = h[place] * _M2
    return (chosen ^ (chosen >> np.uint64(32))) * _M1, place


def contexts_of(raw: np.ndarray, sizes: np.ndarray, place: np.ndarray, p: Repeats) -> np.ndarray:
    """Rows of what spans around each place can cover, 255 beyond its document."""
    stop = np.cumsum(sizes)
    doc = np.searchsorted(stop, place, "right")
    at = place.astype(np.int32)[:, None] + np.arange(1 - p.window, p.span, dtype=np.int32)
    inside = (at >= (stop - sizes).astype(np.int32)[doc][:, None]) & (at < stop.astype(np.int32)[doc][:, None])
    out = raw[np.clip(at, 0, len(raw) - 1, out=at)]
    out[~inside] = 255
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct row, and for each row which of these it is."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = np.random.default_rng(9).integers(1, 1 << 63, (rows.shape[1] + 7) // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.zeros((len(rows), 8 * len(factor)), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for k, f in enumerate(factor):
        h = (h ^ words[:, k]) * f
        h ^= h >> np.uint64(29)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not (rows[first][which] == rows).all():
        _, first, which = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, which


# --- the operator

_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("n", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary()), ("contexts", pa.binary())])
_FOUND = pa.schema([("chunk", pa.string()), ("bucket", pa.int64()), ("part", pa.int32()), ("contexts", pa.binary()), ("least", pa.binary()), ("places", pa.binary()), ("which", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())])
ALONE, SHARED, CROWD = 0, 1, 2


@dataclass
class Anchors:
    """A chunk's anchors: distinct hashes, sorted; each place with its hash's number and its document's id."""

    distinct: np.ndarray
    place: np.ndarray
    which: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, ids: np.ndarray, sizes: np.ndarray, p: Repeats) -> Anchors:
        h, place = anchors(raw, sizes, p)
        distinct, which = np.unique(h, return_inverse=True)
        return cls(distinct, place, which, ids[np.searchsorted(np.cumsum(sizes), place, "right")])

    def many(self) -> np.ndarray:
        """Whether several documents have each hash."""
        low, high = np.full(len(self.distinct), C.NO_ID), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.own)
        np.maximum.at(high, self.which, self.own)
        return low != high

    def contexts(self, raw: np.ndarray, sizes: np.ndarray, p: Repeats) -> np.ndarray:
        """How many different contexts each hash has, told apart by hash."""
        stop = np.cumsum(sizes)
        doc = np.searchsorted(stop, self.place, "right")
        low = np.maximum(self.place - (p.window - 1), (stop - sizes)[doc])
        high = np.minimum(self.place + p.span, stop[doc])
        h = (_hashes(raw, low, high) ^ (high - low).astype(np.uint64)) * _M1 + self.which.astype(np.uint64)
        _, first = np.unique(h, return_index=True)
        return np.bincount(self.which[first], minlength=len(self.distinct)).astype(np.uint32)


def _hashes(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the bytes from low to high."""
    sums = _sums(raw)
    h = (sums[high] - sums[low]) * _powers(len(raw) + 1)[1][low]
    return (h ^ (h >> np.uint64(29))) * _M2


def strings_of(raw: np.ndarray, sizes: np.ndarray, place: np.ndarray, p: Repeats) -> np.ndarray:
    """Starts of all spans that hold an anchor at one of the places, within its document."""
    stop = np.cumsum(sizes)
    doc = np.searchsorted(stop, place, "right")
    first, last = np.maximum(place - (p.window - 1), (stop - sizes)[doc]), np.minimum(place, stop[doc] - p.span)
    edge = np.zeros(len(raw) + 2, np.int32)
    ok = first <= last
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def _deal(out: dict[str, list], chunk: str, part: int, rows: np.ndarray, place: np.ndarray, own: np.ndarray, bucket: np.ndarray, n: int, which: np.ndarray | None = None) -> None:
    """Add, for each bucket, the distinct rows with the least id of each, and the places with the number of theirs. which: the row of each place, if rows are distinct already."""
    first, index = (np.arange(len(rows)), which) if which is not None else distinct_rows(rows)
    low, top = np.full(len(first), C.NO_ID), np.zeros(len(first), np.int64)
    np.minimum.at(low, index, own)
    top[index] = bucket
    by, sorted_ = np.argsort(top, kind="stable"), np.argsort(bucket, kind="stable")
    number = np.empty(len(first), np.int64)
    number[by] = np.arange(len(first))
    edge, edge_first = (np.searchsorted(t, np.arange(n + 1)) for t in (bucket[sorted_], top[by]))
    at, nth = place[sorted_].astype(np.int32), number[index][sorted_]
    for b in np.flatnonzero(np.diff(edge)).tolist():
        s, f = slice(edge[b], edge[b + 1]), by[edge_first[b] : edge_first[b + 1]]
        for name, x in (("chunk", chunk), ("bucket", b), ("part", part), ("contexts", C.packed(rows[first[f]])), ("least", C.packed(low[f])), ("distinct", len(f)), ("places", C.packed(at[s])), ("which", C.packed((nth[s] - edge_first[b]).astype(np.int32))), ("n", len(at[s]))):
            out[name].append(x)


def repeats(docs: DataFrame, p: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary)."""
    table = C.build(docs, doc_id, text)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    n = C.buckets(total, 6 << 20)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, ids, sizes = C.opened(batch, i)
                a = Anchors.of(raw, ids, sizes, p)
                many, contexts, chunk = a.many(), a.contexts(raw, sizes, p), batch.column("chunk")[i].as_py()
                # Half of a hash is enough within a bucket: what it mistakes for shared is only sorted in vain.
                rows = [(b, chunk, s.stop - s.start, a.distinct[s].astype(np.uint32).tobytes(), np.packbits(many[s]).tobytes(), C.planes(contexts[s])) for b, s in C.split(a.distinct, n)]
                yield C.record({f.name: [r[k] for r in rows] for k, f in enumerate(_ASK)}, _ASK)

    def meet(group: pa.Table) -> pa.Table:
        """For each chunk's hashes, whether another document may have them, and whether many contexts do."""
        size = group["n"].to_pylist()
        each = [np.frombuffer(x, np.uint32) for x in group["hashes"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(group["many"].to_pylist(), size, strict=True)]
        contexts = [C.unplanes(x, np.uint32, k) for x, k in zip(group["contexts"].to_pylist(), size, strict=True)]
        _, which, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        found = (count > 1).astype(np.uint8)
        found[which[np.concatenate(many) > 0]] = SHARED
        found[(np.bincount(which, weights=np.concatenate(contexts)) > p.crowd) & (found > 0)] = CROWD
        said = np.split(found[which], np.cumsum(size)[:-1])
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "n": group["n"], "found": pa.array([C.packed(x) for x in said], pa.binary())})

    asked = table.mapInArrow(ask, "bucket bigint, chunk string, n bigint, hashes binary, many binary, contexts binary")
    shared = materialize(asked.groupBy("bucket").applyInArrow(meet, "chunk string, bucket bigint, n bigint, found binary"), "shared")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct contexts of shared anchors by bucket, and which of them lies where; of crowds, the strings instead."""
        for batch in batches:
            for i in range(batch.num_rows):
                raw, ids, sizes = C.opened(batch, i)
                a = Anchors.of(raw, ids, sizes, p)
                said = {x["bucket"]: C.unpacked(x["found"], np.uint8, x["n"]) for x in batch.column("said")[i].as_py() or ()}
                found = np.concatenate([said[b] for b, _ in C.split(a.distinct, n)] or [np.zeros(0, np.uint8)])[a.which]
                shift = np.uint64(64 - n.bit_length() + 1)
                members = np.flatnonzero(found == SHARED)
                out = {f.name: [] for f in _FOUND}
                chunk = batch.column("chunk")[i].as_py()
                _deal(out, chunk, 0, contexts_of(raw, sizes, a.place[members], p), a.place[members], a.own[members], (a.distinct[a.which[members]] >> shift).astype(np.int64), n)
                if (found == CROWD).any():
                    start = strings_of(raw, sizes, a.place[found == CROWD], p)
                    # Only one of each string is looked at; it stands as a context of its own, with nothing behind it.
                    h = _hashes(raw, start, start + p.span)
                    _, first, which = np.unique(h, return_index=True, return_inverse=True)
                    if not all((raw[start + k] == raw[start[first] + k][which]).all() for k in range(p.span)):  # two strings of one hash
                        first, which = distinct_rows(raw[start[:, None] + np.arange(p.span)])
                    rows = np.full((len(first), p.context), 255, np.uint8)
                    rows[:, : p.span] = raw[start[first][:, None] + np.arange(p.span)]
                    own = ids[np.searchsorted(np.cumsum(sizes), start, "right")]
                    _deal(out, chunk, 1, rows, start + p.window - 1, own, (h >> shift).astype(np.int64), n, which)
                yield C.record(out, _FOUND)

    found = C.answered(table, shared, "found").mapInArrow(find, "chunk string, bucket bigint, part int, contexts binary, least binary, places binary, which binary, n bigint, distinct bigint")

    def sort(group: pa.Table) -> pa.Table:
        low_each = [C.unpacked(x, np.int64, k) for x, k in zip(group["least"].to_pylist(), group["distinct"].to_pylist(), strict=True)]
        each = [C.unpacked(x, np.uint8, len(k) * p.context).reshape(-1, p.context) for x, k in zip(group["contexts"].to_pylist(), low_each, strict=True)]
        rows, ids = np.concatenate(each), np.concatenate(low_each)
        first, which = distinct_rows(rows)
        low = np.full(len(first), C.NO_ID)
        np.minimum.at(low, which, ids)
        best = least_of_classes(rows[first], low, p)
        # A start says something only if its class has an id that is less than that of a document here.
        answer = np.split(best[which], np.cumsum([len(x) for x in each])[:-1])
        return group.select(["chunk", "bucket", "part", "places", "which", "n", "distinct"]).append_column("best", pa.array([C.packed(a) for a in answer], pa.binary()))

    # Contexts are shuffled straight to their shards; places ride along, and come back with the answers.
    answers = found.groupBy("bucket", "part").applyInArrow(sort, "chunk string, bucket bigint, part int, places binary, which binary, n bigint, distinct bigint, best binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, ids, sizes = C.opened(batch, i)
                stop = np.cumsum(sizes)
                edge = np.zeros(len(raw) + 1, np.int32)
                for x in batch.column("said")[i].as_py() or ():
                    place, which = C.unpacked(x["places"], np.int32, x["n"]).astype(np.int64), C.unpacked(x["which"], np.int32, x["n"])
                    low = C.unpacked(x["best"], np.int64, x["distinct"] * p.window).reshape(-1, p.window)
                    own = ids[np.searchsorted(stop, place, "right")]
                    k, at = np.nonzero(low[which] < own[:, None])
                    start = place[k] + at - (p.window - 1)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + p.span, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for d, a, b in zip(ids.tolist(), (stop - sizes).tolist(), stop.tolist(), strict=True):
                    g = gone[a:b]
                    kept = raw[a:b][~g].tobytes()
                    for name, x in (("doc_id", None if d == C.NO_ID else d), ("n_bytes", b - a), ("n_removed", int(g.sum())), ("n_spans", int(np.count_nonzero(g[1:] & ~g[:-1]) + g[:1].sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                        out[name].append(x)
                yield C.record(out, schema)

    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text
    schema = pa.schema(names)
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return C.answered(table, answers).mapInArrow(cut, ddl)
