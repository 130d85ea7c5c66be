"""MinHash near-duplicates by an LSH forest.

A document's set holds its distinct shingles of `words` words. Equal sets are one node. Every node has a
signature of MinHash values. Each tree of the forest is a sorted order of the nodes: by the signature, read
from another value on. Neighbours in an order are those of the longest common prefix. Nodes whose order
begins with the same `least` values are a region. How deep candidates must agree adapts to it: a region of
up to `window` + 1 nodes is compared whole; in a larger one, a crowd, a node meets its neighbours only, the deepest
prefixes there are. Candidates whose sketches agree too little are let go, the others confirmed on their full
sets from the texts.

It runs in rounds. The first takes neighbours in a few orders, which joins most of a crowd of copies; then all nodes of a
component count as one, and candidates are pairs of different components. The next rounds take all orders, the
last ones only nodes of crowds, until a round adds no link. Components that still meet in a crowd are settled
exactly: the crowd's nodes outside its largest component are compared on full sets with all its nodes, in blocks, by
a prefix filter. So no crowd loses a link; with 32 trees of least depth 3, a pair of similarity 0.75 shares a
region but for 2 in 100 million, crowded or not. Equal 16-bit values stand for equal MinHash values, and
shingles are compared as 64-bit hashes.

Components are found in blocks of links, and these joined by alternating stars.

A document without words has an empty set and no link. Rows with null id take part in no link and are kept. Rows that
share an id and a text count once; an id with several texts has a node for each. An empty table gives an empty result. Only the
id and the text are read: extra columns, of any name, don't matter, and deduplicate() returns them as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_table, materialize, small

#: Links that a task joins in memory.
BLOCK_LINKS = 500_000
#: Of a crowd's comparisons: most nodes and shingles of a block that is held in memory, and nodes that a task streams past it.
BLOCK_NODES, BLOCK_SHINGLES, STREAMED = 2000, 2_000_000, 2000


@dataclass(frozen=True)
class Forest:
    words: int = 5
    percent: int = 75
    trees: int = 32
    #: Values that a region shares (at most 3), and values that an order reads.
    least: int = 3
    depth: int = 16
    window: int = 8
    #: Orders of the first round, and rounds at most; what they leave open is settled exactly.
    first: int = 4
    rounds: int = 4
    seed: int = 7

    @property
    def values(self) -> int:
        return self.trees * self.least

    @property
    def agree(self) -> int:
        """Sketches of a pair agree in so many values at least: six standard deviations below what a pair at the threshold has, as 2 bits agree by chance in a quarter of the rest."""
        share = self.percent / 100 + (1 - self.percent / 100) / 4
        return max(0, math.floor(self.values * share - 6 * math.sqrt(self.values * share * (1 - share))))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word, of its letters as a polynomial."""
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    start, stop = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * _powers(_BASE, len(raw)))))
    return _mix((total[stop] - total[start]) * _powers(_BACK, len(raw) + 1)[start] + (stop - start).astype(np.uint64))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = word_hashes(text or b"")
    k = min(words, len(h))
    if not k:
        return h[:0]
    factor = _powers(np.uint64(0xD6E8FEB86659FD93), words) if k == words else _powers(np.uint64(0xA0761D6478BD642F), k + 1)[1:]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * factor[i]
    return np.unique(_mix(out + np.uint64(k)))


def signature(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> tuple[bytes, bytes]:
    """16 bits of each MinHash value, big-endian; and the sketch, 2 other bits of each."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048] * factors[:, None] + shifts[:, None]).min(axis=1))
    low = _mix(low)
    two = np.stack((low & np.uint64(1), low >> np.uint64(1) & np.uint64(1)), axis=1).astype(np.uint8)
    return (low >> np.uint64(48)).astype(">u2").tobytes(), np.packbits(two).tobytes()


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def sign(docs: DataFrame, p: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha (of the text), n_shingles, node (a 128-bit digest of the set; null if empty), sig, sketch."""
    draw = np.random.default_rng(p.seed)
    factors, shifts = draw.integers(0, 1 << 63, p.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, p.values, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sig = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(t, p.words)
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, factors, shifts) if len(s) else (None, None))
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), *(pa.array([x[k] for x in sig], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "n_shingles", "node", "sig", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _sha(F.col(text)).alias("sha"))
    return own.mapInArrow(run, f"doc_id {kind}, sha binary, n_shingles bigint, node binary, sig binary, sketch binary")


# --- candidates

PAIR, MEETING, EDGE = 0, 1, 2
_SEEN = "kind int, a binary, b binary, region bigint, label binary, sketch binary, n bigint"
_SEEN_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("region", pa.int64()), ("label", pa.binary()), ("sketch", pa.binary()), ("n", pa.int64())])


class _Rows:
    """Rows of a sorted order: region, label, node, component, sketch."""

    def __init__(self, p: Forest, region: np.ndarray, label: np.ndarray, node: np.ndarray, component: np.ndarray, sketch: np.ndarray):
        self.p, self.columns = p, (region, label, node, component, sketch)
        self.region, self.label, self.node, self.component, self.sketch = self.columns

    @classmethod
    def read(cls, p: Forest, batch: pa.RecordBatch) -> _Rows:
        cells = lambda c, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width)
        label, node, component, sketch = cells("label", 2 * p.depth), cells("node", 16), cells("component", 16), cells("sketch", p.values // 4)
        region = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(p.least):
            region = region << 16 | label[:, 2 * k].astype(np.int64) << 8 | label[:, 2 * k + 1]
        return cls(p, region, label, *(np.ascontiguousarray(x).view("V16").ravel() for x in (node, component)), sketch)

    def __len__(self) -> int:
        return len(self.region)

    def take(self, at) -> _Rows:
        return _Rows(self.p, *(c[at] for c in self.columns))

    def then(self, other: _Rows) -> _Rows:
        return _Rows(self.p, *(np.concatenate(both) for both in zip(self.columns, other.columns, strict=True)))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Of the pairs of rows x, y those of different components whose sketches agree enough."""
        apart = self.component[x] != self.component[y]
        x, y = x[apart], y[apart]
        unlike = self.sketch[x] ^ self.sketch[y]
        agree = self.p.values - np.bitwise_count((unlike | unlike >> 1) & np.uint8(0x55)).sum(axis=1)
        near = agree >= self.p.agree
        return [(min(a, b), max(a, b)) for a, b in zip(*(self.node[i[near]].tolist() for i in (x, y)), strict=True)]

    def meetings(self, x: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Components of the rows x and those after them, where they differ."""
        apart = x[self.component[x] != self.component[x + 1]]
        return [(min(a, b), max(a, b)) for a, b in zip(self.component[apart].tolist(), self.component[apart + 1].tolist(), strict=True)]


def _whole(rows: _Rows, crowded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list, list]:
    """Pairs and meetings of whole regions, given by their starts and sizes."""
    pairs, meetings = [], []
    inside = np.repeat(np.arange(len(start)), size)
    for k in range(1, min(rows.p.window, len(rows) - 1) + 1):
        x = np.flatnonzero((inside[k:] == inside[:-k]) & ((k == 1) | ~crowded[inside[:-k]]))
        pairs += rows.pairs(x, x + k)
        if k == 1:
            meetings += rows.meetings(x[crowded[inside[x]]])
    return pairs, meetings


def _neighbours(rows: DataFrame, p: Forest, first: bool) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Candidates (a, b), meetings of components in crowds (a, b), and the tables to drop. rows: nodes with sig, sketch and component. first: neighbours alone, in few orders."""
    trees = rows.select("node", "component", "sketch", F.concat("sig", "sig").alias("s"), F.explode(F.sequence(F.lit(0), F.lit((p.first if first else p.trees) - 1))).alias("tree"))
    order = trees.select("tree", F.substring("s", F.col("tree") * (2 * p.least) + 1, F.lit(2 * p.depth)).alias("label"), "node", "component", "sketch")
    order = order.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def out(kinds: dict[int, list], edge: _Rows | None = None, n: list[int] = ()) -> pa.RecordBatch:
        both = [(k, *x) for k, found in kinds.items() for x in set(found)]
        rest = [] if edge is None else list(zip(edge.node.tolist(), edge.component.tolist(), edge.region.tolist(), edge.label, edge.sketch, n, strict=True))
        none = [None] * len(both)
        columns = [[x[0] for x in both] + [EDGE] * len(rest), [x[1] for x in both] + [r[0] for r in rest], [x[2] for x in both] + [r[1] for r in rest], none + [r[2] for r in rest], none + [r[3].tobytes() for r in rest], none + [r[4].tobytes() for r in rest], none + [r[5] for r in rest]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEEN_SCHEMA, strict=True)], schema=_SEEN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The region that the rows end with may go on in the next batch, or the next task: its last rows are kept, and it is known how many it had before them."""
        last, before, opening = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _Rows.read(p, batch)
            if last is not None:
                now = last.then(now)
            start = np.flatnonzero(np.diff(now.region, prepend=now.region[0] - 1))
            size = np.diff(start, append=len(now))
            total = size.copy()
            total[0] += before
            crowded = np.full(len(start), True) if first else total > p.window + 1
            pairs, meetings = [], []
            # The first and the last region of a task are judged with what other tasks have of them.
            if opening and not first and len(start) > 1:
                head = now.take(slice(0, min(size[0], p.window + 1)))
                yield out({}, head, [int(total[0])] + [0] * (len(head) - 1))
                opening = False
                if not crowded[0]:
                    now, start, size, crowded, total = now.take(slice(size[0], None)), start[1:] - size[0], size[1:], crowded[1:], total[1:]
            done = len(start) if crowded[-1] else len(start) - 1
            if done:
                end = len(now) if done == len(start) else start[-1]
                pairs, meetings = _whole(now.take(slice(0, end)), crowded[:done], start[:done], size[:done])
            keep = 1 if first else p.window + 1
            last, before = now.take(slice(max(start[-1], len(now) - keep), None)), max(0, int(total[-1]) - keep)
            yield out({PAIR: pairs, MEETING: [] if first else meetings})
        if last is not None and not first:
            yield out({}, last, [before + len(last)] + [0] * (len(last) - 1))

    seen = materialize(order.mapInArrow(run, _SEEN), "seen")
    of = lambda kind: seen.where(F.col("kind") == kind).select("a", "b")
    if first:
        return of(PAIR).distinct(), None, [seen]

    def join(group: pa.Table) -> pa.Table:
        """What tasks had at their ends of a region: a few rows of each."""
        group = group.sort_by([("label", "ascending"), ("a", "ascending")]).combine_chunks()
        cells = lambda c: np.frombuffer(b"".join(group[c].to_pylist()), np.uint8).reshape(len(group), -1)
        own = _Rows(p, group["region"].to_numpy(), cells("label"), *(np.ascontiguousarray(cells(c)).view("V16").ravel() for c in ("a", "b")), cells("sketch"))
        crowded = np.array([int(np.sum(group["n"].to_numpy())) > p.window + 1])
        pairs, meetings = _whole(own, crowded, np.array([0]), np.array([len(own)]))
        return pa.Table.from_batches([out({PAIR: pairs, MEETING: meetings}).select(["kind", "a", "b"])])

    ends = materialize(seen.where(F.col("kind") == EDGE).groupBy("region").applyInArrow(join, "kind int, a binary, b binary"), "ends")
    every = lambda kind: of(kind).union(ends.where(F.col("kind") == kind).select("a", "b")).distinct()
    return every(PAIR), every(MEETING), [seen, ends]


def _fetch(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, p: Forest, doc_id: str, text: str) -> DataFrame:
    """node, text of the wanted nodes, as a table."""
    wanted = materialize(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
    fetched = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(small(wanted), "doc_id").select("node", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that share an id may have other texts; only the node's own stays."""
        for batch in batches:
            node, t = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            same = [hashlib.blake2b(shingles(y, p.words).tobytes(), digest_size=16).digest() == x for x, y in zip(node, t, strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    texts = materialize(fetched.mapInArrow(own, fetched.schema).dropDuplicates(["node"]), "texts")
    drop_table(wanted)
    return texts


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: Forest, doc_id: str, text: str) -> DataFrame:
    """The pairs whose full sets are similar enough, from the texts."""
    texts = _fetch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, p, doc_id, text)
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if ta != last:
                    last, set_a = ta, shingles(ta, p.words)
                set_b = shingles(tb, p.words)
                lo, hi = sorted((len(set_a), len(set_b)))
                common = len(np.intersect1d(set_a, set_b, assume_unique=True)) if 100 * lo >= p.percent * hi else 0
                keep.append(100 * common >= p.percent * (lo + hi - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    links = materialize(both.select("ta", "tb", "a", "b").mapInArrow(run, "a binary, b binary").distinct(), "links")
    drop_table(texts)
    return links


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links a, b (arrays of V16) and the least node that each reaches."""
    names, which = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = which[: len(a)], which[len(a) :]
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if (new == least).all():
            return names, names[least]
        least = new


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches), of links (a, b): a table.

    Blocks of links are joined in memory; if there are several, alternating large and small stars join what they found.
    """
    edges = materialize(links.where("a != b").select("a", "b").distinct(), "edges")
    blocks = max(1, -(-edges.count() // BLOCK_LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for batch in batches if batch.num_rows]
        if found:
            a, b = (np.frombuffer(b"".join(x for part in found for x in part[k]), "V16") for k in (0, 1))
            node, least = _joined(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.binary()) for x in (node, least)], names=["node", "component"])

    stars = materialize(edges.repartition(blocks).mapInArrow(run, "node binary, component binary"), "stars")
    drop_table(edges)
    if blocks == 1:
        return stars
    edges, before = stars.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")), None
    while True:
        # What a node's neighbours are joined to is a table of its own, so that a hub's rows needn't meet in one task.
        both = edges.union(edges.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        both = large.join(small(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(both.where("u != v").distinct(), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_table(stars, least, large, low)
        edges = stars = new
        if state == before:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = materialize(ends.union(ends.select("component", "component")).distinct(), "components")
            drop_table(edges)
            return out
        before = state


class _Block:
    """Sets that others are compared with, by an inverted index of their shingles."""

    def __init__(self, percent: int):
        self.percent, self.components, self.sets, self.hashes = percent, [], [], None

    def close(self) -> None:
        self.codes = {c: k for k, c in enumerate(dict.fromkeys(self.components))}
        self.code = np.array([self.codes[c] for c in self.components], np.int64)
        self.names, self.done = list(self.codes), {}
        self.size = np.array([len(x) for x in self.sets], np.int64)
        every, own = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
        self.hashes, entry, self.count = np.unique(every, return_inverse=True, return_counts=True)
        self.own, self.first = own[np.argsort(entry, kind="stable")], np.cumsum(self.count) - self.count
        # A similar set has `percent` of these shingles at least, so one of any that are more than the rest; the rarest are taken.
        order = np.lexsort((entry, self.count[entry], own))
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        least = -(-self.percent * self.size // 100)
        self.prefix = np.zeros(len(self.hashes), bool)
        self.prefix[entry[order[place < np.repeat(self.size - least + 1, self.size)]]] = True
        self.sets = []

    def links(self, components: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        """Pairs of a component here and another of these sets that a similar pair joins; each once."""
        every, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(self.hashes, every), len(self.hashes) - 1)
        met = self.hashes[at] == every
        at, which = at[met], which[met]
        edge = np.searchsorted(which, np.arange(len(sets) + 1))
        for k in np.unique(which[self.prefix[at]]).tolist():
            near = at[edge[k] : edge[k + 1]]
            n = self.count[near]
            index = np.arange(n.sum()) + np.repeat(self.first[near] - np.cumsum(n) + n, n)
            common = np.bincount(self.own[index], minlength=len(self.size))
            similar = 100 * common >= self.percent * (self.size + len(sets[k]) - common)
            if components[k] not in self.done:
                self.done[components[k]] = np.zeros(len(self.names), bool)
                if components[k] in self.codes:
                    self.done[components[k]][self.codes[components[k]]] = True
            done = self.done[components[k]]
            for c in np.unique(self.code[similar & ~done[self.code]]).tolist():
                done[c] = True
                yield self.names[c], components[k]


def _crowds(meetings: DataFrame, joined: DataFrame) -> DataFrame | None:
    """component, crowd: components that still differ where they met, and the least component each crowd reaches; None if there are none."""
    now = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    edges = meetings.join(small(now("a")), "a", "left").join(small(now("b")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = materialize(edges.where("a != b").distinct(), "meetings")
    crowds = components(edges).select(F.col("node").alias("component"), F.col("component").alias("crowd")) if edges.take(1) else None
    drop_table(edges)
    return crowds


def _settle(meetings: DataFrame, joined: DataFrame, nodes: DataFrame, docs: DataFrame, p: Forest, doc_id: str, text: str) -> DataFrame | None:
    """Links (a, b) between components that meet in crowds; None if there can't be any. joined: node, component of all linked nodes."""
    crowds = _crowds(meetings, joined)
    if crowds is None:
        return None
    members = nodes.select("node", "n_shingles").join(joined, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    members = materialize(members.join(small(crowds), "component"), "crowd")
    per = members.groupBy("crowd", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = per.groupBy("crowd").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("s").alias("s"), F.max_by("s", F.struct("n", "component")).alias("main_s"))
    blocks = F.ceil(F.greatest((F.col("n") - F.col("most")) / BLOCK_NODES, (F.col("s") - F.col("main_s")) / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("crowd", "main", F.greatest(blocks, F.lit(1)).alias("blocks"), F.ceil(F.col("n") / STREAMED).cast("int").alias("streams"))
    texts = _fetch(members.select("node"), nodes, docs, p, doc_id, text)
    placed = members.join(small(materialize(sizes, "crowd-sizes")), "crowd").join(texts, "node")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    held = placed.where("component != main").select("crowd", one("blocks").alias("i"), upto("streams").alias("j"), F.lit(0).alias("role"), "component", "text")
    streamed = placed.select("crowd", upto("blocks").alias("i"), one("streams").alias("j"), F.lit(1).alias("role"), "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task the held sets come first; those streamed past needn't fit memory."""
        task = block = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("crowd", "i", "j", "role")), strict=True))
            found, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end < at + 256:
                    end += 1
                if keys[at][:3] != task:
                    task, block = keys[at][:3], _Block(p.percent)
                own = batch.column("component")[at:end].to_pylist()
                sets = [shingles(t, p.words) for t in batch.column("text")[at:end].cast(pa.binary()).to_pylist()]
                if keys[at][3] == 0:
                    block.components += own
                    block.sets += sets
                elif block.components:
                    if block.hashes is None:
                        block.close()
                    found += block.links(own, sets)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    rows = held.union(streamed).repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j", "role")
    links = materialize(rows.mapInArrow(run, "a binary, b binary").distinct(), "links")
    drop_table(texts)
    return links


def _classes(docs: DataFrame, p: Forest, doc_id: str, text: str) -> DataFrame:
    """doc_id, sha, n_shingles, node, component_id: a row for each of docs; node is null without id or words."""
    signed = materialize(sign(docs, p, doc_id, text), "signed")
    nodes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n_shingles", "sig", "sketch")).alias("s"))
    nodes = materialize(nodes.select("node", "doc_id", "s.*"), "nodes")
    links = joined = meetings = None
    for k in range(1 + p.rounds):
        rows = nodes.withColumn("component", F.col("node"))
        if joined is not None:
            rows = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if k > 1:
            crowds = _crowds(meetings, joined)
            if crowds is None:
                break
            rows = rows.join(small(crowds.select("component")), "component", "left_semi")
        pairs, met, used = _neighbours(rows, p, not k)
        pairs = materialize(pairs, "pairs")
        meetings = materialize(met, "meetings") if k == 1 else meetings
        drop_table(*used)
        found = _confirm(pairs, nodes, docs, p, doc_id, text)
        drop_table(pairs)
        if k > 1 and not found.take(1):
            break
        links = found if links is None else links.union(found)
        if joined is not None:
            drop_table(joined)
        joined = components(links)
    third = _settle(meetings, joined, nodes, docs, p, doc_id, text) if meetings is not None else None
    if third is not None and third.take(1):
        # Links of settled crowds are between components; each stands for itself in them.
        joined = components(links.union(third))
    linked = joined.join(nodes.select("node", "doc_id"), "node")
    least = materialize(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "classes")
    classes = materialize(joined.join(small(least), "component").select("node", "component_id"), "classes")
    own = nodes.select("node", F.col("doc_id").alias("first")).join(classes, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    own = materialize(own, "classes")
    out = signed.select("doc_id", "sha", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(own, "node", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def classify(docs: DataFrame, p: Forest = Forest(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept: a row for each of docs."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _classes(docs, p, doc_id, text).select("doc_id", "n_shingles", "component_id", kept)


def deduplicate(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """One document of each component: that of the smallest id. Of repeated rows, one; rows that share an id but not the text are judged each."""
    classes = materialize(_classes(docs, p, "doc_id", "text"), "classes")
    linked = classes.where(F.col("node").isNotNull())
    # Texts of the smallest id that are near copies of each other: the least by hash stays.
    several = linked.where("doc_id = component_id").groupBy("component_id").agg(F.count_distinct("sha").alias("n")).where("n > 1").select("component_id")
    several = materialize(several, "several")
    own = linked.where("doc_id = component_id").join(small(several), "component_id").select("component_id", "node", "sha").distinct()
    groups = own.groupBy("component_id", "node").agg(F.min("sha").alias("least"))
    extra = own.join(groups, ["component_id", "node"]).where("sha != least").select(F.col("component_id").alias("doc_id"), "sha")
    gone = materialize(linked.where("doc_id != component_id").select("doc_id", "sha").union(extra).distinct(), "gone")
    key = (docs["doc_id"] == gone["doc_id"]) & (_sha(docs["text"]) == gone["sha"])
    left = docs.join(small(gone), key, "left_anti")
    often = materialize(classes.groupBy("doc_id", "sha").count().where("count > 1 and doc_id is not null").select("doc_id").distinct(), "often")
    if not often.take(1):
        return left
    often = small(often)
    return left.join(often, "doc_id", "left_anti").unionByName(left.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
