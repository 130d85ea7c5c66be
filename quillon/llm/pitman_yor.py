"""Language-model scoring by a hierarchical Pitman-Yor model.

Tokens are white-space words and an end. Every pair of words that comes before a token has a restaurant, whose customers are the
tokens after it. Its tables are customers of the restaurant of the one word before, whose tables are customers of the root, the
restaurant of no context, whose base is uniform over the vocabulary and one unknown word. So contexts share parents, and
what the model holds grows with the text: a restaurant for each pair and each word.

Seating is sampled by Gibbs: a customer leaves; a table left empty goes, and with it a customer of the parent; then it sits down
at a table of its dish, by those there less the discount, or at a new one, by the strength, the discount times the tables and
the parent's probability. Customers of different dishes move at once, and of a dish with over BLOCK customers a BLOCK-th of them at
once; those that move at once don't see each other. A level sits still while the other moves. Discounts and strengths
are sampled too, by the usual auxiliary variables: those of pairs of words for each bucket. A text's probabilities are averages over the samples.

Contexts are spread over buckets by the word before, so that all restaurants of a word, and what their customers eat, lie in
one bucket; a word that has more than a quarter of a bucket's tokens has a restaurant for each class of the word before it
instead (at the start of texts, of texts), so that no word makes a bucket large. Buckets share the root alone. It is seated once, from the
tables of a first run with single-word contexts; the second run has both levels, given the root.

Texts come as chunks. A chunk asks buckets of hash ranges for its words' numbers and counts, and later sends its tokens to their
contexts' buckets, which answer with sums by text.

Counts cover all documents that aren't held out. Null text counts as empty: the end alone. Null ids are neither held
out nor learned from. Words are told apart by 64-bit hashes. Ids must fit 64 bits. Repeated rows are learned from, and scored, each;
extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import chunks as C
from quillon.llm.common import drop_table, materialize
from quillon.llm.neardup import _BLANK, _LETTER, _mix
from quillon.llm.suffix import _powers

END, START = np.uint64(0x243F6A8885A308D3), 0
#: Of a dish with more customers, so many parts move one after the other.
BLOCK = 32
#: A word before so many tokens, and before a quarter of a bucket's, has several classes.
CONTEXT = 1 << 17
#: Buckets send sums of log probabilities in whole numbers of this share of 1.
UNIT = 1 << 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Prior:
    """Discount and strength of a level."""

    discount: float
    strength: float


@dataclass(frozen=True)
class Model:
    first: int = 2  # sweeps of the first run
    #: Of the second run; half of the customers move for each sample.
    burn: int = 2
    samples: int = 10
    root: Prior = Prior(0.7, 10.0)
    one: Prior = Prior(0.7, 5.0)
    two: Prior = Prior(0.8, 2.0)
    sample_priors: bool = True
    seed: int = 1
    folds: int = 10


def held_out(doc_id: int | None, folds: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: each token's hash, and where each text's tokens end."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw], [True]))))
    start, stop = edge[::2], edge[1::2]
    power, back = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[:-1])))
    h = _mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    last = np.cumsum(np.bincount(doc, minlength=len(texts)) + 1)
    out = np.full(len(start) + len(texts), END)
    out[np.arange(len(start)) + doc] = h
    return out, last


# --- seating


class Seats:
    """Customers at tables. count: customers of each dish of a restaurant (an entry); a dish with one has one table, the others' customers are kept one by one."""

    def __init__(self, count: np.ndarray, restaurant: np.ndarray, restaurants: int, outside: float = 0.0):
        """At first all customers of a dish share a table. outside: tables that are not here but in the same restaurant."""
        self.count, self.restaurant, self.outside = count, restaurant.astype(np.int32), outside
        self.tables = np.minimum(count, 1).astype(np.int32)
        self.all = np.bincount(restaurant, weights=self.tables, minlength=restaurants) + outside
        self.whole = np.bincount(restaurant, weights=count, minlength=restaurants)
        self._place()
        first = np.arange(len(self.many))
        self.table[:] = np.repeat(first, self.size)
        self.seated = self.size.astype(np.int64)
        self._tables(len(first))

    def _place(self) -> None:
        """Room for the customers of all dishes with several."""
        self.many = np.flatnonzero(self.count > 1)
        self.many = self.many[np.argsort(-self.count[self.many], kind="stable")]
        self.size = self.count[self.many]
        self.start = np.cumsum(self.size) - self.size
        self.table = np.full(int(self.size.sum()), -1, np.int32)
        self.place = np.full(len(self.count), -1, np.int32)
        self.place[self.many] = np.arange(len(self.many))

    def _tables(self, used: int) -> None:
        """Sizes and owners of tables, which are numbered below used; and the numbers that are free."""
        there = self.table >= 0
        self.n = np.bincount(self.table[there], minlength=len(self.table)).astype(np.int32)
        self.owner = np.zeros(len(self.table), np.int32)
        self.owner[self.table[there]] = np.repeat(np.arange(len(self.many)), self.size)[there]
        self.free, self.top = np.arange(len(self.table), dtype=np.int32)[::-1].copy(), len(self.table) - used

    def resized(self, count: np.ndarray) -> None:
        """Other counts of customers, all at least 1 where they were: the last ones of a dish leave, new ones wait to be seated."""
        old, index, old_start, old_size = self.table, self.place, self.start, self.size
        self.whole = np.bincount(self.restaurant, weights=count, minlength=len(self.whole))
        self.count = count
        self._place()
        was = index[self.many]
        kept = np.where(was >= 0, np.minimum(old_size[was] if len(old_size) else 0, self.size), 0)
        rank = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
        to, of = np.repeat(self.start, kept) + rank, np.repeat(old_start[was] if len(old_start) else kept, kept) + rank
        moved = old[of]
        names, moved[moved >= 0] = np.unique(moved[moved >= 0], return_inverse=True)
        self.table[to] = moved
        alone = np.flatnonzero(was < 0)  # had one customer, at a table of its own
        self.table[self.start[alone]] = len(names) + np.arange(len(alone))
        self._tables(len(names) + len(alone))
        self.seated = np.add.reduceat((self.table >= 0).astype(np.int64), self.start) if len(self.start) else np.zeros(0, np.int64)
        self.tables = np.minimum(count, 1).astype(np.int32)
        self.tables[self.many] = np.bincount(self.owner[: len(names) + len(alone)], minlength=len(self.many))
        self.all = np.bincount(self.restaurant, weights=self.tables, minlength=len(self.all)) + self.outside

    def sweep(self, prior: Prior, base: np.ndarray, without: Callable[[np.ndarray], np.ndarray] | None, draw: np.random.Generator, half: int | None = None) -> None:
        """Customers that wait are seated; then every one, or every other one, leaves and sits down again.

        base: the parent's probability of each entry; without(entries): that after a customer of the parent has left; half: 0 or 1.
        """
        waits = np.flatnonzero(self.table < 0)
        if len(waits):
            dish = np.searchsorted(self.start, waits, "right") - 1
            rank = np.arange(len(waits)) - np.searchsorted(dish, dish)
            turn = rank // np.maximum(1, self.size[dish] // BLOCK)
            for t in range(int(turn.max()) + 1):
                now = turn == t
                self._move(dish[now], waits[now], False, prior, base, without, draw)
        large = int(np.searchsorted(-self.size, -BLOCK, "left"))  # dishes are sorted by customers
        for j in range(half or 0, int(min(self.size[0], BLOCK)) if len(self.size) else 0, 1 if half is None else 2):
            if large:
                low = self.start[:large] + self.size[:large] * j // BLOCK
                n = self.start[:large] + self.size[:large] * (j + 1) // BLOCK - low
                dish = np.repeat(np.arange(large), n)
                self._move(dish, np.arange(len(dish)) - np.repeat(np.cumsum(n) - n, n) + low[dish], False, prior, base, without, draw)
            dish = np.arange(large, int(np.searchsorted(-self.size, -j, "left")))
            if len(dish):
                self._move(dish, self.start[dish] + j, True, prior, base, without, draw)

    def _move(self, dish: np.ndarray, who: np.ndarray, single: bool, prior: Prior, base: np.ndarray, without, draw: np.random.Generator) -> None:
        """The customers who, of the dishes dish, all at once; single: one of each dish."""
        def add(of: np.ndarray, at: np.ndarray, by: int) -> None:
            if single:
                of[at] += by
            else:
                np.add.at(of, at, of.dtype.type(by))

        entry = self.many[dish]
        restaurant = self.restaurant[entry]
        was = self.table[who]
        there = was >= 0
        if there.all():
            add(self.n, was, -1)
            add(self.seated, dish, -1)
        elif there.any():
            add(self.n, was[there], -1)
            add(self.seated, dish[there], -1)
        self.table[who] = -1
        left = np.flatnonzero(there & (self.n[was] == 0))
        if len(left):
            gone = was[left] if single else np.unique(was[left])
            self.free[self.top : self.top + len(gone)] = gone
            self.top += len(gone)
            own = self.many[self.owner[gone]]
            add(self.tables, own, -1)
            np.subtract.at(self.all, self.restaurant[own], 1.0)
        p = base[entry]
        if without is not None and len(left):
            p[left] = without(entry[left])
        new = (prior.strength + prior.discount * self.all[restaurant]) * p
        seated = self.seated[dish]
        old = np.where(seated > 0, seated - prior.discount * self.tables[entry], 0.0)
        opens = draw.random(len(who)) * (new + old) < new
        # Tables of the dish by size less the discount: that of one of its customers, kept by so much of its size.
        open_, sits = np.flatnonzero(~opens), np.full(len(who), -1, np.int32)
        while len(open_):
            d = dish[open_]
            k = self.table[self.start[d] + (draw.random(len(d)) * self.size[d]).astype(np.int64)]
            taken = (k >= 0) & (draw.random(len(d)) * self.n[k] >= prior.discount)
            sits[open_[taken]] = k[taken]
            open_ = open_[~taken]
        fresh = np.flatnonzero(opens)
        self.top -= len(fresh)
        sits[fresh] = self.free[self.top : self.top + len(fresh)]
        self.owner[sits[fresh]] = dish[fresh]
        add(self.n, sits, 1)
        self.table[who] = sits
        add(self.seated, dish, 1)
        add(self.tables, entry[fresh], 1)
        np.add.at(self.all, restaurant[fresh], 1.0)

    def predictive(self, prior: Prior, base: np.ndarray) -> np.ndarray:
        """The probability of each entry's dish in its restaurant."""
        mine = np.maximum(self.count - prior.discount * self.tables, 0)
        return (mine + (prior.strength + prior.discount * self.all[self.restaurant]) * base) / (prior.strength + self.whole[self.restaurant])

    def one_less(self, entry: np.ndarray, prior: Prior, base: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        """predictive() of entries after a random one of their customers has left."""
        r, count, tables = self.restaurant[entry], self.count[entry], self.tables[entry]
        at = self.place[entry]
        several = np.flatnonzero(at >= 0)
        closes = np.ones(len(entry), bool)  # a dish's only customer closes its table
        k = self.table[self.start[at[several]] + (draw.random(len(several)) * self.size[at[several]]).astype(np.int64)]
        closes[several] = (k >= 0) & (self.n[k] == 1)
        left = np.maximum(count - 1 - prior.discount * (tables - closes), 0)
        return (left + (prior.strength + prior.discount * (self.all[r] - closes)) * base[entry]) / (prior.strength + self.whole[r] - 1)

    def sums(self, prior: Prior, draw: np.random.Generator, restaurants: bool = True) -> np.ndarray:
        """Sums of the auxiliary variables that discount and strength are sampled by: of 1 - y, of y, of 1 - z, of -log x."""
        d, s = prior.discount, prior.strength
        y, more = 0.0, np.zeros(4)
        if restaurants:
            over = np.bincount(self.all.astype(np.int64))[::-1].cumsum()[::-1]  # restaurants with at least so many tables
            i = np.arange(1, max(1, len(over) - 1))
            y = draw.binomial(over[i + 1], s / (s + d * i)).sum() if len(i) else 0
            more[0] = (over[i + 1].sum() if len(i) else 0) - y
            large = self.whole[self.whole >= 2]
            more[3] = -np.log(np.maximum(draw.beta(s + 1, large - 1), 1e-300)).sum()
        sizes = np.bincount(self.n)[::-1].cumsum()[::-1]
        j = np.arange(1, max(1, len(sizes) - 1))
        more[1], more[2] = y, draw.binomial(sizes[j + 1], (1 - d) / (j - d)).sum() if len(j) else 0
        return more


def sampled(sums: np.ndarray, draw: np.random.Generator) -> Prior:
    """Discount and strength given sums of all restaurants; priors Beta(1, 1) and Gamma(1, 1)."""
    return Prior(float(np.clip(draw.beta(1 + sums[0], 1 + sums[2]), 0.01, 0.95)), float(np.clip(draw.gamma(1 + sums[1], 1 / (1 + sums[3])), 1e-3, 1e6)))


@dataclass(frozen=True)
class Root:
    """What all buckets know of the root."""

    prior: Prior
    customers: float
    tables: float
    vocabulary: int

    def predictive(self, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words with so many customers and tables; (0, 0) is the unknown word."""
        d, s = self.prior.discount, self.prior.strength
        return (np.maximum(count - d * tables, 0) + (s + d * self.tables) / (self.vocabulary + 1)) / (s + self.customers)

    def one_less(self, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
        closes = (tables >= count) & (count > 0)
        d, s = self.prior.discount, self.prior.strength
        return (np.maximum(count - 1 - d * (tables - closes), 0) + (s + d * (self.tables - closes)) / (self.vocabulary + 1)) / (s + self.customers - 1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the first of each distinct key, each key's number, how many there are; in the order of their first."""
    which, distinct = pd.factorize(keys)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)) if len(keys) else which
    return first, which, len(distinct)


class Contexts:
    """Restaurants of one word, and those of two above them, of a bucket's tokens."""

    def __init__(self, context: np.ndarray, before: np.ndarray | None, word: np.ndarray, learned: np.ndarray):
        """context: of one word (or a class of it); before: the word before that; None: no restaurants of two. learned: how often each token counts."""
        pair = _mix(context * _ODD ^ _mix(word + np.uint64(1)))
        if before is None:
            first, self.entry, n = _numbered(pair)
            self.two, self.parent, top = None, None, first
            count = np.bincount(self.entry, weights=learned, minlength=n).astype(np.int64)
        else:
            first, self.entry, n = _numbered(_mix(pair * _ODD ^ _mix(before + np.uint64(3))))
            above, self.parent, n_above = _numbered(pair[first])
            _, restaurant, of_two = _numbered(_mix(context[first] * _ODD ^ _mix(before[first] + np.uint64(5))))
            self.two = Seats(np.bincount(self.entry, weights=learned, minlength=n).astype(np.int64), restaurant, of_two)
            count, top = np.bincount(self.parent, weights=self.two.tables, minlength=n_above).astype(np.int64), first[above]
        _, restaurant, of_one = _numbered(context[top])
        at, self.word, _ = _numbered(word[top])
        self.words = word[top][at]
        self.one = Seats(count, restaurant, of_one)

    def sweep(self, one: Prior, two: Prior, base: np.ndarray, one_less: np.ndarray | None, draw: np.random.Generator, half: int | None = None) -> None:
        """base, one_less: the root's probability of each word, and that with a customer less; half: as for seats."""
        own = base[self.word]
        if self.two is not None:
            p = self.one.predictive(one, own)
            self.two.sweep(two, p[self.parent], lambda e: self.one.one_less(self.parent[e], one, own, draw), draw, half)
            count = np.bincount(self.parent, weights=self.two.tables, minlength=len(self.one.count)).astype(np.int64)
            self.one.resized(count)
        self.one.sweep(one, own, None if one_less is None else (lambda e: one_less[self.word[e]]), draw, half)

    def predictive(self, one: Prior, two: Prior, base: np.ndarray) -> np.ndarray:
        """Of each entry: a context with its word."""
        p = self.one.predictive(one, base[self.word])
        return p if self.two is None else self.two.predictive(two, p[self.parent])

    def customers_of_root(self) -> np.ndarray:
        """By word."""
        return np.bincount(self.word, weights=self.one.tables, minlength=len(self.words)).astype(np.int64)


# --- chunks


_CODED = pa.schema([
    ("chunk", pa.string()), ("docs", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("base", pa.binary()), ("known", pa.binary()),
    ("n", pa.int64()), ("tokens", pa.binary()), ("n_words", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()),
])
_CODED_DDL = "chunk string, docs binary, held binary, sizes binary, base binary, known binary, n bigint, tokens binary, n_words bigint, words binary, counts binary"


@dataclass
class Coded:
    """A chunk's tokens as numbers of words."""

    chunk: str
    docs: np.ndarray
    learned: np.ndarray  # by document
    sizes: np.ndarray
    tokens: np.ndarray  # number in words
    words: np.ndarray  # global number
    counts: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Coded:
        cell = lambda c: batch.column(c)[i].as_py()
        docs = np.frombuffer(cell("docs"), np.int64)
        held = np.unpackbits(np.frombuffer(cell("held"), np.uint8), count=len(docs)).astype(bool)
        return cls(
            cell("chunk"), docs, ~held & (docs != C.NO_ID), np.frombuffer(cell("sizes"), np.int64), C.unplanes(cell("tokens"), np.uint32, cell("n")).astype(np.int64),
            C.unplanes(cell("words"), np.uint64, cell("n_words")), C.unplanes(cell("counts"), np.int64, cell("n_words")),
        )

    def contexts(self, total: int, starts: int, buckets: int) -> dict[str, np.ndarray]:
        """Of each token: its document, the word two before, the context (the word before, its class), the word, the bucket."""
        w = self.words[self.tokens]
        first = np.cumsum(self.sizes) - self.sizes
        v, u = np.roll(w, 1), np.roll(w, 2)
        count = np.roll(self.counts[self.tokens], 1)
        v[first], u[first], count[first] = START, START, starts
        second = first[self.sizes > 1] + 1
        u[second] = START
        doc = np.repeat(np.arange(len(self.docs)), self.sizes)
        classes = -(-count // max(CONTEXT, total // (4 * buckets)))
        by = u.copy()
        by[first] = self.docs.astype(np.uint64)
        kind = np.zeros(len(w), np.uint64)
        heavy = classes > 1
        kind[heavy] = _mix(by[heavy] + np.uint64(7)) % classes[heavy].astype(np.uint64)
        context = _context(v, kind)
        return {"doc": doc, "u": u, "v": v, "kind": kind, "w": w, "context": context, "bucket": (context >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)}


def _context(v: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return _mix(v * _ODD + _mix(kind))


_HASHED_DDL = "chunk string, docs binary, held binary, sizes binary, n bigint, tokens binary, n_words bigint, hashes binary, counts binary"
_HASHED = pa.schema([("chunk", pa.string()), ("docs", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("n_words", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _hashed(docs: DataFrame, m: Model, total: int) -> DataFrame:
    """Chunks of documents: the hashes of their words, in order, how often each is learned from, and the tokens as places among them. A table. Texts are read once."""
    size = C.grown(total, C.CHUNK, C.CHUNKS)

    def row(texts: list[bytes], ids: list[int]) -> pa.RecordBatch:
        h, last = tokens(texts)
        which, distinct = pd.factorize(h)
        order = np.argsort(distinct)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        distinct, which = distinct[order], rank[which]
        sizes, held = np.diff(last, prepend=0), np.array([held_out(None if d == C.NO_ID else d, m.folds) for d in ids], bool)
        use = np.repeat(~held & (np.array(ids, np.int64) != C.NO_ID), sizes)
        count = np.bincount(which, weights=use, minlength=len(distinct)).astype(np.int64)
        return C.record({
            "chunk": [uuid.uuid4().hex], "docs": [np.array(ids, np.int64).tobytes()], "held": [np.packbits(held).tobytes()], "sizes": [sizes.tobytes()], "n": [len(which)], "tokens": [C.planes(which)],
            "n_words": [len(distinct)], "hashes": [distinct.tobytes()], "counts": [C.planes(count)],
        }, _HASHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, n = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.append(t or b"")
                ids.append(C.NO_ID if i is None else i)
                n += len(texts[-1])
                if n >= size or len(texts) >= 50_000:
                    yield row(texts, ids)
                    texts, ids, n = [], [], 0
        if texts:
            yield row(texts, ids)

    return materialize(docs.mapInArrow(run, _HASHED_DDL), "hashed")


def _coded(table: DataFrame, total: int) -> tuple[DataFrame, int, int]:
    """The chunks with numbered words and the documents' base scores, as a table; tokens learned from; vocabulary."""
    n = C.buckets(total, C.grown(total, 8 << 20, 16 << 20))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, size, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_words", "hashes", "counts")), strict=True):
                distinct, count = np.frombuffer(hashes, np.uint64), C.unplanes(counts, np.int64, size)
                rows = [(b, chunk, s.stop - s.start, distinct[s].tobytes(), C.planes(count[s])) for b, s in C.split(distinct, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "n", "hashes", "count"])

    def merge(group: pa.Table) -> pa.Table:
        """Numbers of the bucket's words, the commoner the less, and their counts, for each chunk; the first row has the bucket's sums."""
        rows = group.to_pylist()
        each = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        distinct, which = np.unique(np.concatenate(each), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([C.unplanes(r["count"], np.int64, r["n"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
        number = np.empty(len(distinct), np.uint64)
        number[np.argsort(-count, kind="stable")] = np.arange(len(distinct), dtype=np.uint64) * np.uint64(n) + np.uint64(rows[0]["bucket"] + 1)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        none = [0] * (len(rows) - 1)
        return pa.table({
            "chunk": group["chunk"], "bucket": group["bucket"], "n": group["n"], "words": pa.array([C.planes(x) for x in np.split(number[which], cuts)], pa.binary()), "counts": pa.array([C.planes(x) for x in np.split(count[which], cuts)], pa.binary()),
            "learned": [int(count.sum()), *none], "known": [int((count > 0).sum()), *none],
        })

    asked = table.select("chunk", "n_words", "hashes", "counts").mapInArrow(ask, "bucket bigint, chunk string, n bigint, hashes binary, count binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(merge, "chunk string, bucket bigint, n bigint, words binary, counts binary, learned bigint, known bigint"), "numbers")
    sums = answers.agg(F.sum("learned").alias("n"), F.sum("known").alias("v")).first()
    trained, vocabulary = sums["n"] or 0, sums["v"] or 0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                sizes, which = np.frombuffer(cell("sizes"), np.int64), C.unplanes(cell("tokens"), np.uint32, cell("n"))
                said = sorted(cell("said"), key=lambda x: x["bucket"])
                number = np.concatenate([C.unplanes(x["words"], np.uint64, x["n"]) for x in said])
                count = np.concatenate([C.unplanes(x["counts"], np.int64, x["n"]) for x in said])
                order = np.argsort(number, kind="stable")  # common words first
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                first, seen = np.cumsum(sizes) - sizes, count[which]
                base = np.add.reduceat(np.log10((seen + 0.1) / (trained + 0.1 * (vocabulary + 1))), first)
                yield C.record({
                    "chunk": [cell("chunk")], "docs": [cell("docs")], "held": [cell("held")], "sizes": [cell("sizes")], "base": [base.tobytes()],
                    "known": [np.add.reduceat((seen > 0).astype(np.int64), first).tobytes()], "n": [len(which)], "tokens": [C.planes(rank[which])], "n_words": [len(order)], "words": [C.planes(number[order])], "counts": [C.planes(count[order])],
                }, _CODED)

    coded = materialize(C.answered(table.select("chunk", "docs", "held", "sizes", "n", "tokens"), answers.select("chunk", "bucket", "n", "words", "counts"), "words").mapInArrow(code, _CODED_DDL), "coded")
    drop_table(answers)
    return coded, trained, vocabulary


_SENT = pa.schema([("bucket", pa.int64()), ("role", pa.int32()), ("chunk", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("doc", "u", "v", "kind", "w", "use"))])
_SENT_DDL = "bucket bigint, role int, chunk string, n bigint, doc binary, u binary, v binary, kind binary, w binary, use binary"


def _send(coded: DataFrame, trained: int, starts: int, n: int, pairs: bool) -> DataFrame:
    """Tokens by the bucket of their context. pairs: only what is learned from, without the word two before, each pair once with its count and its word's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Coded.read(batch, i)
                x = c.contexts(trained, starts, n)
                use = np.repeat(c.learned, c.sizes).astype(np.uint8)
                count = c.counts[c.tokens]
                if pairs:
                    x = {k: a[use > 0] for k, a in x.items()}
                    at, which, some = _numbered(_mix(_context(x["v"], x["kind"]) * _ODD ^ _mix(x["w"])))
                    use, count = np.bincount(which, minlength=some).astype(np.uint32), count[use > 0][at]
                    x = {k: a[at] for k, a in x.items()}
                # Pairs lie by context, tokens of a bucket in the text's order.
                order = np.argsort(x["context"]) if pairs else np.argsort(x["bucket"], kind="stable")
                x, use, count = {k: a[order] for k, a in x.items()}, use[order], count[order]
                edge = np.searchsorted(x["bucket"], np.arange(n + 1))
                out = {f.name: [] for f in _SENT}
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    s = slice(int(edge[b]), int(edge[b + 1]))
                    doc = count[s].astype(np.int64) if pairs else np.diff(x["doc"][s], prepend=0)
                    cells = {"bucket": b, "role": 0, "chunk": c.chunk, "n": s.stop - s.start, "doc": C.planes(doc), "u": b"" if pairs else C.planes(x["u"][s]), "v": C.planes(x["v"][s]), "kind": C.planes(x["kind"][s]), "w": C.planes(x["w"][s]), "use": C.planes(use[s])}
                    for k, value in cells.items():
                        out[k].append(value)
                yield C.record(out, _SENT)

    return coded.mapInArrow(run, _SENT_DDL)


def _opened(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.concatenate([C.unplanes(r[column], kind, r["n"]) for r in rows] or [np.zeros(0, kind)])


def score(docs: DataFrame, m: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = _hashed(own, m, total)
    coded, trained, vocabulary = _coded(table, total)
    drop_table(table)
    starts = own.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % m.folds != 0)).count()
    n = C.buckets(total, C.grown(total, 8 << 20, 16 << 20))

    def first(group: pa.Table) -> pa.Table:
        """Single-word contexts, seated over a root of plain counts: the root's customers by buckets of words."""
        rows = group.to_pylist()
        v, kind, w, use, count = (_opened(rows, c, t) for c, t in (("v", np.uint64), ("kind", np.uint64), ("w", np.uint64), ("use", np.uint32), ("doc", np.int64)))
        own = Contexts(_context(v, kind), None, w, use)
        draw = np.random.default_rng([m.seed, 0, rows[0]["bucket"]])
        at = np.empty(len(own.words), np.int64)
        at[own.word[own.entry]] = np.arange(len(w))
        base = Root(m.root, float(trained), float(vocabulary), vocabulary).predictive(count[at], np.ones(len(at)))
        for _ in range(m.first):
            own.sweep(m.one, m.two, base, None, draw)
        sums, customers = own.one.sums(m.one, draw), own.customers_of_root()
        to = ((own.words - np.uint64(1)) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((own.words, to))
        edge = np.searchsorted(to[order], np.arange(n + 1))
        out = {"to": [], "bucket": [], "n": [], "words": [], "customers": [], "sums": []}
        for b in np.flatnonzero(np.diff(edge)).tolist():
            s = order[edge[b] : edge[b + 1]]
            for k, x in (("to", b), ("bucket", rows[0]["bucket"]), ("n", len(s)), ("words", C.planes(own.words[s])), ("customers", C.planes(customers[s])), ("sums", sums.tolist() if not out["to"] else None)):
                out[k].append(x)
        return pa.table([pa.array(out[f], t) for f, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())), strict=True)], names=list(out))

    sent = _send(coded, trained, starts, n, True).groupBy("bucket").applyInArrow(first, "to bigint, bucket bigint, n bigint, words binary, customers binary, sums array<double>")
    customers = materialize(sent, "customers")

    def seat(group: pa.Table) -> pa.Table:
        """Customers and tables of the root's words, for each bucket that has them; the first row has the sums."""
        rows = group.to_pylist()
        each = [C.unplanes(r["words"], np.uint64, r["n"]) for r in rows]
        words, which = np.unique(np.concatenate(each), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([C.unplanes(r["customers"], np.int64, r["n"]) for r in rows]), minlength=len(words)).astype(np.int64)
        draw = np.random.default_rng([m.seed, 1, rows[0]["to"]])
        own = Seats(count, np.zeros(len(words), np.int64), 1, outside=float(vocabulary - len(words)))
        for _ in range(m.first):
            own.sweep(m.root, np.full(len(words), 1 / (vocabulary + 1)), None, draw)
        cuts, none = np.cumsum([len(x) for x in each])[:-1], [None] * (len(rows) - 1)
        return pa.table({
            "bucket": group["bucket"], "n": group["n"], "words": group["words"], "customers": pa.array([C.planes(x) for x in np.split(count[which], cuts)], pa.binary()), "tables": pa.array([C.planes(x) for x in np.split(own.tables.astype(np.int64)[which], cuts)], pa.binary()),
            "sums": pa.array([[float(count.sum()), float(own.tables.sum()), *own.sums(m.root, draw, False).tolist()], *none], pa.list_(pa.float64())),
        })

    root = materialize(customers.groupBy("to").applyInArrow(seat, "bucket bigint, n bigint, words binary, customers binary, tables binary, sums array<double>"), "root")
    added = lambda frame, k: np.array([x or 0.0 for x in frame.agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k))).first()])
    draw = np.random.default_rng([m.seed, 2])
    one = sampled(added(customers, 4), draw) if m.sample_priors else m.one
    whole = added(root, 6)
    # The root is one restaurant: its sums over tables and its draw are made here.
    d, s = m.root.discount, m.root.strength
    few = np.arange(1, max(1, min(int(whole[1]), 1_000_000)))
    y = int(draw.binomial(1, s / (s + d * few)).sum())
    if whole[1] > len(few) + 1:  # the rest are rare: their number is Poisson's, with the sum's integral for mean
        y += int(draw.poisson(s / d * np.log((whole[1] + s / d) / (len(few) + 1 + s / d))))
    of_root = np.array([max(0.0, whole[1] - 1 - y), y, whole[4], -np.log(max(1e-300, draw.beta(s + 1, whole[0] - 1))) if whole[0] > 1 else 0.0])
    top = Root(sampled(of_root, draw) if m.sample_priors else m.root, whole[0], whole[1], vocabulary)
    drop_table(customers)

    def second(group: pa.Table) -> pa.Table:
        """Both levels given the root: the sums of log probabilities, averaged over samples, by text."""
        every = group.to_pylist()
        rows, given = [r for r in every if r["role"] == 0], [r for r in every if r["role"] == 1]
        if not rows:
            return pa.table({"chunk": pa.array([], pa.string()), "bucket": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "docs": pa.array([], pa.binary()), "sums": pa.array([], pa.binary())})
        u, v, kind, w = (_opened(rows, c, np.uint64) for c in ("u", "v", "kind", "w"))
        own = Contexts(_context(v, kind), u, w, _opened(rows, "use", np.uint8))
        words, customers, tables = (_opened(given, c, t) for c, t in (("w", np.uint64), ("u", np.int64), ("v", np.int64)))
        order = np.argsort(words)
        at = np.minimum(np.searchsorted(words[order], own.words), max(0, len(words) - 1))
        met = words[order][at] == own.words if len(words) else np.zeros(len(own.words), bool)
        count, seats = (np.where(met, x[order][at], 0) if len(words) else np.zeros(len(own.words), np.int64) for x in (customers, tables))
        base, less = top.predictive(count, seats), top.one_less(count, seats)
        draw = np.random.default_rng([m.seed, 3, rows[0]["bucket"]])
        two, mean = m.two, 0.0
        for k in range(m.burn + m.samples):
            own.sweep(one, two, base, less, draw, k % 2)
            two = sampled(own.two.sums(two, draw), draw) if m.sample_priors else two
            if k >= m.burn:
                mean = mean + own.predictive(one, two, base) / m.samples
        logs = np.log10(mean)[own.entry]
        out = {"chunk": [], "bucket": [], "n": [], "docs": [], "sums": []}
        edge = np.cumsum([0, *(r["n"] for r in rows)])
        for r, a, z in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            doc = np.cumsum(C.unplanes(r["doc"], np.int64, r["n"]))
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for c, x in (("chunk", r["chunk"]), ("bucket", r["bucket"]), ("n", len(first)), ("docs", C.planes(doc[first].astype(np.uint32))), ("sums", C.planes(np.rint(np.add.reduceat(logs[a:z], first) * UNIT).astype(np.int64)))):
                out[c].append(x)
        return pa.table([pa.array(out[c], t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=list(out))

    none = F.lit(None).cast("binary")
    known = root.select("bucket", F.lit(1).alias("role"), F.lit(None).cast("string").alias("chunk"), "n", none.alias("doc"), F.col("customers").alias("u"), F.col("tables").alias("v"), none.alias("kind"), F.col("words").alias("w"), none.alias("use"))
    both = _send(coded, trained, starts, n, False).unionByName(known)
    answers = both.groupBy("bucket").applyInArrow(second, "chunk string, bucket bigint, n bigint, docs binary, sums binary")
    names = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                ids, sizes = np.frombuffer(cell("docs"), np.int64), np.frombuffer(cell("sizes"), np.int64)
                points = np.zeros(len(ids))
                for x in sorted(cell("said"), key=lambda x: x["bucket"]):
                    points[C.unplanes(x["docs"], np.uint32, x["n"])] += C.unplanes(x["sums"], np.int64, x["n"]) / UNIT
                yield C.record({
                    "doc_id": [None if d == C.NO_ID else d for d in ids.tolist()], "held_out": np.unpackbits(np.frombuffer(cell("held"), np.uint8), count=len(ids)).astype(bool).tolist(), "n_tokens": sizes.tolist(),
                    "n_known": np.frombuffer(cell("known"), np.int64).tolist(), "train_tokens": [trained] * len(ids), "base_score": np.frombuffer(cell("base"), np.float64).tolist(), "score": points.tolist(), "perplexity": (10 ** np.minimum(-points / sizes, 300)).tolist(),
                }, names)

    lean = coded.select("chunk", F.col("docs"), "held", "sizes", "base", "known")
    return C.answered(lean, answers).mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
