import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import pitman_yor as P
from quillon.llm.queries import op6_lm_scores

from tests.llm.conftest import DATA


def brute(rows):
    """(id, held out, tokens, known tokens, learned tokens, base score), counted one by one."""
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, ws in split if i is not None and not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((i, i is not None and held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in split), key=lambda r: (str(r[0]), r[2]))


def compare(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()), key=lambda r: (str(r[0]), r[2]))
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)


def test_query(spark, documents):
    out = op6_lm_scores(spark, DATA).cache()
    compare(out, [(r.doc_id, r.text) for r in documents.collect()])
    rows = out.where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)  # held-out text is likelier than under the base


def test_odd_rows(spark, odd):
    compare(P.score(odd), [(r.doc_id, r.text) for r in odd.collect()])


def test_empty(spark, odd):
    assert P.score(odd.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and the unknown one, in every context of two words."""
    draw, m = np.random.default_rng(0), P.Model()
    word, before, context = (x.ravel().astype(np.uint64) for x in np.mgrid[0:30, 0:3, 0:4])
    count = draw.poisson(2, len(word))
    count[word == 29] = 0  # the unknown
    own = P.Contexts(context, before, word, count)
    customers = np.where(own.words == 29, 0, 5 + own.words.astype(np.int64))
    tables = np.minimum(customers, 3)
    root = P.Root(m.root, float(customers.sum()), float(tables.sum()), 29)
    base = root.predictive(customers, tables)
    assert base.sum() == pytest.approx(1)
    for half in (None, 0, 1, None, 0):
        own.sweep(m.one, m.two, base, root.one_less(customers, tables), draw, half)
        assert (own.two.table >= 0).all() and (own.one.table >= 0).all()
        p = own.predictive(m.one, m.two, base)[own.entry]
        assert np.bincount((before * np.uint64(4) + context).astype(np.int64), weights=p) == pytest.approx(np.ones(12))
        assert (own.two.tables <= own.two.count).all() and (own.two.tables[own.two.count > 0] >= 1).all()
        assert (own.one.count == np.bincount(own.parent, weights=own.two.tables)).all()
        assert (np.bincount(own.two.owner[np.flatnonzero(own.two.n)], minlength=len(own.two.many)) == own.two.tables[own.two.many]).all()


@pytest.mark.parametrize("customers", [2, 3, 6])
def test_seating_of_one_dish(customers):
    """The share of samples with each number of tables against its probability, by enumeration of all seatings."""
    prior, p = P.Prior(0.4, 1.5), 0.3

    def partitions(sizes, left):
        if not left:
            yield tuple(sizes)
            return
        for k in range(len(sizes)):
            yield from partitions([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], left - 1)
        yield from partitions([*sizes, 1], left - 1)

    want = Counter()
    for sizes in partitions([], customers):
        weight = math.prod((prior.strength + prior.discount * k) * p for k in range(len(sizes))) * math.prod(math.prod(j - prior.discount for j in range(1, n)) for n in sizes)
        want[len(sizes)] += weight
    draw, got, n = np.random.default_rng(3), Counter(), 3000
    seats = P.Seats(np.full(n, customers), np.arange(n), n)
    for k in range(30):
        seats.sweep(prior, np.full(n, p), None, draw)
        if k >= 10:
            got.update(seats.tables.tolist())
    for t, weight in want.items():
        assert got[t] / got.total() == pytest.approx(weight / want.total(), abs=0.01)


class Restaurant:
    """A Pitman-Yor restaurant, customers one by one."""

    def __init__(self, prior, parent, draw):
        self.prior, self.parent, self.draw, self.tables = prior, parent, draw, {}

    def p(self, dish):
        own, t = self.tables.get(dish, []), sum(map(len, self.tables.values()))
        c = sum(sum(x) for x in self.tables.values())
        d, s = self.prior.discount, self.prior.strength
        return (max(0.0, sum(own) - d * len(own)) + (s + d * t) * self.parent.p(dish)) / (s + c)

    def sit(self, dish):
        own, t = self.tables.setdefault(dish, []), sum(map(len, self.tables.values()))
        d, s = self.prior.discount, self.prior.strength
        x = self.draw.random() * (sum(own) - d * len(own) + (s + d * t) * self.parent.p(dish))
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return
        own.append(1)
        self.parent.sit(dish)

    def leave(self, dish):
        own = self.tables[dish]
        k = self.draw.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            self.parent.leave(dish)


class Uniform:
    def __init__(self, n):
        self.n = n

    def p(self, _):
        return 1 / self.n

    def sit(self, _):
        pass

    leave = sit


def by_hand(rows, m, sweeps, burn):
    """Mean scores of all texts, by plain Gibbs sampling of all levels."""
    draw = random.Random(5)
    split = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    events = [(i, ("<", "<", *ws)[k : k + 2], w) for i, ws in split for k, w in enumerate(ws)]
    learned = [(c, w) for i, c, w in events if zlib.crc32(str(i).encode()) % 10]
    vocabulary = {w for _, w in learned}
    root = Restaurant(m.root, Uniform(len(vocabulary) + 1), draw)
    one, two = {}, {}
    for _, c, _ in events:
        one.setdefault(c[1], Restaurant(m.one, root, draw))
        two.setdefault(c, Restaurant(m.two, one[c[1]], draw))
    for c, w in learned:
        two[c].sit(w)
    mean = Counter()
    for k in range(sweeps):
        for c, w in learned:
            two[c].leave(w)
            two[c].sit(w)
        if k >= burn:
            for e in {(c, w) for _, c, w in events}:
                mean[e] += two[e[0]].p(e[1]) / (sweeps - burn)
    out = Counter()
    for i, c, w in events:
        out[i] += math.log10(mean[c, w])
    return out


def test_against_a_plain_sampler(spark):
    """Scores of a small corpus, by all levels at once and one customer at a time; ours approximates this."""
    draw = random.Random(9)
    words = [f"w{k}" for k in range(25)]
    chain = {w: draw.choices(words, k=3) for w in words}
    rows = []
    for i in range(60):
        text = [draw.choice(words)]
        while len(text) < 25:
            text.append(draw.choice(chain[text[-1]]) if draw.random() < 0.8 else draw.choice(words))
        rows.append((i, " ".join(text)))
    m = P.Model(sample_priors=False, samples=40, first=10, burn=10)
    got = {r.doc_id: r.score for r in P.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    want = by_hand(rows, m, 40, 10)
    assert all(got[i] == pytest.approx(want[i], rel=0.15) for i in want)
    assert np.corrcoef([got[i] for i in want], [want[i] for i in want])[0, 1] > 0.98
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)


def test_what_repeats_is_likelier(spark):
    """Contexts of words are learned: a text that was seen is likelier than its words in another order."""
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(60)) for _ in range(40)]
    held = [i for i in range(1000, 1200) if P.held_out(i, 10)][:2]
    mixed = texts[0].split()
    draw.shuffle(mixed)
    rows = [(i, t) for i, t in zip((i for i in range(1000) if not P.held_out(i, 10)), texts)] + [(held[0], texts[0]), (held[1], " ".join(mixed))]
    got = {r.doc_id: r for r in P.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].held_out and got[held[0]].score > got[held[1]].score + 20
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)


def test_a_frequent_word_has_several_restaurants(monkeypatch):
    """Classes of the word before deal a word's contexts over buckets, and change nothing else."""
    monkeypatch.setattr(P, "CONTEXT", 1)
    words = np.arange(1, 50, dtype=np.uint64)
    n = 4000
    draw = np.random.default_rng(0)
    tokens = np.where(np.arange(n) % 2, 0, draw.integers(1, 49, n))
    c = P.Coded("c", np.array([5, 6]), np.array([True, True]), np.array([n // 2, n // 2]), tokens, words, np.bincount(tokens, minlength=49))
    x = c.contexts(n, 2, 16)
    assert x["v"][1:5].tolist() == words[tokens[:4]].tolist() and x["u"][2:5].tolist() == words[tokens[:3]].tolist() and x["v"][0] == x["v"][n // 2] == x["u"][1] == 0
    assert len(set(x["kind"][x["v"] == 1].tolist())) > 16 and set(x["kind"][x["v"] != 1].tolist()) == {0}
    assert np.bincount(x["bucket"], minlength=16).max() < n / 4
