import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.queries import op9_near_duplicates

from tests.llm.conftest import DATA

P = neardup.Forest()


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(id, size of set, least id reachable) by comparing every pair."""
    own = [(i, sets(t)) for i, t in rows]
    least = {i: i for i, _ in own}
    def top(i):
        while least[i] != i:
            i = least[i]
        return i
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and i is not None and j is not None and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                least[y] = x
    return sorted(((i, len(s), top(i) if i is not None else None) for i, s in own), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query(spark, documents):
    out = op9_near_duplicates(spark, DATA)
    assert got(out) == brute([(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_large_region_and_chain(spark):
    """More near copies than a region holds, a chain of links, and pairs just on either side of the threshold."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        text[draw.randrange(120)] = word()
        rows.append((1000 - i, " ".join(text)))
    chain = [word() for _ in range(200)]
    for i in range(12):
        rows.append((2000 + i, " ".join(chain[8 * i : 8 * i + 60])))
    for k, extra in enumerate((32, 33, 34, 35, 36)):
        rows += [(3000 + 10 * k, " ".join(one := [word() for _ in range(104)])), (3001 + 10 * k, " ".join([*one, *(word() for _ in range(extra))]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.classify(frame)) == brute(rows)


@pytest.mark.parametrize("n,changed", [(300, 8), (1500, 8), (5000, 7)])
def test_crowd_of_mutated_copies(spark, n, changed):
    """So many copies, each changed in other places, that regions are crowded at all depths."""
    draw = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in draw.sample(range(200), draw.randint(1, changed)):
            text[k] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    own = [sets(t) for _, t in rows]
    shared = [x for x, n in Counter(x for s in own for x in s).items() if n > 1]
    common = (has := np.array([[x in s for x in shared] for s in own], np.float32)) @ has.T
    size = np.array([len(s) for s in own], np.float32)
    linked = (100 * common >= 75 * (size[:, None] + size - common)) | np.eye(len(rows), dtype=bool)
    least = np.arange(len(rows))
    while (new := np.array([least[x].min() for x in linked])).tolist() != least.tolist():
        least = new
    assert got(neardup.classify(frame)) == sorted(zip(range(len(rows)), size.astype(int).tolist(), least.tolist()), key=str)
    assert len(set(least.tolist())) > 1


def test_ids_with_several_texts(spark):
    """Each text is judged by itself: a linked one goes, an unlinked one stays; of equal sets of one id, one row."""
    text = lambda k, n=60: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (4, text("e")), (4, text("e").upper()), (5, text("b", 59)), (None, text("a"))]
    left = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.text.lower()) for r in left.collect()]
    assert sorted(got, key=str) == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (None, text("a"))], key=str)


def test_components_in_blocks(spark, monkeypatch):
    """Blocks that hold few links each, joined by stars, give what one block gives."""
    draw = random.Random(1)
    name = lambda k: k.to_bytes(16, "big")
    links = [(name(k), name(k + 1)) for k in range(0, 120) if k % 40] + [(name(500), name(draw.randrange(501, 700))) for _ in range(150)]
    frame = spark.createDataFrame(links, "a binary, b binary")
    whole = {bytes(r.node): bytes(r.component) for r in neardup.components(frame).collect()}
    monkeypatch.setattr(neardup, "BLOCK_LINKS", 40)
    assert {bytes(r.node): bytes(r.component) for r in neardup.components(frame).collect()} == whole
    assert len(set(whole.values())) == 4


def test_odd_rows(spark, odd):
    odd = odd.withColumns({c: F.lit("mine") for c in ("node", "sha", "sig", "component_id", "kept", "n_shingles", "component")})
    assert got(neardup.classify(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    left = [r.doc_id for r in neardup.deduplicate(odd).collect()]
    assert sorted(left, key=str) == sorted([1, 2, 3, None, 4, 6, 7], key=str)
    assert neardup.deduplicate(odd).columns == odd.columns


def test_empty(spark, odd):
    assert neardup.classify(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", [b"", b"  \t", b"one", b"One  TWO\x0bthree\n", "é ß".encode()])
def test_words(text):
    assert len(neardup.word_hashes(text)) == len(text.split())
    assert (neardup.word_hashes(text) == neardup.word_hashes(b" ".join(text.lower().split()))).all()
