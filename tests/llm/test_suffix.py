import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import lit

from quillon.llm import suffix
from quillon.llm.queries import op2_suffix_dedup

from tests.llm.conftest import DATA


def brute(rows, span=50):
    """(id, bytes, removed, spans, digest of the rest) from a table of every string and its least id."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if i is not None and (w not in least or least[w] > i):
                least[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if (low := least.get(b[s : s + span])) is not None and (i is None or low < i):
                gone[s : s + span] = b"\1" * span
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query(spark, documents):
    assert got(op2_suffix_dedup(spark, DATA)) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_edges(spark):
    """Strings of just the span and one less, at either end of a document, of one letter, overlapping, across chunks."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzé ", k=n))
    a, b, c = word(50), word(49), word(300)
    rows = [(9, a), (3, word(70) + a), (4, a + word(90)), (5, word(20) + b + "x"), (6, "y" + b + word(20)), (7, "z" * 400), (8, "z" * 90), (10, c), (11, c[:120] + c[100:]), (12, word(10)), (None, c), (13, "z" * 49)]
    assert got(suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_crowded_anchors(spark, documents):
    """With hardly any context allowed to an anchor, strings are dealt one by one, and the result is the same."""
    docs = documents.limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = "the same passage of more than fifty bytes, that all have in common"
    rows += [(10_000 + i, f"{i * 7919} {passage} {i * 104729} {'z' * (i % 90)}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (0, 3):
        assert got(suffix.repeats(frame, suffix.Repeats(crowd=crowd))) == brute(rows)


def test_odd_rows(spark, odd):
    odd = odd.withColumn("text", odd["text"].substr(1, 3000)).withColumns({c: lit("mine") for c in ("kept", "n_bytes", "chunk", "bucket", "data")})
    out = suffix.repeats(odd)
    assert got(out) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in out.collect())


def test_empty(spark, odd):
    assert suffix.repeats(odd.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    text = np.array([*values, 0], np.int32)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix.suffix_array(text, 5).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 4))
def test_common_prefixes(values, times):
    data = np.array(values * times, np.uint8)
    array = suffix.suffix_array(np.append(data.astype(np.int32) + 1, 0).astype(np.int32), 257)
    want = [0]
    for a, b in zip(array[:-1].tolist(), array[1:].tolist()):
        k = 0
        while max(a, b) + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        want.append(k)
    assert suffix.common_prefixes(data, array).tolist() == want[: len(array)]
