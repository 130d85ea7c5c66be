import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.queries import op1_packing

from tests.llm.conftest import DATA, TEXTS

PATH = P.path("word_bpe_49k.json")


def check(rows, texts, size):
    """An exact round trip: every document's pieces are its ids, and sequences have no gap or overlap."""
    t, want = Tokenizer.from_file(PATH), []
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size].tobytes())) for k, s in enumerate(range(0, len(ids), size))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    total = sum(r.length for r in rows)
    return len(bins), -(-total // size)


def test_query(spark, documents):
    bins, least = check(op1_packing(spark, DATA).collect(), [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert bins <= 1.03 * least + 1


def test_odd_rows(spark, odd):
    texts = [(i, t) for i, t in TEXTS] + []
    odd = odd.withColumns({c: F.lit("mine") for c in ("piece", "start", "sequence_id", "offset", "_bucket", "_n")})
    check(packing.pack_documents(odd, PATH, size=64).collect(), texts, 64)


def test_empty(spark, odd):
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["it's the 's'S re've", "a<|endoftext|>b <|startoftext|>", "é é ́x ΑΣ ΑΣΑ İ", "a b c\x1cd", "12 3a4 !? ... ~~"])
def test_words_are_encoded_alike(text):
    t = Tokenizer.from_file(PATH)
    (got,) = packing.ids_of(PATH, [text.encode()], 0)
    assert np.frombuffer(got, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1))
def test_plan_holds_all(lengths):
    bins = packing.plan(lengths, 50)
    got = {}
    for b in bins:
        assert sum(n * k for n, k in b.counts) <= 50
        for n, k in b.counts:
            got[n] = got.get(n, 0) + k * b.times
    assert got == lengths


def test_second_step_fits_more_tightly():
    # Greedy: 6 + 3 leaves 1; 3 gives way to 2 + 2, which fill the gap of 4.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0].counts == ((6, 1), (2, 2))


def test_a_tokenizer_that_keeps_white_space(tmp_path):
    """Words can't be encoded apart then: texts are encoded whole."""
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 1, " a": 2, "?": 3, " ": 4}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split(" a", "isolated")
    t.save(path := str(tmp_path / "t.json"))
    (got,) = packing.ids_of(path, [b"a a a"], 0)
    assert not packing._encoders[path].apart
    assert np.frombuffer(got, "<u4").tolist() == [*t.encode("a a a", add_special_tokens=False).ids, 0] == [1, 2, 2, 0]
