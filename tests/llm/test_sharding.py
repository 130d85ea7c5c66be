import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import sharding
from quillon.llm.queries import op10_sharding

from tests.llm.conftest import DATA


def check(rows, texts, shards, id_of=lambda r: r.doc_id):
    key = lambda x: str(x)
    assert sorted(((id_of(r), r.size, r.text_crc32) for r in rows), key=key) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=key)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark, documents):
    rows = op10_sharding(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    check(rows, texts.items(), 16)
    sizes, longest = Counter(), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest
    light = defaultdict(set)
    for r in rows:
        light[texts[r.doc_id]].add(r.shard)
    share = sharding.TOLERANCE * sum(sizes.values()) / 16
    weight = Counter()
    for t in texts.values():
        weight[t] += len((t or "").encode()) + 1
    assert all(len(s) == 1 for t, s in light.items() if weight[t] <= share)


def test_hot_group_is_parted(spark):
    rows = [(i, "the same text in a third of all rows" if i % 3 == 0 else f"text {i} of its own kind", "en", f"s{i % 7}", 9) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=7).collect()
    check(out, [(r[0], r[1]) for r in rows], 7)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.03 * min(sizes.values())


def tree(points, shards, first=0):
    """Shard of each point, by sorting each node's points and cutting at the weighted median."""
    whole = {d: max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in sharding.DIMENSIONS}

    def split(own, leaves, first):
        if leaves == 1:
            return {(p["_g"], p["_part"]): first for p in own}
        if not own:
            return {}
        width = [(max(p[d] for p in own) - min(p[d] for p in own)) / whole[d] for d in sharding.DIMENSIONS]
        d = sharding.DIMENSIONS[width.index(max(width))]
        key = lambda p: (p[d], p["tie"])
        own, half, total, cut = sorted(own, key=key), leaves // 2, sum(p["w"] for p in own), 0
        reached = 0
        for p in own:
            reached += p["w"]
            cut = key(p)
            if reached * leaves >= total * half:
                break
        return split([p for p in own if key(p) <= cut], half, first) | split([p for p in own if key(p) > cut], leaves - half, first + half)

    return split(points, shards, first)


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_the_tree(spark, documents, shards):
    meta = sharding._meta(documents, "text", "doc_id")
    found, dealt, _ = sharding.points(meta, shards)
    of = tree([r.asDict() for r in found.collect()], shards)
    want = {r.id: of[r._g, r._part] for r in dealt.collect()}
    assert {r.doc_id: r.shard for r in sharding.shard(documents, shards).collect()} == want


def test_target_and_columns(spark):
    rows = [(i, f"text {i} of its own kind " * 8, "en", "mine", 1, 2, 3) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, size string, shard int, id int, d_lang int")
    out = sharding.shard(docs, target_bytes=sum(len(r[1]) + 1 for r in rows) // 9)
    assert sorted(out.columns) == sorted(["doc_id", "lang", "id", "d_lang", "size", "text_crc32", "law", "shard", "slot"])
    got = out.collect()
    assert len({r.shard for r in got}) == 10 and {(r.id, r.d_lang) for r in got} == {(2, 3)}
    check(got, [(r[0], r[1]) for r in rows], 10)


def test_odd_and_empty(spark, odd):
    check(sharding.shard(odd, 4).collect(), [(r.doc_id, r.text) for r in odd.collect()], 4)
    assert sharding.shard(odd.limit(0), 4).count() == 0
