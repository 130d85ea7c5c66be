"""The operators of DataFrame functions: decontamination, secrets, quality; and that their plans run no Python."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, decontaminate, oracles, quality, secrets, urls
from quillon.llm.queries import QUERIES

from tests.llm import brute
from tests.llm.conftest import DATA, LONG

KEY = lambda r: str(r)


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    assert got == sorted(repr(r) for r in con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({oracles.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["op4_decontaminate", "op5_secrets", "op7_quality"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# --- decontamination


def spread(spark, docs, items):
    found = decontaminate.hits(docs, items)
    return sorted(((r.id, r.n_words, r.n_hit, r.items) for r in found.select("id", "n_words", decontaminate.covered(F.col("spans")).alias("n_hit"), "items").collect()), key=KEY)


def test_decontaminate_documents(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    wins = brute.windows([(r.item_id, r.text) for r in items.collect()])
    assert spread(spark, documents, items) == sorted(((r.doc_id, *brute.contaminated(r.text, wins)) for r in documents.collect()), key=KEY)
    left = decontaminate.clean(documents, items)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in documents.collect() if not brute.contaminated(r.text, wins)[1]}
    assert left.columns == documents.columns


def test_decontaminate_odd(spark, odd):
    """Short items, repeated words, items equal to others or to whole documents, none at all."""
    texts = ["one two three four five six seven", "LOREM ipsum dolor", "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet", None, "", "...", "no id", "no ID", "a a a a a a a a a a a a"]
    items = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, word string")
    docs = odd.unionByName(spark.createDataFrame([(70, "b " + "a " * 25, "en", "s", 9, 0, 0), (71, "One, two. THREE four-five six", "en", "s", 9, 0, 0)], odd.schema))
    wins = brute.windows(enumerate(texts))
    assert spread(spark, docs, items) == sorted(((r.doc_id, *brute.contaminated(r.text, wins)) for r in docs.collect()), key=KEY)
    assert spread(spark, odd, items.limit(0)) == sorted(((r.doc_id, *brute.contaminated(r.text, {})) for r in odd.collect()), key=KEY)
    assert spread(spark, odd.limit(0), items) == []


# --- secrets


def secret_texts():
    draw = random.Random(2)
    run = lambda letters, n: "".join(draw.choices(letters, k=n))
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return [
        None, "", "é" * 5 + ' PassWord = "hunter22" ', "token = token: abcdefgh", "token=secret=abcdefgh", "api_key:short token: 'longer-value.x=='", "AKIA" + run("ABCDEFGH234567", 16), "xAKIAAKIA" + "Z9" * 7, "AKIA1234",
        run(hexes, 24), run(hexes, 23) + "g", "\U0001f600 " + run(hexes, 40) + ", " + run(hexes, 64), "key " + run(b64, 40) + " end", "a" * 30 + "1", "550e8400-e29b-41d4-a716-446655440000", "this-is-a-long-hyphenated-name-2024", run(b64, 300), "secret: " + run(b64, 40) + run(hexes, 30),
        "ſecret=abcdefghij toKen=abcdefghij", LONG, 'apikey"  :   "' + run(b64, 22), "x" * 19 + "1" + run(b64, 25) + "x" * 40, "2024-01-02/2024-01-03/2025", "ABC" + run("0123456789ABCDEF", 40),
        "https://h.com/api/user/reset/" + run(b64[:62], 24), "example/" + run(b64, 60), "/" + run(b64, 10) + "EXAMPLE" + run(b64, 10), "a, b= " * 900 + "token=abcdef " * 1300, "k=" + run(b64, 40) + "~" + run(b64[:62], 90),
    ]


def test_secrets(spark):
    texts = secret_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("base", F.lit("x"))
    out = {r.doc_id: r for r in secrets.scan(rows).collect()}
    for i, t in enumerate(texts):
        base, every = brute.secrets(t, secrets.Entropy())
        assert [tuple(s) for s in out[i].base_spans] == base, t
        assert [tuple(s) for s in out[i].secret_spans] == every, t
    assert sum(len(r.secret_spans) > len(r.base_spans) for r in out.values()) >= 3
    for r in secrets.redact(rows).collect():
        spans = out[r.doc_id].secret_spans
        if not spans:
            assert r.text == texts[r.doc_id]
        else:
            want, at = "", -1
            for s in spans:
                if s.start > at:
                    want += texts[r.doc_id][max(at, 0) : s.start] + "[SECRET]"
                at = max(at, s.end)
            assert r.text == want + texts[r.doc_id][at:]
    assert secrets.redact(rows).columns == rows.columns
    clash = rows.withColumn("base_spans", F.lit(1)).withColumn("secret_spans", F.lit("y")).withColumn("spans", F.lit(2)).where("doc_id = 2")
    assert secrets.redact(clash).select("base_spans", "secret_spans", "spans").first() == (1, "y", 2)
    assert secrets.scan(clash).columns == ["doc_id", "text", "start", "base", "spans", "base_spans", "secret_spans"]
    assert secrets.scan(rows.limit(0)).count() == 0


def test_a_very_long_candidate(spark):
    """Time grows with its length, not with the square: a megabyte takes seconds."""
    draw = random.Random(6)
    text = "x " + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000)) + " y"
    began = time.time()
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    (span,) = row.secret_spans
    assert 2 <= span.start < 1000 and 1_000_002 - 1000 < span.end <= 1_000_002


def test_decontaminate_long_documents_without_broadcast(spark, monkeypatch):
    """Shuffled joins give the same rows; no document's words are sent with each of its places."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.small, "__defaults__", (-1,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        draw = random.Random(8)
        text = lambda n: " ".join(draw.choices(["the", "of", *(f"w{k}" for k in range(300))], weights=[200, 100, *[1] * 300], k=n))
        docs = [(k, text(20_000 if k < 2 else 200)) for k in range(12)] + [(20, None), (None, "the the the"), (None, "the the the")]
        items = [(k, " ".join(docs[k % 12][1].split()[50 * k : 50 * k + 14])) for k in range(30)] + [(40, "the " * 30), (41, "of the of"), (42, text(40)), (43, None)]
        wins = brute.windows(items)
        frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert spread(spark, frame, tests) == sorted(((i, *brute.contaminated(t, wins)) for i, t in docs), key=KEY)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- quality


def test_quality_counts(spark, odd):
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["a", "b", "c", "dd", "#e"], k=n)) for n in (2, 3, 4, 5, 30, 400)] + ["x y z " * 50, "x\n\nx\n \nx y\nx y\n", "\x1fone\u00a0two\x0bthree\x85", "w " * 100]
    rows = odd.unionByName(spark.createDataFrame([(100 + k, t, "en", "s", 0, 0, 0) for k, t in enumerate(texts)], odd.schema))
    rows = rows.withColumns({c: F.lit("mine") for c in ("n_words", "mean_word", "lines", "stratum", "cut_mean_word", "kept")})
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(rows).collect()), key=KEY)
    assert got == sorted(((r.doc_id, *brute.quality(r.text)) for r in rows.collect()), key=KEY)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd, labels).count() == odd.count()
    judged = quality.judge(rows, labels)
    assert judged.count() == rows.count() and judged.columns.count("n_words") == judged.columns.count("kept") == 1
    assert {r.stratum + r.lines + r.cut_mean_word for r in judged.collect()} == {"mine" * 3}
    assert quality.judge(odd.limit(0), labels.limit(0)).count() == 0


def test_equal_hashes_fall_back_to_the_windows(spark):
    """The slow way, by itself, counts alike."""
    draw = random.Random(4)
    texts = [" ".join(draw.choices("abc", k=n)) for n in (3, 4, 20, 200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    fast = [r[0] for r in frame.select(quality.repeat_words(F.col("text"))).collect()]
    assert fast == [brute.quality(t)[4] for t in texts]


def test_binomial(spark):
    from math import comb

    cases = [(0, 10), (3, 100), (1, 1000), (9, 20000), (50, 1000)]
    frame = spark.createDataFrame(cases, "k long, n long")
    got = [r[0] for r in frame.select(quality.binomial_cdf(F.col("k"), F.col("n"), 0.01)).collect()]
    want = [1.0 if k > 0.01 * n else sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) for k, n in cases]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    """A rule that good documents of one stratum break is not applied there, but is where they don't."""
    draw = random.Random(0)
    rows = [(i, lang, False, draw.choice([0.0, 0.02]) if lang == "en" else draw.choice([0.0, 0.35]), 0.0, 0.0, 5.0) for i, lang in enumerate(["en", "de"] * 3000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, symbol_ratio double, dup_line_ratio double, repeat_ratio double, mean_word double")
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    cuts = {r.stratum: r for r in quality.cutoffs(measured, labels, "lang").collect()}
    assert cuts["en"].cut_symbol_ratio == 0.05 and cuts["de"].cut_symbol_ratio == 0.4
    few = {r.stratum: r for r in quality.cutoffs(measured.limit(100), labels, "lang").collect()}
    assert all(r.cut_symbol_ratio is None for r in few.values())


# --- URLs


def test_urls(spark):
    cases = [
        ("https://a.example.org/es/x", "example.org/es/", "block"), ("http://EXAMPLE.org/en/123?q#f", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"), ("http://notexample.org/es/", "org/", "allow"),
        ("http://casino.com/fr/a", "com/fr/", "allow"), ("ftp://x.com/de/", "com/de/", "block"), ("http://x.com/DE/", None, "allow"), ("http://www.casino-win.net/en/", None, "block"), ("http://a.free-bets.info", None, "block"),
        ("http://freebets.info/free/bets", None, "allow"), ("http://org", None, "allow"), ("http://x.org/", "org/", "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme/org/", None, "allow"), ("://y.org/a://b", "org/", "allow"), ("http://porn.example/", None, "block"), ("http://a b.org/x", "org/", "allow"), ("http://x.org?/es/", None, "allow"),
    ]
    frame = spark.createDataFrame([(k, u, "x", 1) for k, (u, _, _) in enumerate(cases)], "page_id long, url string, html string, tokens int")
    got = {r.page_id: r for r in urls.judge(frame).collect()}
    for k, (u, rule, verdict) in enumerate(cases):
        assert (got[k].rule, got[k].verdict) == (rule, verdict), u
    assert (got[1].host, got[1].path) == ("example.org", "/en/123")
    assert (got[12].host, got[12].path) == ("", "")
    assert urls.judge(frame.limit(0)).count() == 0
    clash = frame.withColumns({c: F.lit("mine") for c in ("host", "rule", "verdict", "judged")})
    judged = urls.judge(clash)
    assert sorted(judged.columns) == sorted(["page_id", "url", "html", "tokens", "judged", "host", "path", "rule", "matched", "verdict"])
    assert {r.page_id: r.verdict for r in judged.collect()} == {k: v for k, (_, _, v) in enumerate(cases)}


def test_index_uses_the_rarest_token(spark):
    frame = spark.createDataFrame([("free.org", "/")] * 5 + [("bets.org", "/")], "host string, path string")
    filed = urls.index(frame, (urls.Rule("block", pattern="free-bets", literals=("free", "bets")), urls.Rule("allow", "org")))
    assert set(filed) == {"bets", "org"}
