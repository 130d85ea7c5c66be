import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import secrets, toxicity

from tests.llm import brute
from tests.llm.conftest import DATA
from tests.llm.test_neardup import brute as near
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(runs):
    assert all(b.columns == a.columns for name, (a, b) in runs.items() if name != "packing")


def test_toxicity(spark, runs):
    a, b = runs["toxicity"]
    grammar = toxicity.fit(a, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect() if grammar.score(grammar.evidence(r.text)) < 0.7}
    assert b.count() < a.count()


def test_near_duplicates(runs):
    a, b = runs["near_duplicates"]
    least = near([(r.doc_id, r.text) for r in a.collect()])
    assert sorted(r.doc_id for r in b.collect()) == sorted(i for i, _, c in least if i == c)


def test_decontamination(spark, runs):
    a, b = runs["decontamination"]
    wins = brute.windows([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect() if not brute.contaminated(r.text, wins)[1]}


def test_secrets(runs):
    a, b = runs["secrets"]
    new = {r.doc_id: r.text for r in b.collect()}
    for r in a.collect():
        spans = brute.secrets(r.text, secrets.Entropy())[1]
        assert (new[r.doc_id] == r.text) == (not spans)
        assert all(r.text[s:e] not in new[r.doc_id] for s, _, e in spans)
    assert a.count() == b.count()


def test_packing(runs):
    a, b = runs["packing"]
    check(b.collect(), [(r.doc_id, r.text) for r in a.collect()], 2048)


def test_run(spark, runs):
    assert corpus_pipeline.run(spark, DATA).select(F.sum("length")).first() == runs["packing"][1].select(F.sum("length")).first()
