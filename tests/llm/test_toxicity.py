import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.llm.queries import op8_toxicity


@pytest.fixture(scope="module")
def big(spark):
    return "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, big):
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = op8_toxicity(spark, big).join(labels, "doc_id").where("held_out")
    c = out.agg(F.sum((F.col("predicted") * F.col("toxic"))).alias("hit"), F.sum("toxic").alias("bad"), F.sum("predicted").alias("said"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert c.hit >= 0.7 * c.bad and c.hit >= 0.9 * c.said and 0 <= c.lo <= c.hi <= 1


def test_labels_are_no_input(spark, big):
    """Changing held-out labels, languages, sources and ids changes no score."""
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.withColumn("lang", F.lit("xx")), other)


def test_grammar():
    g = toxicity.Grammar({"idiot": 4.0}, {"stup": 3.0})
    e = g.evidence
    assert e("you are an idiot") == pytest.approx(4.0 * 1.2)
    assert e("an idiot") == 4.0 and e("stupider") == 3.0 and e("stup") == 0
    assert e("this is not an idiot") == pytest.approx(4.0 * 0.6)
    assert e("you are not an idiot") == pytest.approx(4.0 * 0.6 * 1.2)
    assert e("the author called it an idiot move") == pytest.approx(4.0 * 0.7)
    assert e("not. An idiot") == 4.0  # a negation ends with its clause
    assert e("an idiot! an idiot") == 8.0
    assert e(None) == e("") == e("a kind word") == 0
    assert g.score(e("idiot idiot")) > g.score(e("idiot")) > g.score(0)


def test_reported_speech():
    e = toxicity.Grammar({"idiot": 4.0}, {}).evidence
    assert e("he said: you idiot") == e("she wrote : you are really and truly quite an idiot") == pytest.approx(4.0 * 1.2 * 0.7)
    assert e('he said "well. What an idiot" idiot') == pytest.approx(4.0 * 0.7 + 4.0)
    assert e('he said "well.\nWhat an idiot"') == 4.0  # an open quote ends with its line
    assert e("look: an idiot") == e('an "idiot"') == 4.0
    assert e("he said that one two three four five six idiot") == pytest.approx(4.0 * 1.2)


def test_threats_need_no_insult():
    g = toxicity.Grammar({"idiot": 4.0}, {})
    e = g.evidence
    assert e("I will kill you.") == e("you will be killed") == g.threat and g.score(e("I will kill you.")) > 0.7
    assert e("an idiot; i will hurt you") == pytest.approx(4.0 + g.threat)
    assert e("he said they burn you") == pytest.approx(g.threat * 0.7)
    assert e("I will never hurt you") == e("I won't. They hurt. You see") == e("he burns wood") == e("burn wood") == 0
    assert e("Ich werde dich töten") == e("je vais te frapper") == g.threat


def plain(symbols):
    """The grammar's rules one after the other, on a list of symbols: sums of hits and menaces."""
    T = toxicity
    hits = menaces = 0.0
    negated = said = 0
    aim = to = waits = colon = quote = False
    for s in symbols:
        weak = 0.7 if said or colon or quote else 1.0
        if s in (T.INSULT, T.THREAT):
            if s == T.INSULT:
                hits += (0.6 if negated else 1.0) * (1.2 if aim else 1.0) * weak
            elif not negated and to:
                menaces += weak
            elif not negated:
                waits = True
        elif s in (T.OF, T.TO):
            menaces += weak if waits else 0
            aim, to, waits = True, to or s == T.TO, False
        if s not in (T.QUOTE, T.COLON, T.END, T.LINE):
            negated, said = (3 if s == T.NEGATION else max(0, negated - 1)), (6 if s == T.REPORT and not colon and not quote else max(0, said - 1))
        elif s == T.QUOTE:
            quote, colon, said = bool(said or colon) and not quote, False, 0
        elif s == T.COLON:
            colon = (colon or bool(said)) and not quote
            said = 0
        else:
            quote, colon, said = quote and s == T.END, False, 0
        if s in (T.COLON, T.END, T.LINE):
            negated, aim, to, waits = 0, False, False, False
    return hits, menaces


def one_machine(symbols):
    state, hits, menaces = 0, 0.0, 0.0
    for s in symbols:
        state, out, weight = toxicity.MACHINE.step(state, s)
        hits, menaces = hits + weight * (out == toxicity.HIT), menaces + weight * (out == toxicity.MENACE)
    return hits, menaces


def three_machines(symbols):
    """Each machine reads all that the one before wrote."""
    tape = [(s, 1.0) for s in symbols]
    for machine in (toxicity.negation(3, 0.6), toxicity.target(1.2), toxicity.reported(6, 0.7)):
        state, after = 0, []
        for s, w in tape:
            state, out, v = machine.step(state, s)
            after.append((out, w * v))
        tape = after
    return tuple(sum(w for s, w in tape if s == kind) for kind in (toxicity.HIT, toxicity.MENACE))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*toxicity._READ, toxicity.INSULT, toxicity.THREAT, toxicity.OTHER, toxicity.REPORT]), max_size=40))
def test_the_composed_machine(symbols):
    assert one_machine(symbols) == pytest.approx(three_machines(symbols))
    assert one_machine(symbols) == pytest.approx(plain(symbols))


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "you idiot", "a", "b"), (None, None, "a", "b"), (2, "fine", "a", "b")], "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxicity.clean(docs, labels).collect()), key=str) == [(2, "fine", "a", "b"), (None, None, "a", "b")]
    assert toxicity.score(docs, toxicity.fit(docs, labels)).columns == ["doc_id", "text", "score", "predicted"]


def test_odd_and_empty(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    g = toxicity.fit(odd, labels)
    out = toxicity.score(odd, g)
    assert out.count() == odd.count() and out.where("score is null or predicted is null").count() == 0
    assert toxicity.clean(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.clean(odd.limit(0), labels).count() == 0
