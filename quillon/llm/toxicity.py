"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words and marks to symbols: insult, threat, target, negation, report, quote, colon, ends. Three more
read symbols: one for negation, which weakens the insults that it rules and undoes the threats; one for targets, which makes a hit of
an insult (more telling if a target is met in the clause) and a menace of a threat and a target, in either
order if the target is who is spoken to; and one for reported speech, after a verb of saying, a colon or in quotes, which weakens
hits and menaces. They are composed into one machine, whose states are those of all three and whose weights are products. So what
counts are matched clauses: a threat needs no insult, and a threat without a target, or a negated one, is nothing. A hit is worth its
insult's weight, a menace a threat's. Sums over the document are its evidence; a logistic curve of the evidence's logarithm
is its score.

Insults are learned: words and stems whose share among toxic documents exceeds that among clean ones, weighted
by the log odds, from a bounded sample of labelled rows (at most FIT_ROWS of either label, by the hash of
their id). A threat's weight is the log odds of menaces in that sample, from a prior worth ten documents. Near copies count once,
else each word of a document with many copies would look telling; copies are told by the least hash of their shingles.
The other word lists are fixed. Without labels, a small fixed list of insults serves.

Null and empty texts have no evidence. Ids that labels contradict are not learned from. Repeated rows score alike; null ids and
extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, unused
from quillon.llm.neardup import shingles

#: Labelled rows of either label that fitting reads at most.
FIT_ROWS = 6000
STEMS = (4, 5, 6)

# Word lists of the grammar.
INSULTS = ("idiot", "moron", "loser", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown")
THREATS = (
    "kill", "kills", "killed", "killing", "murder", "murdered", "hurt", "destroy", "beat", "shoot", "shot", "stab", "stabbed", "strangle", "burn", "hang", "punch",
    "töten", "töte", "umbringen", "schlagen", "schlage", "verletzen", "vernichten", "erschießen", "erstechen", "verbrennen", "erwürgen",
    "tuer", "tuerai", "frapper", "frapperai", "blesser", "détruire", "détruirai", "brûler", "poignarder", "étrangler",
    "matar", "mataré", "golpear", "golpearé", "herir", "destruir", "destruiré", "quemar", "apuñalar", "estrangular",
)
SPOKEN_TO = ("you", "your", "yourself", "du", "dich", "dir", "euch", "tu", "te", "toi", "vous", "ti", "usted", "ustedes", "vosotros")
SPOKEN_OF = ("he", "she", "they", "them", "him", "her", "er", "sie", "ihn", "ihm", "ihr", "il", "elle", "ils", "elles", "lui", "leur", "él", "ella", "ellos", "ellas")
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "nunca", "jamás", "sin")
REPORTS = ("said", "says", "wrote", "called", "quoted", "claimed", "shouted", "sagte", "sagt", "schrieb", "nannte", "rief", "dit", "disait", "écrit", "cria", "dijo", "dice", "escribió", "gritó")

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[.!?;|]+|[:\n\"\u201c\u201d\u201e\u00ab\u00bb]")

#: Symbols. What the last two stand for, machines write; the others are read.
OTHER, INSULT, THREAT, OF, TO, NEGATION, REPORT, QUOTE, COLON, END, LINE, HIT, MENACE = range(13)
_READ = range(LINE + 1)
_LEXICON = {w: k for k, words in ((OF, SPOKEN_OF), (TO, SPOKEN_TO), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (COLON, (":",)), (LINE, ("\n",)), (QUOTE, tuple("\"\u201c\u201d\u201e\u00ab\u00bb"))) for w in words}
_THREATS = frozenset(THREATS)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs[state, symbol] is the next state, the symbol written and its weight. A symbol without an arc passes, and changes no state."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what first reads; what first writes goes through second. States are pairs, numbered as they are reached; weights multiply."""
    number, open_, arcs = {(0, 0): 0}, [(0, 0)], {}
    while open_:
        x, y = open_.pop()
        for symbol in _READ:
            a, between, w = first.step(x, symbol)
            b, out, v = second.step(y, between)
            if (a, b) not in number:
                number[a, b] = len(number)
                open_.append((a, b))
            arcs[number[x, y], symbol] = (number[a, b], out, w * v)
    return Transducer(arcs)


def negation(reach: int, weight: float) -> Transducer:
    """State: how many words the last negation still rules."""
    arcs = {}
    for k in range(reach + 1):
        arcs |= {(k, NEGATION): (reach, OTHER, 1.0)} | {(k, s): (0, s, 1.0) for s in (COLON, END, LINE)}
        if k:
            arcs |= {(k, s): (k - 1, s, 1.0) for s in (OTHER, OF, TO, REPORT)} | {(k, INSULT): (k - 1, INSULT, weight), (k, THREAT): (k - 1, OTHER, 1.0)}
    return Transducer(arcs)


def target(weight: float) -> Transducer:
    """State: whether the clause has a target, one who is spoken to, a threat that waits for its target."""
    arcs = {}
    for k in range(8):
        any_, to, waits = k & 1, k & 2, k & 4
        arcs |= {(k, s): (0, s, 1.0) for s in (COLON, END, LINE)}
        arcs[k, INSULT] = (k, HIT, weight if any_ else 1.0)
        arcs[k, THREAT] = (k, MENACE, 1.0) if to else (k | 4, OTHER, 1.0)
        arcs[k, OF] = (k & 3 | 1, MENACE if waits else OTHER, 1.0)
        arcs[k, TO] = (k & 3 | 3, MENACE if waits else OTHER, 1.0)
    return Transducer(arcs)


def reported(span: int, weight: float) -> Transducer:
    """State: 0; how many words a verb of saying still rules; after its colon; in its quotes, which go on over ends, but not over lines."""
    colon, quote, arcs = span + 1, span + 2, {}
    for k in range(span + 3):
        next_ = k - 1 if 0 < k <= span else k
        arcs |= {(k, s): (next_, s, weight if k else 1.0) for s in (HIT, MENACE)} | {(k, s): (next_, OTHER, 1.0) for s in (OTHER, NEGATION)}
        arcs[k, REPORT] = (span if k <= span else k, OTHER, 1.0)
        arcs[k, COLON] = (colon if 0 < k <= colon else k, OTHER, 1.0)
        arcs[k, QUOTE] = (quote if 0 < k <= colon else 0, OTHER, 1.0)
        arcs[k, END] = (quote if k == quote else 0, END, 1.0)
        arcs[k, LINE] = (0, LINE, 1.0)
    return Transducer(arcs)


MACHINE = compose(compose(negation(3, 0.6), target(1.2)), reported(6, 0.7))


@dataclass(frozen=True)
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 2.5
    offset: float = -2.0
    threat: float = 4.0

    def insult(self, word: str) -> float:
        return self.words.get(word) or max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)

    def matches(self, text: str | None) -> tuple[float, float]:
        """Hits, weighted by their insults, and menaces; both by how they are negated, aimed and reported."""
        text = (text or "").lower()
        every = set(WORD.findall(text))
        found = {w: x for w in every if (x := self.insult(w))}
        if not found and _THREATS.isdisjoint(every):
            return 0.0, 0.0
        hits = menaces = 0.0
        # No state outlives a line.
        for line in text.split("\n"):
            own = set(WORD.findall(line))
            if found.keys().isdisjoint(own) and _THREATS.isdisjoint(own):
                continue
            state = 0
            for token in TOKEN.findall(line):
                symbol = INSULT if token in found else _LEXICON.get(token, OTHER if token.isalpha() else END)
                state, out, weight = MACHINE.step(state, symbol)
                if out == HIT:
                    hits += weight * found[token]
                elif out == MENACE:
                    menaces += weight
        return hits, menaces

    def evidence(self, text: str | None) -> float:
        hits, menaces = self.matches(text)
        return hits + self.threat * menaces

    def score(self, evidence: float) -> float:
        x = self.slope * math.log1p(evidence) + self.offset
        return 1 / (1 + math.exp(-x)) if x > 0 else math.exp(x) / (1 + math.exp(x))


def held_out(doc_id: Column, buckets: int = 3, bucket: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets == bucket, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the rows to learn from: not held out, at most FIT_ROWS of either label."""
    known = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    known = known.where(~held_out(F.col("doc_id")))
    first = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(first(0).union(first(1))), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    rows = sample(docs, labels)

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        """Distinct words and, marked by a hyphen, stems."""
        def of(t: str | None) -> list[str]:
            words = set(WORD.findall((t or "").lower()))
            return [*words, *{w[:n] + "-" for w in words for n in STEMS if len(w) > n}]
        return texts.map(of)

    @F.pandas_udf("long")
    def copy(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: int(s[0] >> np.uint64(1)) if len(s := shingles((t or "").encode(), 5)) else 0)

    rows = materialize(rows.withColumn("copy", copy("text")), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("copy").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Grammar(dict.fromkeys(INSULTS, 4.0), {})
    # Executors keep a term only if it can matter; the driver gets the lexicon alone.
    once = rows.select("toxic", "copy", F.explode(terms("text")).alias("term")).distinct()
    seen = once.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (bad + 1)) - F.log((F.col("q") + 0.5) / (good + 1))
    best = seen.where(F.col("p") >= max(4, bad / 150)).withColumn("odds", odds).where((F.col("odds") >= 2.5) & (F.col("p") >= F.col("q")))
    words, stems = {}, {}
    for r in best.collect():  # each is in a 150th of the toxic rows at least: there are at most 150 times as many as one has
        (stems if r["term"].endswith("-") else words)[r["term"].rstrip("-")] = r["odds"]
    raw = Grammar(words or dict.fromkeys(INSULTS, 4.0), stems)

    @F.pandas_udf("array<double>")
    def matches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(raw.matches(t)))

    found = rows.select(matches("text").alias("x"), "toxic").collect()  # at most 2 * FIT_ROWS of three numbers
    hits, menaces, toxic = (np.array(v, float) for v in zip(*((*r["x"], r["toxic"]) for r in found), strict=True))
    p, q = ((menaces[toxic == v] > 0).sum() for v in (1, 0))
    threat = max(0.0, math.log((p + 5.5) / (sum(toxic == 1) + 10)) - math.log((q + 0.1) / (sum(toxic == 0) + 10)))
    slope, offset = _logistic(np.log1p(hits + threat * menaces), toxic)
    return Grammar(raw.words, raw.stems, slope, offset, threat)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method."""
    design, beta = np.c_[x, np.ones_like(x)], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, grammar: Grammar, text: str = "text", at: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted; columns of docs with these names are replaced."""
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: grammar.score(grammar.evidence(t))).astype(float)

    return docs.drop(*(n for n in names if n != text)).withColumn(names[0], scored(F.col(text))).withColumn(names[1], (F.col(names[0]) >= at).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    """The documents that aren't predicted toxic; their columns as they are."""
    names = unused(docs, "score"), unused(docs, "predicted")
    return score(docs, fit(docs, labels), at=at, names=names).where(F.col(names[1]) == 0).select(*docs.columns)
