"""Quality rules with risk-controlled thresholds, DataFrame functions only.

Base rules are fixed. Every further rule rejects a document if a feature is over a cutoff. Cutoffs come
from the labelled good documents of each stratum (language): for each cutoff of a grid, the exact
binomial test asks whether the rule's rate of false rejection could still exceed its share of the
allowed risk; a cutoff is valid if that is refuted at a level corrected (Bonferroni) for all
strata, rules and cutoffs tried. The tightest valid cutoff is taken, none if no cutoff is valid.

Null text has no words. A stratum without labels has no cutoffs. Labels that contradict
each other for one id are ignored. Repeated rows, null ids and extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, let, materialize, unused

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word")


@dataclass(frozen=True)
class Risk:
    """Falsely rejected at most `risk` of good documents per stratum, with confidence 1 - `error` over all strata at once."""

    risk: float = 0.02
    error: float = 0.05
    grid: dict[str, tuple[float, ...]] = field(default_factory=lambda: {
        "symbol_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
        "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
        "repeat_ratio": (0.1, 0.15, 0.2, 0.3, 0.4),
        "mean_word": (8.0, 9.0, 10.0, 12.0, 15.0),
    })

    @property
    def tests(self) -> int:
        return sum(map(len, self.grid.values()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _joined(ends: Column) -> Column:
    """Words covered by 3-word windows at the given sorted starts."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(ends, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]


def repeat_words(text: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are sorted as one long each: 43 bits of a hash, 20 of the place. Neighbours of equal hash
    are compared by their words. If any differ, or the text has over 2**20 words, the windows
    themselves are sorted instead.
    """
    def fast(w: Column) -> Column:
        key = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 21), 20).bitwiseOR(i.cast("long"))
        at = lambda k: k.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        same = lambda a, b: F.shiftright(a, 20) == F.shiftright(b, 20)

        def pairs(s: Column) -> Column:
            """Places of windows whose left neighbour has the same hash, with that neighbour's place."""
            return F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x.alias("x"), F.when(j > 0, F.get(s, j - 1)).alias("y"))), lambda p: same(p["x"], p["y"])), lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))

        def count(p: Column) -> Column:
            clash = F.exists(p, lambda q: ~((F.get(w, q["x"]) == F.get(w, q["y"])) & (F.get(w, q["x"] + 1) == F.get(w, q["y"] + 1)) & (F.get(w, q["x"] + 2) == F.get(w, q["y"] + 2))))
            marks = F.array_sort(F.array_distinct(F.concat(F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"]))))
            return F.when(clash, slow(w)).otherwise(_joined(marks))

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key)), lambda s: F.when(F.size(s) > 1, let(pairs(s), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(count(p)))).otherwise(F.lit(0).cast("long")))

    def slow(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.slice(w, i + 1, 3).alias("w"), i.alias("i")))
        def marks(s: Column) -> Column:
            near = F.filter(s, lambda x, j: (F.get(s, j + 1)["w"] == x["w"]) | F.coalesce((j > 0) & (F.get(s, j - 1)["w"] == x["w"]), F.lit(False)))
            return _joined(F.array_sort(F.transform(near, lambda x: x["i"])))
        return let(F.array_sort(windows), marks)

    return let(words(text), lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) <= 1 << 20, fast(w)).otherwise(slow(w)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns, without the text and those named like a feature, and the counts and ratios of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    n = F.size(words(t)).cast("long")
    out = docs.select(
        *(c for c in docs.columns if c != text and c.lower() not in FEATURES),
        n.alias("n_words"), without(BLANKS).cast("long").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias(both := unused(docs, "lines")),
        repeat_words(t).alias("n_repeat_words"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return (
        out.withColumn("n_dup_lines", F.col(f"{both}.dup"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("symbol_ratio", ratio(F.col("n_symbols"), F.col("word_chars")))
        .withColumn("dup_line_ratio", ratio(F.col("n_dup_lines"), F.col(f"{both}.n")))
        .withColumn("repeat_ratio", ratio(F.col("n_repeat_words"), F.col("n_words")))
        .withColumn("mean_word", ratio(F.col("word_chars"), F.col("n_words")))
        .drop(both)
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in logarithms; 1 where k is over the mean, which no test needs."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    many = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(many, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(total))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, params: Risk = Risk()) -> DataFrame:
    """stratum, and for each rule its cutoff (null: none). measured: features() with doc_id."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select("doc_id")
    held = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    sums = [F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}_{j}") for rule, cuts in params.grid.items() for j, cut in enumerate(cuts)]
    counted = held.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), *sums)
    strata = F.count("*").over(_all())
    level = F.lit(params.error) / (strata * params.tests)
    share = params.risk / len(params.grid)
    chosen = {
        rule: F.coalesce(*(F.when(binomial_cdf(F.col(f"{rule}_{j}"), F.col("n"), share) <= F.col("level"), F.lit(cut)) for j, cut in enumerate(cuts)))
        for rule, cuts in params.grid.items()
    }
    return counted.withColumn("level", level).select("stratum", *(c.alias(f"cut_{rule}") for rule, c in chosen.items()))


def _all():
    """One window over the strata, of which there are few: a row for each language."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", params: Risk = Risk()) -> DataFrame:
    """docs' columns without the text, counts, base_failed, and kept; columns of docs named like a feature, or kept, are replaced."""
    measured = materialize(features(docs.drop("kept"), text), "quality")
    cuts = cutoffs(measured, labels, stratum, params)
    names = {c: unused(measured, c) for c in cuts.columns}
    cuts = cuts.select(*(F.col(c).alias(n) for c, n in names.items()))
    failed = F.lit(False)
    for rule in params.grid:
        failed = failed | F.coalesce(F.col(rule) > F.col(names[f"cut_{rule}"]), F.lit(False))
    return (
        measured.join(cuts, F.coalesce(F.col(stratum), F.lit("")) == F.col(names["stratum"]), "left")
        .withColumn("kept", ~F.col("base_failed") & ~failed)
        .drop(*names.values())
    )
