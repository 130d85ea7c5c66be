"""Secret scans with DataFrame functions only: fixed patterns plus sliding-window entropy.

Fixed kinds are found leftmost, non-overlapping; a match that is too short is dropped after it
has consumed its text. Entropy spans come from candidate strings (runs of token characters):
each has a character class, a window slides over it, and the Shannon entropy of the window is
kept up by the counts of its characters: one leaves, one enters, in time that doesn't depend on the candidate's
length. Candidates on the allow-list, as a whole, give no span; neither do windows that hold a placeholder, nor spans inside
one of a fixed kind.

Null and empty texts have no spans. Repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group whose length counts, least length. The order breaks ties of the start.
#: A run of hex or access characters that is too short holds no longer one, so those two patterns have the least length themselves.
KINDS = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
#: Any text with a match has this; one pass of it spares most texts the exact search.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Matches that are placed together; and the binary digits after the point of sums of n * log2(n).
BLOCK, ONE = 512, 40


@dataclass(frozen=True)
class Entropy:
    """Parameters of the entropy method; thresholds in bits a character. Candidates are of ASCII characters, windows of at most 31."""

    candidate: str = "[A-Za-z0-9+/_=-]{20,}"
    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    base64_bits: float = 3.9
    #: Candidates that are no secrets as a whole.
    allow: tuple[str, ...] = (
        "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
        "^/?[A-Za-z]+([-_/=+][A-Za-z]+)*[0-9]{0,4}/?$",  # words, perhaps joined and numbered; paths
        "^[0-9/_=+-]*$",  # numbers, dates, rules
    )
    #: What no secret's window holds; of a long candidate only the windows around it are let go.
    placeholder: str = "(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh"


def _found(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, size, word>> of all matches, by the lengths of what lies between and in them."""
    def walk(both: Column) -> Column:
        start = lambda acc, i: acc["at"] + F.length(F.get(both["gaps"], i))
        none = F.array().cast("array<struct<start:int,end:int,size:int,word:string>>")
        match = lambda at, i: F.struct(at.alias("start"), (at + F.length(F.get(both["hits"], i))).alias("end"), F.length(F.get(both["sized"], i)).alias("size"), F.get(both["hits"], i).alias("word"))
        add = lambda acc, m: F.struct(m["end"].alias("at"), F.array_append(acc["out"], m).alias("out"))
        # Matches are placed in blocks, as an array that grows is copied with every match.
        def block(acc: Column, b: Column) -> Column:
            own = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(both["hits"])) - 1)
            first = F.struct(acc["at"].alias("at"), none.alias("out"))
            return let(F.aggregate(own, first, lambda x, i: let(match(start(x, i), i), lambda m: add(x, m))), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.ceil(F.size(both["hits"]) / BLOCK).cast("int") - 1)
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,size:int,word:string>>>").alias("out"))
        return F.when(F.size(both["hits"]) > 0, F.flatten(F.aggregate(blocks, empty, block)["out"])).otherwise(none)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), sized.alias("sized")), walk)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, rank, end>> of a fixed kind; code points, end exclusive."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    kept = F.filter(_found(text, pattern, group), lambda m: m["size"] >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def _hot_window(word: Column, bits: Column, size: int, placeholder: str) -> Column:
    """struct<first, last>: 1-based first and last end of a window over the threshold; nulls if none.

    Counts of the window's characters lie in eight longs, 5 bits each; one character leaves, one enters. The sum
    of n * log2(n) over the counts is kept in units of 2**-ONE, so nothing drifts however long the word is.
    """
    times_log = F.array(*(F.lit(round(n * math.log2(max(n, 1)) * (1 << ONE))) for n in range(size + 2)))
    count = lambda counts, c: F.call_function("shiftrightunsigned", F.get(counts, c["k"]), c["s"]).bitwiseAND(F.lit(31)).cast("int")
    put = lambda counts, c, sign: F.transform(counts, lambda x, k: F.when(k == c["k"], x + sign * c["one"]).otherwise(x))

    def body(x: Column) -> Column:
        codes, bits = x["codes"], x["bits"]
        window = lambda i: F.array_join(F.slice(x["letters"], i - size + 1, size), "")

        def leave(acc: Column, i: Column) -> Column:
            """counts and sum without the character that leaves."""
            old = let(F.get(codes, i - size - 1), lambda c: let(count(acc["counts"], c), lambda n: F.struct(put(acc["counts"], c, -1).alias("counts"), (acc["sum"] - F.get(times_log, n) + F.get(times_log, n - 1)).alias("sum"))))
            return F.when(i > size, old).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))

        def enter(was: Column, i: Column) -> Column:
            return let(F.get(codes, i - 1), lambda c: let(count(was["counts"], c), lambda n: F.struct(put(was["counts"], c, 1).alias("counts"), (was["sum"] + F.get(times_log, n + 1) - F.get(times_log, n)).alias("sum"))))

        def step(acc: Column, i: Column) -> Column:
            def judged(now: Column) -> Column:
                hot = (i >= size) & (now["sum"] <= F.floor(F.lit(float(size << ONE)) * (F.lit(math.log2(size)) - bits)) + size) & ~window(i).rlike(placeholder)
                return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), F.when(hot & acc["first"].isNull(), i).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"))

            return let(leave(acc, i), lambda was: let(enter(was, i), judged))

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), 8).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step)

    def code(c: Column) -> Column:
        slot = F.least(F.greatest(F.ascii(c) - 33, F.lit(0)), F.lit(95))
        return let(slot, lambda n: let((n % 12) * 5, lambda s: F.struct(F.floor(n / 12).cast("int").alias("k"), s.alias("s"), F.call_function("shiftleft", F.lit(1).cast("long"), s).alias("one"))))

    return let(F.split(word, ""), lambda letters: let(F.struct(letters.alias("letters"), F.transform(letters, code).alias("codes"), bits.alias("bits")), body))


def entropy_spans(text: Column, base: Column, p: Entropy) -> Column:
    """Spans of the candidates' hot windows, beside those within base spans."""
    rank = len(KINDS)

    def bits(word: Column) -> Column:
        mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
        for allowed in p.allow:
            mixed = mixed & ~word.rlike(allowed)
        kind = F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), p.hex_bits).when(word.rlike("^[A-Za-z0-9]+$"), p.alnum_bits).otherwise(p.base64_bits)
        return F.when(mixed, kind)

    def span(m: Column) -> Column:
        def hot(c: Column) -> Column:
            place = lambda h: F.struct((c["start"] + h["first"] - p.window).alias("start"), F.lit(rank).alias("rank"), (c["start"] + h["last"]).alias("end"))
            return let(_hot_window(c["word"], c["bits"], p.window, p.placeholder), lambda h: F.when(h["first"].isNotNull(), place(h)))
        return let(F.struct(m["word"].alias("word"), bits(m["word"]).alias("bits"), m["start"].alias("start")), lambda c: F.when(c["bits"].isNotNull(), hot(c)))

    spans = F.transform(_found(text, p.candidate, 0), span)
    fresh = F.filter(spans, lambda s: s["start"].isNotNull() & ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return F.when(text.rlike(r"(?=[A-Za-z+/_=-]*[0-9])" + p.candidate), fresh).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def _spans(text: Column, params: Entropy) -> Column:
    """struct<base, all>: arrays of struct<start, rank, end>, sorted."""
    if params.window > 31:
        raise ValueError("windows have at most 31 characters")
    base = F.array_sort(F.concat(*(base_spans(text, k) for k in KINDS)))
    return let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, entropy_spans(text, b, params))).alias("all")))


def scan(docs: DataFrame, text: str = "text", params: Entropy = Entropy()) -> DataFrame:
    """docs with base_spans and secret_spans: arrays of struct<start, rank, end>, sorted.

    rank is the place of the kind in (*KINDS, 'entropy'). Columns of docs with these two names are replaced.
    """
    name = unused(docs, "spans")
    out = docs.drop("base_spans", "secret_spans").withColumn(name, _spans(F.coalesce(F.col(text), F.lit("")), params))
    return out.select("*", F.col(f"{name}.base").alias("base_spans"), F.col(f"{name}.all").alias("secret_spans")).drop(name)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "entropy")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", params: Entropy = Entropy()) -> DataFrame:
    """docs with each maximal run of overlapping or touching spans replaced by the mark; same columns, whatever their names. Null text stays null."""
    def runs(spans: Column) -> Column:
        """Starts and ends of the runs: a span opens one if none before it reaches it."""
        none = F.array().cast("array<struct<start:int,end:int>>")
        def step(acc: Column, s: Column) -> Column:
            opened = F.struct(F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"))).alias("out"), s["start"].alias("start"), s["end"].alias("end"))
            return F.when(s["start"] > acc["end"], opened).otherwise(F.struct(acc["out"].alias("out"), acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end")))
        first = F.struct(none.alias("out"), F.get(spans, F.lit(0))["start"].alias("start"), F.get(spans, F.lit(0))["end"].alias("end"))
        return F.aggregate(spans, first, step, lambda acc: F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))

    def cut(row: Column) -> Column:
        """What lies before each run, each with the mark; then the rest."""
        before = F.transform(row["runs"], lambda r, i: F.substr(row["text"], F.when(i > 0, F.get(row["runs"], i - 1)["end"]).otherwise(0) + 1, r["start"] - F.when(i > 0, F.get(row["runs"], i - 1)["end"]).otherwise(0)))
        last = F.get(row["runs"], F.size(row["runs"]) - 1)["end"]
        return F.concat(F.array_join(F.transform(before, lambda b: F.concat(b, F.lit(mark))), ""), F.substr(row["text"], last + 1, F.length(row["text"])))

    whole = F.coalesce(F.col(text), F.lit(""))
    new = let(_spans(whole, params), lambda s: F.when(F.size(s["all"]) > 0, let(F.struct(whole.alias("text"), runs(s["all"]).alias("runs")), cut)))
    return docs.withColumn(text, F.coalesce(new, F.col(text)))

