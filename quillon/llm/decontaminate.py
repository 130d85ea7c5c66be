"""Benchmark decontamination: a prefix-filtered set join of word windows, DataFrame functions only.

A window is `size` consecutive words of an item (a shorter item is one window). Containment of
a window must be whole, so the necessary prefix of its rarity-ordered words is one word: the
one that the fewest places of the corpus hold. Documents' places with such a word are joined with the windows that
have it; the window's offset and length bound where it can start, and the hashes of the words beside it must agree. What is
left are starts and lengths, for which the documents' own words are fetched and compared with the windows, exactly.

Places that are shuffled are ids, word, offset and two hashes, never texts or arrays. A word that many places hold is dealt over
several keys. Whatever a side's size, the plan is the same; tables of a checked size may be broadcast.

Null texts have no words. Items without words give no windows; null item ids count as none. Repeated document rows stay
repeated; null ids are kept, and rows that share an id but not the text are apart. Equal windows of several items count for
each. Documents longer than any window, or shorter than all, empty tables and extra columns of any name are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, drop_table, materialize, small

#: What isn't part of a word: ASCII but digits and lower-case letters (texts are lower-cased first).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word that has over this share of all places is dealt over several keys; so there are at most as many such words.
HOT = 4096
#: Starts of a document that are compared in one go.
STARTS = 8192


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def item_windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (array of words) with the sorted ids of the items that hold them."""
    split = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0 and item is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        split.select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), size).alias("window"))
        .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _beside(words: Column, at: Column) -> list[Column]:
    """Hashes of the words before and after a 0-based place; of '' where there is none."""
    near = lambda k: F.xxhash64(F.coalesce(F.get(words, k), F.lit("")))
    return [near(at - 1).alias("left"), near(at + 1).alias("right")]


def probes(split: DataFrame, windows: DataFrame) -> tuple[DataFrame, int]:
    """Each window's rarest word with its offset in the window; `keys` is over how many keys the word is dealt. And the most keys of any word."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = materialize(split.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word"), "counts")
    total = split.agg(F.sum("n_words")).first()[0] or 0
    ranked = (
        windows.select("window", F.posexplode("window").alias("before", "word"))
        .join(small(counts), "word", "left")
        .groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "before")).alias("rarest"))
        .where("rarest.n > 0")  # no place holds the others
        .select("rarest.word", "rarest.before", F.size("window").alias("length"), *_beside(F.col("window"), F.col("rarest.before")), F.ceil(F.col("rarest.n") * HOT / max(1, total)).cast("int").alias("keys"))
        .distinct()
    )
    ranked = materialize(ranked, "probes")
    drop_table(counts)
    return ranked, ranked.agg(F.max("keys")).first()[0] or 1


def hits(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: its id, sha (of the text), n_words, spans (array of struct<at, n>: word offset and length of windows), items (sorted)."""
    windows = materialize(item_windows(items, size, item_id, item_text), "windows")
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id).alias("id"), F.sha2(whole, 256).alias("sha"), words(whole).alias("w"))
    split = materialize(split.withColumn("n_words", F.size("w").cast("long")), "words")
    rarest, most = probes(split, windows)
    places = split.select("id", "sha", "n_words", "w", F.posexplode("w").alias("p", "word")).select("id", "sha", "n_words", "p", "word", *(c.alias(f"own_{k}") for k, c in zip(("left", "right"), _beside(F.col("w"), F.col("p")), strict=True)))
    if most > 1:
        hot = materialize(rarest.where("keys > 1").select("word", "keys").distinct(), "hot")  # at most HOT rows
        places = places.join(F.broadcast(hot), "word", "left").withColumn("key", F.coalesce(F.pmod(F.xxhash64("sha", "p"), F.col("keys")), F.lit(0).cast("long"))).drop("keys")
    else:
        places = places.withColumn("key", F.lit(0).cast("long"))
    dealt = rarest.select("word", "before", "length", "left", "right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - F.lit(1).cast("long"))).alias("key"))
    start = F.col("p") - F.col("before")
    agree = ((F.col("before") == 0) | (F.col("left") == F.col("own_left"))) & ((F.col("before") == F.col("length") - 1) | (F.col("right") == F.col("own_right")))
    found = places.join(small(materialize(dealt, "dealt")), ["word", "key"]).where((start >= 0) & (start + F.col("length") <= F.col("n_words")) & agree)
    # The text's hash is part of the key: rows that share an id, or have none, stay apart.
    starts = found.groupBy("id", "sha", F.floor(start / STARTS).alias("part")).agg(F.collect_set(F.struct(start.alias("at"), F.col("length").alias("n"))).alias("starts"))
    starts = materialize(starts.drop("part"), "starts")
    same = lambda a, b: (a["sha"] == b["sha"]) & a["id"].eqNullSafe(b["id"])
    slices = split.join(small(starts), same(split, starts)).select(split["id"], split["sha"], "w", F.explode("starts").alias("s"))
    slices = slices.select("id", "sha", "s", F.slice("w", F.col("s.at") + 1, F.col("s.n")).alias("window"))
    spans = slices.join(small(windows), "window").groupBy("id", "sha").agg(F.array_sort(F.collect_set("s")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans = materialize(spans, "hits")
    drop_table(windows, rarest, starts)
    out = split.join(small(spans), same(split, spans), "left")
    none = lambda c: F.coalesce(spans[c], F.array().cast(spans.schema[c].dataType))
    return out.select(split["id"], split["sha"], "n_words", none("spans").alias("spans"), none("items").alias("items"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
        (acc["n"] + F.greatest(s["at"] + s["n"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"),
    ))["n"]


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark; their columns as they are."""
    bad = hits(docs, items, size).where(F.size("spans") > 0).select(F.col("id").alias("_bad"), F.col("sha").alias("_sha")).distinct()
    bad = materialize(bad, "contaminated")
    key = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == bad["_sha"])
    return docs.join(small(bad), key, "left_anti")
