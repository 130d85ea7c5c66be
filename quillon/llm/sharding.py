"""K-d tree sharding: nodes are split at distributed weighted medians along their widest dimension.

Points of the tree are groups of equal texts, weighted by their bytes, so that copies stay together. The law is that the shards'
bytes are near equal. A cut can miss its median by the group that lies on it, so a shard misses its share by less than twice
the heaviest point. Points weigh at most `tolerance` of a shard's share: a group over that is dealt by doc_id into as many
points of equal coordinates as it takes, which a cut may part. (Whole groups of up to a share would leave shards
half or twice as large as others.) Dimensions are metadata of the group's first row: language, source, size and characters
a byte; names count in the order of their hashes. A node of n leaves is cut so that the parts have n // 2 and the rest of
them, with bytes in proportion, until each is one leaf; how many leaves there are is given, or follows from the bytes that a
shard should have. The median is found by refining histograms of a 62-bit key (the dimension, then a hash that breaks
ties), for all nodes of a level at once; the driver sees bins only.

Null text has no bytes and the checksum of the empty one. Null metadata, or metadata columns that don't exist, count as empty.
Repeated rows get a slot each; null ids are kept. Extra columns of any name are kept, but those named as one of the result's
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import drop_table, materialize, parts, small

LAW = "bytes"
#: Most of a shard's share of the bytes that a point weighs.
TOLERANCE = 0.005
#: Bits of a key that one pass settles at most, and in all; a pass brings at most 2**BINS bins to the driver, or two a node.
BITS, BINS, KEY = 14, 20, 62
DIMENSIONS = ("d_lang", "d_source", "d_size", "d_dense")
RESULT = ("size", "text_crc32", "law", "shard", "slot")


def _name(column: Column) -> Column:
    """A name as a number of 31 bits, of the whole of it."""
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(column), 33))


def _meta(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(t) + 1).cast("long")
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    kept = [c for c in docs.columns if c != text and c.lower() not in RESULT]
    return docs.select(
        F.struct(*kept).alias("row"), F.col(doc_id).alias("id"), size.alias("size"), F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("_g"),
        _name(column("lang")).alias("d_lang"), _name(column("source")).alias("d_source"),
        F.floor(F.log2(size) * (1 << 24)).cast("long").alias("d_size"),
        F.floor(F.length(t) / size * (1 << 24)).cast("long").alias("d_dense"),
    )


def _cut(points: DataFrame, nodes: list[dict]) -> dict[int, tuple[int, int]]:
    """For each node its axis and cut: the least key so that the points below it weigh the node's share at least."""
    number = F.col("node")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), number)
    widest = points.groupBy("node").agg(*(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS), F.sum("w").alias("w")).collect()
    whole = {d: max(1, max(r[f"hi_{d}"] for r in widest) - min(r[f"lo_{d}"] for r in widest)) for d in DIMENSIONS}
    axis, want = [0] * len(nodes), [0] * len(nodes)
    for r in widest:
        axis[r["node"]] = max(range(len(DIMENSIONS)), key=lambda k: ((r[f"hi_{DIMENSIONS[k]}"] - r[f"lo_{DIMENSIONS[k]}"]) / whole[DIMENSIONS[k]], -k))
        left = nodes[r["node"]]["leaves"] // 2
        want[r["node"]] = math.ceil(r["w"] * left / nodes[r["node"]]["leaves"])
    keyed = points.select("node", "w", _key(pick(axis)).alias("key"))
    low, shift = [0] * len(nodes), KEY
    while shift:
        bits = min(BITS, shift, max(1, BINS - (len(nodes) - 1).bit_length()))
        shift -= bits
        inside = F.shiftright(F.col("key"), shift + bits) == F.shiftright(pick([F.lit(x).cast("long") for x in low]), shift + bits)
        bins = keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("w").alias("w")).collect()
        by_node: dict[int, list] = {}
        for r in bins:
            by_node.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for node, found in by_node.items():
            for b, w in sorted(found):
                low[node] = b << shift
                if w >= want[node]:
                    break
                want[node] -= w
    return {n: (axis[n], low[n]) for n in range(len(nodes))}


def _key(axis: Column) -> Column:
    value = F.get(F.array(*DIMENSIONS), axis)
    return F.shiftleft(value.bitwiseAND(F.lit((1 << 31) - 1)), 31).bitwiseOR(F.col("tie"))


def points(meta: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, int]:
    """The tree's points (_g, _part, w, dimensions, tie), as a table; meta with each row's _part; the weight of all."""
    groups = meta.groupBy("_g").agg(F.sum("size").alias("w"), F.min_by(F.struct(*DIMENSIONS), F.struct("id", *DIMENSIONS)).alias("d")).select("_g", "w", "d.*")
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    limit = max(1.0, tolerance * total / shards)
    heavy = groups.where(F.col("w") > limit).select("_g", F.ceil(F.col("w") / limit).cast("int").alias("_parts"))
    heavy = small(materialize(heavy, "heavy"))  # at most shards / tolerance rows, whatever the input
    dealt = meta.join(heavy, "_g", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
    tie = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 33)
    light = groups.join(heavy, "_g", "left_anti").select("_g", F.lit(0).cast("long").alias("_part"), "w", *DIMENSIONS, tie("_g").alias("tie"))
    parted = (
        dealt.join(heavy.select("_g"), "_g", "left_semi").groupBy("_g", "_part").agg(F.sum("size").alias("w"))
        .join(groups.drop("w"), "_g").select("_g", "_part", "w", *DIMENSIONS, tie("_g", "_part").alias("tie"))
    )
    return materialize(light.unionByName(parted), "points"), dealt, total


def shard(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs' columns (without the text) with size, text_crc32, law, shard and slot. target_bytes: as many shards as that makes, instead of a given number."""
    meta = materialize(_meta(docs, text, doc_id), "sharding")
    if target_bytes:
        shards = max(1, math.ceil((meta.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    found, dealt, total = points(meta, shards, tolerance)
    spread = found.withColumn("node", F.lit(0))
    nodes = [{"leaves": shards, "first": 0}]
    while total and any(n["leaves"] > 1 for n in nodes):
        cuts = _cut(spread, nodes)
        after, left, right = [], [], []
        for i, n in enumerate(nodes):
            left.append(len(after))
            half = n["leaves"] // 2
            if half:
                after += [{"leaves": half, "first": n["first"]}, {"leaves": n["leaves"] - half, "first": n["first"] + half}]
            else:
                after.append(n)
                cuts[i] = (0, 1 << KEY)
            right.append(len(after) - 1)
        at = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("node"))
        axis, low = at([cuts[i][0] for i in range(len(nodes))]).cast("int"), at([cuts[i][1] for i in range(len(nodes))])
        spread = spread.withColumn("node", F.when(_key(axis) <= low, at(left)).otherwise(at(right)).cast("int"))
        nodes = after
    first = F.get(F.array(*(F.lit(n["first"]) for n in nodes)), F.col("node"))
    placed = dealt.join(spread.select("_g", "_part", first.alias("shard")), ["_g", "_part"])
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(4 * parts(docs.sparkSession))))
    placed = materialize(placed.drop("_g", "_part", *DIMENSIONS), "placed")
    drop_table(found, meta)
    counts = materialize(placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")), "counts")
    before = counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("id", "text_crc32"))).join(small(materialize(before, "before")), ["shard", "_bucket"])
    return ranked.select("row.*", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_before") + F.col("_row") - 1).alias("slot"))
