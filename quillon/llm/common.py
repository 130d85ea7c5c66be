"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import discard as drop_table
from quillon.sources.tables import written as materialize

__all__ = ["ascii_lower", "drop_table", "let", "materialize", "n_bytes", "parts", "small", "table", "unused"]

#: ASCII white space, the word separator of most operators here.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    A lambda's body that names a computed column may have that computation inlined by the
    optimizer and repeated per element; a lambda variable can't be.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 24 << 20


def n_bytes(df: DataFrame) -> int:
    """Bytes of all rows, about as they lie in memory."""
    width = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind == "array<string>":
            width += F.coalesce(F.octet_length(F.concat_ws("", c)) + 16 * F.size(c), F.lit(0)) + 16
        elif kind.startswith("array"):
            width += F.coalesce(24 * F.size(c), F.lit(0)) + 16
        else:
            width += 32 if kind.startswith("struct") else 8
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows have at most that many bytes; else left to a shuffled join, which gives the same rows. Give it a table: it is read for its size."""
    return F.broadcast(df) if n_bytes(df) <= most else df
