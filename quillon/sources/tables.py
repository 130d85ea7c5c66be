"""Reading observations, splitting them into shards, and tables that cut the lineage of an iteration."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalar import scrambled
from quillon.plans.model import Params


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Where it is unset, a local one, if driver and executors are one process; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str = "state") -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs a reread only, and plans stay short."""
    path = f"{shared_dir(df.sparkSession)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more, folders and all."""
    for df in frames:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("quillon-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Headerless numeric files of a folder: y as an array, shard from the file's name. Blank lines are none; blank fields fail in validate()."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(width)])
    rows = spark.read.schema(schema).csv(path, mode="PERMISSIVE").select("*", F.col("_metadata.file_name").alias("shard"))
    return rows.select(F.array(*(f"c{i}" for i in range(width))).alias("y"), "shard")


def validate(rows: DataFrame, y: str = "y") -> DataFrame:
    """rows, if no value is missing or NaN and all have the same width; else an error that counts the bad ones."""
    bad = F.col(y).isNull() | F.exists(y, lambda v: v.isNull() | F.isnan(v))
    found = rows.agg(F.sum(bad.cast("long")).alias("bad"), F.count_distinct(F.size(y)).alias("widths")).first()
    if found["bad"] or found["widths"] > 1:
        raise ValueError(f"{found['bad']} rows with missing values, {found['widths']} widths")
    return rows


def nonblank_lines(lines: DataFrame, by: list[str], line: str = "value") -> DataFrame:
    """Lines with more than white space, counted."""
    return lines.where(F.trim(F.regexp_replace(line, r"[\t\r\n\x0b\x0c]", " ")) != "").groupBy(*by).agg(F.count("*").alias("n"))


def split_balanced(rows: DataFrame, key: str, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))


def split_random(rows: DataFrame, key: str, shards: int, seed: int) -> DataFrame:
    """A shard for each row, chosen by a hash of its key: the same one however often, and wherever, it is computed."""
    return rows.withColumn("shard", (scrambled(F.col(key), seed) % shards).cast("int"))


def split_latents(latents: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Given latents (key, mu and perhaps s) with the shard that their rows are in: by key, never by position. Rows without latents are left out."""
    return latents.drop("shard").join(rows.select(key, "shard"), key)


def write_shards(rows: DataFrame, path: str) -> None:
    """Parquet, a folder a shard: later filters by shard read only what they keep. Doubles stay exact."""
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def union(shards: Iterable[DataFrame]) -> DataFrame:
    first, *rest = shards
    for other in rest:
        first = first.unionByName(other)
    return first


def generate(spark: SparkSession, n: int, outputs: int = 3, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Smooth curves of one hidden input: a slope of 1.03 and half a sine of twice the input, plus noise."""
    x = spark.range(n).select(F.col("id").alias("row_id"), (F.randn(seed)).alias("x"))
    y = [1.03 * F.col("x") + 0.5 * F.sin(2 * F.col("x") + 2.1 * i) + noise * F.randn(seed + 1 + i) for i in range(outputs)]
    return x.select("row_id", F.array(*y).alias("y"))


def save_params(spark: SparkSession, p: Params, path: str, **more) -> None:
    """One small JSON row; through Spark, so the path may be in any store."""
    row = json.dumps({"z": p.z.tolist(), "sf2": p.sf2, "alpha": p.alpha.tolist(), "beta": p.beta, **more})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> tuple[Params, dict]:
    row = json.loads(spark.read.text(path).first()[0])
    return Params(np.array(row.pop("z")), row.pop("sf2"), np.array(row.pop("alpha")), row.pop("beta")), row
