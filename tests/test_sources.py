import datetime
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import statistics as st
from quillon.plans.model import Params
from quillon.sources import tables
from quillon.streaming import accumulate


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a_1").write_text("1,2,3\n\n4,5,6\n")
    (tmp_path / "a_2").write_text("7,8,9\n")
    rows = tables.validate(tables.csv(spark, str(tmp_path), 3))
    assert sorted((r.y, r.shard) for r in rows.collect()) == [([1, 2, 3], "a_1"), ([4, 5, 6], "a_1"), ([7, 8, 9], "a_2")]
    lines = spark.read.text(str(tmp_path)).select("value", F.col("_metadata.file_name").alias("shard"))
    assert {r.shard: r.n for r in tables.nonblank_lines(lines, ["shard"]).collect()} == {"a_1": 2, "a_2": 1}
    (tmp_path / "a_3").write_text("1,,3\n")
    with pytest.raises(ValueError, match="1 rows"):
        tables.validate(tables.csv(spark, str(tmp_path), 3))


def test_one_column(spark, tmp_path):
    (tmp_path / "b").write_text("1.5\n2.5\n")
    assert sorted(r.y for r in tables.csv(spark, str(tmp_path), 1).collect()) == [[1.5], [2.5]]


def test_splits(spark, tmp_path):
    rows = tables.generate(spark, 40)
    counts = [r["count"] for r in tables.split_balanced(rows, "row_id", 4).groupBy("shard").count().collect()]
    assert counts == [10] * 4
    assert {r.shard for r in tables.split_random(rows, "row_id", 3, 1).collect()} <= {0, 1, 2}
    tables.write_shards(tables.split_balanced(rows, "row_id", 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.y for r in back.collect()) == sorted(r.y for r in rows.collect())
    assert "PartitionFilters: [isnotnull(shard" in back.where("shard = 1")._jdf.queryExecution().toString()


def test_scalars(spark):
    frame = spark.createDataFrame([(x,) for x in (-50.0, -1.0, 0.5, 50.0)], "x double")
    v = [r[0] for r in frame.select(S.softplus(F.col("x"), strict=False)).collect()]
    assert v == pytest.approx([np.exp(-50), np.log1p(np.exp(-1)), np.log1p(np.exp(0.5)), 50.0])
    g = [r[0] for r in frame.select(S.softplus_gradient(F.col("x"), strict=False)).collect()]
    assert g == pytest.approx([np.exp(-50), 1 / (1 + np.e), 1 / (1 + np.exp(-0.5)), 1.0])
    inside = frame.where("abs(x) < 1")
    assert [r[0] for r in inside.select(S.softplus_inverse(S.softplus(F.col("x")))).collect()] == pytest.approx([0.5])
    with pytest.raises(Exception, match="outside"):
        frame.select(S.softplus(F.col("x"))).collect()


def test_softplus_inverse_limits(spark):
    """Strict: an error at 0. Else the limit at 0, NaN below, and null only of null."""
    frame = spark.createDataFrame([(x,) for x in (0.0, -1.0, 1e-20, 50.0, None)], "x double").coalesce(1)
    zero, below, tiny, large, none = (r[0] for r in frame.select(S.softplus_inverse(F.col("x"), strict=False)).collect())
    assert zero == -np.inf and np.isnan(below) and tiny == pytest.approx(np.log(1e-20)) and large == 50.0 and none is None
    with pytest.raises(Exception, match="outside"):
        frame.where("x = 0").select(S.softplus_inverse(F.col("x"))).collect()


def test_rounded(spark):
    """Halves, zeros of either sign, large numbers and those that aren't finite, against DuckDB's round()."""
    values = [0.0, 5e-07, -5e-07, -4e-07, 4.9999999999999994e-07, 1.0000005, -2.5, 123.4567895, 1e15, 1e300, np.inf, -np.inf, np.nan, None]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, x double").coalesce(1)
    got = [repr(r[0]) for r in frame.orderBy("i").select(S.rounded(F.col("x"), 6)).collect()]
    assert got == [repr(duckdb.execute("select round(?::double, 6)", [x]).fetchone()[0]) for x in values]


def test_stream(spark, tmp_path):
    p = Params(np.array([[-0.5], [0.5]]), 1.0, np.ones(1), 1.0)
    rows = tables.generate(spark, 60).select("y", F.array(F.get("y", F.lit(0))).alias("mu"), F.array(F.lit(0.3)).alias("s"))
    for k in range(3):
        rows.where(F.pmod(F.hash("y"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.follow(stream, p, 3, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = st.from_long(accumulate.total(spark, str(tmp_path / "out")), p, 3)
    want = st.accumulate(spark.read.parquet(str(tmp_path / "in")), p, 3, False)
    assert got.n == want.n == 60 and got.psi2 == pytest.approx(want.psi2) and got.psi1y == pytest.approx(want.psi1y)


def test_windows_of_a_stream(spark, tmp_path):
    """Rows later than the watermark are left out, others are counted in their window."""
    def events(name, rows):
        spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), v) for h, m, v in rows], "ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    events("e", [(1, 5, 1.0), (1, 50, 2.0), (2, 10, 4.0)])
    time.sleep(1.1)  # files are taken in the order of their times
    events("e", [(9, 0, 8.0)])
    time.sleep(1.1)
    events("e", [(9, 10, 1.0)])  # a batch's watermark holds for what is late in the next one but one
    time.sleep(1.1)
    events("e", [(1, 30, 100.0), (8, 30, 16.0), (23, 0, 0.0)])
    source = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    sums = accumulate.windowed(source, "ts", "value", "1 hour", "2 hours").select(F.hour("window.start").alias("hour"), "n", "total", "squares")
    sums.writeStream.format("parquet").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.hour: (r.n, r.total, r.squares) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got == {1: (2, 3.0, 5.0), 2: (1, 4.0, 16.0), 8: (1, 16.0, 256.0), 9: (2, 9.0, 65.0)}
