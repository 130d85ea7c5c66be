"""First values of latents and inducing points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalar import centred, dot, doubles, masked, scrambled
from quillon.operators.statistics import matrix
from quillon.sources.tables import written


def moments(rows: DataFrame, d: int, y: str = "y") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (over the count) of the first d outputs, in one scan.

    Each task sums its blocks' products, taken from the first row so that no digits are lost; executors add them up.
    """
    rows = rows.select(F.slice(F.col(y).cast("array<double>"), 1, d).alias("y"))
    head = rows.first()
    shift = np.array(head["y"], float) if head else np.zeros(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            away = matrix(batch.column(0), d) - shift
            n, first, second = n + len(away), first + away.sum(0), second + away.T @ away
        flat = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(1 + d + d * d)
    sums[found["at"].to_numpy()] = found["v"].to_numpy()
    n, first, second = int(sums[0]), sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
    away = first / max(1, n)
    return n, shift + away, second / max(1, n) - np.outer(away, away)


def _signed(w: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    return w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])


def project(rows: DataFrame, mean: np.ndarray, w: np.ndarray, out: str, y: str = "y") -> DataFrame:
    """rows with out = (y - mean) w, over its own population deviation over all rows."""
    away = centred(F.col(y).cast("array<double>"), F.array(*map(F.lit, mean.tolist())))
    raw = rows.withColumn("_c", away).withColumn(out, F.array(*(dot(F.col("_c"), F.array(*map(F.lit, col.tolist()))) for col in w.T))).drop("_c")
    scale = raw.agg(*(F.stddev_pop(F.get(out, F.lit(i))).alias(f"s{i}") for i in range(w.shape[1]))).first()
    return raw.withColumn(out, F.array(*(F.get(out, F.lit(i)) / (scale[f"s{i}"] or 1.0) for i in range(w.shape[1]))))


def pca(rows: DataFrame, d: int, q: int, out: str = "mu") -> DataFrame:
    """Whitened scores on the leading axes."""
    _, mean, cov = moments(rows, d)
    return project(rows, mean, _signed(np.linalg.eigh(cov)[1][:, ::-1][:, :q]), out)


def ppca_weights(cov: np.ndarray, q: int) -> tuple[np.ndarray, float]:
    """Loadings and noise of probabilistic PCA at the likelihood's maximum: the leading axes, scaled by what their variances have over the noise, the mean of the rest."""
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], _signed(axes[:, ::-1])
    noise = max(float(values[q:].mean()) if len(values) > q else 0.0, 1e-12)
    return axes[:, :q] * np.sqrt(np.maximum(values[:q] - noise, 0.0)), noise


def fa_weights(cov: np.ndarray, q: int, seed: int = 0, tol: float = 1e-6, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and noises of factor analysis; its moments depend on the covariance alone."""
    d = len(cov)
    w, psi, last = np.random.default_rng(seed).standard_normal((d, q)), np.maximum(np.diag(cov), 1e-9).copy(), np.inf
    for _ in range(most):
        beta = w.T @ np.linalg.inv(w @ w.T + np.diag(psi))
        second = np.eye(q) - beta @ w + beta @ cov @ beta.T
        w = cov @ beta.T @ np.linalg.inv(second)
        psi = np.maximum(np.diag(cov - w @ beta @ cov), 1e-9)
        c = w @ w.T + np.diag(psi)
        value = np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, cov))
        if abs(last - value) < tol:
            break
        last = value
    return w, psi


def ppca(rows: DataFrame, d: int, q: int, out: str = "mu") -> DataFrame:
    _, mean, cov = moments(rows, d)
    w, noise = ppca_weights(cov, q)
    return project(rows, mean, w @ np.linalg.inv(w.T @ w + noise * np.eye(q)), out)


def fa(rows: DataFrame, d: int, q: int, seed: int = 0, out: str = "mu") -> DataFrame:
    _, mean, cov = moments(rows, d)
    w, psi = fa_weights(cov, q, seed)
    return project(rows, mean, np.linalg.inv(w @ w.T + np.diag(psi)) @ w, out)


def random(rows: DataFrame, q: int, seed: int = 0, out: str = "mu") -> DataFrame:
    return rows.withColumn(out, F.array(*(F.randn(seed + i) for i in range(q))))


def variances(rows: DataFrame, q: int, seed: int, fixed: bool, out: str = "s") -> DataFrame:
    """Half, with a little noise, within [0.001, 1]; zeros if the latents are fixed."""
    cells = [F.lit(0.0) if fixed else F.least(F.greatest(0.5 + 0.01 * F.randn(seed + i), F.lit(0.001)), F.lit(1.0)) for i in range(q)]
    return rows.withColumn(out, F.array(*cells))


def inducing_prefix(rows: DataFrame, m: int, key: str = "row_id", x: str = "mu") -> DataFrame:
    return rows.orderBy(key).limit(m).select(key, x)


def inducing(rows: DataFrame, m: int, seed: int = 0, noise: float = 0.05, key: str = "row_id", x: str = "mu", choice: str = "kmeans") -> np.ndarray:
    """k-means centres of the latents, or m random rows of them; filled up with the first rows where there are fewer, with a little noise."""
    if choice == "random":
        z = np.array([r[x] for r in random_rows(rows, m, seed, key).select(x).collect()])
    else:
        fitted = KMeans(k=max(2, m), seed=seed, featuresCol="_v", maxIter=30).fit(rows.select(array_to_vector(x).alias("_v")))
        z = np.array([c for c in fitted.clusterCenters()])[:m]
    if len(z) < m:
        z = np.vstack([z, *([r[x]] for r in inducing_prefix(rows, m - len(z), key, x).collect())])
    return z + noise * np.random.default_rng(seed).standard_normal(z.shape)


def random_rows(rows: DataFrame, m: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """m rows, chosen by a hash of their key and the seed: the same ones however the rows are spread."""
    return rows.orderBy(scrambled(F.col(key), seed), key).limit(m)


#: Test rows that a task of nearest() holds, and training rows that it reads past them, about.
HELD, READ = 1024, 50_000


def nearest(test: DataFrame, train: DataFrame, bound: float = 6.0, mask: list[int] | None = None, others: bool = False) -> DataFrame:
    """test_id, row_id, distance: the nearest training row within the bound (others: of another id); ties go to the least row_id.

    Rows lie in cells as wide as the bound, by their first two outputs: only rows of neighbouring cells can be near enough. Test
    rows are dealt over blocks; a task holds one block's test rows of a cell and reads a share of its training rows past them. It keeps
    the nearest for each, and these are compared over tasks. Missing values are an error.
    """
    cut = (lambda c: masked(doubles(F.col(c)), mask)) if mask else (lambda c: doubles(F.col(c)))
    asked = test.select(F.col("test_id").alias("id"), cut("y").alias("y"))
    n = asked.agg(F.count("*").alias("n"), F.max(F.size("y")).alias("d")).first()
    d, blocks, shares = n["d"] or 1, max(1, -(-n["n"] // HELD)), max(1, -(-train.count() // READ))
    kind, row_kind = test.schema["test_id"].dataType, train.schema["row_id"].dataType
    cell = lambda k, by=0: (F.floor(F.coalesce(F.get("y", F.lit(k)), F.lit(0.0)) / bound) + by).cast("long")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    around = F.explode(F.array(*(F.struct(cell(0, i).alias("c0"), cell(1, j).alias("c1")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    asked = written(asked.select("id", "y", block, around.alias("c")).select("c.*", "block", "id", "y"), "asked")
    wanted = written(asked.select("c0", "c1", "block").distinct(), "wanted")
    read = train.select(F.col("row_id").alias("id"), cut("y").alias("y"))
    read = read.select(cell(0).alias("c0"), cell(1).alias("c1"), "id", "y", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"))
    read = read.join(wanted, ["c0", "c1"])  # as many rows as there are blocks with test rows near
    keys = ["c0", "c1", "block", "share"]
    both = asked.select("c0", "c1", "block", upto(shares).alias("share"), F.lit(0).alias("role"), F.col("id").alias("test"), F.lit(None).cast(row_kind).alias("row"), "y")
    both = both.unionByName(read.select(*keys, F.lit(1).alias("role"), F.lit(None).cast(kind).alias("test"), F.col("id").alias("row"), "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}
        best: dict = {}
        now = None

        def out() -> pa.RecordBatch:
            ids = list(best)
            return pa.RecordBatch.from_arrays([pa.array(ids, test_type), pa.array([best[i][0] for i in ids], pa.float64()), pa.array([best[i][1] for i in ids], row_type)], names=["test_id", "distance", "row_id"])

        for batch in batches:
            test_type, row_type = batch.schema.field("test").type, batch.schema.field("row").type
            y = matrix(batch.column(batch.schema.names.index("y")), d)
            key = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            role, t, r = (batch.column(c).to_pylist() for c in ("role", "test", "row"))
            at = 0
            while at < len(key):
                end = at + 1
                while end < len(key) and key[end] == key[at] and role[end] == role[at]:
                    end += 1
                if key[at] != now:
                    if best:
                        yield out()
                    now, held, best = key[at], ([], []), {}
                if role[at] == 0:
                    held[0].extend(t[at:end])
                    held[1].extend(y[at:end])
                else:
                    ids = np.empty(end - at, object)
                    ids[:] = r[at:end]
                    for i, point in zip(*held, strict=True):
                        gap = y[at:end] - point
                        distance = np.sqrt((gap * gap).sum(axis=1))
                        ok = distance < bound
                        if others:
                            ok &= ids != i
                        if ok.any():
                            low = distance[ok].min()
                            found = (float(low), min(ids[ok & (distance == low)]))
                            best[i] = min(best.get(i, found), found)
                at = end
        if best:
            yield out()

    schema = T.StructType([T.StructField("test_id", kind), T.StructField("distance", T.DoubleType()), T.StructField("row_id", row_kind)])
    parted = both.repartition(*keys).sortWithinPartitions(*keys, "role")
    found = parted.mapInArrow(run, schema)
    return found.groupBy("test_id").agg(F.min(F.struct("distance", "row_id")).alias("b")).select("test_id", "b.row_id", "b.distance")
