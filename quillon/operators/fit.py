"""Fitting, saving, and embedding of new rows."""

from __future__ import annotations

import random as _random
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import axpy, softplus
from quillon.operators import initialise, latents, optimise
from quillon.operators.bound import Algebra
from quillon.operators.statistics import _flat, _stats, accumulate, block
from quillon.plans.model import FitConfig, Params, Stats, softplus_slope
from quillon.plans.model import softplus as np_softplus
from quillon.sources import tables


@dataclass
class Evaluation:
    """What one evaluation of the objective had: kept at choice."""

    raw: np.ndarray  # unconstrained globals
    bound: float
    stats: Stats
    by_kmm: np.ndarray
    by_psi1y: np.ndarray
    by_psi2: np.ndarray
    kmm: np.ndarray
    jitter: float

    def cells(self) -> dict[str, list[float]]:
        return {
            "raw": self.raw.tolist(), "bound": [self.bound], "stats": _flat(self.stats).tolist(), "by_kmm": self.by_kmm.ravel().tolist(),
            "by_psi1y": self.by_psi1y.ravel().tolist(), "by_psi2": self.by_psi2.ravel().tolist(), "kmm": self.kmm.ravel().tolist(), "jitter": [self.jitter],
        }


@dataclass
class Fitted:
    params: Params
    stats: Stats
    rows: DataFrame  # row_id, y, mu, s
    trace: optimise.Trace
    config: FitConfig
    history: list[Evaluation] | None = None  # of each evaluation, if kept

    def ard_ranking(self, spark) -> DataFrame:
        """Latent dimensions by relevance."""
        return spark.createDataFrame([(q, float(a)) for q, a in enumerate(self.params.alpha)], "q int, alpha double").orderBy(F.desc("alpha"), "q")

    def save(self, path: str) -> None:
        """Write the model; the folder may be the one that it was loaded from."""
        spark = self.rows.sparkSession
        rows = tables.written(self.rows)  # what is read may be what is overwritten
        tables.save_params(spark, self.params, f"{path}/params", d=self.stats.d, stats=_flat(self.stats).tolist())
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        tables.discard(rows)
        self.trace.frame(spark).write.mode("overwrite").parquet(f"{path}/metrics")
        if self.history:
            cells = [(k, name, v) for k, e in enumerate(self.history) for name, v in e.cells().items()]
            spark.createDataFrame(cells, "evaluation int, name string, values array<double>").write.mode("overwrite").parquet(f"{path}/history")


def load(spark, path: str, config: FitConfig = FitConfig()) -> Fitted:
    p, more = tables.load_params(spark, f"{path}/params")
    metrics = optimise.Trace([tuple(r) for r in spark.read.parquet(f"{path}/metrics").collect()])
    stats = _stats(np.array(more["stats"]), p, more["d"], len(more["stats"]) > 4 + p.m * p.m + p.m * more["d"])
    return Fitted(p, stats, spark.read.parquet(f"{path}/rows"), metrics, config)


def keep_shards(shards: list, drop_out: float, seed: int) -> list:
    """Each with probability 1 - drop_out; one at random if none would stay."""
    draw = _random.Random(seed)
    return [s for s in shards if draw.random() >= drop_out] or [draw.choice(shards)]


def dropped(rows: DataFrame, shards: list, drop_out: float, seed: int) -> tuple[DataFrame, float]:
    """Rows of the shards that stay, and what to divide their sums by."""
    kept = keep_shards(shards, drop_out, seed)
    return rows.where(F.col("shard").isin(kept)), len(kept) / len(shards)


def width(rows: DataFrame) -> int:
    """Numbers of a row's y."""
    first = rows.select(F.size("y").alias("d")).first()
    if first is None:
        raise ValueError("no rows")
    if first["d"] is None or first["d"] < 1:
        raise ValueError("rows with missing values")
    return first["d"]


def bound(rows: DataFrame, p: Params, kl: bool = False) -> float:
    """The bound of rows (y, mu, s) under given parameters. No rows, or missing values, are an error."""
    return Algebra.of(p, accumulate(rows, p, width(rows), False, kl)).bound()


def initial(rows: DataFrame, config: FitConfig, d: int) -> DataFrame:
    """rows with mu and s, unless given."""
    if "mu" not in rows.columns:
        if config.fixed_embeddings:
            raise ValueError("fixed embeddings need a column mu")
        kinds = {"pca": lambda: initialise.pca(rows, d, config.latent), "ppca": lambda: initialise.ppca(rows, d, config.latent), "fa": lambda: initialise.fa(rows, d, config.latent, config.seed), "random": lambda: initialise.random(rows, config.latent, config.seed)}
        rows = kinds[config.init]()
    return rows if "s" in rows.columns else initialise.variances(rows, config.latent, config.seed + 100, config.fixed_embeddings)


def _unconstrained(rows: DataFrame, key: str, *more: str) -> optimise.Latents:
    """The optimiser's state of rows with mu and s."""
    raw = F.transform("s", lambda v: F.log(F.expm1(v)))
    return optimise.Latents(tables.written(rows.select(key, "y", *more, F.concat("mu", raw).alias("x"))))


def _at(state: optimise.Latents, step: float, q: int) -> DataFrame:
    """The state with mu and s at x + step * d, and _x, that point."""
    x = axpy(F.col("x"), float(step), F.col("d")) if step and "d" in state.table.columns else F.col("x")
    moved = state.table.withColumn("_x", x)
    return moved.withColumn("mu", F.slice("_x", 1, q)).withColumn("s", F.transform(F.slice("_x", q + 1, q), lambda v: softplus(v, strict=False)))


def _descend(state: optimise.Latents, now: DataFrame, a: Algebra) -> None:
    """Set g_latest of the state to minus the gradient at now: one map over the rows, which carries their state along."""
    q = a.p.q
    slope = F.transform(F.slice("_x", q + 1, q), lambda v: 1 / (1 + F.exp(-v)))
    new = latents.gradients(now, a).withColumn("g_latest", F.transform(F.concat("grad_mu", F.zip_with("grad_s", slope, lambda g, w: g * w)), lambda v: -v))
    state.replace(new.select(*dict.fromkeys([*state.table.columns, "g_latest"])))


def fit(rows: DataFrame, config: FitConfig = FitConfig(), start: Params | None = None) -> Fitted:
    """rows: row_id, y, perhaps mu, s and shard. Maximises the bound over globals and, unless fixed, the latents.

    A dropped shard's latents are still updated; only the sums leave it out. Rows may share an id. No rows, missing values and
    rows of several widths are errors.
    """
    d = width(rows)
    q, free = config.latent, not config.fixed_embeddings
    base = tables.written(initial(rows, config, d))
    p = start or Params(initialise.inducing(base, config.inducing, config.seed, choice=config.inducing_choice), 1.0, np.ones(q), 1.0)
    m = p.m
    shards = sorted(r[0] for r in base.select("shard").distinct().collect()) if config.drop_out else []
    state, calls, history = _unconstrained(base, "row_id", *["shard"] * bool(shards)) if free else None, [0], []

    def objective(x: np.ndarray, local: optimise.Latents | None, step: float) -> tuple[float, np.ndarray]:
        p = Params.from_raw(x, m, q)
        now = _at(state, step, q) if free else base
        share, use = 1.0, now
        if shards:
            use, share = dropped(now, shards, config.drop_out, config.seed + calls[0])
            calls[0] += 1
        a = Algebra.of(p, accumulate(use, p, d, True, free).scaled(1 / share))
        if config.keep_history:
            history.append(Evaluation(x.copy(), a.bound(), a.s, a.by_kmm(), a.by_psi1y(), a.by_psi2(), a.kmm, a.jitter))
        if free:
            _descend(local, now, a)
        chain = np.concatenate([np.ones(m * q), softplus_slope(x[m * q :])])
        return -a.bound(), -a.gradient(config.fixed_beta) * chain

    run = {"scg": optimise.scg, "gd": optimise.gd}[config.optimiser]
    tol = {f"{k}tol": v for k, v in config.tolerances.items()}
    more = {"max_evaluations": config.max_evaluations, "reset_local": config.reset_local} if config.optimiser == "scg" else {}
    trace = run(objective, p.raw(), state, iterations=config.iterations, report=config.report, **tol, **more)
    p = Params.from_raw(trace.x, m, q)
    rows = tables.written(_at(state, 0.0, q).select("row_id", "y", "mu", "s")) if free else base.select("row_id", "y", "mu", "s")
    if free:
        tables.discard(base, state.table)
    return Fitted(p, accumulate(rows, p, d, True, free), rows, trace, config, history)


def sequential(y: np.ndarray, mu: np.ndarray, s: np.ndarray, start: Params) -> tuple[optimise.Objective, np.ndarray]:
    """The objective of few rows in memory, whose latents are numbers of the one vector as the globals are, and where it starts."""
    m, q, n = start.m, start.q, len(y)
    k = m * q + 2 + q

    def objective(x: np.ndarray, _: None, __: float) -> tuple[float, np.ndarray]:
        p, mu, raw = Params.from_raw(x[:k], m, q), x[k : k + n * q].reshape(n, q), x[k + n * q :].reshape(n, q)
        s = np_softplus(raw)
        a = Algebra.of(p, block(y, mu, s, p, True, True))
        g_mu, g_s = latents.row_gradients(y, mu, s, p, a.by_psi1y(), a.by_psi2())
        chain = np.concatenate([np.ones(m * q), softplus_slope(x[m * q : k])])
        return -a.bound(), -np.concatenate([a.gradient() * chain, g_mu.ravel(), (g_s * softplus_slope(raw)).ravel()])

    return objective, np.concatenate([start.raw(), mu.ravel(), np.log(np.expm1(s)).ravel()])


def _embed(y: np.ndarray, mu: np.ndarray, s: np.ndarray, model_p: Params, stats: Stats, iterations: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Latents of the rows of y that maximise the bound of training and test rows together; N stays that of training."""
    n, q = mu.shape

    def objective(x: np.ndarray, _: None, __: float) -> tuple[float, np.ndarray]:
        mu, raw = x[: n * q].reshape(n, q), x[n * q :].reshape(n, q)
        s = np_softplus(raw)
        own = block(y, mu, s, model_p, False, True)
        both = replace(stats, yy=stats.yy + own.yy, psi0=stats.psi0 + own.psi0, psi2=stats.psi2 + own.psi2, psi1y=stats.psi1y + own.psi1y, kl=stats.kl + own.kl)
        a = Algebra.of(model_p, both)
        g_mu, g_s = latents.row_gradients(y, mu, s, model_p, a.by_psi1y(), a.by_psi2())
        return -a.bound(), -np.concatenate([g_mu.ravel(), (g_s * softplus_slope(raw)).ravel()])

    t = optimise.scg(objective, np.concatenate([mu.ravel(), np.log(np.expm1(s)).ravel()]), iterations=iterations)
    return t.x[: n * q].reshape(n, q), np_softplus(t.x[n * q :]).reshape(n, q), -t.f


_EMBEDDED = "test_id long, mu array<double>, s array<double>, bound double, restart int"


def embed(model: Fitted, test: DataFrame, iterations: int = 50, restarts: int = 0, mask: list[int] | None = None, bound: float = 6.0, random_init: bool = False) -> DataFrame:
    """test_id, mu, s, bound, restart: each test row's latents, each row on its own beside the training rows.

    Starts at the latents of the nearest training row (mask: by these outputs only), or at 0 if none is within the bound; with
    random_init, at a random inducing point; further starts are random inducing points. The best is kept.
    """
    p, stats = model.params, model.stats
    start = test.select("test_id", F.col("y").cast("array<double>").alias("y"))
    if random_init:
        start = start.withColumn("first", F.lit(None).cast("array<double>"))
    else:
        near = initialise.nearest(test, model.rows, bound, mask).join(model.rows.select("row_id", F.col("mu").alias("first")), "row_id")
        start = start.join(near.groupBy("test_id").agg(F.min("first").alias("first")), "test_id", "left")
    tries = start.select("*", F.explode(F.sequence(F.lit(0), F.lit(restarts))).alias("restart"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                draw = np.random.default_rng([int(r.test_id), int(r.restart)])
                mu = p.z[draw.integers(p.m)] if r.restart or random_init else np.zeros(p.q) if r.first is None else np.asarray(r.first)
                mu, s, value = _embed(np.asarray(r.y, float)[None], np.array(mu, float)[None], np.clip(0.5 + 0.01 * draw.standard_normal((1, p.q)), 0.001, 1), p, stats, iterations)
                out.append((r.test_id, mu[0], s[0], value, r.restart))
            yield pd.DataFrame(out, columns=["test_id", "mu", "s", "bound", "restart"])

    found = tries.mapInPandas(run, _EMBEDDED)
    return found.groupBy("test_id").agg(F.max_by(F.struct("mu", "s", "bound", "restart"), F.struct("bound", -F.col("restart"))).alias("b")).select("test_id", "b.*")


def embed_jointly(model: Fitted, test: DataFrame, iterations: int = 50) -> tuple[DataFrame, float]:
    """test_id, mu, s of all test rows, optimised together beside the training rows, and the joint bound; N stays that of training.

    The rows are the optimiser's distributed state, as in fit(): the driver sees sums only. No rows: an empty table, and the model's own bound.
    """
    p, stats, q = model.params, model.stats, model.params.q
    near = initialise.nearest(test, model.rows).join(model.rows.select("row_id", F.col("mu").alias("first")), "row_id").groupBy("test_id").agg(F.min("first").alias("first"))
    rows = test.select("test_id", F.col("y").cast("array<double>").alias("y")).join(near, "test_id", "left")
    rows = rows.select("test_id", "y", F.coalesce("first", F.array_repeat(F.lit(0.0), q)).alias("mu"), F.array_repeat(F.lit(0.5), q).alias("s"))
    state = _unconstrained(rows, "test_id")

    def objective(x: np.ndarray, local: optimise.Latents, step: float) -> tuple[float, np.ndarray]:
        now = _at(local, step, q)
        own = accumulate(now, p, stats.d, False, True)
        a = Algebra.of(p, replace(stats, yy=stats.yy + own.yy, psi0=stats.psi0 + own.psi0, psi2=stats.psi2 + own.psi2, psi1y=stats.psi1y + own.psi1y, kl=stats.kl + own.kl))
        _descend(local, now, a)
        return -a.bound(), np.zeros(0)

    trace = optimise.scg(objective, np.zeros(0), state, iterations=iterations)
    return _at(state, 0.0, q).select("test_id", "mu", "s"), -trace.f
