"""Sufficient statistics of observations: sums over rows.

Two forms. The column form is one aggregation of unrolled expressions, for few inducing points. The block form
computes Arrow batches with numpy and sums one row a task, for any number; rows are taken in
chunks so that what they have with pairs of inducing points stays small. Both give the same sums.

Rows: y, mu, s as array<double>. With free latents s is the variance itself, already positive. No rows give sums of 0; a
missing array or number, or another width, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.kernels import psi1, psi2
from quillon.functions.scalar import dot
from quillon.plans.model import Params, Stats

#: Doubles of one chunk's largest matrix.
TENSOR = 1 << 20


def kl_row(mu: Column, s: Column, q: int) -> Column:
    logs = F.aggregate(F.transform(s, lambda v: v - F.log(v)), F.lit(0.0), lambda a, v: a + v)
    return 0.5 * (logs + dot(mu, mu) - float(q))


def terms(p: Params, d: int, gradients: bool = False, kl: bool = False, y: str = "y", mu: str = "mu", s: str = "s") -> dict[tuple, Column]:
    """Expressions of a row to be summed, by (statistic, i, j, k)."""
    ys = [F.get(y, F.lit(i)) for i in range(d)]
    x = [F.get(mu, F.lit(i)) for i in range(p.q)]
    v = [F.get(s, F.lit(i)) for i in range(p.q)]
    out: dict[tuple, Column] = {("n", 0, 0, 0): F.lit(1.0), ("yy", 0, 0, 0): dot(F.col(y), F.col(y))}
    one = [psi1(m, x, v, p) for m in range(p.m)]
    two = {(m, k): psi2(m, k, x, v, p) for m in range(p.m) for k in range(m, p.m)}
    for m in range(p.m):
        for i in range(d):
            out["psi1y", m, i, 0] = one[m] * ys[i]
        for k in range(m, p.m):
            out["psi2", m, k, 0] = two[m, k]
    if kl:
        out["kl", 0, 0, 0] = kl_row(F.col(mu), F.col(s), p.q)
    if gradients:
        for q in range(p.q):
            a = float(p.alpha[q])
            den1, den2 = a * v[q] + 1.0, 2.0 * a * v[q] + 1.0
            for m in range(p.m):
                gap = (x[q] - float(p.z[m, q])) / den1
                for i in range(d):
                    out["psi1y_dz", m, q, i] = a * one[m] * gap * ys[i]
                    out["psi1y_dalpha", q, m, i] = -0.5 * one[m] * (gap * gap + v[q] / den1) * ys[i]
                for k in range(p.m):
                    pair, apart = two[min(m, k), max(m, k)], float(p.z[m, q] - p.z[k, q])
                    mid = (2.0 * x[q] - float(p.z[m, q] + p.z[k, q])) / den2
                    out["psi2_dz", m, q, k] = pair * (0.5 * a * (mid - apart))
                    out["psi2_dalpha", q, m, k] = -pair * (0.25 * apart * apart + 0.25 * mid * mid + v[q] / den2)
    return out


def long_form(rows: DataFrame, p: Params, d: int, by: list[str] | None = None, **kind) -> DataFrame:
    """stat, i, j, k, v (after the grouping columns): one aggregation, then one small row a group unfolds."""
    own = terms(p, d, **kind)
    sums = rows.groupBy(*(by or [])).agg(*(F.sum(e).alias(f"_{n}") for n, e in enumerate(own.values())))
    cells = [F.struct(F.lit(s).alias("stat"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.col(f"_{n}").alias("v")) for n, (s, i, j, k) in enumerate(own)]
    cells += [F.struct(F.lit(s).alias("stat"), F.lit(j).alias("i"), F.lit(i).alias("j"), F.lit(k).alias("k"), F.col(f"_{n}").alias("v")) for n, (s, i, j, k) in enumerate(own) if s == "psi2" and i != j]
    return sums.select(*(by or []), F.explode(F.array(*cells)).alias("c")).select(*(by or []), "c.*")


def merge(shares: DataFrame, kept: float = 1.0) -> DataFrame:
    """The shards' sums together, divided by the kept share of shards."""
    return shares.groupBy("stat", "i", "j", "k").agg((F.sum("v") / kept).alias("v"))


@dataclass(frozen=True)
class Expected:
    """Kernel expectations of a chunk of rows: `one` by inducing point, `two` by pair of them (i <= j)."""

    den1: np.ndarray
    den2: np.ndarray
    one: np.ndarray
    two: np.ndarray
    i: np.ndarray
    j: np.ndarray
    mid: np.ndarray  # the pairs' midpoints

    @classmethod
    def of(cls, mu: np.ndarray, s: np.ndarray, p: Params) -> Expected:
        """All products of rows and points are products of matrices."""
        if mu.shape != s.shape or mu.shape[1:] != (p.q,):
            raise ValueError(f"means and variances of {p.q} numbers a row are needed")
        if (s < 0).any():
            raise ValueError("negative variances")
        i, j = np.triu_indices(p.m)
        mid, apart = (p.z[i] + p.z[j]) / 2, p.z[i] - p.z[j]
        den1, den2 = p.alpha * s + 1, 2 * p.alpha * s + 1

        def gaps(weight: np.ndarray, points: np.ndarray) -> np.ndarray:
            """Sum over dimensions of weight * (mu - point)**2; taken from the points' mean, so that no digits are lost."""
            centre = points.mean(0)
            x, c = mu - centre, points - centre
            return np.maximum((weight * x * x).sum(1)[:, None] - 2 * (weight * x) @ c.T + weight @ (c * c).T, 0.0)

        one = p.sf2 * np.exp(-0.5 * gaps(p.alpha / den1, p.z)) / np.sqrt(den1.prod(1))[:, None]
        two = p.sf2**2 * np.exp(-gaps(p.alpha / den2, mid) - 0.25 * (apart**2 @ p.alpha)) / np.sqrt(den2.prod(1))[:, None]
        return cls(den1, den2, one, two, i, j, mid)


def chunk(p: Params) -> int:
    """Rows that are computed at once."""
    return max(1, TENSOR // (p.m * (p.m + 1) // 2 + p.m))


def block(y: np.ndarray, mu: np.ndarray, s: np.ndarray, p: Params, gradients: bool = True, kl: bool = False) -> Stats:
    """The sums of a chunk of rows."""
    n, d = y.shape
    e = Expected.of(mu, s, p)

    def square(v: np.ndarray) -> np.ndarray:
        """The symmetric matrix, or the stack of them over the last axis, of values by pair."""
        out = np.zeros((p.m, p.m, *v.shape[1:]))
        out[e.i, e.j] = out[e.j, e.i] = v
        return out

    psi2 = square(e.two.sum(0))
    out = Stats(n, d, float((y * y).sum()), p.sf2 * n, psi2, e.one.T @ y, float(0.5 * ((s - np.log(s)).sum() + (mu * mu).sum() - n * p.q)) if kl else 0.0)
    if not gradients:
        return out
    apart = p.z[:, None] - p.z[None]

    def with_y(weight: np.ndarray) -> np.ndarray:
        """Sum over rows of one[m] * weight[q] * y[d]."""
        return (e.one.T @ (weight[:, :, None] * y[:, None, :]).reshape(n, p.q * d)).reshape(p.m, p.q, d)

    z = p.z[:, :, None]
    gap = with_y(mu / e.den1) - z * with_y(1 / e.den1)
    gap2 = with_y((mu / e.den1) ** 2 + s / e.den1) - 2 * z * with_y(mu / e.den1**2) + z**2 * with_y(1 / e.den1**2)
    two = e.two.T
    mid = 2 * (two @ (mu / e.den2) - e.mid * (two @ (1 / e.den2)))
    mid2 = 4 * (two @ (mu / e.den2) ** 2 - 2 * e.mid * (two @ (mu / e.den2**2)) + e.mid**2 * (two @ (1 / e.den2**2)))
    return replace(
        out,
        psi1y_dz=p.alpha[:, None] * gap,
        psi2_dz=(0.5 * p.alpha * (square(mid) - psi2[:, :, None] * apart)).transpose(0, 2, 1),
        psi1y_dalpha=-0.5 * gap2.transpose(1, 0, 2),
        psi2_dalpha=(-0.25 * psi2[:, :, None] * apart**2 - 0.25 * square(mid2) - square(two @ (s / e.den2))).transpose(2, 0, 1),
    )


def _flat(s: Stats) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in (s.n, s.yy, s.psi0, s.psi2, s.psi1y, s.kl, s.psi1y_dz, s.psi2_dz, s.psi1y_dalpha, s.psi2_dalpha) if x is not None])


def _stats(v: np.ndarray, p: Params, d: int, gradients: bool) -> Stats:
    shapes = [(), (), (), (p.m, p.m), (p.m, d), ()] + [(p.m, p.q, d), (p.m, p.q, p.m), (p.q, p.m, d), (p.q, p.m, p.m)] * gradients
    cuts = np.cumsum([int(np.prod(x)) for x in shapes])
    own = [x.reshape(shape) if shape else float(x[0]) for x, shape in zip(np.split(v, cuts[:-1]), shapes, strict=True)]
    return Stats(own[0], d, *own[1:])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column."""
    values = column.flatten()
    if column.null_count or values.null_count or len(values) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"rows with missing values, or not of {width} numbers")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), width)


def accumulate(rows: DataFrame, p: Params, d: int, gradients: bool = True, kl: bool = False) -> Stats:
    """Block form over all rows: one job; every task sends one row of sums, which are added on executors."""
    size = chunk(p)
    cells = len(_flat(block(np.zeros((1, d)), np.zeros((1, p.q)), np.ones((1, p.q)), p, gradients)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            y, mu, s = (matrix(batch.column(k), width) for k, width in enumerate((d, p.q, p.q)))
            for a in range(0, len(y), size):
                total += _flat(block(y[a : a + size], mu[a : a + size], s[a : a + size], p, gradients, kl))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    real = [F.col(c).cast("array<double>").alias(c) for c in ("y", "mu", "s")]
    sums = rows.select(*real).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(cells)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return _stats(out, p, d, gradients)


def from_long(frame: DataFrame, p: Params, d: int) -> Stats:
    """Statistics of the long form, which has one row a cell."""
    found = {(r["stat"], r["i"], r["j"], r["k"]): r["v"] for r in frame.collect()}
    cell = lambda name, *shape: np.array([found.get((name, *ix, *[0] * (3 - len(ix))), 0.0) for ix in np.ndindex(*shape)]).reshape(shape)
    n = found["n", 0, 0, 0]
    more = {}
    if any(k[0] == "psi2_dz" for k in found):
        more = {"psi1y_dz": cell("psi1y_dz", p.m, p.q, d), "psi2_dz": cell("psi2_dz", p.m, p.q, p.m), "psi1y_dalpha": cell("psi1y_dalpha", p.q, p.m, d), "psi2_dalpha": cell("psi2_dalpha", p.q, p.m, p.m)}
    return Stats(n, d, found["yy", 0, 0, 0], p.sf2 * n, cell("psi2", p.m, p.m), cell("psi1y", p.m, d), found.get(("kl", 0, 0, 0), 0.0), **more)
