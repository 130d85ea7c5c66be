"""Gradients of the bound by each row's latent mean and variance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.bound import Algebra
from quillon.operators.statistics import Expected, chunk, matrix
from quillon.plans.model import Params


def row_gradients(y: np.ndarray, mu: np.ndarray, s: np.ndarray, p: Params, by_psi1y: np.ndarray, by_psi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the bound gains by mu and s of each row, through its terms' weights."""
    e = Expected.of(mu, s, p)
    w1 = e.one * (y @ by_psi1y.T)
    w2 = e.two * np.where(e.i == e.j, by_psi2[e.i, e.j], by_psi2[e.i, e.j] + by_psi2[e.j, e.i])
    sum1, sum2 = w1.sum(1)[:, None], w2.sum(1)[:, None]
    z1, z2 = w1 @ p.z, w2 @ e.mid
    gap, gap2 = mu * sum1 - z1, mu * mu * sum1 - 2 * mu * z1 + w1 @ (p.z * p.z)
    mid, mid2 = 2 * (mu * sum2 - z2), 4 * (mu * mu * sum2 - 2 * mu * z2 + w2 @ (e.mid * e.mid))
    by_mu = -mu - p.alpha * (gap / e.den1 + mid / e.den2)
    by_s = -0.5 * (1 - 1 / s) + 0.5 * p.alpha**2 * (gap2 / e.den1**2 + mid2 / e.den2**2) - 0.5 * sum1 * p.alpha / e.den1 - sum2 * p.alpha / e.den2
    return by_mu, by_s


def gradients(rows: DataFrame, a: Algebra) -> DataFrame:
    """rows, all columns, with grad_mu and grad_s: a map without shuffle or join; the adjoints go with the closure."""
    p, c, d = a.p, a.by_psi1y(), a.by_psi2()
    size, width = chunk(p), a.s.d
    real = rows.withColumns({k: F.col(k).cast("array<double>") for k in ("y", "mu", "s")})
    more = ("grad_mu", "grad_s")

    def lists(v: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, p.q, dtype=np.int32)), pa.array(v.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                y, mu, s = (matrix(part.column(part.schema.names.index(k)), n) for k, n in (("y", width), ("mu", p.q), ("s", p.q)))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(lists, row_gradients(y, mu, s, p, c, d))], names=[*part.schema.names, *more])

    return real.mapInArrow(run, T.StructType([*real.schema.fields, *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in more)]))
