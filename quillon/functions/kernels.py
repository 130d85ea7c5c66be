"""The squared-exponential kernel and its expectations as column expressions, one per inducing point.

They are unrolled over the few latent dimensions and inducing points, so a statistic is a plain sum that
stays in generated code with its partial aggregation: no join multiplies the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.plans.model import Params


def ard(a: Sequence, b: Sequence, p: Params) -> Column:
    """Kernel of two points whose coordinates are columns or numbers."""
    gaps = [float(w) * (x - y) * (x - y) for w, x, y in zip(p.alpha, a, b, strict=True)]
    return float(p.sf2) * F.exp(-0.5 * reduce(add, gaps))


def psi1(m: int, mu: Sequence[Column], s: Sequence[Column], p: Params) -> Column:
    den = [float(a) * v + 1.0 for a, v in zip(p.alpha, s, strict=True)]
    gaps = [float(a) * (float(z) - x) * (float(z) - x) / d for a, z, x, d in zip(p.alpha, p.z[m], mu, den, strict=True)]
    return float(p.sf2) * F.exp(-0.5 * reduce(add, gaps)) / F.sqrt(reduce(mul, den))


def psi2(m: int, k: int, mu: Sequence[Column], s: Sequence[Column], p: Params) -> Column:
    den = [2.0 * float(a) * v + 1.0 for a, v in zip(p.alpha, s, strict=True)]
    still = 0.25 * float(sum(p.alpha * (p.z[m] - p.z[k]) ** 2))
    mid = (p.z[m] + p.z[k]) / 2
    gaps = [float(a) * (x - float(z)) * (x - float(z)) / d for a, x, z, d in zip(p.alpha, mu, mid, den, strict=True)]
    return float(p.sf2) ** 2 * F.exp(-still - reduce(add, gaps)) / F.sqrt(reduce(mul, den))
