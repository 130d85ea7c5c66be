"""Column functions for arrays and for positive parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this, exp() loses the 1 next to it in double precision.
LIMIT = -math.log(2.220446049250313e-16)


def _within(x: Column, low: float, high: float, value: Column, strict: bool, below: Column, above: Column) -> Column:
    if strict:
        return F.when((x > low) & (x < high), value).when(x.isNotNull(), F.raise_error(F.lit(f"outside ({low}, {high})")).cast("double"))
    return F.when(x >= high, above).when(x <= low, below).otherwise(value)


def softplus(x: Column, strict: bool = True) -> Column:
    """log(1 + exp(x)); outside the limits an error, or if not strict its asymptote."""
    return _within(x, -LIMIT, LIMIT, F.log1p(F.exp(x)), strict, F.exp(x), x)


def _log(x: Column) -> Column:
    """log(x), with -inf at 0 and NaN below: Spark's log() has nulls there."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


def softplus_inverse(x: Column, strict: bool = True, plain: bool = False) -> Column:
    """log(exp(x) - 1) of positive x; if not strict also its limit at 0, and NaN below. plain: exp(x) - 1 is taken as it stands, as in SQL, without the digits of a small x that it loses."""
    y = F.when(F.abs(x) < 0.1, F.expm1(x) + 1).otherwise(F.exp(x)) - 1 if plain else F.expm1(x)  # exp(x) itself is less often the nearest double
    return _within(x, math.exp(-LIMIT), LIMIT, _log(y), strict, _log(y if plain else x), x)


def softplus_gradient(x: Column, strict: bool = True) -> Column:
    return _within(x, -LIMIT, LIMIT, 1 / (1 + F.exp(-x)), strict, F.exp(x), F.lit(1.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int) -> Column:
    """round(x * 10**digits) / 10**digits in doubles, halves away from 0, as in DuckDB. F.round goes by the shortest decimal digits instead, and makes -0.0 of small negative numbers 0.0."""
    y = F.abs(x) * 10.0**digits
    whole = F.floor(y).cast("double")
    size = F.when(y < 2.0**52, (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits).otherwise(F.abs(x))
    return F.when(x < 0, -size).otherwise(size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(x: Column, step: float | Column, d: Column) -> Column:
    """x + step * d: a trial point."""
    return F.zip_with(x, d, lambda a, b: a + b * (F.lit(step) if isinstance(step, float) else step))


def centred(x: Column, mean: Column, scale: Column | None = None) -> Column:
    """x minus mean, over scale where one is given."""
    out = F.zip_with(x, mean, lambda a, b: a - b)
    return out if scale is None else F.zip_with(out, scale, lambda a, b: a / b)


def masked(x: Column, mask: list[int]) -> Column:
    return F.array(*(F.get(x, F.lit(i)) for i in mask))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def sum_abs(x: Column) -> Column:
    return F.aggregate(F.transform(x, F.abs), F.lit(0.0), lambda s, v: s + v)


def scrambled(key: Column, seed: int, rounds: int = 3) -> Column:
    """A number from 1 to 2**31 - 2 that looks random, of an integer key and a seed: steps of a multiplicative generator. Plain arithmetic, so any SQL engine gives the same."""
    x = F.pmod(key.cast("long") + seed, F.lit(2147483646)) + 1
    for _ in range(rounds):
        x = (x * 48271) % 2147483647
    return x
