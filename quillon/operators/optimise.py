"""Minimisers over global parameters and, at choice, a distributed block of latents.

The global part is a numpy vector. The latent part is a table (row_id, y, x, d, g_new, g_old, g_latest), x being means
and unconstrained variances. Products over it are one aggregation that gives all of them. An
evaluation at x + step * d writes g_latest only, so a probe never disturbs g_new and g_old.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import axpy, dot, max_abs, sum_abs
from quillon.sources.tables import discard, written

FAILURES = (ArithmeticError, ValueError, np.linalg.LinAlgError)


class Latents:
    """Optimiser state of the rows."""

    def __init__(self, table: DataFrame):
        self.table = table
        self._dots: dict[str, float] | None = None

    def put(self, **columns) -> None:
        """Set columns, in one written table."""
        new = written(self.table.withColumns(columns))
        discard(self.table)
        self.table, self._dots = new, None

    def replace(self, table: DataFrame) -> None:
        new = written(table)
        discard(self.table)
        self.table, self._dots = new, None

    def dots(self) -> dict[str, float]:
        """All products that a step may need, in one scan."""
        if self._dots is None:
            have = set(self.table.columns)
            c = F.col
            pairs = {"gd": ("g_new", "d"), "dd": ("d", "d"), "dl": ("d", "g_latest"), "gg": ("g_new", "g_new"), "go": ("g_new", "g_old"), "ll": ("g_latest", "g_latest")}
            sums = [F.sum(dot(c(a), c(b))).alias(k) for k, (a, b) in pairs.items() if {a, b} <= have]
            sums += [F.max(max_abs(c("d"))).alias("max_d")] * ("d" in have) + [F.max(max_abs(c("g_latest"))).alias("max_l"), F.sum(sum_abs(c("g_latest"))).alias("sum_l")] * ("g_latest" in have)
            self._dots = {k: v or 0.0 for k, v in self.table.agg(*sums).first().asDict().items()}
        return self._dots


def scg_products(rows: DataFrame) -> DataFrame:
    """The products of scaled conjugate gradients, of columns g_new, g_old, g_latest, d."""
    c = F.col
    return rows.agg(
        F.sum(dot(c("g_new"), c("d"))).alias("mu"), F.sum(dot(c("d"), c("d"))).alias("kappa"), F.sum(F.aggregate(F.zip_with("d", F.zip_with("g_latest", "g_new", lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("theta"),
        F.sum(dot(c("g_new"), c("g_new"))).alias("current"), F.sum(dot(c("g_new"), c("g_old"))).alias("gamma"), F.max(max_abs(c("d"))).alias("max_d"),
    )


@dataclass
class Trace:
    """Metrics of a run: a row each evaluation."""

    rows: list[tuple] = field(default_factory=list)
    status: str = ""
    x: np.ndarray | None = None
    f: float = math.inf

    def frame(self, spark):
        return spark.createDataFrame(self.rows or [(0, "none", 0.0, float("nan"))], "iteration int, phase string, seconds double, objective double")


#: objective(x, latents, step): f and the gradient by x; with latents, g_latest is set at x + step * d.
Objective = Callable[[np.ndarray, "Latents | None", float], tuple[float, np.ndarray]]


class Guard:
    """An objective whose failures count as infinite; so many in a row are an error."""

    def __init__(self, objective: Objective, trace: Trace, most: int = 100):
        self.objective, self.trace, self.most, self.failed = objective, trace, most, 0

    def __call__(self, x: np.ndarray, latents: Latents | None, step: float, iteration: int, phase: str) -> tuple[float, np.ndarray]:
        import time

        began = time.time()
        try:
            f, g = self.objective(x, latents, step)
            if not (math.isfinite(f) and np.isfinite(g).all()):
                raise ArithmeticError("not finite")
            self.failed = 0
        except FAILURES:
            self.failed += 1
            if self.failed > self.most:
                raise
            f, g = math.inf, np.ones_like(x)
        self.trace.rows.append((iteration, phase, time.time() - began, float(f)))
        return f, g


def gradient_error(objective: Objective, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """How far each number of the gradient is from central differences, as a share of the larger of the two (and of 1)."""
    _, g = objective(x, None, 0.0)
    apart = np.empty_like(x)
    for i, at in enumerate(np.eye(len(x)) * step):
        apart[i] = (objective(x + at, None, 0.0)[0] - objective(x - at, None, 0.0)[0]) / (2 * step)
    return np.abs(g - apart) / np.maximum(1.0, np.maximum(np.abs(g), np.abs(apart)))


@dataclass
class _Course:
    """Where conjugate gradients stand: the global part, and numbers that rows and globals share. Rows keep theirs in the state table."""

    x: np.ndarray
    f: float
    g_new: np.ndarray
    g_old: np.ndarray
    d: np.ndarray
    trust: float = 1.0
    slope: float = 0.0  # along d
    length: float = 0.0  # of d, squared
    curvature: float = 0.0
    restart_in: float = math.inf


def _no_report(_: str) -> None:
    pass


def _line(report: Callable[[str], None] | None, iteration: int, f: float, gradient: float, scale: float) -> None:
    (report or _no_report)(f"{iteration:>6} {f:>16.8e} {scale:>12.4e} {gradient:>12.4e}")


def _aim(c: _Course, call: Guard, latents: Latents | None, local: Callable[[str], float], iteration: int) -> bool:
    """Slope, length and curvature along the direction, which turns downhill if it isn't; False if there is none."""
    c.slope = c.d @ c.g_new + local("gd")
    if c.slope >= 0:
        c.d = -c.g_new
        if latents:
            latents.put(d=F.transform("g_new", lambda v: -v))
        c.slope = c.d @ c.g_new + local("gd")
    c.length = c.d @ c.d + local("dd")
    if c.length < np.finfo(float).eps ** 2:
        return False
    sigma, before = 1e-4 / math.sqrt(c.length), local("gd")
    _, probe = call(c.x + sigma * c.d, latents, sigma, iteration, "curvature")
    c.curvature = (c.d @ (probe - c.g_new) + (local("dl") - before)) / sigma
    return True


def _accept(c: _Course, step: float, f: float, g: np.ndarray, latents: Latents | None, local: Callable[[str], float]) -> tuple[float, float]:
    """Move by step along the direction; the largest change of a coordinate and that of f."""
    largest, change = max(np.abs(step * c.d).max(initial=0.0), abs(step) * local("max_d")), f - c.f
    c.x, c.f, c.g_old, c.g_new = c.x + step * c.d, f, c.g_new, g
    c.restart_in -= 1
    if latents:
        latents.put(x=axpy(F.col("x"), step, F.col("d")), g_old=F.col("g_new"), g_new=F.col("g_latest"))
    return largest, change


def _turn(c: _Course, latents: Latents | None, local: Callable[[str], float], reset_local: bool) -> None:
    """The next direction: conjugate, or after as many successes as there are globals, downhill for these."""
    if c.restart_in <= 0:
        c.d, c.restart_in = -c.g_new, len(c.x)
        if latents and reset_local:
            latents.put(d=F.transform("g_new", lambda v: -v))
        return
    gamma = (c.g_old @ c.g_new - c.g_new @ c.g_new + local("go") - local("gg")) / c.slope
    c.d = gamma * c.d - c.g_new
    if latents:
        latents.put(d=F.zip_with("d", "g_new", lambda a, b: a * F.lit(float(gamma)) - b))


def scg(
    objective: Objective, x: np.ndarray, latents: Latents | None = None, iterations: int = 100, xtol: float = 1e-6, ftol: float = 1e-6, gtol: float = 1e-5,
    max_evaluations: int | None = 500, reset_local: bool = False, report: Callable[[str], None] | None = None,
) -> Trace:
    """Scaled conjugate gradients: the curvature along d from a gradient difference, the step from a trust factor.

    An iteration is a trial, accepted or not; trials alone count as evaluations. report gets a line each.
    """
    trace = Trace(status="maximum of iterations reached")
    call = Guard(objective, trace)
    local = (lambda k: latents.dots().get(k, 0.0)) if latents else (lambda k: 0.0)
    f, g = call(x, latents, 0.0, 0, "start")
    c = _Course(x, f, g, g, -g, restart_in=len(x) or math.inf)
    if latents:
        latents.put(g_new=F.col("g_latest"), g_old=F.col("g_latest"), d=F.transform("g_latest", lambda v: -v))
    success = True
    for iteration in range(iterations):
        if success and not _aim(c, call, latents, local, iteration):
            trace.status = "no direction left"
            break
        damped = c.curvature + c.trust * c.length
        if damped <= 0:
            damped, c.trust = c.trust * c.length, c.trust - c.curvature / c.length
        step = -c.slope / damped
        f, g = call(c.x + step * c.d, latents, step, iteration + 1, "trial")
        if max_evaluations and iteration + 2 >= max_evaluations:
            trace.status = "maximum of evaluations reached"
            break
        quality = 2 * (f - c.f) / (step * c.slope) if math.isfinite(f) else -math.inf
        success = quality >= 0
        if success:
            largest, change = _accept(c, step, f, g, latents, local)
            gradient = c.g_new @ c.g_new + local("gg")
            _line(report, iteration + 1, c.f, gradient, c.trust)
            if largest < xtol or abs(change) < ftol:
                trace.status = "converged"
                break
            if gradient <= gtol:
                trace.status = "converged by gradient"
                break
        else:
            _line(report, iteration + 1, c.f, c.g_new @ c.g_new + local("gg"), c.trust)
        if quality < 0.25:
            c.trust = min(4 * c.trust, 1e100)
        elif quality > 0.75:
            c.trust = max(c.trust / 2, 1e-60)
        if success:
            _turn(c, latents, local, reset_local)
    trace.x, trace.f = c.x, c.f
    return trace


def gd(
    objective: Objective, x: np.ndarray, latents: Latents | None = None, iterations: int = 100, step: float = 0.01, momentum: float = 0.0, xtol: float = 1e-16, ftol: float = 1e-6, gtol: float = 1e-6,
    report: Callable[[str], None] | None = None,
) -> Trace:
    """Gradient descent whose step doubles when accepted and halves when not; rejected steps aren't iterations.

    It ends when a trial changes f by less than ftol, before that trial counts, when the step is under xtol, or when no number of the
    gradient is over gtol. Momentum is that share of the step just made.
    """
    trace = Trace(status="maximum of iterations reached")
    call = Guard(objective, trace)
    f_old, g = call(x, latents, 0.0, 0, "start")
    d, iteration = -g, 0
    if latents:
        latents.put(g_new=F.col("g_latest"), d=F.transform("g_latest", lambda v: -v))
    while iteration < iterations:
        f, latest = call(x + step * d, latents, step, iteration, "trial")
        if abs(f_old - f) < ftol or step < xtol:
            trace.status = "converged"
            break
        if f <= f_old:
            kept = momentum * step
            if latents:
                latents.put(x=axpy(F.col("x"), step, F.col("d")), g_new=F.col("g_latest"), d=F.zip_with("g_latest", "d", lambda a, b: -(a + F.lit(float(kept)) * b)))
            x, f_old, g = x + step * d, f, latest
            d, step, iteration = -(g + kept * d), 2 * step, iteration + 1
            sums = latents.dots() if latents else {}
            if max(np.abs(g).max(initial=0.0), sums.get("max_l", 0.0)) < gtol:
                trace.status = "converged by gradient"
                break
            _line(report, iteration, f_old, np.abs(g).sum() + sums.get("sum_l", 0.0), step)
        else:
            step /= 2
            _line(report, iteration, f_old, np.abs(g).sum(), step)
    trace.x, trace.f = x, f_old
    return trace
