"""Global parameters, accumulated statistics and the fit's settings: small, and kept on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Params:
    z: np.ndarray  # M x Q
    sf2: float
    alpha: np.ndarray  # Q, inverse squared length scales
    beta: float

    def __post_init__(self) -> None:
        if self.z.ndim != 2 or np.shape(self.alpha) != (self.z.shape[1],):
            raise ValueError("inducing points are rows of as many numbers as there are length scales")
        if not (self.sf2 > 0 and self.beta > 0 and np.all(np.asarray(self.alpha) >= 0)):
            raise ValueError("variances and precisions are positive")

    @property
    def m(self) -> int:
        return self.z.shape[0]

    @property
    def q(self) -> int:
        return self.z.shape[1]

    def kmm(self) -> np.ndarray:
        return kernel(self.z, self.z, self)

    def raw(self, fixed_beta: bool = False) -> np.ndarray:
        """Unconstrained vector, in the order z, sf2, alpha, beta."""
        return np.concatenate([self.z.ravel(), unsoftplus(np.array([self.sf2])), unsoftplus(self.alpha), unsoftplus(np.array([self.beta]))])

    @classmethod
    def from_raw(cls, x: np.ndarray, m: int, q: int) -> Params:
        z, rest = x[: m * q].reshape(m, q), softplus(x[m * q :])
        return cls(z, float(rest[0]), rest[1 : 1 + q], float(rest[1 + q]))


def kernel(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    return p.sf2 * np.exp(-0.5 * np.einsum("ijq,q->ij", (a[:, None] - b[None]) ** 2, p.alpha))


LIMIT = -np.log(np.finfo(float).eps)


def softplus(x: np.ndarray) -> np.ndarray:
    if not (np.abs(x) < LIMIT).all():
        raise ValueError("a parameter left the range of doubles")
    return np.log1p(np.exp(x))


def unsoftplus(x: np.ndarray) -> np.ndarray:
    return np.log(np.expm1(x))


def softplus_slope(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: Statistics that are sums over rows, and their axes.
SUMS = ("yy", "psi0", "psi2", "psi1y", "kl")
GRADIENT_SUMS = ("psi1y_dz", "psi2_dz", "psi1y_dalpha", "psi2_dalpha")


@dataclass(frozen=True)
class Stats:
    n: float
    d: int
    yy: float
    psi0: float
    psi2: np.ndarray  # M x M
    psi1y: np.ndarray  # M x D
    kl: float
    psi1y_dz: np.ndarray | None = None  # M x Q x D
    psi2_dz: np.ndarray | None = None  # M x Q x M
    psi1y_dalpha: np.ndarray | None = None  # Q x M x D
    psi2_dalpha: np.ndarray | None = None  # Q x M x M

    def scaled(self, by: float) -> Stats:
        """All sums times by, as if rows that were left out had been like the rest."""
        return replace(self, **{k: getattr(self, k) * by for k in (*SUMS, *GRADIENT_SUMS) if getattr(self, k) is not None})


@dataclass(frozen=True)
class FitConfig:
    inducing: int = 10
    latent: int = 2
    iterations: int = 100
    optimiser: str = "scg"
    init: str = "pca"
    fixed_embeddings: bool = False
    fixed_beta: bool = False
    drop_out: float = 0.0
    seed: int = 0
    keep_history: bool = False
    reset_local: bool = False
    #: Trial points of conjugate gradients at most; None: no limit.
    max_evaluations: int | None = 500
    #: Where inducing points come from: "kmeans" centres of the latents, or "random" rows.
    inducing_choice: str = "kmeans"
    #: Gets a line of progress for each trial, e.g. print.
    report: Callable[[str], None] | None = None
    tolerances: dict[str, float] = field(default_factory=lambda: {"x": 0.0, "f": 0.0, "g": 0.0})
