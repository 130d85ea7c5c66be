"""The variational bound and its gradients from accumulated statistics: dense algebra of M x M matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillon.plans.model import Params, Stats


class NotPositive(ArithmeticError):
    """A matrix isn't positive definite, even with the largest jitter."""


def cholesky(a: np.ndarray, most: int = 6) -> tuple[np.ndarray, float]:
    """Factor, and the jitter that it took: none, or the mean of the diagonal times 1e-7, 1e-6 and so on.

    A factor whose diagonal spans over six decades would lose the digits of what is solved with it, so it takes jitter too.
    """
    jitter = 0.0
    for k in range(most):
        try:
            factor = np.linalg.cholesky(a + jitter * np.eye(len(a)))
            if np.ptp(np.log10(np.diag(factor))) < 6:
                return factor, jitter
        except np.linalg.LinAlgError:
            pass
        jitter = 10.0 ** (k - 7) * float(np.mean(np.diag(a)))
    raise NotPositive(f"no factor with jitter {jitter}")


def inverse(factor: np.ndarray) -> np.ndarray:
    half = np.linalg.solve(factor, np.eye(len(factor)))
    return half.T @ half


def log_det(factor: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(factor)).sum())


@dataclass(frozen=True)
class Algebra:
    """What bound and gradients share."""

    p: Params
    s: Stats
    kmm: np.ndarray
    ki: np.ndarray
    ai: np.ndarray
    log_k: float
    log_a: float
    jitter: float

    @classmethod
    def of(cls, p: Params, s: Stats) -> Algebra:
        kmm = p.kmm()
        lk, jitter = cholesky(kmm)
        la, more = cholesky(kmm + jitter * np.eye(len(kmm)) + p.beta * s.psi2)
        return cls(p, s, kmm, inverse(lk), inverse(la), log_det(lk), log_det(la), max(jitter, more))

    @property
    def aic(self) -> np.ndarray:
        return self.ai @ self.s.psi1y

    def bound(self) -> float:
        p, s = self.p, self.s
        half = s.d / 2
        return float(
            half * s.n * (np.log(p.beta) - np.log(2 * np.pi)) + half * (self.log_k - self.log_a) - p.beta / 2 * s.yy
            + half * p.beta * (np.sum(self.ki * s.psi2) - s.psi0) + p.beta**2 / 2 * np.sum(s.psi1y * self.aic) - s.kl
        )

    def by_kmm(self) -> np.ndarray:
        b, half, g = self.p.beta, self.s.d / 2, self.aic @ self.aic.T
        return half * (self.ki - self.ai - b * self.ki @ self.s.psi2 @ self.ki) - b**2 / 2 * g

    def by_psi1y(self) -> np.ndarray:
        return self.p.beta**2 * self.aic

    def by_psi2(self) -> np.ndarray:
        b, half = self.p.beta, self.s.d / 2
        return half * b * (self.ki - self.ai) - b**3 / 2 * self.aic @ self.aic.T

    def by_psi0(self) -> float:
        return -self.p.beta * self.s.d / 2

    def grad_z(self) -> np.ndarray:
        p, s = self.p, self.s
        dk = -p.alpha * (p.z[:, None] - p.z[None]) * self.kmm[:, :, None]  # m, m', q
        k = self.by_kmm()
        return (
            np.einsum("jm,jmq->jq", k + k.T, dk) + np.einsum("jd,jqd->jq", self.by_psi1y(), s.psi1y_dz)
            + 2 * np.einsum("jm,jqm->jq", self.by_psi2(), s.psi2_dz)
        )

    def grad_alpha(self) -> np.ndarray:
        p, s = self.p, self.s
        dk = -0.5 * (p.z[:, None] - p.z[None]) ** 2 * self.kmm[:, :, None]
        return np.einsum("jm,jmq->q", self.by_kmm(), dk) + np.einsum("md,qmd->q", self.by_psi1y(), s.psi1y_dalpha) + np.einsum("mk,qmk->q", self.by_psi2(), s.psi2_dalpha)

    def grad_sf2(self) -> float:
        """The derivatives of the statistics by sf2 are these themselves, scaled."""
        p, s = self.p, self.s
        return float((np.sum(self.by_kmm() * self.kmm) + self.by_psi0() * s.psi0 + np.sum(self.by_psi1y() * s.psi1y) + 2 * np.sum(self.by_psi2() * s.psi2)) / p.sf2)

    def grad_beta(self) -> float:
        p, s = self.p, self.s
        half = s.d / 2
        return float(
            half * s.n / p.beta - s.yy / 2 - half * s.psi0 + half * np.sum((self.ki - self.ai) * s.psi2)
            + p.beta * np.sum(s.psi1y * self.aic) - p.beta**2 / 2 * np.sum(self.aic * (s.psi2 @ self.aic))
        )

    def gradient(self, fixed_beta: bool = False) -> np.ndarray:
        """By z, sf2, alpha, beta, as one vector."""
        return np.concatenate([self.grad_z().ravel(), [self.grad_sf2()], self.grad_alpha(), [0.0 if fixed_beta else self.grad_beta()]])
