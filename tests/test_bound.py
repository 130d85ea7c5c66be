import numpy as np
import pytest

from quillon.operators import statistics as st
from quillon.operators.bound import Algebra, cholesky
from quillon.operators.latents import row_gradients
from quillon.plans.model import Params, kernel


@pytest.fixture
def case():
    draw = np.random.default_rng(0)
    p = Params(np.arange(8.0).reshape(4, 2) * 0.8 + 0.1 * draw.standard_normal((4, 2)), 1.7, np.array([0.6, 1.3]), 4.0)
    return p, draw.standard_normal((6, 3)), draw.standard_normal((6, 2)) * 2 + 2, draw.uniform(0.1, 0.6, (6, 2))


def f(p, y, mu, s):
    return Algebra.of(p, st.block(y, mu, s, p, False, True)).bound()


def differences(fun, x, step=1e-5):
    out = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (fun(up) - fun(down)) / (2 * step)
    return out


def test_global_gradients(case):
    p, y, mu, s = case
    a = Algebra.of(p, st.block(y, mu, s, p, True, True))
    of = lambda **k: Params(**{"z": p.z, "sf2": p.sf2, "alpha": p.alpha, "beta": p.beta} | k)
    assert a.grad_z() == pytest.approx(differences(lambda z: f(of(z=z), y, mu, s), p.z), rel=1e-5, abs=1e-6)
    assert a.grad_alpha() == pytest.approx(differences(lambda v: f(of(alpha=v), y, mu, s), p.alpha), rel=1e-5)
    assert a.grad_sf2() == pytest.approx(differences(lambda v: f(of(sf2=float(v[0])), y, mu, s), np.array([p.sf2]))[0], rel=1e-5)
    assert a.grad_beta() == pytest.approx(differences(lambda v: f(of(beta=float(v[0])), y, mu, s), np.array([p.beta]))[0], rel=1e-5)
    assert a.gradient(fixed_beta=True)[-1] == 0


def test_row_gradients(case):
    p, y, mu, s = case
    a = Algebra.of(p, st.block(y, mu, s, p, False, True))
    g_mu, g_s = row_gradients(y, mu, s, p, a.by_psi1y(), a.by_psi2())
    assert g_mu == pytest.approx(differences(lambda v: f(p, y, v, s), mu), rel=1e-4, abs=1e-5)
    assert g_s == pytest.approx(differences(lambda v: f(p, y, mu, v), s), rel=1e-4, abs=1e-5)


def test_without_variance_expectations_are_kernels(case):
    p, y, mu, _ = case
    own = st.block(y, mu, np.zeros_like(mu), p, False)
    k = kernel(mu, p.z, p)
    assert own.psi1y == pytest.approx(k.T @ y)
    assert own.psi2 == pytest.approx(k.T @ k)
    assert np.linalg.eigvalsh(own.psi2).min() > -1e-9


def test_bound_is_below_the_likelihood():
    draw = np.random.default_rng(1)
    x, p = np.linspace(-5, 5, 12)[:, None], Params(np.linspace(-4, 4, 5)[:, None], 1.2, np.array([0.7]), 9.0)
    y = np.sin(x) + draw.standard_normal((12, 1)) / 3
    c = kernel(x, x, p) + np.eye(12) / p.beta
    exact = -0.5 * (y.T @ np.linalg.solve(c, y)).item() - 0.5 * np.linalg.slogdet(c)[1] - 6 * np.log(2 * np.pi)
    value = Algebra.of(p, st.block(y, x, np.zeros_like(x), p, False)).bound()
    assert value <= exact
    full = Params(x, 1.2, np.array([0.7]), 9.0)
    assert Algebra.of(full, st.block(y, x, np.zeros_like(x), full, False)).bound() == pytest.approx(exact, rel=1e-3)


def test_jitter_ladder():
    factor, jitter = cholesky(np.ones((3, 3)))
    assert jitter > 0 and np.isfinite(factor).all()


@pytest.mark.parametrize("m,q", [(3, 1), (4, 2), (2, 3)])
def test_forms_agree(spark, m, q):
    draw = np.random.default_rng(m)
    p = Params(draw.standard_normal((m, q)), 1.3, draw.uniform(0.5, 2, q), 2.0)
    y, mu, s = draw.standard_normal((40, 2)), draw.standard_normal((40, q)), draw.uniform(0.1, 1, (40, q))
    rows = spark.createDataFrame([(i, *(r.tolist() for r in x)) for i, x in enumerate(zip(y, mu, s, strict=True))], "row_id long, y array<double>, mu array<double>, s array<double>").repartition(3)
    want = st.block(y, mu, s, p, True, True)
    for got in (st.accumulate(rows, p, 2, True, True), st.from_long(st.long_form(rows, p, 2, gradients=True, kl=True), p, 2)):
        for name in ("n", "yy", "psi0", "psi2", "psi1y", "kl", "psi1y_dz", "psi2_dz", "psi1y_dalpha", "psi2_dalpha"):
            assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-9, abs=1e-9), name
    by = rows.withColumn("shard", rows["row_id"] % 4)
    merged = st.from_long(st.merge(st.long_form(by, p, 2, by=["shard"])), p, 2)
    assert merged.psi2 == pytest.approx(want.psi2)
