import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fit as fits
from quillon.operators import initialise, latents, optimise, statistics
from quillon.operators.bound import Algebra
from quillon.plans.model import FitConfig, Params
from quillon.sources import tables


@pytest.fixture(scope="module")
def curve(spark):
    return tables.generate(spark, 50, seed=4).withColumn("shard", (F.col("row_id") % 4).cast("int")).cache()


def accepted(trace):
    return [r[3] for r in trace.rows if r[1] != "curvature" and np.isfinite(r[3])]


@pytest.mark.parametrize("kind", ["scg", "gd"])
def test_free_latents(spark, curve, kind):
    model = fits.fit(curve, FitConfig(inducing=5, latent=2, iterations=3, optimiser=kind))
    assert model.trace.f <= accepted(model.trace)[0]
    assert fits.bound(model.rows, model.params, True) == pytest.approx(-model.trace.f, rel=1e-6)


def test_fixed_latents_save_and_load(spark, curve, tmp_path):
    given = initialise.pca(curve, 3, 1)
    model = fits.fit(given, FitConfig(inducing=4, latent=1, iterations=8, fixed_embeddings=True, fixed_beta=True, keep_history=True))
    assert model.params.beta == pytest.approx(1.0)
    assert model.trace.f < accepted(model.trace)[0]
    model.save(str(tmp_path))
    kept = spark.read.parquet(str(tmp_path / "history"))
    assert kept.count() == 8 * len(model.trace.rows) and {r["name"] for r in kept.select("name").distinct().collect()} >= {"raw", "stats", "by_kmm", "by_psi1y", "by_psi2"}
    again = fits.load(spark, str(tmp_path))
    again.save(str(tmp_path))  # onto itself
    assert again.rows.count() == 50
    assert again.params.z == pytest.approx(model.params.z)
    assert again.stats.psi2 == pytest.approx(model.stats.psi2)
    warm = fits.fit(again.rows, FitConfig(inducing=4, latent=1, iterations=2, fixed_embeddings=True), start=again.params)
    assert warm.trace.f <= model.trace.f + 1e-6
    assert model.ard_ranking(spark).count() == 1
    with pytest.raises(ValueError):
        fits.fit(curve, FitConfig(fixed_embeddings=True))


def test_no_rows_and_missing_values(spark, curve):
    for bad in (curve.limit(0), curve.withColumn("y", F.lit(None).cast("array<double>"))):
        with pytest.raises(ValueError):
            fits.fit(bad, FitConfig(inducing=2, latent=1, iterations=1))
    p = Params(np.zeros((2, 1)) + [[0.0], [1.0]], 1.0, np.ones(1), 1.0)
    rows = spark.createDataFrame([([1.0, None], [0.0], [0.5]), ([1.0, 2.0], [0.0], [0.5])], "y array<double>, mu array<double>, s array<double>")
    with pytest.raises(Exception, match="missing values"):
        statistics.accumulate(rows, p, 2)
    assert statistics.accumulate(rows.limit(0), p, 2).n == 0


def test_repeated_rows_count_twice(spark, curve):
    """Rows that share an id stay two rows, whatever the optimiser does with their latents."""
    lines = []
    model = fits.fit(curve.union(curve.where("row_id < 5")), FitConfig(inducing=3, latent=1, iterations=2, inducing_choice="random", report=lines.append))
    assert model.rows.count() == 55 and model.stats.n == 55 and len(lines) == 2


def test_a_step_with_free_latents_joins_nothing(spark, curve):
    rows = curve.select("row_id", "y", F.array(F.lit(0.1)).alias("mu"), F.array(F.lit(0.5)).alias("s"))
    p = Params(np.array([[0.0], [1.0]]), 1.0, np.ones(1), 1.0)
    out = latents.gradients(rows, Algebra.of(p, statistics.accumulate(rows, p, 3, True, True)))
    assert out.columns == [*rows.columns, "grad_mu", "grad_s"]
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Join", "Exchange"))


def test_nearest(spark):
    draw = np.random.default_rng(2)
    train, test = 20 * draw.standard_normal((300, 3)), 20 * draw.standard_normal((40, 3))
    train[7] = train[3] = test[0] + 0.1
    frame = lambda name, x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} long, y array<double>")
    for mask, others in ((None, False), ([2], False), ([1, 0], True)):
        use = mask or [0, 1, 2]
        gap = np.sqrt(((test[:, None, use] - train[None][:, :, use]) ** 2).sum(-1))
        if others:
            gap[np.arange(40), np.arange(40)] = np.inf
        want = {(i, int(gap[i].argmin())): float(gap[i].min()) for i in range(40) if gap[i].min() < 6}
        got = {(r.test_id, r.row_id): r.distance for r in initialise.nearest(frame("test_id", test), frame("row_id", train), 6.0, mask, others).collect()}
        assert got == pytest.approx(want)
    assert initialise.nearest(frame("test_id", test[:1]).limit(0), frame("row_id", train)).count() == 0


def test_drop_out(spark, curve):
    assert fits.keep_shards([1, 2, 3], 1.0, 0) != []
    rows, share = fits.dropped(curve, [0, 1, 2, 3], 0.5, 3)
    assert rows.select("shard").distinct().count() == 4 * share
    model = fits.fit(curve, FitConfig(inducing=4, latent=1, iterations=2, drop_out=0.4))
    assert np.isfinite(model.trace.f)


def test_embedding(spark, curve):
    model = fits.fit(curve, FitConfig(inducing=5, latent=2, iterations=3))
    test = curve.where("row_id < 3").select(F.col("row_id").alias("test_id"), "y")
    one, more = fits.embed(model, test, 20).collect(), {r.test_id: r for r in fits.embed(model, test, 20, restarts=2).collect()}
    assert len(one) == 3 and all(more[r.test_id].bound >= r.bound - 1e-9 for r in one)
    joint, value = fits.embed_jointly(model, test, 10)
    assert joint.count() == 3 and np.isfinite(value)
    assert joint.columns == ["test_id", "mu", "s"] and value >= fits.embed_jointly(model, test, 1)[1] - 1e-9
    assert fits.embed(model, test, 5, mask=[0, 1]).count() == 3
    assert all(any(np.abs(np.array(r.mu)).sum() > 0 for r in fits.embed(model, test, 2, random_init=True).collect()) for _ in range(1))


def test_scg_on_a_quadratic_and_failures():
    a = np.diag([1.0, 10.0, 100.0])
    t = optimise.scg(lambda x, *_: (0.5 * x @ a @ x, a @ x), np.ones(3), iterations=60)
    assert t.f < 1e-5
    t = optimise.gd(lambda x, *_: (0.5 * x @ a @ x, a @ x), np.ones(3), iterations=300)
    assert t.f < 1e-3

    def sometimes(x, *_):
        if abs(x[0]) > 1.5:
            raise ArithmeticError
        return float((x[0] - 1) ** 2), 2 * (x - 1)

    assert optimise.scg(sometimes, np.array([-1.0]), iterations=30).f < 1e-6

    def never(x, *_):
        raise ArithmeticError

    with pytest.raises(ArithmeticError):
        optimise.gd(never, np.ones(1), iterations=500)


def test_sequential_form(spark, curve):
    """All in one vector: its gradient is right, and the distributed form starts at the same bound and gradient."""
    draw = np.random.default_rng(3)
    rows = curve.where("row_id < 12").select("row_id", "y").orderBy("row_id").collect()
    y, mu, s = np.array([r.y for r in rows]), draw.standard_normal((12, 2)), draw.uniform(0.2, 0.6, (12, 2))
    p = Params(draw.standard_normal((4, 2)), 1.2, np.array([0.7, 1.1]), 3.0)
    objective, x = fits.sequential(y, mu, s, p)
    assert optimise.gradient_error(objective, x).max() < 1e-5
    trace = optimise.scg(objective, x, iterations=15)
    assert trace.f < objective(x, None, 0.0)[0]
    frame = spark.createDataFrame([(i, *map(np.ndarray.tolist, r)) for i, r in enumerate(zip(y, mu, s))], "row_id long, y array<double>, mu array<double>, s array<double>")
    model = fits.fit(frame, FitConfig(inducing=4, latent=2, iterations=1), start=p)
    assert model.trace.rows[0][3] == pytest.approx(objective(x, None, 0.0)[0])


def test_what_parameters_and_rows_must_be():
    z = np.zeros((2, 1))
    for bad in ((z, -1.0, np.ones(1), 1.0), (z, 1.0, np.ones(2), 1.0), (z, 1.0, -np.ones(1), 1.0), (z[0], 1.0, np.ones(1), 1.0), (z, 1.0, np.ones(1), 0.0)):
        with pytest.raises(ValueError):
            Params(*bad)
    p = Params(z, 1.0, np.ones(1), 1.0)
    for mu, s in ((np.zeros((3, 1)), -np.ones((3, 1))), (np.zeros((3, 1)), np.ones((2, 1))), (np.zeros((3, 2)), np.ones((3, 2)))):
        with pytest.raises(ValueError):
            statistics.block(np.zeros((3, 1)), mu, s, p)


def test_initialisers(spark, curve):
    y = np.array([r.y for r in curve.orderBy("row_id").collect()])
    n, mean, cov = initialise.moments(curve, 3)
    assert n == 50 and mean == pytest.approx(y.mean(0)) and cov == pytest.approx(np.cov(y.T, bias=True))
    for rows in (initialise.pca(curve, 3, 2), initialise.ppca(curve, 3, 2), initialise.fa(curve, 3, 1)):
        mu = np.array([r.mu for r in rows.collect()])
        assert mu.std(0) == pytest.approx(np.ones(mu.shape[1])) and mu.mean(0) == pytest.approx(np.zeros(mu.shape[1]), abs=1e-9)
    u = np.linalg.svd(y - y.mean(0), full_matrices=False)[0][:, :2]
    mu = np.array([r.mu for r in initialise.pca(curve, 3, 2).orderBy("row_id").collect()])
    assert np.abs([np.corrcoef(u[:, k], mu[:, k])[0, 1] for k in range(2)]) == pytest.approx(np.ones(2))
    w, noise = initialise.ppca_weights(cov, 1)
    values = np.linalg.eigvalsh(cov)
    assert noise == pytest.approx(values[:2].mean()) and np.linalg.eigvalsh(w @ w.T + noise * np.eye(3))[-1] == pytest.approx(values[-1])
    assert initialise.inducing(initialise.pca(curve, 3, 2), 4).shape == (4, 2)
    s = [v for r in initialise.variances(curve, 2, 0, False).collect() for v in r.s]
    assert 0.4 < min(s) <= max(s) < 0.6
