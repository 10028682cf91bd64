"""Iterative operators against numpy, and recovery of planted structure."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill.core import Matrix, canonical
from sparsemill.functions import special, vector
from sparsemill.operators import annotate, edit, knn, mixture, network, pseudobulk, regression, simulate, spectral, stats
from sparsemill.plans import cohorts
from sparsemill.streaming import moments
from sparsemill.streaming.scores import streaming_sums


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (12, 30)).astype(float)
    x[:4, :15] += rng.poisson(6, (4, 15))
    x[4:8, 15:] += rng.poisson(6, (4, 15))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(30) if x[i, j]], "row_id long, col_id long, value double")
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "row_id long, row_name string")
    cols = spark.createDataFrame([(j, f"c{j}") for j in range(30)], "col_id long, col_name string")
    return x, Matrix(cells.persist(), rows, cols)


def normalized(x, target=1e4, tau=1.0):
    y = np.log1p(x * target / np.maximum(x.sum(0), 1))
    n2 = (y * y).sum(0)
    return y / np.sqrt(np.maximum(1, n2 + tau * n2.mean()))


def standardized(x):
    return (x - x.mean(0)) / np.maximum(x.std(0), 1e-8)


@pytest.mark.parametrize("how", [spectral.svd, spectral.svd_em])
def test_svd(small, how):
    x, m = small
    s = standardized(normalized(x))
    u, d, v, ids = how(m.triplets, m.rows, m.cols, 3, **({"rounds": 6} if how is spectral.svd else {"iterations": 5}))
    u0, d0, _ = np.linalg.svd(s, full_matrices=False)
    assert np.allclose(d[0], d0[0], rtol=5e-2) and (d <= d0[:3] * 1.001).all()
    assert np.linalg.norm(u[:, :1] @ u[:, :1].T - u0[:, :1] @ u0[:, :1].T) < 0.05
    got = np.array([r["v"] for r in v.orderBy("col_id").collect()])
    assert np.allclose(got, s.T @ u / d, atol=1e-6)
    again = spectral.project(m.triplets, m.cols, u, d, ids)
    assert np.allclose(np.array([r["v"] for r in again.orderBy("col_id").collect()]), got, atol=1e-6)
    side = got[:, 0] > 0
    assert side[:15].all() != side[15:].all() or (side[:15] != side[0]).sum() == 0


def test_svd_of_a_sample(spark, small):
    """All columns sampled: what svd gives. A third of the columns of a planted matrix: nearly the same space, and every
    column's projection on it."""
    x, m = small
    u, d, v, _ = spectral.svd_sampled(m.triplets, m.rows, m.cols, 2, 100)
    u0, d0, v0, _ = spectral.svd(m.triplets, m.rows, m.cols, 2)
    at = lambda t: np.array([r["v"] for r in t.orderBy("col_id").collect()])
    assert np.allclose(u, u0, atol=1e-6) and np.allclose(d, d0) and np.allclose(at(v), at(v0), atol=1e-6)
    rng = np.random.default_rng(5)
    y = rng.poisson(np.exp(1 + 0.8 * rng.normal(size=(40, 2)) @ rng.normal(size=(2, 300))).clip(0, 200)).astype(float)
    cells = spark.createDataFrame([(int(i), int(j), float(y[i, j])) for i, j in zip(*np.nonzero(y))], "row_id long, col_id long, value double")
    rows, cols = spark.range(40).withColumnRenamed("id", "row_id"), spark.range(301).withColumnRenamed("id", "col_id")
    exact = np.linalg.svd(standardized(normalized(y)), full_matrices=False)[0][:, :2]
    for by in ("cv", "random"):
        u, d, v, _ = spectral.svd_sampled(cells, rows, cols, 2, 100, by)
        assert np.linalg.svd(u.T @ exact)[1].min() > 0.97
        assert np.allclose(at(v)[:300], standardized(normalized(y)).T @ u / d, atol=1e-6) and v.count() == 301


def test_bbknn_of_a_matrix(spark, small):
    x, m = small
    batches = m.cols.select("col_id", (F.col("col_id") % 2).alias("batch"))
    for use_values in (False, True):
        got = spectral.bbknn_matrix(m.triplets, m.rows, m.cols, batches, 3, 6, use_values)
        u, d, v, ids = spectral.svd(m.triplets, m.rows, m.cols, 3)
        assert np.allclose([r["v"] for r in got["u"].orderBy("row_id").collect()], u, atol=1e-6) and np.allclose([r["value"] for r in got["d"].orderBy("factor").collect()], d)
        scale = d if use_values else 1.0
        known = {r["col_id"]: np.array(r["v"]) * scale for r in v.collect()}
        adjusted = {r["col_id"]: np.array(r["v"]) for r in got["factors_adjusted"].collect()}
        edges = got["knn"].collect()
        own = [(r["weight"], known[r["src"]] - known[r["tgt"]]) for r in edges if r["src"] % 2 == 1 and r["tgt"] % 2 == 0]
        shift = sum(w * x for w, x in own) / max(1.0, sum(w for w, _ in own))
        assert all(np.allclose(adjusted[i], known[i] - (shift if i % 2 else 0), atol=1e-6) for i in known)
        assert got["knn_adjusted"].count() > 0 and got["factors"].count() == 30


def test_rebuilt_matrix(spark, small):
    _, m = small
    u, d, v, ids = spectral.svd(m.triplets, m.rows, m.cols, 3)
    full = np.maximum(u * d @ np.array([r["v"] for r in v.orderBy("col_id").collect()]).T, 0) + 1e-4
    got = spectral.rebuilt(v, u, d, ids, [5, 2]).collect()
    assert len(got) == 60 and all(abs(r["value"] - full[r["row_id"], r["col_id"]]) < 1e-6 for r in got)


def test_overlap_and_scale(spark, small):
    x, m = small
    names = lambda *n: spark.createDataFrame([(a,) for a in n], "row_name string")
    assert edit.rows_overlap(m.rows, names("zz", "r3")) and not edit.rows_overlap(m.rows, names("zz")) and not edit.rows_overlap(m.rows, m.rows.where("row_id < 0"))
    got = {(r["row_id"], r["col_id"]): r["value"] for r in edit.scale_columns(m.triplets, spark.createDataFrame([(3, 2.0), (99, 5.0)], "col_id long, scale double")).collect()}
    assert all(v == x[i, j] * (2 if j == 3 else 1) for (i, j), v in got.items()) and len(got) == (x != 0).sum()


def test_log_bessel():
    """The series in exact fractions at orders 1 to 500, and a relation between orders beyond it."""
    from fractions import Fraction

    for v in (0, 1, 2, 7, 40, 150, 500):
        for x in (0.01, 1.0, 30.0, 400.0, 1500.0):
            term, total, k, q = Fraction(1), 0.0, 0, Fraction(x) ** 2 / 4
            logs = [0.0]
            while k < x + 60:
                k += 1
                logs.append(logs[-1] + math.log(float(q)) - math.log(k) - math.log(v + k))
            top = max(logs)
            want = v * math.log(x / 2) - math.lgamma(v + 1) + top + math.log(math.fsum(math.exp(a - top) for a in logs))
            assert abs(float(special.log_bessel_i(v, x)) - want) < 1e-8 * max(1, abs(want))
    for x in (2001.0, 5000.0, 1e6):  # I(v - 1) - I(v + 1) = 2 v / x I(v)
        for v in (1.0, 30.0, 400.0):
            a, b, c = (float(special.log_bessel_i(o, x)) for o in (v - 1, v, v + 1))
            assert abs(math.exp(a - b) - math.exp(c - b) - 2 * v / x) < 1e-8
    assert np.allclose(special.log_bessel_i([0.5], [3000.0]), 3000 - 0.5 * np.log(2 * np.pi * 3000) + np.log1p(-np.exp(-6000)), atol=1e-8)


def test_concentration_of_directions():
    for d in (3, 20, 500):
        for r in (0.05, 0.5, 0.95):
            k = float(special.concentration(r, d)[0])
            assert abs(math.exp(float(special.log_bessel_i(d / 2, k) - special.log_bessel_i(d / 2 - 1, k))) - r) < 1e-9
    assert special.concentration([0.0], 5)[0] == 0.0


def test_mixture_finds_planted_clusters(spark):
    """As EM in numpy from the same start; the likelihood never falls; edges without a cell, odd cells and names."""
    rng = np.random.default_rng(4)
    kind, rates = np.arange(150) % 3, np.full((3, 12), 0.3)
    for c in range(3):
        rates[c, 4 * c : 4 * c + 4] = 4.0
    y = rng.poisson(rates[kind]).astype(float)
    cells = spark.createDataFrame([(int(e), int(r), float(y[e, r])) for e, r in zip(*np.nonzero(y))] + [(0, 99, 7.0), (5, 2, None), (6, 2, -3.0), (777, 50, 1.0)], "edge_id long, row_id long, value double")
    rows = spark.range(14).withColumnRenamed("id", "row_id")
    got = mixture.poisson_mixture(cells, rows, 3, seed=3)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(got["trace"], got["trace"][1:])) and len(got["trace"]) > 2
    found = {r["edge_id"]: r for r in got["members"].collect()}
    alive = [e for e in range(150) if y[e].sum()]
    assert set(found) == set(alive)
    names = {c: np.bincount([kind[e] for e in alive if found[e]["cluster"] == c], minlength=3).argmax() for c in range(3)}
    assert sorted(names.values()) == [0, 1, 2] and np.mean([names[found[e]["cluster"]] == kind[e] for e in alive]) > 0.97
    lam = np.zeros((3, 14))
    for r in got["profiles"].collect():
        lam[r["cluster"], r["row_id"]] = r["rate"]
    full, share = np.hstack([y[alive], np.zeros((len(alive), 2))]), np.array([r["share"] for r in got["sizes"].orderBy("cluster").collect()])
    z = full @ np.log(lam).T - lam.sum(1) + np.log(share)
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    assert np.allclose([found[e]["probs"] for e in alive], z, atol=1e-9) and lam.min() > 0 and abs(share.sum() - 1) < 1e-9
    again = (z.T @ full + 1) / (1 + z.sum(0)[:, None])
    assert np.abs(again - lam).max() < 0.05  # the rates are those of the memberships
    assert mixture.poisson_mixture(cells.where("edge_id < 0"), rows, 3)["members"].count() == 0
    assert mixture.poisson_mixture(cells.where("edge_id < 2"), rows, 5, rounds=3)["sizes"].count() == 2


def test_columns_match_themselves(small):
    _, m = small
    got = spectral.match_columns(m.triplets, m.cols, m.triplets, m.rows, m.cols, 1, 4).collect()
    assert sum(r["src"] == r["tgt"] for r in got) >= 28


def test_batches_move_together(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 3))
    rows = [(i, "b", (base[i] + 1).tolist()) for i in range(15)] + [(100 + i, "a", base[i].tolist()) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, batch string, v array<double>")
    done, before, after = spectral.bbknn(v, 8, reciprocal_match=False)
    got = {r["id"]: np.array(r["v"]) for r in done.collect()}
    gap = lambda d: np.linalg.norm(np.mean([d[i] for i in range(15)], 0) - base.mean(0))
    assert gap(got) < gap({r[0]: np.array(r[2]) for r in rows}) and after.count() > 0 and before.count() > 0


def test_weights():
    assert knn.weights_of([3.0]) == [1.0] and knn.weights_of([]) == []
    w = knn.weights_of([0.0, 0.1, 0.2, 0.4, 0.9])
    assert w[0] == 1.0 and abs(sum(w) - math.log2(5)) < 0.2 and w == sorted(w, reverse=True)
    assert len(set(knn.weights_of([1.0, 1.0, 1.0]))) == 1


def test_knn_edge_cases(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    got = sorted((r["src"], r["tgt"], r["dist"]) for r in knn.knn(v, v, 10, block=1).collect())
    assert len(got) == 9 and got[0] == (1, 1, 0.0)
    assert {(r["src"], r["tgt"]) for r in knn.knn(v, v, 1).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_poisson_gamma(spark, small):
    x, m = small
    member = m.cols.select("col_id", F.when(F.col("col_id") < 15, "i1").otherwise("i2").alias("indv"), F.lit("ct").alias("label"), F.lit(1.0).alias("z"))
    got = pseudobulk.poisson_gamma(m.triplets, member, m.rows, rounds=4).collect()
    for name, part in (("i1", x[:, :15]), ("i2", x[:, 15:])):
        rho = np.ones(15)
        for _ in range(4):
            mu = (1 + part.sum(1)) / (1 + rho.sum())
            used, rho = 1 + rho.sum(), (1 + part.sum(0)) / (1 + mu.sum())
        want = (1 + part.sum(1)) / used
        found = {r["row_id"]: r["mu"] for r in got if r["indv"] == name}
        assert np.allclose([found[i] for i in range(12)], want)


def test_special_functions():
    assert abs(float(special.digamma(1.0)) + 0.5772156649015329) < 1e-9
    assert abs(float(special.lgamma(10.5)) - math.lgamma(10.5)) < 1e-9


def plain_poisson(y, x, reg=1e-4, rounds=5000):
    """One fit, coordinate by coordinate: the reweighted least squares of each, with the ridge, until nothing moves."""
    x = np.column_stack([(x - x.mean(0)) / np.maximum(x.std(0), 1e-2), np.ones(len(x))])
    b = np.r_[np.zeros(x.shape[1] - 1), np.log(max(y.mean(), 1e-3))]
    for _ in range(rounds):
        old = b.copy()
        for j in range(len(b)):
            w = np.exp(x @ b)
            b[j] += (x[:, j] @ (y - w) - reg * b[j]) / (x[:, j] ** 2 @ w + reg)
        if np.abs(b - old).max() < 1e-12:
            break
    return np.exp(x @ b)


def test_poisson_fits_of_planted_slopes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 400, 2))
    y = rng.poisson(np.exp(0.5 + 0.8 * x[:, :, 0] - 0.3 * x[:, :, 1])).astype(float)
    b = regression.poisson_fits(np.concatenate([x, np.ones((3, 400, 1))], 2), y, np.ones((3, 400)), 1e-4)
    assert np.abs(b - [0.8, -0.3, 0.5]).max() < 0.12
    huge = regression.poisson_fits(np.ones((1, 5, 1)), np.full((1, 5), 1e6), np.ones((1, 5)), 1e-8)
    assert abs(huge[0, 0] - np.log(1e6)) < 1e-6  # a start far away


@pytest.mark.parametrize("k", [1, 3])
def test_counterfactual_regression(spark, k):
    """Column by column as numpy; sparse columns, one without a cell, a row without any, fewer columns than neighbours."""
    rng = np.random.default_rng(6)
    y, v = rng.poisson(1.5, (25, 24)).astype(float), rng.normal(size=(24, 3))
    y[:, 3], y[7], trt = 0, 0, [i % 3 if i < 22 else 0 for i in range(24)]
    cells = spark.createDataFrame([(r, c, float(y[r, c])) for r in range(25) for c in range(24) if y[r, c]] + [(999, 0, 5.0)], "row_id long, col_id long, value double")
    vectors = spark.createDataFrame([(i, x.tolist(), t) for i, (x, t) in enumerate(zip(v, trt))], "id long, v array<double>, trt int")
    got = {(r["col_id"], r["row_id"]): r["value"] for r in pseudobulk.counterfactual(cells, vectors, "trt", k, by="regression", rows=spark.range(25).withColumnRenamed("id", "row_id")).collect()}
    assert len(got) == 24 * 25
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    for i in range(24):
        near = [j for t in sorted({0, 1, 2} - {trt[i]}) for j in sorted((j for j in range(24) if trt[j] == t), key=lambda j: d[i, j])[:k]]
        want = plain_poisson(y[:, i], np.log(y[:, near] + 1))
        assert np.allclose([got[i, r] for r in range(25)], want, rtol=1e-4, atol=1e-5 if i != 3 else 1e-3), i
    two = vectors.where("trt < 2 and id < 2")
    alone = {(r["col_id"], r["row_id"]): r["value"] for r in pseudobulk.counterfactual(cells, two, "trt", 4, by="regression", rows=spark.range(25).withColumnRenamed("id", "row_id")).collect()}
    assert [alone[0, r] for r in range(25)] == y[:, 1].tolist()
    assert pseudobulk.counterfactual(cells, vectors.where("trt = 1"), "trt", 4, by="regression", rows=spark.range(25).withColumnRenamed("id", "row_id")).count() == 0


def test_least_squares_of_several_responses(spark):
    """Collinear and constant covariates, nulls and NaN, a null group, a group of one row and one without a whole row."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) + 1e4
    x[:, 2] = 2 * x[:, 0] - x[:, 1]
    y = rng.normal(size=(300, 2)) + x[:, :1] * [[1.0, -2.0]]
    group = ["a"] * 150 + [None] * 148 + ["one", "none"]
    rows = [(i, g, *map(float, y[i]), *map(float, x[i]), 7.0) for i, g in enumerate(group)]
    rows[3] = (3, "a", None, *rows[3][3:])
    rows[5] = (5, "a", *rows[5][2:4], float("nan"), *rows[5][5:])
    rows[299] = (299, "none", 1.0, 2.0, None, 1.0, 1.0, 7.0)
    df = spark.createDataFrame(rows, "id int, g string, y0 double, y1 double, x0 double, x1 double, x2 double, c double")
    for keys in (["g"], []):
        got = {r["id"]: r for r in regression.least_squares(df, keys, ["y0", "y1"], ["x0", "x1", "x2", "c"]).collect()}
        assert len(got) == 300
        for g in (["a", None] if keys else [0]):
            for j in range(2):
                at = [i for i in range(299) if (not keys or group[i] == g) and i != 5 and not (i == 3 and j == 0)]
                design = np.column_stack([x[at] - 1e4, np.ones(len(at))])
                want = design @ np.linalg.lstsq(design, y[at, j], rcond=None)[0]
                assert np.allclose([got[i][f"fitted_y{j}"] for i in at], want, atol=1e-6)
                assert np.allclose([got[i][f"residual_y{j}"] for i in at], y[at, j] - want, atol=1e-6)
        assert got[3]["fitted_y0"] is None and got[3]["fitted_y1"] is not None and got[5]["fitted_y1"] is None and got[299]["fitted_y0"] is None
    assert abs(regression.least_squares(df, ["g"], ["y0"], ["x0"]).where("id = 298").first()["residual_y0"]) < 1e-9
    assert regression.least_squares(df.where("id < 0"), ["g"], ["y0"], ["x0"]).count() == 0 and regression.least_squares(df.where("id < 0"), [], ["y0"], ["x0"]).count() == 0


def test_annotation_finds_planted_types(spark, small):
    _, m = small
    marks = spark.createDataFrame([("one", i) for i in range(4)] + [("two", i) for i in range(4, 8)], "label string, row_id long")
    bad = spark.createDataFrame([(3,)], "col_id long")
    for sample in (False, True):
        got = {r["col_id"]: r["argmax"] for r in annotate.annotate(m.triplets, m.cols, marks, disqualified=bad, sample=sample).collect()}
        assert got[3] == "Incomplete"
        assert sum(got[j] == ("one" if j < 15 else "two") for j in range(30) if j != 3) >= 27


def test_counterfactual_and_pairs(spark, small):
    x, m = small
    v = spark.createDataFrame([(j, [float(j % 15), 0.0], int(j >= 15)) for j in range(30)], "id long, v array<double>, trt int")
    got = {(r["row_id"], r["col_id"]): r["value"] for r in pseudobulk.counterfactual(m.triplets, v, "trt", 1).collect()}
    assert all(abs(got.get((i, j), 0.0) - x[i, (j + 15) % 30]) < 1e-9 for i in range(12) for j in range(30))
    member = m.cols.select("col_id", (F.col("col_id") >= 15).cast("long").alias("indv"), F.lit("ct").alias("label"), F.lit(1.0).alias("z"))
    pairs = spark.createDataFrame([(0, 1)], "src long, tgt long")
    delta = pseudobulk.pairwise_delta(m.triplets, member, v.select("id", "v"), pairs, 1).collect()
    want = x[:, :15].sum(1) - x[:, 15:].sum(1)
    assert all(abs(r["sum_delta"] - want[r["row_id"]]) < 1e-6 and abs(r["mean_delta"] - want[r["row_id"]] / 15) < 1e-6 and r["nobs"] == 2 for r in delta) and len(delta) == 12


def test_cohort_plans(spark, small):
    _, m = small
    typed = m.cols.select("col_name", F.lit("t").alias("label"))
    owner = m.cols.select("col_name", (F.col("col_id") % 4).cast("string").alias("indv")).where("col_name <> 'c0'")
    aligned = cohorts.align(m.cols, typed, owner, spark.createDataFrame([(str(i), "case" if i < 2 else "control") for i in range(4)], "indv string, exposure string"))
    assert {r["indv"] for r in aligned.where("col_id = 0").collect()} == {"NA"}
    latent = spark.createDataFrame([(j, [math.sin(j), math.cos(j)]) for j in range(30)], "id long, v array<double>")
    out = cohorts.cocoa(m, aligned, latent, k=3, rounds=2)
    assert all(out[k].count() > 0 for k in ("bulk", "mu", "cf"))
    out = cohorts.pine(m, aligned.where("indv <> 'NA'"), latent, 3)
    assert out["pairs"].count() >= 2 and out["delta"].count() > 0


def test_simulation(spark):
    mu = np.array([[1.0, 6.0], [3.0, 0.5]])
    cells, owner = simulate.simulate_poisson(spark, mu, [1.0], 2000, [0] * 1000 + [1] * 1000, seed=3)
    means = {(r["row_id"], r["g"]): r["s"] / 1000 for r in cells.withColumn("g", (F.col("col_id") > 1000).cast("int")).groupBy("row_id", "g").agg(F.sum("value").alias("s")).collect()}
    assert all(abs(means[i + 1, g] - mu[i, g]) < 0.25 for i in range(2) for g in range(2)) and owner.count() == 2000
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, simulate.simulate_poisson(spark.newSession(), mu, [1.0], 2000, [0] * 1000 + [1] * 1000, seed=3)[0].repartition(3).collect()))
    one = simulate.simulate_individuals(200, 20, pve1=0.6, pve_covar=0.1, seed=1)
    diff = np.abs(one["ln_mu"][one["exposure"] == 1].mean(0) - one["ln_mu"][one["exposure"] == 0].mean(0))
    assert diff[one["causal"]].mean() > np.delete(diff, one["causal"]).mean()
    geno = np.random.default_rng(0).integers(0, 3, (300, 10))
    two = simulate.simulate_eqtl(geno, 8, h2=0.6)
    assert all(abs(np.corrcoef(two["y"][:, g], geno[:, s])[0, 1]) > 0.3 for g, s in zip(two["genes"], two["snps"]))
    fitted, resid = simulate.safe_lm(geno[:, :2] * 1.0, np.column_stack([geno[:, 2], geno[:, 2]]))
    assert np.allclose(fitted + resid, geno[:, :2]) and np.allclose(resid.T @ np.ones(300), 0)


def test_edit_edge_cases(spark):
    cells = spark.createDataFrame([(1, 1, 1.0), (1, 1, -1.0), (2, 3, 5.0), (1, 3, 2.0)], "row_id long, col_id long, value double")
    names = spark.createDataFrame([(i, f"c{i}") for i in (1, 2, 3)], "col_id long, col_name string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, row_name string")
    m = Matrix(canonical(cells), rows, names)
    assert m.triplets.count() == 2
    assert edit.select_columns(m, spark.createDataFrame([("none",)], "col_name string")).triplets.count() == 0
    only = edit.select_rows(m, spark.createDataFrame([("b",)], "row_name string"))
    assert [tuple(r) for r in only.triplets.collect()] == [(0, 0, 5.0)] and [r["col_name"] for r in only.cols.collect()] == ["c3"]
    assert [tuple(r) for r in edit.column_index(m.triplets, names).orderBy("col_id").collect()] == [(1, 0, 0), (2, 0, 0), (3, 0, 2)]
    fixed = edit.merge([("x", m), ("y", m)], 0, fixed_rows=spark.createDataFrame([(1, "b"), (2, "zz")], "row_id long, row_name string"))
    assert fixed.cols.count() == 6 and fixed.rows.count() == 2 and fixed.triplets.count() == 2
    assert edit.read_columns(m.triplets, []).count() == 0
    assert [r["values"] for r in edit.read_columns_dense(m.triplets, rows, [3, 9]).orderBy("row_id").collect()] == [[2.0, 0.0], [5.0, 0.0]]
    assert edit.stack(m.triplets, m.triplets, 10).agg(F.max("row_id")).first()[0] == 12
    assert stats.laplacian(m.triplets, None, weights=spark.createDataFrame([(1, 4.0), (2, 0.0)], "row_id long, weight double")).where("value = 0").count() == 1


def test_edge_names_and_vectors(spark):
    edges = spark.createDataFrame([(1, 1, 2)], "edge_id long, src long, tgt long")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "col_id long, col_name string")
    assert network.edge_names(edges, names).first()["edge_name"] == "a_b"
    r = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "x array<double>, y array<double>").select(
        vector.dot(F.col("x"), F.col("y")).alias("d"), vector.squared_distance(F.col("x"), F.col("y")).alias("q"), vector.unit(F.col("x")).alias("u"), vector.softmax(F.col("y")).alias("s"), vector.upper_median(F.col("x")).alias("m"), vector.softplus(F.lit(0.0)).alias("p"), vector.finite_or_zero(F.lit(float("nan"))).alias("z")).first()
    assert (r["d"], r["q"], r["u"], r["m"], r["z"]) == (11.0, 8.0, [0.6, 0.8], 4.0, 0.0) and abs(sum(r["s"]) - 1) < 1e-12 and abs(r["p"] - math.log(2)) < 1e-12


def test_stream_of_cells(spark, small, tmp_path):
    x, m = small
    m.triplets.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, col_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["row_id"]: r["sum"] for r in spark.sql("select * from sums").collect()}
    assert np.allclose([got[i] for i in range(12)], x.sum(1))


def test_moments_over_a_stream(spark, tmp_path):
    """Values around 1e9, late parts of cells, a key that a batch does not touch, nulls; after each batch as numpy's."""
    rng = np.random.default_rng(3)
    batches = [[(int(r), int(c), 1e9 + float(rng.normal())) for r, c in zip(rng.integers(0, 4, 200), rng.integers(0, 90, 200)) if b < 2 or r < 3] for b in range(3)]
    batches[1] += [(None, 1, 5.0), (2, None, 5.0), (9, 9, 4.0)]
    batches[2] += [(r, c, -1e9) for r, c, _ in batches[0][:15] if r < 3]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "row_id long, col_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in" / str(b)))
    with moments.state_store(spark):
        stream = moments.streaming_moments(spark.readStream.schema("row_id long, col_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
        run = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        run.awaitTermination()
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert {r["row_id"]: r["v"] for r in versions.groupBy("row_id").agg(F.max("version").alias("v")).collect()} == {0: 3, 1: 3, 2: 3, 3: 2, 9: 1}
    cells = {}
    for r, c, x in (x for b in batches for x in b if None not in x):
        cells[r, c] = cells.get((r, c), 0.0) + x
    got = {r["row_id"]: r for r in moments.latest(versions).collect()}
    for r in (0, 1, 2, 3, 9):
        x = np.array([v for (a, _), v in cells.items() if a == r])
        assert got[r]["n"] == len(x) and abs(got[r]["mean"] - x.mean()) < 1e-6 * max(1, abs(x.mean()) * 1e-9 * 1e6)
        assert got[r]["var"] is None if len(x) == 1 else abs(got[r]["var"] / x.var(ddof=1) - 1) < 1e-6


def test_moments_merge():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=50) + 1e9, rng.normal(size=7) * 5 + 1e9
    both = moments.merged(moments.of_values(x), moments.of_values(y))  # a mean near 1e9 is a multiple of 1e-7
    assert both[0] == 57 and abs(both[2] / ((np.r_[x, y] - np.r_[x, y].mean()) ** 2).sum() - 1) < 1e-7
    after = moments.replaced(moments.of_values(x), x[3], x[3] + 40)
    x[3] += 40
    assert abs(after[2] / ((x - x.mean()) ** 2).sum() - 1) < 1e-6 and moments.merged((0, 0.0, 0.0), both) == both == moments.merged(both, (0, 0.0, 0.0))


@pytest.mark.parametrize("most", [100_000, 1_000])
def test_many_checks_all_count(spark, monkeypatch, most):
    monkeypatch.setattr(network, "BROADCAST_CHECKS", most)
    n = 12_000
    checks = spark.range(n).select(F.col("id").alias("row_id"), F.lit(1.0).alias("threshold"))
    cells = spark.range(3 * n).select((F.col("id") % n).alias("row_id"), F.floor(F.col("id") / n).alias("col_id"), F.when(F.col("id") == n + 11_999, 0.5).otherwise(2.0).alias("value"))
    cells = cells.where(f"not (col_id = 2 and row_id = {n - 5})")
    cols = spark.range(4).withColumnRenamed("id", "col_id")
    assert sorted(r["col_id"] for r in network.disqualified(cells, cols, checks).collect()) == [1, 2, 3]


def plain_annotation(x, sets, anti, d, kappa_max=100.0, iterations=100, tol=1e-4):
    """x: rows by columns; sets and anti: for each set a rows by labels 0/1 matrix."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=0, keepdims=True), 1e-8)
    own = [unit(x * (s.sum(1, keepdims=True) > 0)) for s in sets]
    mu, mu0, kap, kap0, trace = [unit(s) for s in sets], [unit(s) for s in anti], [1.0] * len(sets), [1.0] * len(sets), []
    score = lambda: sum(k * m.T @ o - k0 * m0.T @ o for m, m0, k, k0, o in zip(mu, mu0, kap, kap0, own))
    for it in range(iterations):
        s = score()
        best = np.round(s, 12).argmax(0)
        trace.append(s.max(0).mean())
        z = np.eye(s.shape[0])[best]
        for a, o in enumerate(own):
            up, down = (o @ z) * sets[a], (o @ z) * anti[a]
            r, r0 = (min(np.linalg.norm(m.sum(1)) / x.shape[1], 1 - 1e-6) for m in (up, down))
            mu[a], mu0[a], kap[a], kap0[a] = unit(up), unit(down), min(r * (d - r * r) / (1 - r * r), kappa_max), min(r0 * (d - r0 * r0) / (1 - r0 * r0), kappa_max)
        if it > 4 and abs(sum(trace[it - 3 : it - 1]) - sum(trace[it - 1 : it + 1])) / (abs(sum(trace[it - 3 : it - 1])) + tol) < tol:
            break
    s = score()
    p = np.exp(s - s.max(0))
    return p / p.sum(0), mu, mu0, kap, kap0, own, s.argmax(0)


def test_posterior_of_two_sets_with_counter_markers(spark):
    """Posteriors, directions and concentrations as numpy's, in which planted types come out."""
    rng = np.random.default_rng(12)
    kind, rows, labels = np.arange(90) % 3, 24, ["a", "b", "c"]
    sets, anti = [np.zeros((rows, 3)), np.zeros((rows, 3))], [np.zeros((rows, 3)), np.zeros((rows, 3))]
    for k in range(3):
        sets[0][4 * k : 4 * k + 5, k] = 1  # neighbours share a row
        sets[1][14 + 3 * k : 17 + 3 * k, k] = 1
        anti[0][4 * ((k + 1) % 3) : 4 * ((k + 1) % 3) + 2, k] = 1
    x = rng.poisson(0.7, (rows, 90)).astype(float) + (sets[0] + sets[1])[:, kind] * rng.poisson(4, (rows, 90))
    x[23] = 50.0  # no marker
    long = lambda ms: spark.createDataFrame([(labels[k], int(r), a) for a, m in enumerate(ms) for r, k in zip(*np.nonzero(m))] * 2, "label string, row_id long, set int")
    cells = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(rows) for c in range(90) if x[r, c]] + [(23, 90, 1.0), (0, 91, 3.0)], "row_id long, col_id long, value double")
    cols, bad = spark.range(93).withColumnRenamed("id", "col_id"), spark.createDataFrame([(91,), (None,)], "col_id long")
    marks = long(sets).unionByName(spark.createDataFrame([(None, 1, 0), ("a", None, 0)], "label string, row_id long, set int"))
    got = annotate.annotation(cells, cols, marks, long(anti), bad)
    d = len({r for m in (*sets, *anti) for r in np.nonzero(m)[0]})
    p, mu, mu0, kap, kap0, own, best = plain_annotation(x, sets, anti, d)
    found = np.zeros((3, 90))
    for r in got["posterior"].collect():
        found[labels.index(r["label"]), r["col_id"]] = r["prob"]
    assert np.allclose(found, p, atol=1e-9)
    table = {r["col_id"]: r for r in got["annotation"].collect()}
    assert len(table) == 93 and {i for i, r in table.items() if r["argmax"] == "Incomplete"} == {90, 91, 92}
    assert all(table[i]["argmax"] == labels[best[i]] and abs(table[i]["max_prob"] - p[:, i].max()) < 1e-9 for i in range(90))
    assert np.mean([table[i]["argmax"] == labels[kind[i]] for i in range(90)]) > 0.95
    assert {r["set"]: (round(r["kappa"], 9), round(r["kappa_anti"], 9)) for r in got["kappas"].collect()} == {a: (round(kap[a], 9), round(kap0[a], 9)) for a in range(2)}
    for r in got["parameters"].collect():
        k = labels.index(r["label"])
        assert abs(r["mu"] - mu[r["set"]][r["row_id"], k]) < 1e-9 and abs(r["mu_anti"] - mu0[r["set"]][r["row_id"], k]) < 1e-9
        assert abs(r["mean"] - own[r["set"]][r["row_id"]][best == k].mean()) < 1e-9


def test_labels_without_a_cell_can_win(spark):
    """A column whose only markers speak against its labels goes to the first label that has none of them."""
    marks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "label string, row_id long")
    anti = spark.createDataFrame([("a", 1)], "label string, row_id long")
    cells = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "row_id long, col_id long, value double")
    got = annotate.annotation(cells, spark.range(3).withColumnRenamed("id", "col_id"), marks, anti, iterations=0)
    assert [(r["argmax"], round(r["max_prob"], 6)) for r in got["annotation"].orderBy("col_id").collect()] == [("a", 0.25), ("b", round(math.e / (math.e + 3), 6)), ("Incomplete", 0.0)]
    anti = anti.unionByName(spark.createDataFrame([("a", 2)], "label string, row_id long"))
    cells = cells.unionByName(spark.createDataFrame([(2, 0, 1.0)], "row_id long, col_id long, value double")).where("not (row_id = 2 and col_id = 1)")
    got = annotate.annotation(cells.where("row_id = 2"), spark.range(1).withColumnRenamed("id", "col_id"), marks.where("label <> 'b'").unionByName(spark.createDataFrame([("c", 2)], "label string, row_id long")), anti, iterations=0)
    assert got["annotation"].first()["argmax"] == "c"
    none = annotate.annotation(cells, spark.range(2).withColumnRenamed("id", "col_id"), marks.where("row_id > 9"))
    assert {r["argmax"] for r in none["annotation"].collect()} == {"Incomplete"} and none["posterior"].count() == 0


def test_many_markers(spark):
    n = 40_000
    marks = spark.range(n).select(F.concat(F.lit("t"), F.col("id") % 3).alias("label"), F.col("id").alias("row_id"))
    cells = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 3).alias("col_id"), F.lit(1.0).alias("value"))
    got = {r["col_id"]: r["argmax"] for r in annotate.annotate(cells, cells.select("col_id").distinct(), marks, iterations=6).collect()}
    assert got == {0: "t0", 5: "t1", 2: "t2"}


def test_annotation_of_factors(spark, small):
    x, m = small
    u, d, v, ids = spectral.svd(m.triplets, m.rows, m.cols, 3, rounds=6)
    marks = spark.createDataFrame([("one", i) for i in range(4)] + [("two", i) for i in range(4, 8)] + [("two", 77)], "label string, row_id long")
    got = {r["col_id"]: r["argmax"] for r in annotate.annotate_factors(u, d, v, ids, m.cols, marks)["annotation"].collect()}
    assert sum(got[i] == ("one" if i < 15 else "two") for i in range(30)) >= 29


class Kept:
    """A state that counts how often it is read and written."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, at):
        self.calls += 1
        return self.rows.get(at)

    def updateValue(self, at, value):
        self.calls += 1
        self.rows[at] = value

    def getValueState(self, name, *kind):
        return self.__dict__.setdefault(name, Kept())

    getMapState = getValueState


@pytest.mark.parametrize("block, portion, most", [(8192, 1 << 19, 40), (50, 700, 10_000)])
def test_moments_read_and_write_blocks(monkeypatch, block, portion, most):
    """One key with most of 6,000 cells and others, named by text, in three batches with late parts: few calls of the state;
    small blocks that are split and batches taken in by portions give the same moments, and one version a batch."""
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(moments, "BLOCK_ROWS", block)
    monkeypatch.setattr(moments, "PACKED_ROWS", portion)
    rng, kept, of, cells, last = np.random.default_rng(6), Kept(), moments.Moments("k"), {}, {}
    of.init(kept)
    for batch in range(3):
        n = 2500
        names = ["hot" if x < 0.8 else f"k{int(x * 1000)}" for x in rng.random(n)]
        table = pa.table({"key": names, "hash": pa.array([hash(x) for x in names], "int64"), "cell": pa.array(rng.integers(0, 4000, n)), "value": rng.integers(1, 50, n) + 1e6})
        packs = [moments._packed(table.slice(lo, 100)) for lo in range(0, n, 100)]
        out = pd.concat(list(of.handleInputRows((3,), iter([pd.DataFrame({"pack": packs[:9], "rows": 100}), pd.DataFrame({"pack": packs[9:], "rows": 100})]), None)))
        for k, c, v in zip(names, table["cell"].to_pylist(), table["value"].to_pylist()):
            cells.setdefault(k, {})[c] = cells.get(k, {}).get(c, 0.0) + v
        assert sorted(out["k"]) == sorted(set(names))
        for r in out.itertuples(index=False):
            last[r.k] = last.get(r.k, 0) + 1
            x = np.array(list(cells[r.k].values()))
            assert (r.version, r.n) == (last[r.k], len(x)) and abs(r.mean - x.mean()) < 1e-6
            assert np.isnan(r.var) if len(x) == 1 else abs(r.var - x.var(ddof=1)) <= 1e-9 * x.var(ddof=1) + 1e-3
    assert sum(s.calls for s in (kept.sizes, kept.cells, kept.keys)) <= most
    if block == 50:
        assert len(kept.cells.rows) > 60 and max(len(moments._table([r[0]])) for r in kept.cells.rows.values()) < 3 * block
