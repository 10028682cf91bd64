"""Queries that SQL cannot express, held against numpy over the whole small tables; rates beside plain formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill import catalog
from sparsemill.operators import knn, pseudobulk
from sparsemill.operators.knn import weights_of


@pytest.fixture(scope="module")
def embedded(spark, sf):
    rows = sorted(catalog.vectors(spark, sf).collect(), key=lambda r: r["id"])
    v = np.array([r["v"] for r in rows])
    return [r["id"] for r in rows], v, np.array([r["batch"] for r in rows]), np.round(np.exp(v) * 1024) / 1024


def standardised(cells):
    """Columns to 10,000, ln(1 + x), scaled by their lengths and centred, features by columns."""
    x = np.log1p(cells / np.maximum(cells.sum(1), 1)[:, None] * 1e4)
    n2 = (x * x).sum(1)
    x = x / np.sqrt(np.maximum(1, n2 + n2.mean()))[:, None]
    return ((x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-8)).T


@pytest.mark.parametrize("name", ["svd_approx", "svd_em", "svd_project"])
def test_factors_span_what_numpy_finds(spark, sf, embedded, name):
    ids, _, _, cells = embedded
    got = {r["col_id"]: r["v"] for r in catalog.queries()[name](spark, sf).collect()}
    mine = np.array([got[i] for i in ids])
    x = standardised(cells)
    d = np.linalg.svd(x, compute_uv=False)
    q, _ = np.linalg.qr(mine)
    # the vectors' spectrum is flat, so that what a space holds is told apart sooner than its directions
    assert mine.shape == (len(ids), 5) and ((x @ q) ** 2).sum() >= 0.97 * (d[:5] ** 2).sum()


@pytest.mark.parametrize("name", ["knn_weights", "knn_reweighted"])
def test_weights_of_each_source(spark, sf, name):
    near = {}
    for r in catalog.queries()[name](spark, sf).collect():
        near.setdefault(r["src"], []).append((r["dist"], r["tgt"], r["weight"]))
    assert near and all(np.allclose([w for *_, w in sorted(x)], weights_of([d for d, *_ in sorted(x)])) for x in near.values())


def test_counterfactual_is_a_weighted_mean(spark, sf, embedded):
    ids, v, batch, cells = embedded
    got = {}
    for r in catalog.counterfactual(spark, sf).collect():
        got.setdefault(r["col_id"], {})[r["row_id"]] = r["value"]
    d = ((v[:, None, :] - v[None]) ** 2).sum(2)
    for i, c in enumerate(ids):
        other = np.flatnonzero(batch % 2 != batch[i] % 2)
        near = sorted(other, key=lambda j: (round(d[i, j], 10), ids[j]))[:5]
        w = np.array(weights_of([d[i, j] for j in near]))
        want = w @ cells[near] / w.sum()
        assert np.allclose([got[c][k] for k in range(64)], want, atol=1e-6)


def test_batches_are_shifted_as_wholes(spark, sf, embedded):
    ids, v, batch, _ = embedded
    got = {r["id"]: r["v"] for r in catalog.bbknn(spark, sf).collect()}
    moved = np.array([got[i] for i in ids]) - v
    for b in range(3):
        own = moved[batch % 3 == b]
        assert np.allclose(own, own[0], atol=1e-9)


def test_columns_match_themselves(spark, sf):
    best = {}
    for r in catalog.match_files(spark, sf).collect():
        best[r["src"]] = min(best.get(r["src"], (9.0, 0)), (round(r["dist"], 8), r["tgt"]))
    assert sum(best[i][1] == i for i in best) >= 0.95 * len(best)


def test_labels_are_among_those_marked(spark, sf):
    rows = catalog.annotate(spark, sf).collect()
    assert {r["argmax"] for r in rows} <= {f"type{i}" for i in range(4)} | {"Incomplete"}
    assert all(0.25 <= r["max_prob"] <= 1 + 1e-9 and abs(math.log(r["max_prob"]) - r["max_ln_prob"]) < 1e-9 for r in rows if r["argmax"] != "Incomplete")


def test_means_over_matches_of_two_levels(spark):
    """Weights between individuals times those between columns, against numpy; a null value does not count."""
    rng = np.random.default_rng(9)
    n, who = 24, np.repeat(np.arange(4), 6)
    x, y = rng.normal(size=(n, 3)) + who[:, None] * 0.3, rng.integers(0, 5, (5, n)).astype(float)
    v = spark.createDataFrame([(i, x[i].tolist(), f"p{who[i]}") for i in range(n)], "id long, v array<double>, indv string")
    cells = spark.createDataFrame([(g, j, float(y[g, j])) for g in range(5) for j in range(n) if y[g, j]], "row_id long, col_id long, value double")
    member = spark.createDataFrame([(j, f"p{who[j]}", "ct", 1.0) for j in range(n)], "col_id long, indv string, label string, z double")
    matches = knn.match_groups(v, "indv", 2, True)
    found = {(r["src"], r["tgt"]): (r["dist"], r["weight"]) for r in matches.collect()}
    sums = np.array([x[who == k].sum(0) for k in range(4)])
    prof = sums / np.linalg.norm(sums, axis=0)
    prof /= np.linalg.norm(prof, axis=1, keepdims=True)
    got = {(r["src"], r["row_id"]): r["sum_delta"] for r in pseudobulk.over_matches(pseudobulk.pairwise_delta(cells, member, v.select("id", "v"), matches.select("src", "tgt"), 3), matches, "sum_delta", "mean_delta").collect()}
    for a in range(4):
        near = sorted((round(1 - prof[a] @ prof[b], 10), b) for b in range(4) if b != a)[:2]
        w = knn.weights_of([1 - prof[a] @ prof[b] for _, b in near])
        assert all(np.allclose(found[f"p{a}", f"p{b}"], (d, u)) for (d, b), u in zip(near, w))
        deltas = []
        for _, b in near:
            other = np.zeros((5, 6))
            for i, j in enumerate(np.flatnonzero(who == a)):
                d = ((x[who == b] - x[j]) ** 2).sum(1)
                at = np.argsort(d)[:3]
                u = np.array(knn.weights_of(d[at]))
                other[:, i] = y[:, np.flatnonzero(who == b)[at]] @ u / u.sum()
            deltas.append((y[:, who == a] - other).sum(1))
        want = (w[0] * deltas[0] + w[1] * deltas[1]) / sum(w)
        assert all(abs(got[f"p{a}", g] - want[g]) < 1e-9 for g in range(5))
    covar = {(r["src"], r["tgt"]): r["v"] for r in pseudobulk.matched_covariates(knn.group_profiles(v, "indv"), matches).collect()}
    assert all(np.allclose(d, prof[int(s[1])] - prof[int(t[1])]) for (s, t), d in covar.items()) and len(covar) == 8


def test_rates_of_pairs(spark):
    """pairwise_rates beside the same rounds in numpy, for one pair of individuals and two labels."""
    rng = np.random.default_rng(5)
    y = rng.poisson(3.0, (4, 12)).astype(float)
    cells = spark.createDataFrame([(g, j, float(y[g, j])) for g in range(4) for j in range(12) if y[g, j]], "row_id long, col_id long, value double")
    who = spark.createDataFrame([(j, "a" if j < 6 else "b", "t1" if j % 2 else "t2", 1.0) for j in range(12)], "col_id long, indv string, label string, z double")
    v = spark.createDataFrame([(j, [float(j % 6), 0.0]) for j in range(12)], "id long, v array<double>")
    pairs = spark.createDataFrame([("a", "b")], "src string, tgt string")
    got = {(r["row_id"], r["label"]): r for r in pseudobulk.pairwise_rates(cells, who, v, pairs, spark.range(4).withColumnRenamed("id", "row_id"), k=1, rounds=6).collect()}
    own, other, labels = y[:, :6], y[:, 6:], np.array(["t1" if j % 2 else "t2" for j in range(6)])
    z = np.array([labels == "t1", labels == "t2"], float)
    zy, rho, rho2 = z @ (own + other).T, np.ones(6), np.ones(6)
    for _ in range(6):
        mu = (1 + zy) / (1 + z @ (rho + rho2))[:, None]
        rho, rho2 = ((1 + x.sum(0)) / (1 + z.T @ mu.sum(1)) for x in (own, other))
    zo, rest = z @ own.T, np.ones(6)
    for _ in range(6):
        delta = (1 + zo) / (1 + (z @ rest)[:, None] * mu)
        rest = (1 + own.sum(0)) / (1 + z.T @ (delta * mu).sum(1))
    delta = (1 + zo) / (1 + (z @ rest)[:, None] * mu)
    assert len(got) == 8
    for k, label in enumerate(("t1", "t2")):
        for g in range(4):
            assert abs(got[g, label]["mu"] - mu[k, g]) < 1e-6 and abs(got[g, label]["delta"] - delta[k, g]) < 1e-6 and (got[g, label]["src"], got[g, label]["tgt"]) == ("a", "b")


def test_checks_on_unit_columns(spark):
    from sparsemill.operators import network

    cells = spark.createDataFrame([(0, 0, 3.0), (1, 0, 4.0), (0, 1, 1.0), (5, 1, 99.0)], "row_id long, col_id long, value double")
    marks = spark.createDataFrame([(0,), (1,)], "row_id long")
    unit = {(r["row_id"], r["col_id"]): r["value"] for r in network.unit_columns(cells, marks).collect()}
    assert {k: round(x, 9) for k, x in unit.items()} == {(0, 0): 0.6, (1, 0): 0.8, (0, 1): 1.0}
    checks = spark.createDataFrame([(0, 0.7)], "row_id long, threshold double")
    cols = spark.range(2).withColumnRenamed("id", "col_id")
    assert [r["col_id"] for r in network.disqualified(network.unit_columns(cells, marks), cols, checks).collect()] == [0]
    assert network.disqualified(cells, cols, checks).count() == 0


def test_parts_of_topic_data(spark, sf):
    from sparsemill.operators import network

    v = catalog.vectors(spark, sf)
    names = v.select(F.col("id").alias("col_id"), F.concat(F.lit("v"), "id").alias("col_name"))
    got = network.topic_data(catalog._embedded(spark, sf), names, v.select("id", "batch", "v"), 10)
    edges = got["edges"].count()
    assert edges and got["names"].count() == edges and got["vertices"].count() == 2 * edges
    assert {r["edge_id"] for r in got["features"].select("edge_id").distinct().collect()} <= set(range(1, edges + 1))


def test_unweighted_topic_data_waits_with_weights(spark, sf, monkeypatch):
    """Features without weights ask for none; the adjacency still has them."""
    from sparsemill.operators import knn, network

    v = catalog.vectors(spark, sf).where("id < 60").select("id", "batch", "v").cache()
    cells = v.select(F.explode(F.expr("array(0L, 1L)")).alias("row_id"), F.col("id").alias("col_id"), F.lit(1.0).alias("value"))
    names = v.select(F.col("id").alias("col_id"), F.concat(F.lit("v"), "id").alias("col_name"))

    def none(distances):
        raise AssertionError("weights")

    monkeypatch.setattr(knn, "weights_of", none)
    got = network.topic_data(cells, names, v, 20, weighted=False)
    edges = got["edges"].count()
    assert edges and got["features"].count() == 2 * edges
    monkeypatch.undo()
    got = network.topic_data(cells, names, v, 20, weighted=False)["adjacency"]
    assert got.count() == 2 * edges and not got.where("value <= 0 or value > 1").count()
