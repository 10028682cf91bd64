"""Nearest neighbours away from the origin, with ties, nulls and names; the index's recall; running numbers over ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill import catalog
from sparsemill.core import numbered_ranges, ranged, running
from sparsemill.operators import edit, graph, knn, stats


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("shift", [0.0, 1e8])
@pytest.mark.parametrize("space", ["l2", "ip"])
def test_exact_far_from_the_origin(spark, shift, space):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) + shift
    if space == "ip":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40:60] = x[40]  # more equal ones than the search has to spare
    got = {}
    for r in knn.knn(frame(spark, x), frame(spark, x), 5, space, block=64).collect():
        got.setdefault(r["src"], []).append((round(r["dist"], 10), r["tgt"]))
    d = 1 - (x[:, None, :] * x[None]).sum(2) if space == "ip" else ((x[:, None, :] - x[None]) ** 2).sum(2)
    for i in range(300):
        want = sorted((round(float(v), 10), j) for j, v in enumerate(d[i]))[:5]
        assert np.allclose([v for v, _ in sorted(got[i])], [v for v, _ in want], atol=1e-6 if shift else 1e-9)
        if space == "l2":
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_rows_without_id_or_vector_take_no_part(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [2.0, 2.0])], "id long, v array<double>")
    assert sorted((r["src"], r["tgt"]) for r in knn.knn(v, v, 5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    none = v.where("id > 9")
    assert knn.knn(none, none, 3).count() == 0 and knn.knn_indexed(none, none, 3).count() == 0
    assert sorted((r["src"], r["tgt"]) for r in knn.knn_indexed(v, v, 5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_quota_has_no_cap(spark):
    x = np.random.default_rng(1).normal(size=(1600, 2))
    v = frame(spark, x).withColumn("batch", F.lit(0))
    got = knn.balanced_knn(v.where("id < 1600"), 1500).groupBy("src").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(got) == (1499, 1499)


def recall(found, exact):
    found, exact = ({(r["src"], r["tgt"]) for r in rows.collect()} for rows in (found, exact))
    return len(found & exact) / len(exact)


@pytest.fixture(scope="module")
def sets(spark):
    """The vectors of the larger tables, 4,000 Gaussian ones, and ones in clusters."""
    rng = np.random.default_rng(0)
    clusters = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    return {"tables": catalog.vectors(spark, "/root/testdata/sf0.1"), "gaussian": frame(spark, rng.normal(size=(4000, 64))), "clusters": frame(spark, clusters)}


@pytest.mark.parametrize("name", ["tables", "gaussian", "clusters"])
@pytest.mark.parametrize("space", ["l2", "ip"])
def test_index_finds_nearly_all(sets, name, space):
    v = knn.unit_vectors(sets[name]) if space == "ip" else sets[name]
    assert recall(knn.knn_indexed(v, v, 5, space), knn.knn(v, v, 5, space)) >= 0.9


def test_index_with_all_lists_is_exact(spark, sf):
    v = catalog.vectors(spark, sf)
    assert recall(knn.knn_indexed(v, v, 5, lists=12, probes=12, block=50), knn.knn(v, v, 5)) == 1.0


@pytest.mark.parametrize("name", ["tables", "gaussian", "clusters"])
def test_graph_finds_nearly_all(sets, name):
    v, report = sets[name], {}
    made = graph.neighbour_graph(v, 5, report=report)
    assert recall(made, knn.knn(v, v, 6).where("src <> tgt")) >= 0.9
    assert report["distances"] < 0.7 * report["n"] ** 2 and report["distances"] < 2500 * report["n"]
    assert made.where("src = tgt").isEmpty() and made.groupBy("src").count().where("count <> 5").isEmpty()


def test_search_along_the_graph(sets):
    v = sets["gaussian"]
    made = graph.neighbour_graph(v, 16)
    asked = v.where("id % 20 = 3").withColumn("id", F.col("id") + 100_000)
    assert recall(graph.search_graph(asked, v, made, 5), knn.knn(asked, v, 5)) >= 0.9


def test_search_among_few_targets_is_exact_without_a_walk(sets, monkeypatch):
    """Every vector as a query: no round of a walk, and the rows of the exact search."""
    v = sets["clusters"]
    links = v.select(F.col("id").alias("src"), ((F.col("id") + 1) % 3000).alias("tgt"), F.lit(1.0).alias("dist"))
    monkeypatch.setattr(graph, "_best", None)
    got = graph.search_graph(v, v, links, 5)
    assert {tuple(r) for r in got.select("src", "tgt").collect()} == {tuple(r) for r in knn.knn(v, v, 5).select("src", "tgt").collect()}


def test_walk_along_the_graph(sets):
    v = sets["tables"]
    asked = v.where("id % 50 = 3").withColumn("id", F.col("id") + 100_000)
    made = knn.knn(v, v, 17).where("src <> tgt")
    assert recall(graph.search_graph(asked, v, made, 5, dense=0), knn.knn(asked, v, 5)) >= 0.9


def test_first_lists_of_many_vectors_come_from_more_and_larger_blocks(spark, monkeypatch):
    """For many vectors the first lists alone hold most neighbours; blocks measured by portions of rows."""
    assert graph._first_blocks(4000) == (graph.TREES, graph.LEAF) and graph._first_blocks(200_000) == (graph.MOST_TREES, graph.MOST_LEAF)
    monkeypatch.setattr(graph, "LEAF_ROWS", 100)
    v = frame(spark, np.random.default_rng(9).normal(size=(2000, 32))).cache()
    planes, middle = graph._planes(v, 2000, 32, 16, 512, 7)
    first = graph._best(graph._first_lists(v, planes, middle, 24, 512, "l2"), 24)
    assert recall(first, knn.knn(v, v, 6).where("src <> tgt")) >= 0.9 and first.where("src = tgt").isEmpty()


def test_graph_of_copies_and_holes(spark):
    """One vector a third of all rows; nulls, holes, other lengths, repeated ids; few rows and none."""
    x = np.random.default_rng(2).normal(size=(900, 4))
    x[:300] = x[0]
    odd = [(2000, None), (None, [1.0] * 4), (2001, [1.0, None, 2.0, 3.0]), (2002, [1.0, 2.0]), (899, x[899].tolist())]
    v = frame(spark, x).unionByName(spark.createDataFrame(odd, "id long, v array<double>"))
    got = graph.neighbour_graph(v, 4).collect()
    assert {r["src"] for r in got} == set(range(900)) and all(r["dist"] < 1e-9 for r in got if r["src"] < 300)
    few = v.where("id in (1, 2, 500)")
    assert sorted((r["src"], r["tgt"]) for r in graph.neighbour_graph(few, 4).collect()) == [(1, 2), (1, 500), (2, 1), (2, 500), (500, 1), (500, 2)]
    none = v.where("id > 9999")
    assert graph.neighbour_graph(none, 4).count() == 0
    assert graph.neighbour_graph(v.where("id = 5"), 4).count() == 0
    assert graph.search_graph(none, v, graph.neighbour_graph(v, 4), 3).count() == 0
    assert {r["tgt"] for r in graph.search_graph(v.where("id = 700"), few, graph.neighbour_graph(few, 4), 3).collect()} == {1, 2, 500}
    assert {r["src"] for r in knn.knn(v, v, 2).collect()} == {*range(900), 2002}
    assert {r["src"] for r in knn.knn_indexed(v, v, 2).collect()} == set(range(900))


def test_rows_without_batch_are_no_neighbours(spark):
    v = frame(spark, np.random.default_rng(5).normal(size=(30, 3))).withColumn("batch", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = knn.balanced_knn(v, 6).collect()
    assert {r["src"] % 3 for r in got} == {1, 2} and {r["tgt"] % 3 for r in got} == {1, 2}


def test_groups_with_names(spark):
    v = spark.createDataFrame([(0, [1.0, 0.1], "x"), (1, [1.0, 0.2], "y"), (2, [0.1, 1.0], "z"), (3, [0.2, 1.0], None)], "id long, v array<double>, g string")
    got = {(r["src"], r["tgt"]) for r in knn.match_groups(v, "g", 1).collect()}
    assert got == {("x", "y"), ("y", "x"), ("z", "y")}


@pytest.fixture
def several_ranges(spark):
    """Small tables in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_ranges(spark, several_ranges):
    rng = np.random.default_rng(4)
    made = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 50, 3000), rng.permutation(3000), rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(made, "a long, b long, w long").repartition(7)
    assert ranged(df, ["a", "b"]).select("_part").distinct().count() > 1
    got = {(r["a"], r["b"]): (r["s"], r["n"]) for r in running(running(df, ["a", "b"], "w", "s"), ["a", "b"], None, "n").collect()}
    total = 0
    for n, (a, b, w) in enumerate(sorted(made)):
        assert got[a, b] == (total, n)
        total += w
    assert running(df.where("a < 0"), ["a"], None, "n").count() == 0


def test_blocks_across_ranges(spark, several_ranges):
    ids = sorted({int(i) for i in np.random.default_rng(5).integers(0, 20000, 1500)})
    want, at = [], []
    for i in ids:
        if at and i - at[-1] >= 10:
            want.append((at[0], at[-1], len(at)))
            at = []
        at.append(i)
    want.append((at[0], at[-1], len(at)))
    got = edit.column_blocks(spark.createDataFrame([(i,) for i in ids], "col_id long").repartition(5)).orderBy("block").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in got] == want and [r["block"] for r in got] == list(range(len(want)))


def test_long_requests(spark, monkeypatch):
    cells = spark.createDataFrame([(i % 5, i, float(i)) for i in range(1, 400)], "row_id long, col_id long, value double")
    request = [7, 3, 399, 3, 1000]
    few = sorted(map(tuple, edit.read_columns(cells, request).collect()))
    monkeypatch.setattr(edit, "PUSHED_IDS", 2)
    monkeypatch.setattr(edit, "BROADCAST_IDS", 2)
    assert sorted(map(tuple, edit.read_columns(cells, request).collect())) == few == [(2, 1, 7.0), (3, 2, 3.0), (3, 4, 3.0), (4, 3, 399.0)]
    assert edit.read_columns(cells, []).count() == 0


def test_median_and_sizes(spark):
    cells = spark.createDataFrame([(0, c, float(c % 7)) for c in range(1, 50)], "row_id long, col_id long, value double")
    sums = sorted(float(c % 7) for c in range(1, 50))
    assert stats.median_degree(cells).first()["median"] == max(1.0, sums[len(sums) // 2])
    labels = spark.createDataFrame([(x,) for x in "bbacccb"], "label string")
    assert {(r["label"], r["new_label"]) for r in stats.relabelled_by_size(labels).collect()} == {("b", 0), ("c", 1), ("a", 2)}


def test_ranges_of_names_and_pairs(spark):
    """Running numbers over strings with a null, and over pairs; dense reads and merges of many columns."""
    names = [(f"n{i * 7919 % 5000}é"[: 2 + i % 5] + str(i),) for i in range(3000)] + [(None,), ("",)]
    df = spark.createDataFrame(names, "name string").repartition(5)
    assert df.select(numbered_ranges(df, ["name"]).alias("r")).distinct().count() > 1
    got = {r["name"]: r["n"] for r in running(df, ["name"], None, "n").collect()}
    order = sorted(got, key=lambda x: (x is not None, (x or "").encode()))
    assert [got[x] for x in order] == list(range(3002))
    pairs = spark.range(4000).select((F.col("id") % 3).alias("a"), F.concat(F.lit("x"), F.col("id")).alias("b"))
    got = sorted((r["a"], r["b"], r["n"]) for r in running(pairs, ["a", "b"], None, "n").collect())
    assert [r[2] for r in got] == list(range(4000))


def test_dense_read_of_many_columns(spark):
    cells = spark.range(9000).select((F.col("id") % 3).alias("row_id"), F.col("id").alias("col_id"), (F.col("id") + 0.5).alias("value"))
    rows = spark.range(4).withColumnRenamed("id", "row_id")
    request = [8999, 5, 77777, *range(100, 2000)]
    got = {r["row_id"]: r["values"] for r in edit.read_columns_dense(cells, rows, request).collect()}
    assert all(got[i] == [c + 0.5 if c < 9000 and c % 3 == i else 0.0 for c in request] for i in range(4))
    assert [r["values"] for r in edit.read_columns_dense(cells, rows, []).collect()] == [[]] * 4


def pairs_of_blocks(monkeypatch, search) -> int:
    """How many pairs of blocks a search meets."""
    met, made = [], knn._search
    monkeypatch.setattr(knn, "_search", lambda pairs, *more: met.append(pairs) or made(pairs, *more))
    search()
    monkeypatch.undo()
    return met[0].count()


@pytest.fixture(scope="module")
def batches(spark):
    return frame(spark, np.random.default_rng(8).normal(size=(1000, 8))).withColumn("batch", F.col("id") % 10).cache()


def test_balanced_search_meets_blocks_of_a_batch_by_its_size(spark, monkeypatch, batches):
    """Ten batches of a hundred in blocks of a hundred are about ten blocks on either side, not ten for each batch."""
    monkeypatch.setattr(knn, "BLOCK", 100)
    assert pairs_of_blocks(monkeypatch, lambda: knn.knn(batches, batches, 2, "l2", "batch", block=100)) <= 200


def test_search_across_groups_meets_blocks_of_a_batch_by_its_size(spark, monkeypatch, batches):
    """About ten blocks on either side, less those of one batch; before, a hundred on either side."""
    monkeypatch.setattr(knn, "BLOCK", 100)
    assert pairs_of_blocks(monkeypatch, lambda: knn.knn(batches, batches, 2, "l2", "batch", True, block=100)) <= 180


@pytest.mark.parametrize("space", ["l2", "ip"])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_lists_carried_over_blocks_are_exact(space, k):
    """Lists brought up to date block by block: a far outlier, copies, ties by id, fewer rows than k, large and tiny values."""
    rng = np.random.default_rng(k)
    for scale in (1.0, 1e-3, 1e6, 1e20):
        x, y = rng.normal(size=(300, 16)), rng.normal(size=(700, 16))
        y[5] *= 1000
        y[20:90] = y[20]
        x[:4] = y[20]
        x, y, ids = x * scale, y * scale, rng.permutation(700)
        best, tgt = np.full((300, k), np.inf), np.full((300, k), knn.NOBODY)
        for part in np.split(np.arange(700), [30, 31, 300, 550]):
            knn.nearer(x, y[part], ids[part], k, space, best, tgt)
        d = 1 - np.einsum("id,jd->ij", x, y) if space == "ip" else ((x[:, None] - y[None]) ** 2).sum(2)
        want = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 10)), axis=1)[:, :k]
        assert np.allclose(best, np.take_along_axis(d, want, 1), rtol=1e-9, atol=1e-9 * min(scale, 1) ** 2)
        if scale <= 1:
            assert (tgt == ids[want]).all()
