"""Queries over the reference tables, by name, with the SQL that gives the same rows.

Cells are lineitem's quantities by part (row) and order (column); names are parts and orders; individuals are nations of
customers, treatments order statuses, labels order priorities; vectors are the embeddings with their label as batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Matrix, canonical, settled
from .functions.vector import doubles
from .operators import annotate as annotation
from .operators import edit, graph, knn, mixture, network, pseudobulk, regression, simulate, spectral, stats


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark, sf, where: str = "true") -> DataFrame:
    return canonical(_t(spark, sf, "lineitem").where(where).select(F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").alias("value")))


def rows(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.concat_ws("_", "p_name", "p_partkey").alias("row_name"))


def cols(spark, sf) -> DataFrame:
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("col_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("col_name"))


def matrix(spark, sf, where: str = "true") -> Matrix:
    return Matrix(cells(spark, sf, where), rows(spark, sf), cols(spark, sf))


def vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), F.col("label").alias("batch"))


def member(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("col_id"), F.col("c_nationkey").cast("long").alias("indv"), F.col("o_orderpriority").alias("label"), F.lit(1.0).alias("z"))


def _r(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# The lists that selections are made with.
KEPT_COLUMN, KEPT_ROW = "o_orderkey % 3 = 0", "p_partkey % 4 = 1"
REQUEST = [5, 2, 9, 100000000, 7, 40, 3]


def row_scores(spark, sf):
    out = stats.row_scores(cells(spark, sf), rows(spark, sf), cols(spark, sf))
    return _r(out, 6, "sum", "sum_sq", "mean", "sd", "cv").select("row_id", "row_name", "nnz", "sum", "sum_sq", "mean", "sd", "cv")


def col_scores(spark, sf):
    out = stats.col_scores(cells(spark, sf), rows(spark, sf), cols(spark, sf))
    return _r(out, 6, "sum", "sum_sq", "mean", "sd", "cv").select("col_id", "col_name", "nnz", "sum", "sum_sq", "mean", "sd", "cv")


def value_histogram(spark, sf):
    return stats.value_histogram(cells(spark, sf))


def matrix_info(spark, sf):
    return matrix(spark, sf).dims()


def build_sparse_sum(spark, sf):
    raw = _t(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("row_id"), (F.col("l_orderkey") % 500).alias("col_id"), F.col("l_quantity").alias("weight"))
    return _r(edit.build_sparse(raw, 450, 400), 6, "value")


def symmetrize(spark, sf):
    raw = _t(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("row_id"), (F.col("l_orderkey") % 500).alias("col_id"), F.col("l_quantity").alias("weight"))
    return _r(edit.build_sparse(raw, 400, 400), 6, "value")


def _out(m: Matrix) -> DataFrame:
    return m.triplets.join(m.cols, "col_id").select("row_id", "col_id", "col_name", F.round("value", 6).alias("value"))


def select_columns(spark, sf):
    names = _t(spark, sf, "orders").where(KEPT_COLUMN).select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("col_name"))
    return _out(edit.select_columns(matrix(spark, sf), names.union(names).union(spark.createDataFrame([("nobody",)], "col_name string"))))


def select_rows(spark, sf):
    names = _t(spark, sf, "part").where(KEPT_ROW).select(F.concat_ws("_", "p_name", "p_partkey").alias("row_name"))
    return _out(edit.select_rows(matrix(spark, sf), names))


def filter_columns_nnz(spark, sf):
    return _out(edit.filter_columns(matrix(spark, sf), 4))


def filtered_scores(spark, sf):
    """Number of cells of the columns that a filter keeps, under their new and old numbers."""
    _, kept, every = edit.filter_columns_scored(matrix(spark, sf), 4)
    return kept.join(every.select(F.col("col_id").alias("old_id"), "col_name", F.col("nnz").alias("full_nnz")), "col_name")


def merge_batches(spark, sf):
    parts = [(f, matrix(spark, sf, f"l_returnflag = '{f}'")) for f in "ANR"]
    return _out(edit.merge(parts, 2))


def common_names_union(spark, sf):
    return edit.common_names([_t(spark, sf, t).select(F.col(c).cast("string").alias("name")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))], True)


def common_names_intersect(spark, sf):
    return edit.common_names([_t(spark, sf, t).select(F.col(c).cast("string").alias("name")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))], False)


def column_index(spark, sf):
    return edit.column_index(cells(spark, sf), cols(spark, sf))


def index_check(spark, sf):
    index = edit.column_index(cells(spark, sf), cols(spark, sf)).withColumn("nnz", F.when(F.col("col_id") % 100 == 0, F.col("nnz") + 1).otherwise(F.col("nnz")))
    return edit.index_problems(cells(spark, sf), index)


def column_blocks(spark, sf):
    return edit.column_blocks(_t(spark, sf, "orders").where("o_orderkey % 37 < 5 or o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("col_id")))


def read_columns_sparse(spark, sf):
    return edit.read_columns(cells(spark, sf), REQUEST)


def read_columns_dense(spark, sf):
    out = edit.read_columns_dense(cells(spark, sf), rows(spark, sf), REQUEST)
    return out.select("row_id", *[F.col("values")[i].alias(f"c{i + 1}") for i in range(len(REQUEST))])


def normalize_fixed(spark, sf):
    return _r(stats.normalize_fixed(cells(spark, sf)), 6, "value")


def normalize_median(spark, sf):
    return _r(stats.normalize_median(cells(spark, sf)), 6, "value")


def l2_columns(spark, sf):
    return _r(stats.normalize_l2(cells(spark, sf)), 6, "value")


def laplacian_norm(spark, sf):
    return _r(stats.laplacian(cells(spark, sf)), 6, "value")


def standardize_columns(spark, sf):
    return _r(stats.standardize(_few(spark, sf), _few_rows(spark), cols(spark, sf)), 6, "value")


def top_columns_cv(spark, sf):
    out = stats.col_scores(cells(spark, sf), rows(spark, sf), cols(spark, sf)).withColumn("cv", F.round("cv", 6))
    return stats.top_columns(out, 50).select("col_id", "cv")


def pseudobulk_sum_mean(spark, sf):
    return _r(pseudobulk.pseudobulk(cells(spark, sf), member(spark, sf)), 6, "sum", "mean")


def annotate_join(spark, sf):
    pairs = _t(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("col_name"), F.col("o_orderpriority").alias("label"))
    return pseudobulk.membership(cols(spark, sf), pairs.union(pairs), "label")


def knn_l2(spark, sf):
    v = vectors(spark, sf)
    return _r(knn.knn(v, v, 5), 6, "dist").select("src", "tgt", "dist")


def knn_cosine(spark, sf):
    v = knn.unit_vectors(vectors(spark, sf))
    return _r(knn.knn(v, v, 5, "ip"), 6, "dist").select("src", "tgt", "dist")


def knn_balanced(spark, sf):
    return _r(knn.balanced_knn(vectors(spark, sf), 20), 6, "dist")


def knn_reciprocal(spark, sf):
    v = vectors(spark, sf)
    return _r(knn.reciprocal(knn.knn(v, v, 8).where("src <> tgt"), True), 6, "dist").select("src", "tgt", "dist")


def knn_cross_group(spark, sf):
    v = vectors(spark, sf)
    return _r(knn.knn(v, v, 2, "l2", "batch", True), 6, "dist").select("src", "tgt", "dist", F.col("tgt_group").alias("tgt_batch"))


def match_individuals(spark, sf):
    out = knn.match_groups(vectors(spark, sf), "batch", 2)
    return out.select(F.col("src").cast("long").alias("src"), F.col("tgt").cast("long").alias("tgt"), F.round("dist", 5).alias("dist"))


def dedup_pairs(spark, sf):
    v = vectors(spark, sf)
    return _r(knn.nearest_records(knn.knn(v, v, 6).where("src <> tgt").select("src", "tgt", F.round("dist", 6).alias("dist"))), 6, "dist")


def _chain(spark, sf) -> DataFrame:
    """A graph of orders of one customer, each with the next, of weight 1."""
    from pyspark.sql import Window

    o = _t(spark, sf, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("src"), nxt.alias("tgt"), F.lit(1.0).alias("weight")).where("tgt is not null")


def _few(spark, sf) -> DataFrame:
    """Cells with few rows, so that orders have rows in common."""
    return canonical(_t(spark, sf, "lineitem").select((F.col("l_partkey") % 25).alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").alias("value")))


def _few_rows(spark) -> DataFrame:
    return spark.range(25).withColumnRenamed("id", "row_id")


def edge_features(spark, sf):
    return _r(network.edge_features(_few(spark, sf), _chain(spark, sf)), 6, "value")


def feature_incidence(spark, sf):
    return _r(network.feature_incidence(network.edge_features(_few(spark, sf), _chain(spark, sf))), 6, "value")


def sample_incidence(spark, sf):
    return network.vertex_incidence(network.numbered_edges(network.edge_features(_few(spark, sf), _chain(spark, sf))))


def sample_adjacency(spark, sf):
    return _r(network.adjacency(_chain(spark, sf)), 6, "value")


def marker_match(spark, sf):
    named = _t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("row_name"))
    marks = _t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("label"), F.col("p_name").alias("feature"))
    return network.marker_match(marks.union(spark.createDataFrame([("Brand#0", "no such part")], "label string, feature string")), named)


def qc_disqualified(spark, sf):
    checks = spark.createDataFrame([(1, 10.0), (2, 1.0)], "row_id long, threshold double")
    return network.disqualified(_few(spark, sf), cols(spark, sf), checks)


def regression_residuals(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    return _r(simulate.regression_residuals(li, ["l_returnflag"], "l_extendedprice", "l_quantity"), 4, "fitted", "residual").select("l_orderkey", "l_linenumber", "fitted", "residual")


# Iterative operators and those with draws: not SQL; tests hold them against numpy.


def knn_weights(spark, sf):
    v = vectors(spark, sf)
    return knn.with_weights(knn.knn(v, v, 6).where("src <> tgt").select("src", "tgt", "dist"))


def knn_reweighted(spark, sf):
    v = vectors(spark, sf)
    return knn.reweighted(knn.reciprocal(knn.knn(v, v, 8).where("src <> tgt")), v, 5)


def knn_reweighted_distances(spark, sf):
    return _r(knn_reweighted(spark, sf), 6, "dist").select("src", "tgt", "dist")


def knn_indexed(spark, sf):
    v = vectors(spark, sf)
    return _r(knn.knn_indexed(v, v, 5), 6, "dist")


def knn_graph(spark, sf):
    return _r(graph.neighbour_graph(vectors(spark, sf), 5), 6, "dist")


def knn_graph_search(spark, sf):
    v = vectors(spark, sf)
    return _r(graph.search_graph(v, v, graph.neighbour_graph(v, 16), 5), 6, "dist")


def knn_named(spark, sf):
    v = vectors(spark, sf).withColumn("name", F.concat(F.lit("v"), "id"))
    return _r(knn.knn_named(v, v, 3, valid=v.where("batch < 5").select("name")), 6, "dist")


def poisson_pseudobulk(spark, sf):
    return pseudobulk.poisson_gamma(_few(spark, sf), member(spark, sf), _few_rows(spark))


def poisson_rates(spark, sf):
    return _r(poisson_pseudobulk(spark, sf), 6, "mu", "mu_sd", "ln_mu_sd").select("row_id", "indv", "label", "mu", "mu_sd", "ln_mu_sd")


def _embedded(spark, sf):
    """Vectors as columns of a matrix: cells of the positive coordinates, in 1024ths, so that sums and halves are exact."""
    long = vectors(spark, sf).select(F.col("id").alias("col_id"), F.posexplode("v").alias("row_id", "x")).select(F.col("row_id").cast("long").alias("row_id"), "col_id", (F.round(F.exp("x") * 1024) / 1024).alias("value"))
    return canonical(long)


def _latent(spark, sf):
    return spark.range(64).withColumnRenamed("id", "row_id"), vectors(spark, sf).select(F.col("id").alias("col_id"))


def counterfactual(spark, sf):
    return pseudobulk.counterfactual(_embedded(spark, sf), vectors(spark, sf).withColumn("trt", F.col("batch") % 2).select("id", "v", "trt"), "trt", 5)


def residual_rates(spark, sf):
    """What is left beside rates that are the same for all labels of an individual: their mean."""
    from pyspark.sql import Window

    mu = poisson_pseudobulk(spark, sf).withColumn("mu", F.avg("mu").over(Window.partitionBy("row_id", "indv")))
    out = pseudobulk.residual_rates(_few(spark, sf), member(spark, sf), mu)
    return _r(out, 5, "resid_mu", "resid_mu_sd").select("row_id", "indv", "label", "resid_mu", "resid_mu_sd")


def counterfactual_nearest(spark, sf):
    out = pseudobulk.counterfactual(_embedded(spark, sf), vectors(spark, sf).withColumn("trt", F.col("batch") % 2).select("id", "v", "trt"), "trt", 1)
    return out.select("col_id", "row_id", "value")


def counterfactual_regression(spark, sf):
    v = vectors(spark, sf).withColumn("trt", F.col("batch") % 2).select("id", "v", "trt")
    return pseudobulk.counterfactual(_embedded(spark, sf), v, "trt", 5, by="regression", rows=_latent(spark, sf)[0])


def least_squares(spark, sf):
    """Prices on three covariates by return flag."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(f"l_{c}").cast("double").alias(c) for c in ("extendedprice", "quantity", "discount", "tax")])
    out = regression.least_squares(li, ["l_returnflag"], ["extendedprice"], ["quantity", "discount", "tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("fitted_extendedprice", 4).alias("fitted"), F.round("residual_extendedprice", 4).alias("residual"))


def pairwise_nearest(spark, sf):
    return pairwise_delta(spark, sf, 1)


def pairwise_delta(spark, sf, k: int = 5):
    v = vectors(spark, sf)
    who = v.select(F.col("id").alias("col_id"), F.col("batch").cast("long").alias("indv"), F.lit("ct1").alias("label"), F.lit(1.0).alias("z"))
    pairs = knn.match_groups(v, "batch", 1).select("src", "tgt")
    return pseudobulk.pairwise_delta(_embedded(spark, sf), who, v.select("id", "v"), pairs.select(F.col("src").cast("long").alias("src"), F.col("tgt").cast("long").alias("tgt")), k)


def paired_covariates(spark, sf):
    """Batches as individuals: what each has beside its nearest, by factor, with the weight of the match."""
    profiles = settled(knn.group_profiles(vectors(spark, sf), "batch"), "covar")
    out = pseudobulk.matched_covariates(profiles, knn.match_groups(None, "batch", 1, True, profiles))
    long = out.select(F.col("src").cast("long").alias("src"), F.col("tgt").cast("long").alias("tgt"), "weight", F.posexplode("v").alias("factor", "covar"))
    return _r(long, 6, "covar", "weight")


def paired_means(spark, sf):
    """Differences of each batch from its three nearest, by weight."""
    v = vectors(spark, sf)
    who = v.select(F.col("id").alias("col_id"), F.col("batch").cast("long").alias("indv"), F.lit("ct1").alias("label"), F.lit(1.0).alias("z"))
    matches = settled(knn.match_groups(v.withColumn("batch", F.col("batch").cast("long")), "batch", 3, True), "matches")
    delta = pseudobulk.pairwise_delta(_embedded(spark, sf), who, v.select("id", "v"), matches.select("src", "tgt"), 5)
    return pseudobulk.over_matches(delta, matches, "sum_delta", "mean_delta")


def svd_approx(spark, sf):
    r, c = _latent(spark, sf)
    return spectral.svd(_embedded(spark, sf), r, c, 5)[2]


def svd_sampled(spark, sf):
    r, c = _latent(spark, sf)
    return spectral.svd_sampled(_embedded(spark, sf), r, c, 5, 200)[2]


def edge_clusters(spark, sf):
    """Edges between the orders of a customer, in five clusters of what their orders have in common."""
    found = network.edge_features(_few(spark, sf), _chain(spark, sf))
    return mixture.poisson_mixture(network.feature_incidence(found), _few_rows(spark), 5, rounds=10)["members"].drop("probs")


def bbknn_matrix(spark, sf):
    r, c = _latent(spark, sf)
    return spectral.bbknn_matrix(_embedded(spark, sf), r, c, vectors(spark, sf).select(F.col("id").alias("col_id"), (F.col("batch") % 3).alias("batch")), 5, 9)["knn_adjusted"]


def scaled_columns(spark, sf):
    """Cells by their order's discount; orders without one keep theirs."""
    factor = _t(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("col_id"), (1 - F.col("l_discount").cast("double")).alias("scale"))
    return _r(edit.scale_columns(cells(spark, sf), factor), 6, "value")


def svd_em(spark, sf):
    r, c = _latent(spark, sf)
    return spectral.svd_em(_embedded(spark, sf), r, c, 5)[2]


def svd_project(spark, sf):
    r, c = _latent(spark, sf)
    u, d, _, ids = spectral.svd(_embedded(spark, sf), r, c, 5)
    return spectral.project(_embedded(spark, sf), c, u, d, ids)


def bbknn(spark, sf):
    return spectral.bbknn(vectors(spark, sf).withColumn("batch", F.col("batch") % 3), 9)[0]


def column_degrees_scaled(spark, sf):
    return _r(stats.scale_by_degree(cells(spark, sf)), 6, "value")


def nonempty_columns(spark, sf):
    return edit.nonempty_columns(matrix(spark, sf)).select("col_id", "col_name", "nnz")


def read_block(spark, sf):
    return edit.read_block(_few(spark, sf), [3, 1, 24, 77], REQUEST)


def read_column_range(spark, sf):
    return edit.read_column_range(cells(spark, sf), 100, 600)


def relabelled_by_size(spark, sf):
    return stats.relabelled_by_size(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderpriority").alias("label")))


def observed_products(spark, sf):
    x = _few(spark, sf)
    return _r(stats.observed_products(x.select(F.col("row_id").alias("i"), F.col("col_id").alias("k"), "value"), x.select(F.col("col_id").alias("k"), F.col("row_id").alias("j"), "value")), 4, "product")


def topic_features(spark, sf):
    """Features on the edges of vectors' mutual neighbours, without weights."""
    v = vectors(spark, sf)
    names = v.select(F.col("id").alias("col_id"), F.concat(F.lit("v"), "id").alias("col_name"))
    return network.topic_data(_embedded(spark, sf), names, v.select("id", "batch", "v"), 20, weighted=False)["features"]


def file_set(spark, sf):
    """Written as text with names and index, read back with all columns and names."""
    import uuid

    from .core import drop_at_exit, shared_dir
    from .sources import mtx

    folder = f"{shared_dir(spark)}/file-set-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    files = mtx.write_file_set(Matrix(_few(spark, sf), _few_rows(spark).withColumn("row_name", F.concat(F.lit("r"), "row_id")), cols(spark, sf)), f"{folder}/m")
    m = mtx.read_mtx_sparse(spark, files)
    out = m.triplets.join(m.rows, "row_id").join(m.cols, "col_id").join(mtx.read_index(spark, files.idx), "col_id")
    return _r(out, 6, "value").select("row_name", "col_name", "row_id", "col_id", "value", "first_pos", "nnz")


def streaming_variance(spark, sf):
    """Quantities by part, as a stream of three batches in which lines of one order come late."""
    import uuid

    from .core import drop_at_exit, shared_dir
    from .streaming import moments

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    lines = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_linenumber") % 3).alias("batch"))
    with moments.state_store(spark):
        for b in range(3):
            lines.where(F.col("batch") == b).drop("batch").write.parquet(f"{folder}/in/{b}")
            stream = moments.streaming_moments(spark.readStream.schema("row_id long, col_id long, value double").parquet(f"{folder}/in/*"))
            run = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out", format="parquet")
            run.awaitTermination()
    out = moments.latest(spark.read.schema("row_id long, version long, n long, mean double, var double").parquet(f"{folder}/out"))
    return _r(out, 6, "mean", "var")


def match_files(spark, sf):
    r, c = _latent(spark, sf)
    x = _embedded(spark, sf)
    return spectral.match_columns(x, c, x, r, c, 3, 5)


def _marks(rows) -> DataFrame:
    return rows.where("row_id < 40").select(F.concat(F.lit("type"), (F.col("row_id") % 4)).alias("label"), "row_id")


def annotate(spark, sf):
    r, c = _latent(spark, sf)
    return annotation.annotate(_embedded(spark, sf), c, _marks(r))


def annotate_posterior(spark, sf):
    """Two sets of markers, and counter-markers."""
    r, c = _latent(spark, sf)
    two = _marks(r).withColumn("set", F.lit(0)).unionByName(r.where("row_id >= 40").select(F.concat(F.lit("type"), F.floor(F.col("row_id") / 6) % 4).alias("label"), "row_id", F.lit(1).alias("set")))
    anti = r.where("row_id < 8").select(F.concat(F.lit("type"), (F.col("row_id") + 1) % 4).alias("label"), "row_id")
    return annotation.annotation(_embedded(spark, sf), c, two, anti)["posterior"]


def annotate_factors(spark, sf):
    r, c = _latent(spark, sf)
    u, d, v, ids = spectral.svd(_embedded(spark, sf), r, c, 5)
    return annotation.annotate_factors(u, d, v, ids, c, _marks(r))["annotation"]


def simulate_poisson(spark, sf):
    return simulate.simulate_poisson(spark, [[1.0, 4.0], [3.0, 0.5], [0.2, 2.0]], [0.5, 1.0, 2.0], 500)[0]


def simulate_mixture(spark, sf):
    return simulate.simulate_mixture(spark, [[[1.0, 4.0]] * 5, [[3.0, 0.5]] * 5], 100)[0]


_NAMES = """row_scores col_scores value_histogram matrix_info build_sparse_sum symmetrize select_columns select_rows filter_columns_nnz
merge_batches common_names_union common_names_intersect column_index index_check column_blocks read_columns_sparse read_columns_dense
normalize_fixed normalize_median l2_columns laplacian_norm standardize_columns top_columns_cv pseudobulk_sum_mean annotate_join knn_l2
knn_cosine knn_balanced knn_reciprocal knn_cross_group match_individuals dedup_pairs edge_features feature_incidence sample_incidence
sample_adjacency marker_match qc_disqualified regression_residuals knn_weights knn_reweighted knn_reweighted_distances knn_indexed knn_graph knn_graph_search knn_named poisson_pseudobulk
poisson_rates residual_rates counterfactual counterfactual_nearest counterfactual_regression least_squares pairwise_delta pairwise_nearest paired_covariates paired_means column_degrees_scaled nonempty_columns read_block
read_column_range relabelled_by_size observed_products topic_features file_set streaming_variance scaled_columns filtered_scores edge_clusters svd_approx svd_sampled svd_em svd_project bbknn bbknn_matrix match_files annotate annotate_posterior annotate_factors simulate_poisson simulate_mixture""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}


def _sql_poisson(rounds: int) -> str:
    """The rounds of rates and sizes, one common table each."""
    steps = "".join(f", r{i} AS MATERIALIZED (SELECT indv, label, any_value(top) AS top, 1 + sum((1 + y) / (1 + top / rate)) AS rate FROM m JOIN r{i - 1} USING (indv, label) GROUP BY ALL)" for i in range(2, rounds + 1))
    return f"""WITH {_FEW}, y AS (SELECT col_id, sum(value) AS y FROM t GROUP BY 1), m AS MATERIALIZED (SELECT o_orderkey AS col_id, c_nationkey::BIGINT AS indv, o_orderpriority AS label, coalesce(y, 0) AS y FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN y ON y.col_id = o_orderkey),
    z AS (SELECT row_id, indv, label, sum(value) AS zy FROM t JOIN m USING (col_id) GROUP BY ALL), r1 AS MATERIALIZED (SELECT indv, label, 25 + sum(y) AS top, 1.0::DOUBLE + count(*) AS rate FROM m GROUP BY ALL){steps},
    e AS (SELECT r.row_id::BIGINT AS row_id, indv, label, 1 + coalesce(zy, 0) AS a, rate FROM range(25) r(row_id) CROSS JOIN r{rounds} LEFT JOIN z USING (row_id, indv, label))
    SELECT row_id, indv, label, round(a / rate, 6) AS mu, round(sqrt(a) / rate, 6) AS mu_sd, round(1 / sqrt(CASE WHEN a > 1 THEN greatest(a - 1, 1e-8) ELSE a END), 6) AS ln_mu_sd FROM e"""


def _sql_residual(rounds: int) -> str:
    """The rounds of _sql_poisson, means of its rates over labels, and the rounds of residuals."""
    rates = _sql_poisson(rounds).split("    SELECT row_id, indv")[0]
    steps = "".join(f", q{i} AS MATERIALIZED (SELECT indv, label, sum((1 + y) / (1 + total)) AS rate FROM m JOIN (SELECT indv, label, sum(u.mu * u.a / (1 + q.rate * u.mu)) AS total FROM u JOIN q{i - 1} q USING (indv, label) GROUP BY ALL) USING (indv, label) GROUP BY ALL)" for i in range(1, rounds + 1))
    return f"""{rates}, u AS MATERIALIZED (SELECT row_id, indv, label, a, avg(a / rate) OVER (PARTITION BY row_id, indv) AS mu FROM e), q0 AS MATERIALIZED (SELECT indv, label, count(*)::DOUBLE AS rate FROM m GROUP BY ALL){steps}
    SELECT u.row_id, u.indv, u.label, round(a / (1 + q.rate * mu), 5) AS resid_mu, round(sqrt(a) / (1 + q.rate * mu), 5) AS resid_mu_sd FROM u JOIN q{rounds} q USING (indv, label)"""


_T = "t AS (SELECT l_partkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_FEW = "t AS (SELECT l_partkey % 25 AS row_id, l_orderkey AS col_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label AS batch FROM embeddings)"
_D = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
_CHAIN = "g AS (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tgt, 1.0::DOUBLE AS weight FROM orders) WHERE tgt IS NOT NULL)"
_EF = "f AS (SELECT g.src, g.tgt, x.row_id, (x.value + y.value) / 2 AS value FROM g JOIN t x ON x.col_id = g.src JOIN t y ON y.col_id = g.tgt AND y.row_id = x.row_id)"
_NUM = "k AS (SELECT row_number() OVER (ORDER BY src, tgt) AS edge_id, src, tgt FROM (SELECT DISTINCT src, tgt FROM f))"


def _sql_scores(key: str, names: str, other: str) -> str:
    return f"""WITH {_T}, s AS (SELECT {key}, sum(value) AS s1, sum(value * value) AS s2, count(*) FILTER (WHERE abs(value) > 1e-8) AS nnz FROM t GROUP BY 1),
    n AS (SELECT count(*) AS n FROM {other}), j AS (SELECT names.*, coalesce(nnz, 0) AS nnz, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, n FROM ({names}) names LEFT JOIN s USING ({key}), n),
    k AS (SELECT *, s1 / n AS mean, sqrt(greatest(s2 - s1 * s1 / n, 0) / greatest(n - 1, 1)) AS sd FROM j)"""


_SELECT_SCORES = "nnz, round(s1, 6) AS sum, round(s2, 6) AS sum_sq, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN abs(mean) > 1e-8 THEN sd / abs(mean) ELSE 0 END, 6) AS cv FROM k"
_ROWS = "SELECT p_partkey AS row_id, concat_ws('_', p_name, p_partkey) AS row_name FROM part"
_COLS = "SELECT o_orderkey AS col_id, concat('o', o_orderkey) AS col_name FROM orders"


def _sql_built(n_row: int, n_col: int) -> str:
    return f"SELECT l_partkey % 500 AS row_id, l_orderkey % 500 AS col_id, sum(l_quantity) AS value FROM lineitem WHERE l_partkey % 500 BETWEEN 1 AND {n_row} AND l_orderkey % 500 BETWEEN 1 AND {n_col} GROUP BY ALL"


def _sql_knn(k: int, dist: str, e: str, where: str = "true", by: str = "a.id", more: str = "") -> str:
    return f"WITH {e} SELECT src, tgt, dist{more and ', tgt_batch'} FROM (SELECT a.id AS src, b.id AS tgt, round({dist}, 6) AS dist{more}, row_number() OVER (PARTITION BY {by} ORDER BY round({dist}, 10), b.id) AS r FROM e a, e b WHERE {where}) WHERE r <= {k}"


_UNIT = _E[:-1].replace("e AS (SELECT", "e0 AS (SELECT") + "), e AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)) AS v, batch FROM e0)"
_CELLS = "t AS (SELECT unnest(range(64)) AS row_id, vec_id AS col_id, round(exp(unnest(embedding)::DOUBLE) * 1024) / 1024 AS value FROM embeddings)"
_MATCH = "l AS (SELECT batch, unnest(range(1, 65)) AS f, unnest(v) AS x FROM e), s AS (SELECT batch, f, sum(x) AS x FROM l GROUP BY ALL), h AS (SELECT f, greatest(sqrt(sum(x * x)), 1e-8) AS h FROM s GROUP BY 1), p AS (SELECT batch, f, x / h AS x FROM s JOIN h USING (f)), u AS (SELECT batch, greatest(sqrt(sum(x * x)), 1e-8) AS u FROM p GROUP BY 1), y AS (SELECT batch, f, x / u AS x FROM p JOIN u USING (batch)), d AS (SELECT a.batch AS src, b.batch AS tgt, 1 - sum(a.x * b.x) AS dist FROM y a JOIN y b USING (f) WHERE a.batch <> b.batch GROUP BY 1, 2)"
#: All pairs, once: the distance is that of lists.
_PAIRS = "x AS MATERIALIZED (SELECT a.id AS src, b.id AS tgt, a.batch AS src_batch, b.batch AS tgt_batch, list_distance(a.v, b.v) ** 2 AS dist FROM e a, e b)"
_NORMED = "(SELECT col_id, sum(value) AS d, sum(value * value) AS d2 FROM t GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    request = ", ".join(f"({c}, {i + 1})" for i, c in enumerate(REQUEST))
    dense = ", ".join(f"coalesce(max(CASE WHEN new_col = {i + 1} THEN value END), 0)::DOUBLE AS c{i + 1}" for i in range(len(REQUEST)))
    merged = " UNION ALL ".join(f"SELECT {k} AS part, '{f}' AS flag, l_partkey AS p, l_orderkey AS own, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = '{f}' GROUP BY ALL" for k, f in enumerate("ANR"))
    return {
        "row_scores": f"{_sql_scores('row_id', _ROWS, 'orders')} SELECT row_id, row_name, {_SELECT_SCORES}",
        "col_scores": f"{_sql_scores('col_id', _COLS, 'part')} SELECT col_id, col_name, {_SELECT_SCORES}",
        "value_histogram": f"WITH {_T} SELECT round(value)::BIGINT AS bin, count(*) AS n FROM t GROUP BY 1",
        "matrix_info": f"WITH {_T} SELECT (SELECT count(*) FROM part) AS max_row, (SELECT count(*) FROM orders) AS max_col, (SELECT count(*) FROM t) AS max_elem",
        "build_sparse_sum": f"SELECT row_id, col_id, round(value, 6) AS value FROM ({_sql_built(450, 400)})",
        "symmetrize": f"WITH b AS ({_sql_built(400, 400)}) SELECT row_id, col_id, round(sum(value) * 0.5, 6) AS value FROM (SELECT * FROM b UNION ALL SELECT col_id, row_id, value FROM b) GROUP BY 1, 2",
        "select_columns": f"WITH {_T}, c AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey) - 1 AS col_id, concat('o', o_orderkey) AS col_name FROM orders WHERE {KEPT_COLUMN}) SELECT row_id, c.col_id, col_name, round(value, 6) AS value FROM t JOIN c ON t.col_id = c.old",
        "select_rows": f"WITH {_T}, r AS (SELECT p_partkey AS old, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE {KEPT_ROW}), x AS (SELECT new AS row_id, col_id, value FROM t JOIN r ON t.row_id = r.old), c AS (SELECT col_id AS old, row_number() OVER (ORDER BY col_id) - 1 AS new FROM (SELECT DISTINCT col_id FROM x)) SELECT row_id, new AS col_id, concat('o', old) AS col_name, round(value, 6) AS value FROM x JOIN c ON x.col_id = c.old",
        "filter_columns_nnz": f"WITH {_T}, c AS (SELECT col_id AS old, row_number() OVER (ORDER BY col_id) - 1 AS new FROM (SELECT col_id FROM t GROUP BY 1 HAVING count(*) >= 4)) SELECT row_id, new AS col_id, concat('o', old) AS col_name, round(value, 6) AS value FROM t JOIN c ON t.col_id = c.old",
        "merge_batches": f"WITH m AS ({merged}), r AS (SELECT p_partkey AS p, row_number() OVER (ORDER BY concat_ws('_', p_name, p_partkey)) - 1 AS row_id FROM part), c AS (SELECT part, flag, own, row_number() OVER (ORDER BY part, own) - 1 AS col_id FROM (SELECT part, flag, own FROM m GROUP BY ALL HAVING count(*) >= 2)) SELECT row_id, col_id, concat('o', own, '_', c.flag) AS col_name, round(value, 6) AS value FROM m JOIN r USING (p) JOIN c USING (part, own)",
        "common_names_union": "SELECT s_nationkey::VARCHAR AS name FROM supplier UNION SELECT c_nationkey::VARCHAR FROM customer UNION SELECT n_nationkey::VARCHAR FROM nation",
        "common_names_intersect": "SELECT s_nationkey::VARCHAR AS name FROM supplier INTERSECT SELECT c_nationkey::VARCHAR FROM customer INTERSECT SELECT n_nationkey::VARCHAR FROM nation",
        "column_index": f"WITH {_T}, n AS (SELECT o_orderkey AS col_id, coalesce(k, 0)::BIGINT AS nnz FROM orders LEFT JOIN (SELECT col_id, count(*) AS k FROM t GROUP BY 1) x ON x.col_id = o_orderkey) SELECT col_id, (sum(nnz) OVER (ORDER BY col_id) - nnz)::BIGINT AS first_pos, nnz FROM n",
        "index_check": f"WITH {_T} SELECT o_orderkey AS col_id, coalesce(k, 0)::BIGINT + 1 AS listed, coalesce(k, 0)::BIGINT AS found FROM orders LEFT JOIN (SELECT col_id, count(*) AS k FROM t GROUP BY 1) x ON x.col_id = o_orderkey WHERE o_orderkey % 100 = 0",
        "column_blocks": "WITH q AS (SELECT DISTINCT o_orderkey AS c FROM orders WHERE o_orderkey % 37 < 5 OR o_orderkey % 11 = 0), b AS (SELECT c, CASE WHEN c - lag(c) OVER (ORDER BY c) >= 10 THEN 1 ELSE 0 END AS new FROM q), s AS (SELECT c, (sum(new) OVER (ORDER BY c))::BIGINT AS block FROM b) SELECT block, min(c) AS lo, max(c) AS hi, count(*) AS n FROM s GROUP BY 1",
        "read_columns_sparse": f"WITH {_T}, q(col_id, new_col) AS (VALUES {request}) SELECT row_id, new_col::BIGINT AS col_id, value FROM t JOIN q USING (col_id)",
        "read_columns_dense": f"WITH {_T}, q(col_id, new_col) AS (VALUES {request}), x AS (SELECT row_id, new_col, value FROM t JOIN q USING (col_id)) SELECT p_partkey AS row_id, {dense} FROM part LEFT JOIN x ON x.row_id = p_partkey GROUP BY 1",
        "normalize_fixed": f"WITH {_T} SELECT row_id, col_id, round(value * 10000.0::DOUBLE / greatest(d, 1), 6) AS value FROM t JOIN {_NORMED} USING (col_id)",
        "normalize_median": f"WITH {_T}, n AS {_NORMED}, m AS (SELECT greatest(1, d) AS m FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS k FROM n) WHERE r = k // 2 + 1) SELECT row_id, col_id, round(value * m / greatest(d, 1), 6) AS value FROM t JOIN n USING (col_id), m",
        "l2_columns": f"WITH {_T} SELECT row_id, col_id, round(value / greatest(sqrt(d2), 1e-8), 6) AS value FROM t JOIN {_NORMED} USING (col_id)",
        "laplacian_norm": f"WITH {_T}, x AS (SELECT row_id, col_id, ln(1 + value * 10000.0::DOUBLE / greatest(d, 1)) AS value FROM t JOIN {_NORMED} USING (col_id)), n AS (SELECT col_id, sum(value * value) AS n2 FROM x GROUP BY 1), m AS (SELECT avg(n2) AS m2 FROM n) SELECT row_id, col_id, round(value / sqrt(greatest(1, n2 + m2)), 6) AS value FROM x JOIN n USING (col_id), m",
        "standardize_columns": f"WITH {_FEW}, s AS (SELECT o_orderkey AS col_id, coalesce(sum(value), 0) / 25 AS m, sqrt(greatest(coalesce(sum(value * value), 0) / 25 - (coalesce(sum(value), 0) / 25) ** 2, 0)) AS sd FROM orders LEFT JOIN t ON t.col_id = o_orderkey GROUP BY 1) SELECT r.row_id::BIGINT AS row_id, s.col_id, round((coalesce(value, 0) - m) / greatest(sd, 1e-8), 6) AS value FROM range(25) r(row_id) CROSS JOIN s LEFT JOIN t ON t.row_id = r.row_id AND t.col_id = s.col_id",
        "top_columns_cv": f"{_sql_scores('col_id', _COLS, 'part')}, v AS (SELECT col_id, round(CASE WHEN abs(mean) > 1e-8 THEN sd / abs(mean) ELSE 0 END, 6) AS cv FROM k) SELECT col_id, cv FROM v ORDER BY cv DESC, col_id LIMIT 50",
        "pseudobulk_sum_mean": f"WITH {_T}, m AS (SELECT o_orderkey AS col_id, c_nationkey::BIGINT AS indv, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey), z AS (SELECT indv, label, count(*) AS z FROM m GROUP BY ALL) SELECT row_id, indv, label, round(sum(value), 6) AS sum, round(sum(value) / any_value(z), 6) AS mean FROM t JOIN m USING (col_id) JOIN z USING (indv, label) GROUP BY row_id, indv, label",
        "annotate_join": "SELECT o_orderkey AS col_id, concat('o', o_orderkey) AS col_name, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '?' END AS label FROM orders",
        "knn_l2": _sql_knn(5, _D, _E),
        "knn_cosine": _sql_knn(5, f"1 - {_DOT}", _UNIT),
        "knn_balanced": f"WITH {_E}, s AS (SELECT batch, count(*) AS n, count(*) OVER () AS nb FROM e GROUP BY 1) SELECT src, tgt, dist, src_batch, tgt_batch FROM (SELECT a.id AS src, b.id AS tgt, round({_D}, 6) AS dist, a.batch AS src_batch, b.batch AS tgt_batch, greatest(1, least(20, n) // nb) AS q, row_number() OVER (PARTITION BY a.id, b.batch ORDER BY round({_D}, 10), b.id) AS r FROM e a, e b JOIN s ON s.batch = b.batch) WHERE r <= q AND src <> tgt",
        "knn_reciprocal": f"WITH {_E}, {_PAIRS}, n AS MATERIALIZED (SELECT src, tgt, dist FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 8), m AS MATERIALIZED (SELECT * FROM n WHERE src <> tgt) SELECT a.src, a.tgt, round(a.dist, 6) AS dist FROM m a JOIN m b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src < a.tgt",
        "knn_reweighted_distances": f"WITH {_E}, {_PAIRS}, n AS MATERIALIZED (SELECT src, tgt, dist FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 8), m AS MATERIALIZED (SELECT * FROM n WHERE src <> tgt) SELECT a.src, a.tgt, round(a.dist / 64, 6) AS dist FROM m a JOIN m b ON a.src = b.tgt AND a.tgt = b.src QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY a.tgt) <= 5",
        "knn_named": f"WITH {_E}, {_PAIRS} SELECT concat('v', src) AS src_name, concat('v', tgt) AS tgt_name, round(dist, 6) AS dist FROM x WHERE tgt_batch < 5 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 3",
        "poisson_rates": _sql_poisson(10),
        "residual_rates": _sql_residual(10),
        "counterfactual_nearest": f"WITH {_E}, {_PAIRS}, {_CELLS}, n AS (SELECT src, tgt FROM x WHERE src_batch % 2 <> tgt_batch % 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 1) SELECT src AS col_id, row_id::BIGINT AS row_id, value FROM n JOIN t ON t.col_id = n.tgt",
        "pairwise_nearest": f"WITH {_E}, {_PAIRS}, {_CELLS}, {_MATCH}, g AS (SELECT src, tgt FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 1), n AS (SELECT x.src, x.tgt, src_batch, tgt_batch FROM x JOIN g ON g.src = src_batch AND g.tgt = tgt_batch QUALIFY row_number() OVER (PARTITION BY x.src, tgt_batch ORDER BY round(dist, 10), x.tgt) <= 1), k AS (SELECT batch, count(*) AS k FROM e GROUP BY 1) SELECT src_batch::BIGINT AS src, tgt_batch::BIGINT AS tgt, 'ct1' AS label, a.row_id::BIGINT AS row_id, sum(a.value - b.value) AS sum_delta, sum(a.value - b.value) / any_value(k) AS mean_delta, ((sum(a.value) > 0)::INT + (sum(b.value) > 0)::INT)::INT AS nobs FROM n JOIN t a ON a.col_id = n.src JOIN t b ON b.col_id = n.tgt AND b.row_id = a.row_id JOIN k ON k.batch = src_batch GROUP BY src_batch, tgt_batch, a.row_id",
        "paired_covariates": f"WITH {_E}, {_MATCH}, g AS (SELECT src, tgt FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) <= 1) SELECT src::BIGINT AS src, tgt::BIGINT AS tgt, 1.0::DOUBLE AS weight, (a.f - 1)::INT AS factor, round(a.x - b.x, 6) AS covar FROM g JOIN y a ON a.batch = src JOIN y b ON b.batch = tgt AND b.f = a.f",
        "column_degrees_scaled": f"WITH {_T} SELECT row_id, col_id, round(value / greatest(1, sqrt(d2 + 1)), 6) AS value FROM t JOIN {_NORMED} USING (col_id)",
        "nonempty_columns": f"WITH {_T} SELECT col_id, concat('o', col_id) AS col_name, count(*) AS nnz FROM t GROUP BY 1",
        "read_block": f"WITH {_FEW}, q(col_id, new_col) AS (VALUES {request}), p(row_id, new_row) AS (VALUES (3, 1), (1, 2), (24, 3), (77, 4)) SELECT new_row::BIGINT AS row_id, new_col::BIGINT AS col_id, value FROM t JOIN q USING (col_id) JOIN p USING (row_id)",
        "read_column_range": f"WITH {_T} SELECT row_id, col_id - 100 AS col_id, value FROM t WHERE col_id >= 100 AND col_id < 600",
        "relabelled_by_size": "WITH k AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS new_label FROM orders GROUP BY 1) SELECT label, o_orderkey AS col_id, new_label FROM orders JOIN k ON label = o_orderpriority",
        "observed_products": f"WITH {_FEW} SELECT a.row_id AS i, b.row_id AS j, round(sum(a.value * b.value), 4) AS product, count(*)::DOUBLE AS n FROM t a JOIN t b USING (col_id) GROUP BY 1, 2",
        "topic_features": f"WITH {_E}, {_PAIRS}, {_CELLS}, s AS (SELECT batch, count(*) AS n, count(*) OVER () AS nb FROM e GROUP BY 1), n AS MATERIALIZED (SELECT src, tgt FROM (SELECT src, tgt, greatest(1, least(20, n) // nb) AS q, row_number() OVER (PARTITION BY src, tgt_batch ORDER BY round(dist, 10), tgt) AS r FROM x JOIN s ON s.batch = tgt_batch) WHERE r <= q AND src <> tgt), g AS (SELECT DISTINCT least(a.src, a.tgt) AS src, greatest(a.src, a.tgt) AS tgt FROM n a JOIN n b ON a.src = b.tgt AND a.tgt = b.src), k AS (SELECT *, row_number() OVER (ORDER BY src, tgt) AS edge_id FROM g) SELECT a.row_id::BIGINT AS row_id, edge_id, (a.value + b.value) / 2 AS value FROM k JOIN t a ON a.col_id = src JOIN t b ON b.col_id = tgt AND a.row_id = b.row_id",
        "file_set": f"WITH {_FEW}, c AS (SELECT o_orderkey, concat('o', o_orderkey) AS col_name, row_number() OVER (ORDER BY o_orderkey) AS col_id, coalesce(k, 0) AS nnz FROM orders LEFT JOIN (SELECT col_id AS o, count(*) AS k FROM t GROUP BY 1) ON o = o_orderkey), i AS (SELECT *, (sum(nnz) OVER (ORDER BY col_id) - nnz)::BIGINT AS first_pos FROM c) SELECT concat('r', t.row_id) AS row_name, col_name, t.row_id + 1 AS row_id, i.col_id, round(value, 6) AS value, first_pos, nnz::BIGINT AS nnz FROM t JOIN i ON i.o_orderkey = t.col_id",
        "scaled_columns": f"WITH {_T} SELECT row_id, col_id, round(value * coalesce(1 - l_discount, 1), 6) AS value FROM t LEFT JOIN lineitem ON l_orderkey = col_id AND l_linenumber = 2",
        "filtered_scores": f"WITH {_T} SELECT row_number() OVER (ORDER BY col_id) - 1 AS col_id, concat('o', col_id) AS col_name, count(*) AS nnz, col_id AS old_id, count(*) AS full_nnz FROM t GROUP BY t.col_id HAVING count(*) >= 4",
        "streaming_variance": f"WITH {_T} SELECT row_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var FROM t GROUP BY 1",
        "knn_cross_group": _sql_knn(2, _D, _E, "a.batch <> b.batch", "a.id, b.batch", ", b.batch AS tgt_batch"),
        "match_individuals": f"WITH {_E}, l AS (SELECT batch, unnest(range(1, 65)) AS f, unnest(v) AS x FROM e), s AS (SELECT batch, f, sum(x) AS x FROM l GROUP BY ALL), h AS (SELECT f, greatest(sqrt(sum(x * x)), 1e-8) AS h FROM s GROUP BY 1), p AS (SELECT batch, f, x / h AS x FROM s JOIN h USING (f)), u AS (SELECT batch, greatest(sqrt(sum(x * x)), 1e-8) AS u FROM p GROUP BY 1), y AS (SELECT batch, f, x / u AS x FROM p JOIN u USING (batch)), d AS (SELECT a.batch AS src, b.batch AS tgt, 1 - sum(a.x * b.x) AS dist FROM y a JOIN y b USING (f) WHERE a.batch <> b.batch GROUP BY 1, 2) SELECT src::BIGINT AS src, tgt::BIGINT AS tgt, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 10), tgt) AS r FROM d) WHERE r <= 2",
        "dedup_pairs": f"WITH n AS ({_sql_knn(6, _D, _E)}) SELECT src, tgt, dist FROM (SELECT *, row_number() OVER (PARTITION BY least(src, tgt), greatest(src, tgt) ORDER BY dist, src) AS r FROM n WHERE src <> tgt) WHERE r = 1",
        "edge_features": f"WITH {_FEW}, {_CHAIN}, {_EF} SELECT src, tgt, row_id, round(value, 6) AS value FROM f",
        "feature_incidence": f"WITH {_FEW}, {_CHAIN}, {_EF}, {_NUM} SELECT row_id, edge_id, round(value, 6) AS value FROM f JOIN k USING (src, tgt)",
        "sample_incidence": f"WITH {_FEW}, {_CHAIN}, {_EF}, {_NUM} SELECT unnest([src, tgt]) AS col_id, edge_id, 1.0::DOUBLE AS value FROM k",
        "sample_adjacency": f"WITH {_CHAIN} SELECT row_id, col_id, round(sum(w) * 0.5, 6) AS value FROM (SELECT src AS row_id, tgt AS col_id, weight AS w FROM g UNION ALL SELECT tgt, src, weight FROM g) GROUP BY 1, 2",
        "marker_match": "WITH r AS (SELECT p_name, min(p_partkey) AS row_id FROM part GROUP BY 1) SELECT p_brand AS label, row_id, count(*)::DOUBLE AS value FROM part JOIN r USING (p_name) WHERE p_partkey % 3 = 0 GROUP BY 1, 2",
        "qc_disqualified": f"WITH {_FEW}, c(row_id, threshold) AS (VALUES (1, 10.0), (2, 1.0)) SELECT DISTINCT o_orderkey AS col_id FROM orders CROSS JOIN c LEFT JOIN t ON t.col_id = o_orderkey AND t.row_id = c.row_id WHERE coalesce(value, 0) < threshold",
        "least_squares": """WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_quantity, l_tax) AS c, var_pop(l_discount) AS d, covar_pop(l_discount, l_tax) AS e, var_pop(l_tax) AS f, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v, covar_pop(l_tax, l_extendedprice) AS w FROM lineitem GROUP BY 1),
    k AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
    g AS (SELECT *, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS b1, (a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - v * c)) / det AS b2, (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS b3 FROM k),
    p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, my + b1 * (l_quantity - m1) + b2 * (l_discount - m2) + b3 * (l_tax - m3) AS f FROM lineitem JOIN g USING (l_returnflag)) SELECT l_orderkey, l_linenumber, round(f, 4) AS fitted, round(y - f, 4) AS residual FROM p""",
        "regression_residuals": "WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 4) AS fitted, round(l_extendedprice - (a + b * l_quantity), 4) AS residual FROM lineitem JOIN s USING (l_returnflag)",
    }
