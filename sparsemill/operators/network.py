"""Incidence of features and vertices with the edges of a neighbour graph; marker matching and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import running, settled

#: A list of checks is broadcast up to so many rows (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_CHECKS = 100_000


def edge_features(cells: DataFrame, edges: DataFrame, cutoff: float = 1e-4, weighted: bool = True, max_weight: float = 1.0) -> DataFrame:
    """(src, tgt, row_id, value): features above the cutoff at both ends; the mean of both, times the weight up to a most."""
    x = cells.where(F.col("value") > cutoff)
    a = x.select(F.col("col_id").alias("src"), "row_id", F.col("value").alias("xs"))
    b = x.select(F.col("col_id").alias("tgt"), "row_id", F.col("value").alias("xt"))
    w = F.least(F.col("weight"), F.lit(max_weight)) if weighted else F.lit(1.0)
    out = edges.join(a, "src").join(b, ["tgt", "row_id"]).select("src", "tgt", "row_id", ((F.col("xs") + F.col("xt")) * w / 2).alias("value"))
    return out.where(F.col("value") > cutoff)


def numbered_edges(found: DataFrame) -> DataFrame:
    """(edge_id, src, tgt) of edges with at least one feature, numbered from 1 in order of (src, tgt)."""
    numbered = running(found.select("src", "tgt").distinct(), ["src", "tgt"], None, "before")
    return numbered.select((F.col("before") + 1).alias("edge_id"), "src", "tgt")


def feature_incidence(found: DataFrame) -> DataFrame:
    return found.join(numbered_edges(found), ["src", "tgt"]).select("row_id", "edge_id", "value")


def vertex_incidence(edges: DataFrame) -> DataFrame:
    """(col_id, edge_id, value) of both ends of every numbered edge."""
    ends = F.explode(F.array("src", "tgt")).alias("col_id")
    return edges.select(ends, "edge_id", F.lit(1.0).alias("value"))


def adjacency(edges: DataFrame) -> DataFrame:
    """edges(src, tgt, weight) as (W + W') / 2."""
    from .edit import symmetrized

    return symmetrized(edges.select(F.col("src").alias("row_id"), F.col("tgt").alias("col_id"), F.col("weight").alias("value")))


def edge_names(edges: DataFrame, cols: DataFrame) -> DataFrame:
    a = cols.select(F.col("col_id").alias("src"), F.col("col_name").alias("a"))
    b = cols.select(F.col("col_id").alias("tgt"), F.col("col_name").alias("b"))
    return edges.join(a, "src").join(b, "tgt").select("edge_id", F.concat_ws("_", "a", "b").alias("edge_name"))


def topic_data(cells: DataFrame, cols: DataFrame, latent: DataFrame, k: int = 10, cutoff: float = 1e-4, weighted: bool = True, max_weight: float = 1.0) -> dict[str, DataFrame]:
    """Cells by edges of the columns' neighbour graph, from latent(id, batch, v): features (row_id, edge_id, value), edges
    (edge_id, src, tgt), names (edge_id, edge_name), vertices (col_id, edge_id, value) and adjacency."""
    from .knn import balanced_knn, reciprocal, reweighted

    mutual = settled(reciprocal(balanced_knn(latent, k)).select("src", "tgt"), "mutual")
    graph = reweighted(mutual, latent, k)  # without weighted only the adjacency has weights, and they wait for it
    if weighted:
        graph = settled(graph, "graph")
    place = F.row_number().over(Window.partitionBy("src").orderBy("tgt"))
    kept = graph if weighted else mutual.withColumn("_r", place).where(F.col("_r") <= k).withColumn("weight", F.lit(1.0))
    once = kept.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight").groupBy("src", "tgt").agg(F.avg("weight").alias("weight"))
    found = settled(edge_features(cells, once, cutoff, weighted, max_weight), "edge-features")
    edges = settled(numbered_edges(settled(found.select("src", "tgt").distinct(), "edges")), "edges")
    features = found.join(edges, ["src", "tgt"]).select("row_id", "edge_id", "value")
    return {"features": features, "edges": edges, "names": edge_names(edges, cols), "vertices": vertex_incidence(edges), "adjacency": adjacency(graph)}


def marker_match(markers: DataFrame, rows: DataFrame) -> DataFrame:
    """markers(label, feature) to (label, row_id, value): matched features, repeated pairs summed, the others left out.
    A name that occurs twice stands for its first row."""
    first = rows.groupBy("row_name").agg(F.min("row_id").alias("row_id"))
    return markers.join(first, markers["feature"] == first["row_name"]).groupBy("label", "row_id").agg(F.count("*").cast("double").alias("value"))


def unit_columns(cells: DataFrame, rows: DataFrame, take_ln: bool = False) -> DataFrame:
    """Cells on rows(row_id), log2(1 + x) if asked for, their columns brought to unit length: what annotation works on."""
    from .stats import normalize_l2

    x = cells.join(rows.select("row_id").distinct(), "row_id", "left_semi")
    return normalize_l2(x.withColumn("value", F.log2(1 + F.col("value"))) if take_ln else x)


def disqualified(cells: DataFrame, cols: DataFrame, checks: DataFrame) -> DataFrame:
    """checks(row_id, threshold) to the columns that are below a threshold on any of these rows; absent cells are 0. For
    thresholds on what annotation works on, give the cells of unit_columns."""
    n = checks.agg(F.count("*").alias("n_checks"), F.count_if(F.col("threshold") > 0).alias("n_above"))
    few = checks.limit(BROADCAST_CHECKS + 1).count() <= BROADCAST_CHECKS
    seen = cells.join(F.broadcast(checks) if few else checks, "row_id")
    per = seen.groupBy("col_id").agg(F.count_if(F.col("value") < F.col("threshold")).alias("low"), F.count_if(F.col("threshold") > 0).alias("seen_above"))
    out = cols.select("col_id").join(per, "col_id", "left").crossJoin(F.broadcast(n))
    return out.where((F.coalesce("low", F.lit(0)) > 0) | (F.coalesce("seen_above", F.lit(0)) < F.col("n_above"))).select("col_id")
