"""Row and column statistics, histograms and normalisations of triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import count_true, nonzero, running, settled


def _scores(cells: DataFrame, names: DataFrame, key: str, other: DataFrame) -> DataFrame:
    sums = cells.groupBy(key).agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), count_true(nonzero(F.col("value"))).alias("nnz"))
    size = other.agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = names.join(sums, key, "left").crossJoin(F.broadcast(size))  # size is one row
    out = out.withColumn("sum", zero("s1")).withColumn("sum_sq", zero("s2")).withColumn("nnz", F.coalesce("nnz", F.lit(0)).cast("long"))
    out = out.withColumn("mean", F.col("sum") / F.greatest(F.col("n"), F.lit(1)))
    spread = F.greatest(F.col("sum_sq") - F.col("sum") * F.col("sum") / F.greatest(F.col("n"), F.lit(1)), F.lit(0.0))
    out = out.withColumn("sd", F.sqrt(spread / F.greatest(F.col("n") - 1, F.lit(1))))
    out = out.withColumn("cv", F.when(F.abs("mean") > 1e-8, F.col("sd") / F.abs("mean")).otherwise(0.0))
    return out.drop("s1", "s2", "n")


def row_scores(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """nnz, sum, sum_sq, mean, sd and cv of every named row; the number of columns is the divisor."""
    return _scores(cells, rows, "row_id", cols)


def col_scores(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The same of every named column."""
    return _scores(cells, cols, "col_id", rows)


def value_histogram(cells: DataFrame) -> DataFrame:
    """How many stored cells round to each whole number, halves away from zero."""
    return cells.groupBy(F.round("value").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def column_degrees(cells: DataFrame) -> DataFrame:
    return cells.groupBy("col_id").agg(F.sum("value").alias("degree"), F.sum(F.col("value") * F.col("value")).alias("norm2"))


def with_degrees(cells: DataFrame) -> DataFrame:
    """Cells with their column's degree and norm2: one shuffle by column."""
    column = Window.partitionBy("col_id")
    return cells.withColumns({"degree": F.sum("value").over(column), "norm2": F.sum(F.col("value") * F.col("value")).over(column)})


def normalize_fixed(cells: DataFrame, target: float = 1e4) -> DataFrame:
    """Columns scaled to the target; columns that sum to less than 1 are treated as 1."""
    out = with_degrees(cells)
    return out.select("row_id", "col_id", (F.col("value") * target / F.greatest("degree", F.lit(1.0))).alias("value"))


def median_degree(cells: DataFrame) -> DataFrame:
    """The upper median of the columns' sums, at least 1, as a single row."""
    # Written, as sums of doubles may differ in a bit when they are made again.
    sums = running(settled(column_degrees(cells).groupBy("degree").agg(F.count("*").alias("k")), "degrees"), ["degree"], "k", "before")
    total = sums.agg(F.sum("k").alias("total"))
    ranked = sums.crossJoin(F.broadcast(total))  # total is one row
    return ranked.where(F.col("before") + F.col("k") > F.floor(F.col("total") / 2)).agg(F.greatest(F.min("degree"), F.lit(1.0)).alias("median"))


def normalize_median(cells: DataFrame) -> DataFrame:
    """Columns scaled to the upper median of all columns' sums."""
    out = with_degrees(cells).crossJoin(F.broadcast(median_degree(cells)))  # one row
    return out.select("row_id", "col_id", (F.col("value") * F.col("median") / F.greatest("degree", F.lit(1.0))).alias("value"))


def normalize_l2(cells: DataFrame) -> DataFrame:
    """Columns of unit length, lengths below 1e-8 treated as that."""
    out = with_degrees(cells)
    return out.select("row_id", "col_id", (F.col("value") / F.greatest(F.sqrt("norm2"), F.lit(1e-8))).alias("value"))


def scale_by_degree(cells: DataFrame, tau: float = 1.0) -> DataFrame:
    """Columns divided by max(1, sqrt(sum of squares + tau))."""
    out = with_degrees(cells)
    return out.select("row_id", "col_id", (F.col("value") / F.greatest(F.lit(1.0), F.sqrt(F.col("norm2") + tau))).alias("value"))


def relabelled_by_size(labels: DataFrame, label: str = "label") -> DataFrame:
    """labels with new_label: 0 for the label with the most rows, 1 for the next, ...; the smaller label first among equals."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("_size")).withColumn("_less", -F.col("_size"))
    order = running(sizes, ["_less", label], None, "new_label").select(label, "new_label")
    return labels.join(order, label)


def observed_products(x: DataFrame, y: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """x(i, k, value), y(k, j, value) to (i, j, product, n): sums over the k at which both have a cell, and how many these
    are, with pseudo added. Pairs without a common k are left out. A k with many cells on both sides gives all their
    pairs, as a product does; sums are partial before they are shuffled."""
    both = x.select("i", "k", F.col("value").alias("_x")).join(y.select("k", "j", F.col("value").alias("_y")), "k")
    return both.groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("product"), (F.count("*") + F.lit(pseudo)).alias("n"))


def laplacian(cells: DataFrame, target: float | None = 1e4, tau: float = 1.0, take_ln: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """Scaled columns (to the target or, with None, to the median), ln(1 + x), rows divided by the root of their weight,
    columns divided by sqrt(max(1, own sum of squares + tau * the mean of all columns')). The mean is over all columns."""
    x = normalize_median(cells) if target is None else normalize_fixed(cells, target)
    if take_ln:
        x = x.withColumn("value", F.when(F.col("value") > 0, F.log1p("value")).otherwise(0.0))
    if weights is not None:  # weights(row_id, weight)
        x = x.join(weights, "row_id").withColumn("value", F.when(F.col("weight") > 0, F.col("value") / F.sqrt("weight")).otherwise(0.0)).drop("weight")
    norms = column_degrees(x).select("col_id", "norm2")
    mean = norms.agg(F.avg("norm2").alias("mean2"))
    x = x.join(norms, "col_id").crossJoin(F.broadcast(mean))
    return x.select("row_id", "col_id", (F.col("value") / F.sqrt(F.greatest(F.lit(1.0), F.col("norm2") + tau * F.col("mean2")))).alias("value"))


def standardize(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every cell, stored or not, of the named rows and columns: (x - mean) / max(sd, 1e-8) by column, population sd.

    The result is dense; name the columns that are wanted."""
    n = rows.agg(F.count("*").alias("n"))
    stats = cols.select("col_id").join(cells.groupBy("col_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")), "col_id", "left").crossJoin(F.broadcast(n))
    mean = F.coalesce("s1", F.lit(0.0)) / F.col("n")
    stats = stats.select("col_id", mean.alias("m"), F.sqrt(F.greatest(F.coalesce("s2", F.lit(0.0)) / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
    every = rows.select("row_id").crossJoin(stats)
    return every.join(cells, ["row_id", "col_id"], "left").select("row_id", "col_id", ((F.coalesce("value", F.lit(0.0)) - F.col("m")) / F.greatest("sd", F.lit(1e-8))).alias("value"))


def top_columns(scores: DataFrame, n: int, by: str = "cv", seed: int | None = None) -> DataFrame:
    """The n columns with the largest score, the smaller id first among equals; by a seeded draw instead if by is random."""
    order = F.xxhash64("col_id", F.lit(seed or 0)) if by == "random" else F.desc(by)
    return scores.orderBy(order, "col_id").limit(n)
