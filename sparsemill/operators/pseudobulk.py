"""Sums, means and Gamma-Poisson estimates of columns grouped by individual and label, with counterfactual neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import running, settled


def membership(cols: DataFrame, pairs: DataFrame, to: str, missing: str = "?") -> DataFrame:
    """cols(col_id, col_name) with the first match in pairs(col_name, <to>), else the mark for missing."""
    order = Window.partitionBy("col_name").orderBy("pos" if "pos" in pairs.columns else to)
    first = pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("col_name", to)
    return cols.join(first, "col_name", "left").withColumn(to, F.coalesce(F.col(to).cast("string"), F.lit(missing)))


def pseudobulk(cells: DataFrame, member: DataFrame) -> DataFrame:
    """member(col_id, indv, label, z) to (row_id, indv, label, sum, mean): sum of y z, and that over the sum of z.

    Groups without weight get mean 0. Cells meet their columns' memberships in one join; sums are partial before it is
    shuffled by row and group."""
    weights = member.groupBy("indv", "label").agg(F.sum("z").alias("zsum"))
    sums = cells.join(member, "col_id").groupBy("row_id", "indv", "label").agg(F.sum(F.col("value") * F.col("z")).alias("sum"))
    return sums.join(weights, ["indv", "label"]).select("row_id", "indv", "label", "sum", F.when(F.col("zsum") > 1e-8, F.col("sum") / F.col("zsum")).otherwise(0.0).alias("mean"))


def poisson_gamma(cells: DataFrame, member: DataFrame, rows: DataFrame, a0: float = 1.0, b0: float = 1.0, rounds: int = 10, other: DataFrame | None = None) -> DataFrame:
    """(row_id, indv, label, mu, mu_sd, ln_mu, ln_mu_sd): rates of each individual and label beside a size of each column.

    mu = (a0 + sum z y) / (b0 + sum z rho), rho = (a0 + column sum) / (b0 + sum z mu), repeated. Both are grouped sums: the
    rates enter a column's size only by their total over rows for each label, so a round moves one number a label and
    one a column. With other (cells of matched columns under the same col_id), its sums are added to both. Every cell
    counts in the totals; rows without a cell of a group have the group's rate for zero.
    """
    arms = [cells] if other is None else [cells, other]
    zy = None
    for arm in arms:
        s = arm.join(member, "col_id").groupBy("row_id", "indv", "label").agg(F.sum(F.col("value") * F.col("z")).alias("zy"))
        zy = s if zy is None else zy.unionByName(s)
    zy = zy.groupBy("row_id", "indv", "label").agg(F.sum("zy").alias("zy"))
    zy = settled(zy)
    groups = member.groupBy("indv", "label").agg(F.sum("z").alias("zsum"))
    totals = groups.join(zy.groupBy("indv", "label").agg(F.sum("zy").alias("zytot")), ["indv", "label"], "left").fillna(0.0, ["zytot"])
    n_rows = rows.count()
    sizes = [member.select("col_id").distinct().join(arm.groupBy("col_id").agg(F.sum("value").alias("y")), "col_id", "left").fillna(0.0, ["y"]).withColumn("arm", F.lit(i)) for i, arm in enumerate(arms)]
    size = sizes[0] if len(sizes) == 1 else sizes[0].unionByName(sizes[1])
    cells_of = settled(member.join(size, "col_id"))
    shape = settled(totals.select("indv", "label", (F.lit(n_rows * a0) + F.col("zytot")).alias("top")))
    rho = cells_of.select("col_id", "arm", "indv", "label", "z", "y").withColumn("rho", F.lit(a0 / b0))
    rate = None
    for _ in range(max(1, rounds)):
        rate = settled(rho.groupBy("indv", "label").agg((F.lit(b0) + F.sum(F.col("z") * F.col("rho"))).alias("rate")))
        mu = shape.join(rate, ["indv", "label"]).select("indv", "label", (F.col("top") / F.col("rate")).alias("mu_total"))
        fit = cells_of.join(mu, ["indv", "label"]).groupBy("col_id", "arm").agg(((F.lit(a0) + F.first("y")) / (F.lit(b0) + F.sum(F.col("z") * F.col("mu_total")))).alias("rho"))
        rho = cells_of.join(fit, ["col_id", "arm"])
    every = rows.select("row_id").crossJoin(groups.select("indv", "label")).join(zy, ["row_id", "indv", "label"], "left").join(rate, ["indv", "label"])
    every = every.select("row_id", "indv", "label", (F.lit(a0) + F.coalesce("zy", F.lit(0.0))).alias("a"), F.col("rate").alias("b"))

    return _moments(every, "mu")


def _moments(every: DataFrame, name: str) -> DataFrame:
    """every(row_id, indv, label, a, b) with the mean and deviation of a Gamma(a, b) rate and of its logarithm."""

    def moments(batches):
        import numpy as np

        from ..functions.special import digamma

        for pdf in batches:
            a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
            shape = np.where(a > 1, np.maximum(a - 1, 1e-8), a)
            pdf[name], pdf[f"{name}_sd"] = a / b, np.sqrt(a) / b
            pdf[f"ln_{name}"], pdf[f"ln_{name}_sd"] = digamma(shape) - np.log(b), 1 / np.sqrt(shape)
            yield pdf.drop(columns=["a", "b"])

    kinds = {f.name: f.dataType.simpleString() for f in every.schema}
    every = every.select("row_id", "indv", "label", "a", "b")
    return every.mapInPandas(moments, f"row_id {kinds['row_id']}, indv {kinds['indv']}, label {kinds['label']}, {name} double, {name}_sd double, ln_{name} double, ln_{name}_sd double")


def residual_rates(cells: DataFrame, member: DataFrame, mu: DataFrame, a0: float = 1.0, b0: float = 1.0, rounds: int = 10, name: str = "resid_mu") -> DataFrame:
    """(row_id, indv, label, resid_mu, its deviation, and both of its logarithm): what is left of the cells' rates beside
    mu(row_id, indv, label, mu), which has a row for each row and group.

    residual = (a0 + sum z y) / (b0 + mu sum z rho), rho = (a0 + column sum) / (b0 + sum z total), with the total over rows
    of residual times mu, repeated: a round moves one number a group and one a column.
    """
    zy = cells.join(member, "col_id").groupBy("row_id", "indv", "label").agg(F.sum(F.col("value") * F.col("z")).alias("zy"))
    every = mu.select("row_id", "indv", "label", "mu").join(zy, ["row_id", "indv", "label"], "left")
    every = settled(every.select("row_id", "indv", "label", "mu", (F.lit(a0) + F.coalesce("zy", F.lit(0.0))).alias("a")))
    of = member.join(cells.groupBy("col_id").agg(F.sum("value").alias("y")), "col_id", "left").fillna(0.0, ["y"])
    of = settled(of.select("col_id", "indv", "label", "z", "y"))
    rate = settled(of.groupBy("indv", "label").agg((F.sum("z") * (a0 / b0)).alias("rate")))
    for _ in range(rounds):
        total = every.join(rate, ["indv", "label"]).groupBy("indv", "label").agg(F.sum(F.col("mu") * F.col("a") / (b0 + F.col("rate") * F.col("mu"))).alias("total"))
        rho = of.join(total, ["indv", "label"]).groupBy("col_id").agg(((a0 + F.first("y")) / (b0 + F.sum(F.col("z") * F.col("total")))).alias("rho"))
        rate = settled(of.join(rho, "col_id").groupBy("indv", "label").agg(F.sum(F.col("z") * F.col("rho")).alias("rate")))
    return _moments(every.join(rate, ["indv", "label"]).withColumn("b", b0 + F.col("rate") * F.col("mu")), name)


def matched_cells(cells: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """Cells of each source column as its neighbours have them: weighted mean over edges(keys, tgt, weight), src being one
    of the keys. (col_id, other keys, row_id, value)."""
    total = edges.groupBy(*keys).agg(F.sum("weight").alias("w"))
    near = edges.join(cells.select(F.col("col_id").alias("tgt"), "row_id", "value"), "tgt").groupBy(*keys, "row_id").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return near.join(total, list(keys)).select(F.col("src").alias("col_id"), *keys[1:], "row_id", (F.col("s") / F.greatest("w", F.lit(1e-8))).alias("value"))


def counterfactual(cells: DataFrame, vectors: DataFrame, treatment: str, k: int = 10, by: str = "mean", rows: DataFrame | None = None, **fit) -> DataFrame:
    """What each column would be in the other treatments, from its k nearest columns in each of them: their weighted mean
    or, by="regression", what a Poisson regression of the column on them gives in all of rows(row_id); fit: see
    regression.neighbour_regressions. A column without a column in another treatment has no rows."""
    from .knn import knn, with_weights
    from .regression import neighbour_regressions

    near = knn(vectors, vectors, k, "l2", treatment, other_groups=True).select("src", "tgt", "dist")
    if by == "regression":
        if rows is None:
            raise ValueError("a regression needs the names of the rows")
        return neighbour_regressions(cells, near, rows, **fit)
    return matched_cells(cells, with_weights(near))


def _matched_pairs(cells: DataFrame, member: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Own and matched cells (col_id, b, row_id, value) of the columns of pairs' first individuals, b being the second one."""
    from .knn import knn, with_weights

    who = member.select(F.col("col_id").alias("id"), "indv").distinct()
    v = vectors.join(who, "id")
    near = knn(v, v, k, "l2", "indv", other_groups=True, wanted=pairs.select(F.col("src").alias("q_group"), F.col("tgt").alias("t_group")))
    near = settled(near.withColumnRenamed("tgt_group", "b"), "matched")
    own = cells.join(near.select(F.col("src").alias("col_id"), "b").distinct(), "col_id").select("col_id", "b", "row_id", "value")
    return own, matched_cells(cells, with_weights(near, ("src", "b")), ("src", "b")).select("col_id", "b", "row_id", "value")


def pairwise_rates(cells: DataFrame, member: DataFrame, vectors: DataFrame, pairs: DataFrame, rows: DataFrame, k: int = 10, a0: float = 1.0, b0: float = 1.0, rounds: int = 10) -> DataFrame:
    """pairs(src, tgt) of individuals to (src, tgt, label, row_id) with mu, the rate that a pair's own and matched columns
    have in common, and delta, what its own columns have beside it, with deviations and logarithms of both."""
    own, other = _matched_pairs(cells, member, vectors, pairs, k)
    numbered = settled(running(pairs.select("src", "tgt").distinct(), ["src", "tgt"], None, "pair"), "pairs")
    of = member.join(numbered.select(F.col("src").alias("indv"), F.col("tgt").alias("b"), "pair"), "indv")
    key = F.struct("col_id", "b").alias("col_id")  # a column may be in several pairs
    of = of.select(key, F.col("pair").alias("indv"), "label", "z")
    own, other = (x.select(key, "row_id", "value") for x in (own, other))
    mu = settled(poisson_gamma(own, of, rows, a0, b0, rounds, other), "pair-rates")
    delta = residual_rates(own, of, mu, a0, b0, rounds, "delta")
    both = mu.join(delta, ["row_id", "indv", "label"]).withColumnRenamed("indv", "pair").join(numbered, "pair")
    return both.drop("pair")


def pairwise_delta(cells: DataFrame, member: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """pairs(src, tgt) of individuals to (src, tgt, label, row_id, sum_delta, mean_delta, nobs): own sums less those of the
    nearest columns of the other individual. A label without weight has a null mean."""
    own, other = _matched_pairs(cells, member, vectors, pairs, k)
    y0 = other.withColumns({"value": -F.col("value"), "arm": F.lit(1)})
    y1 = own.withColumn("arm", F.lit(0))
    parts = y1.unionByName(y0).join(member, "col_id")
    zy = F.col("value") * F.col("z")
    got = parts.groupBy("indv", "b", "label", "row_id").agg(F.sum(zy).alias("sum_delta"), (F.sum(F.when(F.col("arm") == 0, zy).otherwise(0.0)) > 0).cast("int").alias("o1"), (F.sum(F.when(F.col("arm") == 1, -zy).otherwise(0.0)) > 0).cast("int").alias("o2"))
    zsum = member.groupBy("indv", "label").agg(F.sum("z").alias("zsum"))
    return got.join(zsum, ["indv", "label"]).select(F.col("indv").alias("src"), F.col("b").alias("tgt"), "label", "row_id", "sum_delta", F.when(F.col("zsum") > 1e-8, F.col("sum_delta") / F.col("zsum")).alias("mean_delta"), (F.col("o1") + F.col("o2")).alias("nobs"))


def matched_covariates(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, tgt, v): the profile (group, v) of each pair's first individual less that of its second; other columns of pairs
    stay."""
    a, b = (profiles.select(F.col("group").alias(x), F.col("v").alias(f"_{x}")) for x in ("src", "tgt"))
    return pairs.join(a, "src").join(b, "tgt").withColumn("v", F.zip_with("_src", "_tgt", lambda x, y: x - y)).drop("_src", "_tgt")


def over_matches(values: DataFrame, pairs: DataFrame, *names: str) -> DataFrame:
    """values(src, tgt, label, row_id, names) of matched individuals to (src, label, row_id, names): means over the matches
    with the weights of pairs(src, tgt, weight). Within a pair the columns have weights of their own, so that a column's
    match counts by both. A pair without a value of its own (null) does not count."""
    w = F.col("weight")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))
    return values.join(pairs.select("src", "tgt", "weight"), ["src", "tgt"]).groupBy("src", "label", "row_id").agg(*[mean(c).alias(c) for c in names])
