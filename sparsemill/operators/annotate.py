"""Labels of columns from marker features: a mixture of directions on the marker rows, fitted by expectation-maximisation.

Markers, directions and scores are tables: a column's score for a label is a sum over the cells that lie on the label's own
marker rows, so that no task holds all markers or all labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import renumber, settled


def annotation(cells: DataFrame, cols: DataFrame, markers: DataFrame, anti: DataFrame | None = None, disqualified: DataFrame | None = None, take_ln: bool = False, kappa_max: float = 100.0, iterations: int = 100, tol: float = 1e-4, sample: bool = False, seed: int = 1, bessel: bool = False) -> dict[str, DataFrame]:
    """What markers(label, row_id[, set]) and counter-markers anti(label, row_id[, set]) say of the columns:

    annotation: (col_id, argmax, max_prob, max_ln_prob, max_score), a row for each of cols;
    posterior: (col_id, label, prob), a row for each column that has a label and each label;
    parameters: (set, label, row_id, mu, mu_anti, mean): directions, and the mean of the label's columns, on each row where
    one of them is not zero; kappas: (set, kappa, kappa_anti).

    Several annotation sets share labels; without set there is one. For each set a column is restricted to the rows that
    are a marker of some label in it and brought to unit length; a label's score is the sum over sets of kappa mu'x less
    kappa_anti mu_anti'x. A round gives each column its best label, or one drawn with the seed, and sums columns by label.
    It ends when the mean score over two rounds moves by less than tol. Columns that are disqualified or have no cell on a
    marker row are Incomplete. kappa is the closed approximation in the mean direction's length or, with bessel, the
    likeliest one. Markers without label or row, and repeated ones, do not count."""
    with_set = lambda m: m.select("label", "row_id", (F.col("set") if "set" in m.columns else F.lit(0)).cast("int").alias("set")).where("label is not null and row_id is not null").distinct()
    up = with_set(markers).withColumn("up", F.lit(1.0))
    marks = up if anti is None else up.join(with_set(anti).withColumn("down", F.lit(1.0)), ["label", "row_id", "set"], "full_outer")
    if anti is None:
        marks = marks.withColumn("down", F.lit(0.0))
    names = settled(renumber(up.select("label").distinct(), "label", "k").withColumn("k", F.col("k").cast("int")), "labels")
    n_labels = names.count()
    marks = settled(marks.fillna(0.0, ["up", "down"]).join(names, "label").select("set", "k", "row_id", "up", "down"), "marks")
    d = marks.select("row_id").distinct().count()

    x = cells.where("value <> 0").join(marks.where("up > 0").select("set", "row_id").distinct(), "row_id")
    if disqualified is not None:
        x = x.join(disqualified.select("col_id").distinct(), "col_id", "left_anti")
    if take_ln:
        x = x.withColumn("value", F.log2(1 + F.col("value")))
    length = F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("col_id", "set"))), F.lit(1e-8))
    x = settled(x.join(cols.select("col_id").distinct(), "col_id", "left_semi").select("set", "row_id", "col_id", (F.col("value") / length).alias("x")), "marked")

    def scores(params: DataFrame) -> DataFrame:
        """(col_id, k, score) of the labels with a marker row in common with the column; the others' are 0."""
        own = params.select("set", "k", "row_id", (F.col("kappa") * F.col("mu") - F.col("kappa_anti") * F.col("mu_anti")).alias("w"))
        return x.join(own, ["set", "row_id"]).groupBy("col_id", "k").agg(F.sum(F.col("x") * F.col("w")).alias("score"))

    def dense(found: DataFrame) -> DataFrame:
        """With a row for each column and label: the result has them all."""
        every = x.select("col_id").distinct().crossJoin(names.select("k"))
        return every.join(found, ["col_id", "k"], "left").fillna(0.0, ["score"])

    def chosen(found: DataFrame) -> DataFrame:
        """(col_id, k, score, rest) of the best label, the first of equal ones. rest: ln of the sum of exp(scores) over all."""
        by = found.groupBy("col_id").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"), F.collect_set("k").alias("own"), F.count("*").alias("n"), F.collect_list("score").alias("s"))
        first = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(max(0, n_labels - 1))), F.col("own")))
        other = (F.col("n") < n_labels) & ((F.col("b.score") < 0) | ((F.col("b.score") == 0) & (first < -F.col("b.k"))))
        by = by.withColumn("other", other).withColumn("k", F.when(F.col("other"), first).otherwise(-F.col("b.k"))).withColumn("score", F.when(F.col("other"), 0.0).otherwise(F.col("b.score")))
        rest = F.aggregate("s", (n_labels - F.col("n")) * F.exp(-F.col("score")), lambda a, s: a + F.exp(s - F.col("score")))
        return by.select("col_id", "k", "score", (F.col("score") + F.log(rest)).alias("rest"))

    def summed(best: DataFrame) -> DataFrame:
        return x.join(best.select("col_id", "k"), "col_id").groupBy("set", "k", "row_id").agg(F.sum("x").alias("s"))

    def unit(value):
        return value / F.greatest(F.sqrt(F.sum(value * value).over(Window.partitionBy("set", "k"))), F.lit(1e-8))

    def kappa(stats: DataFrame, mask: str, n: int) -> DataFrame:
        """(set, r): how far the sums of all columns, on the rows that mark their labels, point one way."""
        return stats.groupBy("set", "row_id").agg(F.sum(F.col("s") * F.col(mask)).alias("v")).groupBy("set").agg(F.least(F.sqrt(F.sum(F.col("v") * F.col("v"))) / max(n, 1), F.lit(1 - 1e-6)).alias("r"))

    def concentration(r):
        return F.least(r * (d - r * r) / (1 - r * r), F.lit(float(kappa_max)))

    params = marks.select("set", "k", "row_id", unit(F.col("up")).alias("mu"), unit(F.col("down")).alias("mu_anti"), F.lit(1.0).alias("kappa"), F.lit(1.0).alias("kappa_anti"))
    params, trace, best = settled(params, "directions"), [], None
    for it in range(iterations):
        found = scores(params)
        if sample:
            noise = -F.log(-F.log((F.xxhash64("col_id", "k", F.lit(seed), F.lit(it)).bitwiseAND(F.expr("9007199254740991L")) + 0.5) / F.lit(float(1 << 53))))
            drawn = dense(found).withColumn("g", F.col("score") + noise).groupBy("col_id").agg(F.max_by(F.struct("k", "score"), "g").alias("b"))
            best = settled(drawn.select("col_id", "b.k", "b.score"), "drawn")
        else:
            best = settled(chosen(found), "chosen")
        total = best.agg(F.count("*").alias("n"), F.avg("score").alias("score")).first()
        if not total["n"]:
            break
        stats = settled(marks.join(summed(best), ["set", "k", "row_id"], "left").fillna(0.0, ["s"]), "sums")
        size = kappa(stats, "up", total["n"]).join(kappa(stats, "down", total["n"]).withColumnRenamed("r", "r0"), "set")
        if bessel:
            from ..functions import special

            known = size.collect()  # a row a set
            exact = [[min(float(k), float(kappa_max)) for k in special.concentration([r[c] for r in known], d)] for c in ("r", "r0")]
            size = cells.sparkSession.createDataFrame([(r["set"], a, b) for r, a, b in zip(known, *exact)], "set int, kappa double, kappa_anti double")
        else:
            size = size.select("set", concentration(F.col("r")).alias("kappa"), concentration(F.col("r0")).alias("kappa_anti"))  # a row a set
        params = settled(stats.select("set", "k", "row_id", unit(F.col("s") * F.col("up")).alias("mu"), unit(F.col("s") * F.col("down")).alias("mu_anti")).join(F.broadcast(size), "set"), "directions")
        trace.append(total["score"])
        if it > 4:
            old, new = sum(trace[it - 3 : it - 1]), sum(trace[it - 1 : it + 1])
            if abs(old - new) / (abs(old) + tol) < tol:
                break

    found = settled(scores(params), "scores")
    done = settled(chosen(found), "labelled")
    labelled = done.join(names, "k").select("col_id", F.col("label").alias("argmax"), F.exp(F.col("score") - F.col("rest")).alias("max_prob"), (F.col("score") - F.col("rest")).alias("max_ln_prob"), F.col("score").alias("max_score"))
    out = cols.select("col_id").join(labelled, "col_id", "left").withColumn("argmax", F.coalesce(F.col("argmax").cast("string"), F.lit("Incomplete")))
    posterior = dense(found).join(done.select("col_id", "rest"), "col_id").join(names, "k").select("col_id", "label", F.exp(F.col("score") - F.col("rest")).alias("prob"))
    sizes = done.groupBy("k").agg(F.count("*").alias("n"))
    means = summed(done).join(sizes, "k").select("set", "k", "row_id", (F.col("s") / F.col("n")).alias("mean"))
    parameters = params.select("set", "k", "row_id", "mu", "mu_anti").join(means, ["set", "k", "row_id"], "full_outer").fillna(0.0, ["mu", "mu_anti", "mean"]).where("mu <> 0 or mu_anti <> 0 or mean <> 0")
    return {
        "annotation": out.fillna(0.0, ["max_prob", "max_ln_prob", "max_score"]),
        "posterior": posterior,
        "parameters": parameters.join(names, "k").select("set", "label", "row_id", "mu", "mu_anti", "mean"),
        "kappas": params.select("set", "kappa", "kappa_anti").distinct(),
    }


def annotate(cells: DataFrame, cols: DataFrame, markers: DataFrame, **more) -> DataFrame:
    """The annotation alone, see annotation()."""
    return annotation(cells, cols, markers, **more)["annotation"]


def annotate_factors(u, d, v: DataFrame, ids: list[int], cols: DataFrame, markers: DataFrame, **more) -> dict[str, DataFrame]:
    """annotation() of the matrix that factors stand for: u (rows by factors, in order of ids), d, and v(col_id, v). Only the
    marker rows among ids are made."""
    from .spectral import rebuilt

    own = markers.sparkSession.createDataFrame([(int(i),) for i in ids], "row_id long")
    marked = [r["row_id"] for r in markers.select("row_id").distinct().join(own, "row_id").collect()]  # at most as many as u has rows
    return annotation(rebuilt(v, u, d, ids, sorted(marked)), cols, markers, **more)
