"""Whole analyses: inputs aligned, factors found where none are given, grouped estimates made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Matrix, settled
from ..operators.knn import group_profiles, match_groups, nearest_records
from ..operators.pseudobulk import counterfactual, matched_covariates, membership, over_matches, pairwise_delta, pairwise_rates, poisson_gamma, pseudobulk, residual_rates
from ..operators.spectral import svd


def align(cols: DataFrame, celltype: DataFrame, cell2indv: DataFrame, indv2exposure: DataFrame) -> DataFrame:
    """(col_id, col_name, label, indv, exposure, z): first matches by name (by pos if the table has it, else the least), NA
    where there is none."""
    out = membership(cols, celltype, "label", "NA")
    out = membership(out, cell2indv, "indv", "NA")
    exposure = indv2exposure.groupBy("indv").agg(F.min("exposure").alias("exposure"))
    out = out.join(exposure, "indv", "left").withColumn("exposure", F.coalesce(F.col("exposure").cast("string"), F.lit("NA")))
    return out.withColumn("z", F.lit(1.0))


def cocoa(m: Matrix, aligned: DataFrame, latent: DataFrame | None = None, rank: int = 10, k: int = 10, rounds: int = 5) -> dict[str, DataFrame]:
    """Sums, means, estimates, estimates together with what columns would be in other exposures, and what the columns have
    beside these."""
    member = aligned.select("col_id", "indv", "label", "z")
    if latent is None:
        latent = svd(m.triplets, m.rows, m.cols, rank)[2].withColumnRenamed("col_id", "id")
    v = latent.join(aligned.select(F.col("col_id").alias("id"), "exposure"), "id")
    cf = counterfactual(m.triplets, v, "exposure", k)
    both = poisson_gamma(m.triplets, member, m.rows, rounds=rounds, other=cf)
    return {
        "bulk": pseudobulk(m.triplets, member),
        "mu": poisson_gamma(m.triplets, member, m.rows, rounds=rounds),
        "cf": both,
        "resid": residual_rates(m.triplets, member, both, rounds=rounds),
    }


def pine(m: Matrix, aligned: DataFrame, latent: DataFrame | None = None, rank: int = 10, k_cell: int = 10, k_indv: int = 1) -> dict[str, DataFrame]:
    """Differences of matched individuals. knn: each individual's matches with distance and weight; pairs: each unordered
    pair once, by its nearest record; delta and rates by pair; mean_delta: delta over an individual's matches by weight;
    covar_ind: (group, v), the individuals' profiles; covar_matched: what a pair's first has beside its second."""
    member = aligned.select("col_id", "indv", "label", "z")
    if latent is None:
        latent = svd(m.triplets, m.rows, m.cols, rank)[2].withColumnRenamed("col_id", "id")
    v = latent.join(member.select(F.col("col_id").alias("id"), "indv"), "id")
    profiles = settled(group_profiles(v, "indv"), "covar")
    matches = settled(match_groups(v, "indv", k_indv, True, profiles), "matches")
    pairs = matches.drop("weight")
    delta = settled(pairwise_delta(m.triplets, member, latent, pairs, k_cell), "delta")
    return {
        "knn": matches,
        "pairs": nearest_records(pairs),
        "delta": delta,
        "mean_delta": over_matches(delta, matches, "sum_delta", "mean_delta"),
        "rates": pairwise_rates(m.triplets, member, latent, pairs, m.rows, k_cell),
        "covar_ind": profiles,
        "covar_matched": matched_covariates(profiles, matches),
    }
