"""Simulated matrices with known structure, and plain regression on a bounded design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate_poisson(spark: SparkSession, mu, rho, n_col: int | None = None, individual: list[int] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cells (row_id, col_id, value) with value ~ Poisson(mu[row, individual] * rho), and (col_id, indv), ids from 1.

    mu: features by individuals; rho: sizes that columns draw from with replacement. A column's draws depend on the seed
    and its id alone, so that the number of partitions does not change the result. Columns without a cell are left out of
    the cells and stay in the second table."""
    import numpy as np

    mu, rho = np.asarray(mu, float), np.asarray(rho, float)
    n_col = n_col if n_col is not None else len(rho)
    given = np.asarray(individual) if individual is not None else None

    def draw(pdf_id):
        rng = np.random.default_rng([seed, int(pdf_id)])
        who = int(given[pdf_id - 1]) if given is not None else int(rng.integers(mu.shape[1]))
        return who, rng.poisson(mu[:, who] * rho[rng.integers(len(rho))])

    def columns(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for c in pdf["id"]:
                who, y = draw(c)
                for r in np.flatnonzero(y):
                    out.append((int(r) + 1, int(c), float(y[r])))
            yield pd.DataFrame(out, columns=["row_id", "col_id", "value"])

    def owners(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"col_id": pdf["id"], "indv": [draw(c)[0] for c in pdf["id"]]})

    ids = spark.range(1, n_col + 1)
    return ids.mapInPandas(columns, "row_id long, col_id long, value double"), ids.mapInPandas(owners, "col_id long, indv int")


def simulate_mixture(spark: SparkSession, mus: list, n_cell: int, dir_alpha: float = 1.0, gam_alpha: float = 2.0, gam_beta: float = 2.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Mixtures of the given feature by individual rates with a Dirichlet draw for each individual and a Gamma size
    (gam_beta is its scale) for each of its n_cell columns."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n_ind = np.asarray(mus[0]).shape[1]
    shares = rng.dirichlet([dir_alpha] * len(mus), n_ind)
    mu = sum(np.asarray(m, float) * shares[:, k][None, :] for k, m in enumerate(mus))
    rho = rng.gamma(gam_alpha, gam_beta, max(1000, n_cell))
    return simulate_poisson(spark, mu, rho, n_ind * n_cell, [i for i in range(n_ind) for _ in range(n_cell)], seed)


def _scaled(x):
    import numpy as np

    return x / np.maximum(x.std(0), 1e-8)


def simulate_individuals(n_ind: int, n_genes: int, n_causal: int = 5, n_covar: int = 3, pve1: float = 0.3, pve_covar: float = 0.5, p_assign: float = 0.5, reverse: float = 0.0, seed: int = 42) -> dict:
    """Rates of genes by individuals with an exposure that confounders and, by `reverse`, other genes assign. Returns
    ln rates, exposure, confounders and the causal genes."""
    import numpy as np

    rng = np.random.default_rng(seed)
    covar, noise = rng.normal(size=(n_ind, n_covar)), rng.normal(size=(n_ind, n_genes))
    back = rng.normal(size=n_ind)
    score = np.sqrt(max(0.0, 1 - p_assign - reverse)) * rng.normal(size=n_ind) + np.sqrt(p_assign) * _scaled(covar.sum(1)) + np.sqrt(reverse) * back
    w = (rng.uniform(size=n_ind) < 1 / (1 + np.exp(-score))).astype(float)
    causal = np.sort(rng.choice(n_genes, n_causal, replace=False))
    effect = np.zeros((n_ind, n_genes))
    effect[:, causal] = _scaled(w[:, None] * rng.normal(size=n_causal)[None, :])
    shared = _scaled(covar @ rng.normal(size=(n_covar, n_genes)))
    ln = np.sqrt(pve1) * effect + np.sqrt(pve_covar) * shared + np.sqrt(max(0.0, 1 - pve1 - pve_covar) + 1e-8) * _scaled(noise)
    return {"ln_mu": np.clip(ln, -8, 8), "exposure": w, "covariates": covar, "causal": causal.tolist()}


def simulate_eqtl(genotypes, n_genes: int, n_causal: int = 3, h2: float = 0.3, p0: float = 0.2, p1: float = 0.1, seed: int = 42) -> dict:
    """Expression of genes by individuals from genotypes, unobserved and population factors; the causal SNP of each of the
    causal genes is returned with it."""
    import numpy as np

    rng, x = np.random.default_rng(seed), np.asarray(genotypes, float)
    n, m = x.shape
    left = np.linalg.svd(x - x.mean(0), full_matrices=False)[0][:, : min(3, m)]
    u1 = np.sqrt(0.5) * _scaled(left) + np.sqrt(0.5) * rng.normal(size=left.shape)
    fitted, resid = safe_lm(x, u1)
    u0 = rng.normal(size=(n, 3))
    y = np.sqrt(p0) * _scaled(u0 @ rng.normal(size=(3, n_genes))) + np.sqrt(p1) * _scaled(u1 @ rng.normal(size=(u1.shape[1], n_genes)))
    y = y + np.sqrt(max(0.0, 1 - h2 - p0 - p1)) * rng.normal(size=(n, n_genes))
    genes, snps = np.sort(rng.choice(n_genes, n_causal, replace=False)), rng.integers(m, size=n_causal)
    y[:, genes] += np.sqrt(h2) * _scaled(resid[:, snps])
    return {"y": np.clip(y, -8, 8), "genes": genes.tolist(), "snps": snps.tolist()}


def safe_lm(y, c):
    """(fitted, residuals) of each column of y on c with intercept, by least squares that bear collinear columns."""
    import numpy as np

    y = np.asarray(y, float)
    x = np.column_stack([np.ones(len(y)), np.asarray(c, float)])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return fitted, y - fitted


def regression_residuals(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """df with fitted and residual of y on one covariate x in each group: grouped sums, then one join."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_m"))
    fitted = F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.col("_m"))
    return df.join(s, keys).withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("_a", "_b", "_m")
