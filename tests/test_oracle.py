"""Every query that SQL can express gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import math
import os

import pytest

from sparsemill import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) + 0.0 if isinstance(value, (float, int)) and not isinstance(value, bool) else value


def canon(names, found):
    """Rows with columns in order of names, sorted by what is not a measured number first."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(rows, key=lambda r: (repr([x if not isinstance(x, float) or x.is_integer() else None for x in r]), repr([round(x, 4) if isinstance(x, float) else 0 for x in r])))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    got, want = canon(df.columns, df.collect()), canon(names, rel.fetchall())
    assert len(got) == len(want)
    # A sum's last bit may differ; a digit that was rounded the other way may not.
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b))]
    assert not bad, bad[:3]


#: Held against numpy in test_numeric, test_search and test_models.
NUMERIC = "annotate annotate_factors annotate_posterior bbknn bbknn_matrix counterfactual counterfactual_regression edge_clusters knn_graph knn_graph_search knn_indexed knn_reweighted knn_weights match_files paired_means pairwise_delta poisson_pseudobulk simulate_mixture simulate_poisson svd_approx svd_em svd_project svd_sampled".split()


def test_every_query_is_held_against_something():
    assert sorted(set(catalog.queries()) - set(catalog.oracle_sql())) == NUMERIC


def test_data_is_there(sf):
    assert glob.glob(f"{sf}/*.parquet")
