"""Matrix text, name files and the native layout."""

from __future__ import annotations

import gzip

from sparsemill.core import Matrix
from sparsemill.sources import mtx


def test_read_mtx_with_odd_lines(spark, tmp_path):
    path = tmp_path / "m.mtx.gz"
    with open(path, "wb") as out:  # two gzip members, a comment within, CRLF, double blanks, out of range, repeats, a zero
        out.write(gzip.compress(b"%%MatrixMarket matrix coordinate integer general\n% c\n3 4 6\n1 1 2\r\n"))
        out.write(gzip.compress(b"2  1 1.5e0\n%x\n9 1 7\n3\t2 -1\n3 2 0.25\n1 4 0\n2 4 1e-9"))
    assert mtx.read_info(spark, str(path)) == {"max_row": 3, "max_col": 4, "max_elem": 6}
    got = {(r["row_id"], r["col_id"]): r["value"] for r in mtx.read_mtx(spark, str(path)).collect()}
    assert got == {(1, 1): 2.0, (2, 1): 1.5, (3, 2): -0.75, (2, 4): 1e-9}


def test_names_lines_tokens_pairs(spark, tmp_path):
    path = tmp_path / "n.txt"
    path.write_text("a b c\nx\n  p   q  \n")
    assert [tuple(r) for r in mtx.read_rows(spark, str(path)).collect()] == [(1, "a_b"), (2, "x"), (3, "p_q")]
    assert [r["col_name"] for r in mtx.read_cols(spark, str(path)).collect()] == ["a@b@c", "x", "p@q"]
    assert mtx.read_lines(spark, str(path)).count() == 3 and mtx.read_tokens(spark, str(path)).count() == 6
    assert [tuple(r) for r in mtx.read_pairs(spark, str(path)).collect()] == [("a", "b"), ("x", None), ("p", "q")]
    dense = tmp_path / "d.txt"
    dense.write_text("1 2\n3 4.5\n")
    assert [list(r["values"]) for r in mtx.read_dense(spark, str(dense)).collect()] == [[1.0, 2.0], [3.0, 4.5]]
    assert mtx.file_set("h").idx == "h.mtx.gz.index"


def test_round_trips(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2, 1.5), (2, 1, 3.0), (2, 3, -1.0)], "row_id long, col_id long, value double")
    rows = spark.createDataFrame([(1, "r1"), (2, "r2")], "row_id long, row_name string")
    cols = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c3")], "col_id long, col_name string")
    m = Matrix(cells, rows, cols)
    mtx.write_parquet(m, str(tmp_path / "p"))
    again = mtx.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, again.triplets.collect())) == sorted(map(tuple, cells.collect()))
    mtx.write_mtx(m, str(tmp_path / "t"))
    lines = [r["value"] for r in mtx.numbered_lines(spark, str(tmp_path / "t"), "at").orderBy("at").collect()]
    assert lines == ["%%MatrixMarket matrix coordinate real general", "2 3 3", "2 1 3.0", "1 2 1.5", "2 3 -1.0"]


def test_file_set_round_trip(spark, tmp_path):
    import pytest

    cells = spark.createDataFrame([(10, 7, 1.5), (30, 5, 3.0), (30, 9, -1.0)], "row_id long, col_id long, value double")
    rows = spark.createDataFrame([(10, "ra"), (20, "rb"), (30, "rc")], "row_id long, row_name string")
    cols = spark.createDataFrame([(5, "c5"), (7, "c7"), (8, "c8"), (9, "c9")], "col_id long, col_name string")
    files = mtx.write_file_set(Matrix(cells, rows, cols), str(tmp_path / "m"))
    assert mtx.read_info(spark, files.mtx) == {"max_row": 3, "max_col": 4, "max_elem": 3}
    m = mtx.read_mtx_sparse(spark, files)
    assert sorted(map(tuple, m.triplets.collect())) == [(1, 2, 1.5), (3, 1, 3.0), (3, 4, -1.0)]
    assert sorted(map(tuple, m.rows.collect())) == [(1, "ra"), (2, "rb"), (3, "rc")]
    assert [tuple(r) for r in mtx.read_index(spark, files.idx).orderBy("col_id").collect()] == [(1, 0, 1), (2, 1, 1), (3, 2, 0), (4, 2, 1)]
    few = mtx.read_mtx_sparse(spark, files, spark.createDataFrame([("c9",), ("c5",)], "col_name string"))
    assert sorted(map(tuple, few.triplets.collect())) == [(3, 0, 3.0), (3, 1, -1.0)]
    dense = {r["col_name"]: list(r["values"]) for r in mtx.read_mtx_dense(spark, files).collect()}
    assert dense == {"c5": [0.0, 0.0, 3.0], "c7": [1.5, 0.0, 0.0], "c8": [0.0, 0.0, 0.0], "c9": [0.0, 0.0, -1.0]}
    twice = mtx.write_file_set(Matrix(cells, rows, cols.withColumn("col_name", cols["col_name"].substr(1, 1))), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="more than once"):
        mtx.read_mtx_sparse(spark, twice)


def test_named_text_and_dims(spark, tmp_path):
    path = tmp_path / "named.txt"
    path.write_text("ra c1 2\nrb c1\nrx c1 5\nra c1 1\n")
    rows = spark.createDataFrame([(1, "ra"), (2, "rb"), (3, "ra")], "row_id long, row_name string")
    cols = spark.createDataFrame([(1, "c1")], "col_id long, col_name string")
    assert sorted(map(tuple, mtx.read_named(spark, str(path), rows, cols).collect())) == [(1, 1, 3.0), (2, 1, 1.0)]
    assert mtx.text_dims(spark, str(path)) == {"num_rows": 4, "num_cols": 3}
    values = spark.createDataFrame([(2, [3.0, 4.5]), (1, [1.0, 2.0])], "row_id long, `values` array<double>")
    mtx.write_dense(values, str(tmp_path / "dense"))
    assert [(r["row_id"], list(r["values"])) for r in mtx.read_dense(spark, str(tmp_path / "dense")).orderBy("row_id").collect()] == [(1, [1.0, 2.0]), (2, [3.0, 4.5])]
