"""Coordinate-format matrix text, name files, file sets and Parquet as the native layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Matrix, canonical, running, settled
from ..operators import edit


@dataclass(frozen=True)
class FileSet:
    mtx: str
    row: str
    col: str
    idx: str


def file_set(header: str) -> FileSet:
    return FileSet(f"{header}.mtx.gz", f"{header}.rows.gz", f"{header}.cols.gz", f"{header}.mtx.gz.index")


#: Where a line is: its file, its part of the file and its place there.
PLACE = ["_file", "_start", "_at"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the files of a folder, with their place; part files are in order of their names."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    return spark.read.text(path).select("value", *place)


def numbered_lines(spark: SparkSession, path: str, new: str) -> DataFrame:
    """(new, value): lines with their positions from 1. Parts of a file are read by different tasks."""
    return running(settled(_lines(spark, path), "lines"), PLACE, None, "_n").select((F.col("_n") + 1).alias(new), "value")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path).withColumn("line", F.trim(F.regexp_replace("value", r"[\r\t]", " ")))
    return lines.where(~F.col("line").startswith("%") & (F.col("line") != "")).select(F.split("line", r"\s+").alias("f"), *PLACE)


def read_info(spark: SparkSession, path: str) -> dict[str, int]:
    """max_row, max_col and max_elem of the first line that is not a comment."""
    f = _fields(spark, path).agg(F.min_by("f", F.struct(*PLACE)).alias("f")).first()["f"]
    return dict(zip(("max_row", "max_col", "max_elem"), map(int, f[:3])))


def text_dims(spark: SparkSession, path: str) -> dict[str, int]:
    """num_rows and num_cols of a dense text: its lines, and the words of the first one."""
    got = _lines(spark, path).agg(F.count("*").alias("n"), F.min_by("value", F.struct(*PLACE)).alias("first")).first()
    return {"num_rows": got["n"], "num_cols": len((got["first"] or "").split())}


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a matrix file, plain or gzip of any number of members, or of a folder of such; ids as in the file, from 1.
    Lines out of range are left out, repeated cells summed, zeros dropped. The header is told from cells by its place: the
    first line of fields."""
    info = read_info(spark, path)
    f = _fields(spark, path).select((F.col("f")[0]).cast("long").alias("row_id"), F.col("f")[1].cast("long").alias("col_id"), F.col("f")[2].cast("double").alias("value"), F.struct("_file", "_start", "_at").alias("_place"))
    first = f.agg(F.min("_place").alias("_first"))
    body = f.crossJoin(F.broadcast(first)).where(F.col("_place") != F.col("_first"))  # first is one row
    inside = F.col("row_id").between(1, info["max_row"]) & F.col("col_id").between(1, info["max_col"])
    return canonical(body.where(inside).select("row_id", "col_id", F.coalesce("value", F.lit(1.0)).alias("value")))


def read_named(spark: SparkSession, path: str, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells of a text of `row_name col_name value` lines, by the positions of their names; a name that occurs twice stands
    for its first position, and lines with other names are left out. Without a value it is 1."""
    f = _fields(spark, path).select(F.col("f")[0].alias("row_name"), F.get("f", F.lit(1)).alias("col_name"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
    at = lambda names, key, name: names.groupBy(name).agg(F.min(key).alias(key))
    return canonical(f.join(at(rows, "row_id", "row_name"), "row_name").join(at(cols, "col_id", "col_name"), "col_name"))


def read_names(spark: SparkSession, path: str, max_word: int, sep: str, key: str, name: str) -> DataFrame:
    """(key, name): one a line, its first words joined; positions from 1."""
    words = F.slice(F.split(F.trim("value"), r"\s+"), 1, max_word)
    return numbered_lines(spark, path, key).select(key, F.concat_ws(sep, words).alias(name))


def read_rows(spark: SparkSession, path: str, max_word: int = 2, sep: str = "_") -> DataFrame:
    return read_names(spark, path, max_word, sep, "row_id", "row_name")


def read_cols(spark: SparkSession, path: str, max_word: int = 100, sep: str = "@") -> DataFrame:
    return read_names(spark, path, max_word, sep, "col_id", "col_name")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("token")).where("token <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).select(F.col("f")[0].alias("key"), F.get("f", F.lit(1)).alias("value"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, values) of a dense text, a row a line, from 1."""
    f = F.split(F.trim("value"), r"\s+")
    return numbered_lines(spark, path, "row_id").select("row_id", F.transform(f, lambda x: x.cast("double")).alias("values"))


def read_matrix(spark: SparkSession, files: FileSet) -> Matrix:
    return Matrix(read_mtx(spark, files.mtx), read_rows(spark, files.row), read_cols(spark, files.col))


def write_mtx(m: Matrix, path: str) -> None:
    """Matrix text as a folder of part files, in order: the header first, then cells in order of columns. Ids are written as
    they are, so that they should start at 1."""
    spark = m.triplets.sparkSession
    d = m.dims().first()
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{d['max_row']} {d['max_col']} {d['max_elem']}")], "col_id long, row_id long, value string")
    body = m.triplets.select("col_id", "row_id", F.concat_ws(" ", "row_id", "col_id", F.col("value").cast("string")).alias("value"))
    head.unionByName(body).orderBy("col_id", "row_id").select("value").write.option("compression", "gzip").text(path)


def write_lines(df: DataFrame, path: str, order: str, *columns: str, sep: str = " ") -> None:
    """A line for each row in ascending order, of its columns: names, vectors, pairs and tuples."""
    df.orderBy(order).select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]).alias("value")).write.option("compression", "gzip").text(path)


def write_dense(values: DataFrame, path: str, key: str = "row_id") -> None:
    """A line for each row of values(key, values array)."""
    values.orderBy(key).select(F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value")).write.option("compression", "gzip").text(path)


def write_file_set(m: Matrix, header: str) -> FileSet:
    """Matrix, row names, column names and column index beside each other, readable by read_matrix, read_index and the two
    wrappers. Names are numbered from 1 in the order of their ids, and cells are written with these numbers."""
    files = file_set(header)
    rows = settled(running(m.rows, ["row_id"], None, "n").withColumn("n", F.col("n") + 1), "rows")
    cols = settled(running(m.cols, ["col_id"], None, "n").withColumn("n", F.col("n") + 1), "cols")
    cells = m.triplets.join(rows.select("row_id", F.col("n").alias("r")), "row_id").join(cols.select("col_id", F.col("n").alias("c")), "col_id")
    again = Matrix(settled(cells.select(F.col("r").alias("row_id"), F.col("c").alias("col_id"), "value"), "cells"), rows.select(F.col("n").alias("row_id"), "row_name"), cols.select(F.col("n").alias("col_id"), "col_name"))
    write_mtx(again, files.mtx)
    write_lines(again.rows, files.row, "row_id", "row_name")
    write_lines(again.cols, files.col, "col_id", "col_name")
    write_lines(edit.column_index(again.triplets, again.cols), files.idx, "col_id", "col_id", "first_pos", "nnz")
    return files


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(col_id, first_pos, nnz) as write_file_set stores it."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*[f[i].cast("long").alias(c) for i, c in enumerate(("col_id", "first_pos", "nnz"))])


def _chosen(spark: SparkSession, files: FileSet, columns: DataFrame | None) -> Matrix:
    m = read_matrix(spark, files)
    for names, name in ((m.rows, "row_name"), (m.cols, "col_name")):
        twice = names.groupBy(name).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name} {twice[0][name]!r} occurs more than once")
    return m if columns is None else edit.select_columns(m, columns)


def read_mtx_sparse(spark: SparkSession, files: FileSet, columns: DataFrame | None = None) -> Matrix:
    """The matrix of a file set, or of those of its columns that are in columns(col_name). Names that occur twice are an
    error."""
    return _chosen(spark, files, columns)


def read_mtx_dense(spark: SparkSession, files: FileSet, columns: DataFrame | None = None) -> DataFrame:
    """(col_id, col_name, values): for each column its values in all rows, in order, zeros included."""
    m = _chosen(spark, files, columns)
    lists = m.cols.join(edit.listed(m.triplets, "col_id", "row_id"), "col_id", "left")
    return edit.scattered(lists, ["col_id", "col_name"], m.rows.count())


def write_parquet(m: Matrix, folder: str) -> None:
    """The native layout: cells in ranges of columns and sorted, so that a range of columns is a range of row groups."""
    m.triplets.repartitionByRange("col_id").sortWithinPartitions("col_id", "row_id").write.parquet(f"{folder}/cells")
    m.rows.write.parquet(f"{folder}/rows")
    m.cols.write.parquet(f"{folder}/cols")


def read_parquet(spark: SparkSession, folder: str) -> Matrix:
    return Matrix(*(spark.read.parquet(f"{folder}/{x}") for x in ("cells", "rows", "cols")))
