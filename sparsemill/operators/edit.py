"""Building, selecting, merging and indexing of triplets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Matrix, canonical, count_true, nonzero, ranged, renumber, running, settled


def build_sparse(cells: DataFrame, n_row: int, n_col: int, symmetrize: bool = True) -> DataFrame:
    """cells(row_id, col_id[, weight]) from 1, out of range left out, repeated ones summed; (A + A') / 2 if square."""
    if "weight" not in cells.columns:
        cells = cells.withColumn("weight", F.lit(1.0))
    out = canonical(cells.where(F.col("row_id").between(1, n_row) & F.col("col_id").between(1, n_col)).select("row_id", "col_id", F.col("weight").alias("value")))
    return symmetrized(out) if symmetrize and n_row == n_col else out


def symmetrized(cells: DataFrame) -> DataFrame:
    half = F.col("value") * 0.5
    there = cells.select("row_id", "col_id", half.alias("value"))
    back = cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), half.alias("value"))
    return canonical(there.unionByName(back))


def select_columns(m: Matrix, names: DataFrame) -> Matrix:
    """Columns whose name is in names(col_name), in the matrix's own order, numbered anew; all rows stay."""
    chosen = settled(m.cols.join(names.select("col_name").distinct(), "col_name", "left_semi"), "chosen")
    kept = renumber(chosen, "col_id", "new")
    # A semi join goes below the sums of a matrix that is built from raw cells.
    cells = m.triplets.join(chosen.select("col_id"), "col_id", "left_semi").join(kept.select("col_id", "new"), "col_id").select("row_id", F.col("new").alias("col_id"), "value")
    return Matrix(cells, m.rows, kept.select(F.col("new").alias("col_id"), "col_name"))


def select_rows(m: Matrix, names: DataFrame) -> Matrix:
    """Rows whose name is in names(row_name), numbered anew; columns left without a cell go too."""
    chosen = settled(m.rows.join(names.select("row_name").distinct(), "row_name", "left_semi"), "chosen")
    kept = renumber(chosen, "row_id", "new")
    cells = m.triplets.join(chosen.select("row_id"), "row_id", "left_semi").join(kept.select("row_id", "new"), "row_id").select(F.col("new").alias("row_id"), "col_id", "value")
    return filter_columns(Matrix(cells, kept.select(F.col("new").alias("row_id"), "row_name"), m.cols), 1)


def filter_columns(m: Matrix, least: int) -> Matrix:
    """Columns with at least so many cells beyond 1e-8, numbered anew. Which they are is counted once and written."""
    return filter_columns_scored(m, least)[0]


def filter_columns_scored(m: Matrix, least: int) -> tuple[Matrix, DataFrame, DataFrame]:
    """filter_columns, with the number of cells (col_id, col_name, nnz) of the columns that stay, under their new numbers,
    and of all columns, under their old ones."""
    found = m.triplets.groupBy("col_id").agg(count_true(nonzero(F.col("value"))).alias("nnz"))
    every = settled(m.cols.join(found, "col_id", "left").select("col_id", "col_name", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz")), "scores")
    kept = renumber(every.where(F.col("nnz") >= least), "col_id", "new")
    cells = m.triplets.join(kept.select("col_id", "new"), "col_id").select("row_id", F.col("new").alias("col_id"), "value")
    scores = kept.select(F.col("new").alias("col_id"), "col_name", "nnz")
    return Matrix(cells, m.rows, scores.drop("nnz")), scores, every


def merge(parts: list[tuple[str, Matrix]], nnz_cutoff: int = 1, delim: str = "_", fixed_rows: DataFrame | None = None) -> Matrix:
    """Matrices side by side. Rows are the sorted union of names, or fixed_rows(row_id, row_name) in their order; columns
    with too few cells on those rows go; names get the part's name; cells of rows of the same name are summed. All parts'
    cells go through one join and one sum, and are written once."""
    one = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    named = one([m.rows.select(F.lit(at).alias("part"), F.col("row_id").alias("own"), "row_name") for at, (_, m) in enumerate(parts)])
    if fixed_rows is None:
        rows = renumber(named.select("row_name").distinct(), "row_name", "row_id")
    else:
        rows = fixed_rows.groupBy("row_name").agg(F.min("row_id").alias("row_id"))
    cells = one([m.triplets.select(F.lit(at).alias("part"), F.col("row_id").alias("own"), F.col("col_id").alias("own_col"), "value") for at, (_, m) in enumerate(parts)])
    cells = cells.join(named.join(rows, "row_name").select("part", "own", "row_id"), ["part", "own"])
    cells = settled(cells.groupBy("part", "row_id", "own_col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0"), "merged")
    nnz = cells.groupBy("part", "own_col").agg(count_true(nonzero(F.col("value"))).alias("nnz"))
    cols = one([m.cols.select(F.lit(at).alias("part"), F.col("col_id").alias("own_col"), F.concat_ws(delim, "col_name", F.lit(name)).alias("col_name")) for at, (name, m) in enumerate(parts)])
    cols = settled(cols.join(nnz, ["part", "own_col"], "left").where(F.coalesce("nnz", F.lit(0)) >= nnz_cutoff).drop("nnz"), "kept")
    cols = renumber(cols, "col_id", "col_id", ["part", "own_col"])
    out = cells.join(cols.select("part", "own_col", "col_id"), ["part", "own_col"]).select("row_id", "col_id", "value")
    return Matrix(out, rows.select("row_id", "row_name"), cols.select("col_id", "col_name"))


def common_names(lists: list[DataFrame], union: bool) -> DataFrame:
    """Sorted distinct names of all lists, or those that are in every one."""
    out = lists[0].distinct()
    for x in lists[1:]:
        out = out.union(x).distinct() if union else out.intersect(x)
    return out


def stack(upper: DataFrame, lower: DataFrame, offset: int, by: str = "row_id") -> DataFrame:
    """Cells of two matrices, one below (row_id) or beside (col_id) the other."""
    return upper.unionByName(lower.withColumn(by, F.col(by) + offset))


def column_index(cells: DataFrame, cols: DataFrame) -> DataFrame:
    """(col_id, first_pos, nnz) of every named column: its place among the cells in order of columns. Columns without a
    cell have the next one's place."""
    n = cols.select("col_id").join(cells.groupBy("col_id").agg(F.count("*").alias("nnz")), "col_id", "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)).cast("long"))
    return running(settled(n, "index"), ["col_id"], "nnz", "first_pos").select("col_id", "first_pos", "nnz")


def index_problems(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Columns whose cells are not as many as the index says; none for a correct index."""
    n = cells.groupBy("col_id").agg(F.count("*").alias("found"))
    both = index.join(n, "col_id", "full_outer")
    return both.select("col_id", F.coalesce("nnz", F.lit(0)).cast("long").alias("listed"), F.coalesce("found", F.lit(0)).cast("long").alias("found")).where("listed <> found")


def column_blocks(request: DataFrame, gap: int = 10) -> DataFrame:
    """request(col_id) as ranges (block, lo, hi, n): ids closer than gap lie in one."""
    ids = ranged(request.select("col_id").distinct(), ["col_id"])
    last = ids.groupBy("_part").agg(F.max("col_id").alias("last")).select("_part", F.lag("last").over(Window.orderBy("_part")).alias("last"))
    before = F.coalesce(F.lag("col_id").over(Window.partitionBy("_part").orderBy("col_id")), F.col("last"))
    new = F.coalesce((F.col("col_id") - before >= gap).cast("long"), F.lit(0).cast("long"))
    marked = settled(ids.join(F.broadcast(last), "_part").select("col_id", new.alias("new")), "gaps")  # a row a range
    marked = running(marked, ["col_id"], "new", "block").withColumn("block", F.col("block") + F.col("new"))
    return marked.groupBy("block").agg(F.min("col_id").alias("lo"), F.max("col_id").alias("hi"), F.count("*").alias("n"))


#: Ids up to so many are written into the plan, so that the filter reaches the Parquet scan; a longer list is a table. A list
#: of ids is broadcast up to BROADCAST_IDS (16 bytes each).
PUSHED_IDS, BROADCAST_IDS = 1000, 1_000_000


def asked_ids(cells: DataFrame, request: list[int], key: str, new: str) -> DataFrame:
    """Cells whose key is in the request, with new, its place there from 1. The range of a long list is pushed down too."""
    request = [int(c) for c in request]
    asked = cells.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(request)], f"{key} long, {new} long")
    if not request:
        found = cells.where(F.lit(False))
    elif len(request) <= PUSHED_IDS:
        found = cells.where(F.col(key).isin(request))
    else:
        found = cells.where(F.col(key).between(min(request), max(request)))
    return found.join(F.broadcast(asked) if len(request) <= BROADCAST_IDS else asked, key)


def read_columns(cells: DataFrame, request: list[int]) -> DataFrame:
    """Cells of the requested columns, numbered 1, 2, ... by their place in the request; a column asked for twice comes
    twice. The request is the caller's own list."""
    return asked_ids(cells, request, "col_id", "new_col").select("row_id", F.col("new_col").alias("col_id"), "value")


def read_column_range(cells: DataFrame, lo: int, hi: int) -> DataFrame:
    """Cells of the columns lo, ..., hi - 1, numbered from 0."""
    return cells.where((F.col("col_id") >= lo) & (F.col("col_id") < hi)).select("row_id", (F.col("col_id") - lo).alias("col_id"), "value")


def read_block(cells: DataFrame, row_request: list[int], col_request: list[int]) -> DataFrame:
    """Cells of the requested rows and columns, both numbered by their places in the requests."""
    found = asked_ids(asked_ids(cells, col_request, "col_id", "new_col"), row_request, "row_id", "new_row")
    return found.select(F.col("new_row").alias("row_id"), F.col("new_col").alias("col_id"), "value")


def nonempty_columns(m: Matrix) -> DataFrame:
    """(col_id, col_name, nnz) of columns with a cell beyond 1e-8; a column without a name has its number."""
    found = m.triplets.groupBy("col_id").agg(count_true(nonzero(F.col("value"))).alias("nnz")).where("nnz > 0")
    return found.join(m.cols, "col_id", "left").select("col_id", F.coalesce("col_name", F.col("col_id").cast("string")).alias("col_name"), "nnz")


def rows_overlap(rows: DataFrame, fixed: DataFrame) -> bool:
    """Whether at least one of fixed(row_name) is a row's name."""
    return bool(fixed.join(rows, "row_name", "left_semi").limit(1).count())


def scale_columns(cells: DataFrame, scale: DataFrame) -> DataFrame:
    """Cells times their column's factor in scale(col_id, scale), 1 where there is none."""
    return cells.join(scale, "col_id", "left").select("row_id", "col_id", (F.col("value") * F.coalesce("scale", F.lit(1.0))).alias("value"))


def scattered(lists: DataFrame, keys: list[str], n: int) -> DataFrame:
    """lists(keys, at array of places from 1, x array of values) to (keys, values): arrays of n with the values at their
    places and zeros elsewhere; a null list is all zeros. Places beyond n are an error."""
    import pyarrow as pa

    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in keys)

    def scatter(batches):
        import numpy as np

        rows = max(1, (1 << 24) // max(1, n))  # values that are made at a time
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                at, x = b.column("at"), b.column("x")
                size = np.array([0 if v is None else v for v in at.value_lengths().to_pylist()], "i8")
                out = np.zeros((b.num_rows, n))
                out[np.repeat(np.arange(b.num_rows), size), at.flatten().to_numpy(zero_copy_only=False) - 1] = x.flatten().to_numpy(zero_copy_only=False)
                made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype="i4") * n), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), made], [*keys, "values"])

    return lists.select(*keys, "at", "x").mapInArrow(scatter, f"{kinds}, values array<double>")


def listed(cells: DataFrame, key: str, place: str) -> DataFrame:
    """(key, at, x): places and values of each key's cells."""
    both = cells.groupBy(key).agg(F.collect_list(F.struct(F.col(place).cast("long").alias("at"), F.col("value").cast("double").alias("x"))).alias("_c"))
    return both.select(key, F.col("_c.at").alias("at"), F.col("_c.x").alias("x"))


def read_columns_dense(cells: DataFrame, rows: DataFrame, request: list[int]) -> DataFrame:
    """(row_id, values): for every named row its cells in the requested columns, zeros included."""
    found = listed(read_columns(cells, request), "row_id", "col_id")
    return scattered(rows.select("row_id").join(found, "row_id", "left"), ["row_id"], len(request))
