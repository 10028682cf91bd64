"""Row and column statistics kept up to date over a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import count_true, nonzero


def streaming_sums(cells: DataFrame, key: str = "row_id") -> DataFrame:
    """cells, a stream or not, to running sums by key; write it with output mode complete or update. The sums merge, so a
    later cell only adds to them; repeated cells are taken as parts of one."""
    return cells.groupBy(key).agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), count_true(nonzero(F.col("value"))).alias("nnz"))
