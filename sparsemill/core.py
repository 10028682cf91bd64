"""The data model: triplets(row_id, col_id, value), names(id, name) and dims(max_row, max_col, max_elem) as DataFrames.

Absent cells are zeros. Statistics over cells therefore divide by the number of names on the other side, never by the
number of stored cells, and names without a cell still get a row.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A stored value counts as different from zero above this.
TINY = 1e-8


@dataclass
class Matrix:
    """A sparse matrix with named rows and columns. rows(row_id, row_name), cols(col_id, col_name)."""

    triplets: DataFrame
    rows: DataFrame
    cols: DataFrame

    def dims(self) -> DataFrame:
        """One row: max_row, max_col from the names, max_elem from the cells."""
        r = self.rows.agg(F.count("*").alias("max_row"))
        c = self.cols.agg(F.count("*").alias("max_col"))
        e = self.triplets.agg(F.count("*").alias("max_elem"))
        return r.crossJoin(c).crossJoin(e)  # three single rows


def canonical(cells: DataFrame) -> DataFrame:
    """One row for each (row_id, col_id): repeated cells are summed (partially before the shuffle), zeros left out."""
    out = cells.groupBy("row_id", "col_id").agg(F.sum(F.col("value").cast("double")).alias("value"))
    return out.where(F.col("value") != 0)


def nonzero(value: Column) -> Column:
    return F.abs(value) > TINY


def count_true(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a written table in ranges of order, with _part, the number of each row's range: ranges ascend."""
    return settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


#: Ranges that running numbers are taken in, at most, and rows of the sample that their bounds come from, for each.
MOST_RANGES, SAMPLED_ROWS = 1024, 32


def numbered_ranges(df: DataFrame, order: list[str]) -> Column:
    """The number of the range of `order` that a row lies in: about as many as there are shuffle partitions, alike in size,
    one for a small table. Bounds come from a bounded sample by hash and stand in the plan, so that the number depends on
    the row alone, however often df is read."""
    parts = max(1, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLED_ROWS * parts).collect()
    if len(sample) < SAMPLED_ROWS * parts or parts == 1:
        return F.lit(0)
    sample = sorted({tuple(r) for r in sample}, key=lambda r: [(x is not None, x) for x in r])
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)]
    kinds = [df.schema[c].dataType for c in order]
    literal = lambda rows: F.array(*[F.struct(*[F.lit(x).cast(k).alias(c) for x, k, c in zip(r, kinds, order)]) for r in rows])
    step, key = max(1, math.isqrt(len(bounds))), F.struct(*[F.col(c) for c in order])
    block = F.size(F.filter(literal(bounds[::step]), lambda b: b <= key))
    within = F.size(F.filter(F.slice(literal(bounds), F.greatest(block - 1, F.lit(0)) * step + 1, step), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + within)


def running(df: DataFrame, order: list[str], value: str | None, new: str) -> DataFrame:
    """df with new, the sum of value (or, without one, the number) of the rows before in order; no two rows should be equal
    in it, and df must give the same rows each time it is read, as it is read for the sums of ranges and for the result.
    Rows are summed within ranges; only one number a range is summed over all of them, so that no task gets more than its
    range."""
    df = df.withColumn("_part", numbered_ranges(df, order))
    x = F.col(value) if value else F.lit(1).cast("long")
    total = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = df.groupBy("_part").agg(F.sum(x).alias("_n")).select("_part", F.coalesce(total, F.lit(0)).alias("_before"))
    within = F.sum(x).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_part")  # at most MOST_RANGES rows
    return out.withColumn(new, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def renumber(names: DataFrame, key: str, new: str, order: list | None = None) -> DataFrame:
    """names with new = 0, 1, ... in order of key."""
    return running(names, order or [key], None, new)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one is made and set, on a single machine only: the
    executors of a cluster would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparsemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """df written to the shared folder and read back; it is removed when the process ends. Rounds of an iteration start from
    such tables, so that plans stay short and lost executors cost one round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparsemill-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(drop_settled)
    _written.append((spark, path))


def drop_settled() -> None:
    """Remove what settled() wrote in this process; a stopped session leaves that to the cluster's own clean-up."""
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            pass
    _written.clear()
