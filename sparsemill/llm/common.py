"""What several operators share: words and shingles as Spark expressions, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import drop_at_exit, settled, shared_dir  # noqa: F401  shared_dir and drop_at_exit are for operators that write files

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"

def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives the loss of executors. The table
    is removed when the process ends."""
    return settled(df, name)


#: A table is broadcast up to so many bytes on disk.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all files that df is read from have at most so many bytes together. Asks the file system, not for rows."""
    spark, total = df.sparkSession, 0
    for f in df.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return total <= most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, as texts may be long: what a task holds in Python and beside the heap grows with it.
BATCH_ROWS = 2000


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_ROWS rows. Operators that send texts to Python ask for it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def few_at_once(column, n: int = 256):
    """The values of an Arrow column, n of them as Python objects at a time, as texts may be long."""
    for lo in range(0, len(column), n):
        yield from column.slice(lo, n).to_pylist()


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the system. Otherwise it stays with the worker, and workers serve
    one stage after another. Only the C library knows how; where it has no such call, nothing happens."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def without_spaces(text: Column) -> Column:
    return F.translate(text_or_empty(text), _SPACES, "")


def word_hashes(words_: Column) -> Column:
    return F.transform(words_, lambda x: F.xxhash64(x))


def window_hashes(hashes: Column, k: int = 5) -> Column:
    """64-bit hashes of all windows of k words, in order; empty for fewer than k words. hashes must be a plain column."""
    n = F.size(hashes)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))


def hash_unit(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    return F.expr("9007199254740991L").bitwiseAND(F.xxhash64(*columns, F.lit(seed))) / F.lit(float(1 << 53))
