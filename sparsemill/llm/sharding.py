"""Shards in random order by a two-pass external shuffle.

First pass: records are scattered into buckets by seeded hashes, each bucket small enough for a task's memory. Second pass:
a task loads a bucket, gives its records the order of a Fisher-Yates shuffle, and writes them to their places in the shards.
Bucket after bucket is one random order of all records, of which each shard is a run; counts of shards differ by at most one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import running
from .common import drop_at_exit, in_small_batches, shared_dir, table, text_or_empty

SHARDS = 16
#: Bytes of text in a bucket, on average, and tasks of the second pass at most; a task has several buckets beyond that.
BUCKET_BYTES, MOST_TASKS = 16 << 20, 1 << 16
#: Rows handed on at a time.
ROWS = 512
LAW = "rows"


def fisher_yates(n: int, rng) -> list[int]:
    """A random order of 0 .. n - 1: from the last place down, each swaps with one at or below it."""
    import numpy as np

    order, with_ = list(range(n)), rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = with_[i]
        order[i], order[j] = order[j], order[i]
    return order


def scattered(docs: DataFrame, seed: int) -> DataFrame:
    """docs as a written table with what their buckets depend on: _sh_h, a hash of doc_id and text; _sh_n, how many equal
    hashes its task has seen before; and _sh_p, the task, for those with any before. So copies of one row spread over all
    buckets, while other rows depend on nothing but themselves. As the table is written, a task that runs again cannot
    move a row from one bucket to another."""
    text = text_or_empty(F.col("text"))
    given = docs.withColumn("_sh_size", F.octet_length(text).cast("long") + 1).withColumn("_sh_h", F.xxhash64(F.lit(seed), F.col("doc_id"), text))
    kinds = T.StructType([*given.schema.fields, T.StructField("_sh_n", T.LongType()), T.StructField("_sh_p", T.IntegerType())])

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            n = []
            for h in b.column("_sh_h").to_pylist():
                n.append(k := seen.get(h, 0))
                seen[h] = k + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array([part if k else 0 for k in n], pa.int32())], [*b.schema.names, "_sh_n", "_sh_p"])

    path = f"{shared_dir(docs.sparkSession)}/scattered-{uuid.uuid4().hex}"
    drop_at_exit(docs.sparkSession, path)
    given.mapInArrow(number, kinds).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kinds).parquet(path)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write docs(doc_id, text, ...) to folder/shard=0 .. as Parquet, with all their columns and slot, a row's place in its
    shard; a column of docs named shard or slot is left out. Returns the folder.

    Every row of docs is in one shard; repeated rows are rows of their own and are dealt one by one, as all rows are, so
    that equal texts are spread. Null texts count as empty, rows without doc_id by their text. An empty table gives no
    shard. A bucket is loaded whole: on average bucket_bytes, and as much more as its longest text.
    """
    in_small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    names = docs.columns
    rows = scattered(docs, seed)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_sh_size"), F.lit(0)).alias("size")).first()
    n_rows, buckets = total["n"], max(shards, -(-total["size"] // bucket_bytes))
    rows = rows.withColumn("_sh_bucket", F.pmod(F.xxhash64("_sh_h", "_sh_n", "_sh_p", F.lit(seed)), F.lit(buckets)).cast("int"))
    before = running(rows.groupBy("_sh_bucket").agg(F.count("*").alias("_sh_rows")), ["_sh_bucket"], "_sh_rows", "_sh_before")
    # What lies before a bucket comes to it as a row of its own, ahead of the records.
    both = rows.withColumn("_sh_before", F.lit(None).cast("long")).unionByName(before.select("_sh_bucket", "_sh_before"), allowMissingColumns=True)
    tasks = min(buckets, MOST_TASKS)
    dealt = both.repartitionById(tasks, F.expr(f"int(bigint(_sh_bucket) * {tasks} div {buckets})")).sortWithinPartitions("_sh_bucket", F.col("_sh_before").isNull(), "_sh_h", "_sh_n", "_sh_p")
    kinds = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(batches):
        import numpy as np
        import pyarrow as pa

        def written(bucket, first, held):
            if not held:
                return
            loaded = pa.Table.from_batches(held)
            order = np.array(fisher_yates(loaded.num_rows, np.random.default_rng([seed, bucket])))
            place = first + np.arange(len(order), dtype="i8")
            shard = place * shards // n_rows
            slot = place - -(-shard * n_rows // shards)
            for lo in range(0, len(order), ROWS):
                now = slice(lo, lo + ROWS)
                taken = loaded.take(pa.array(order[now])).combine_chunks()
                for b in taken.append_column("shard", pa.array(shard[now], pa.int32())).append_column("slot", pa.array(slot[now], pa.int64())).to_batches():
                    yield b

        bucket, first, held = None, 0, []
        for b in batches:
            ids, heads, at = b.column("_sh_bucket").to_numpy(), b.column("_sh_before").to_pylist(), 0
            for i in [i for i, x in enumerate(heads) if x is not None]:
                if i > at:
                    held.append(b.slice(at, i - at).select(names))
                yield from written(bucket, first, held)
                bucket, first, held, at = int(ids[i]), heads[i], [], i + 1
            if at < b.num_rows:
                held.append(b.slice(at).select(names))
        yield from written(bucket, first, held)

    placed = dealt.select(*names, "_sh_bucket", "_sh_before").mapInArrow(shuffled, kinds)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return folder


def read_shards(spark, folder: str, docs: DataFrame) -> DataFrame:
    """The rows of the shards with the columns of docs, shard and slot."""
    fields = [f for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(folder)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    rows, data = read_shards(spark, write_shards(docs, folder), docs), text_or_empty(F.col("text")).cast("binary")
    return rows.select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).cast("long").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
