"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch holds the k smallest 64-bit hashes of a text's distinct shingles (five words, lower case; a shorter text is
one shingle). Sketches merge, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ranged
from .common import table, text_or_empty, window_hashes, word_hashes, words

K = 128
SHINGLE = 5
#: Neighbours are found in ranges of about so many documents. Bounds of so many ranges at most stand in the plan; beyond that
#: each of them is cut evenly by value.
RANGE_ROWS, BOUNDS = 4000, 1024


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add the column out: array<bigint>, ascending. A text without words, or null, has an empty sketch."""
    w, h = f"_{out}_words", f"_{out}_windows"
    df = df.withColumn(w, word_hashes(words(F.lower(F.col(text)))))
    n = F.size(F.col(w))
    one = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(F.col(w).cast("array<string>"), " "))))
    df = df.withColumn(h, F.when(n < shingle, one).otherwise(window_hashes(F.col(w), shingle)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(F.col(h))), 1, k)).drop(w, h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group of rows. Rows of a group are first merged in 64 parts, of at most k hashes each."""
    least = df.select(*keys, F.explode(sketch).alias("_h")).groupBy(*keys, "_h").count()
    part = Window.partitionBy(*keys, F.pmod("_h", F.lit(64))).orderBy("_h")
    least = least.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that both have; 1 if both sketches are empty."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th smallest hash's place in the range of hashes."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    inter = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def range_number(docs: DataFrame, key: str, rows: int, bounds: int) -> Column:
    """A number that does not fall as the key ascends, nulls first, about as many different ones as docs has times `rows`
    rows: which of the ranges between quantiles a key lies in, and which even part of that range. At most `bounds` numbers
    reach the driver."""
    k = F.col(key).cast("long")
    seen = docs.agg(F.count("*").alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi")).first()
    if seen["lo"] is None or seen["n"] <= rows:
        return F.lit(0).cast("long")
    parts = min(bounds, math.ceil(seen["n"] / rows))
    inner = docs.agg(F.percentile_approx(k, [i / parts for i in range(1, parts)], 100 * bounds).alias("b")).first()["b"] if parts > 1 else []
    edges = sorted({seen["lo"], *inner})
    fine, step = math.ceil(seen["n"] / len(edges) / rows), max(1, math.isqrt(len(edges)))

    def literal(values: list[int]) -> Column:
        return F.expr(f"array({', '.join(f'{v}L' for v in values)})")

    block = F.greatest(F.size(F.filter(literal(edges[::step]), lambda b: b <= k)), F.lit(1))  # how many coarse bounds lie at or below
    within = F.size(F.filter(F.slice(literal(edges), (block - 1) * step + 1, step), lambda b: b <= k))
    at = (block - 1) * step + F.greatest(within, F.lit(1))  # from 1
    low, high = (F.element_at(literal(v), at.cast("int")).cast("double") for v in (edges, [*edges[1:], seen["hi"] + 1]))
    part = F.least(F.floor((k.cast("double") - low) / (high - low) * fine), F.lit(fine - 1))
    return F.when(k.isNull(), 0).otherwise((at - 1) * fine + part).cast("long")


def with_guests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with _range and _guest: each range also gets a copy (_guest) of the rows with the least key of the next range that
    has rows, the last those of the first, so that every row's successor is in its own range. What is joined for that is one
    row a range."""
    out = docs.withColumn("_range", range_number(docs, key, RANGE_ROWS, BOUNDS))
    least = out.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("k"))).alias("least"))
    least = ranged(least.select("_range", F.col("least.k").alias("_least")), ["_range"])
    ends = least.groupBy("_part").agg(F.max("_range").alias("end"))
    before = ends.select("_part", F.lag("end").over(Window.orderBy("_part")).alias("_end"))  # a row a task
    own = F.lag("_range").over(Window.partitionBy("_part").orderBy("_range"))
    last = least.agg(F.max("_range").alias("_last"))
    hosts = least.withColumn("_own", own).join(F.broadcast(before), "_part").crossJoin(F.broadcast(last))  # a row a task, one row
    hosts = hosts.select(F.col("_range").alias("_from"), "_least", F.coalesce("_own", "_end", "_last").alias("_host"))
    guests = out.join(hosts, (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_least")))
    return out.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_range", F.col("_host")).select(*out.columns).withColumn("_guest", F.lit(True)))


def fingerprint_neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document with its sketch, that of its edited text, and how alike they and the next document's sketch are.

    Null text counts as empty. Order is ascending doc_id, null first, equal ids by hash of text; the last document is
    followed by the first, a single one by itself. Repeated rows stay. An empty table gives no rows.
    """
    docs = docs.select("doc_id", text_or_empty(F.col("text")).alias("_text"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_tie")
    out = with_guests(docs).withColumn("_tie", F.xxhash64("_text")).withColumn("_next", F.lead("_text").over(order))
    out = with_sketch(out, "_text", "_sketch", k)
    around = F.lead("_sketch").over(order)
    out = out.withColumn("_next_sketch", around).where(~F.col("_guest"))
    out = out.withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next"), F.lit(1), half))
    out = out.withColumn("_edited", edited).drop("_next")
    out = with_sketch(out, "_edited", "_edited_sketch", k)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_sketch")).alias("fingerprint"),
        as_string(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
        containment(F.col("_sketch"), F.col("_edited_sketch"), k).alias("contained_edited"),
        distinct_shingles(F.col("_sketch"), k).alias("shingles_estimate"),
    )


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
