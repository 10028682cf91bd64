"""Mixing sources to target weights.

Words are summed per source, a target per source is filled up from the weights, and each document is taken
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.

The draws of a source are coupled, so that its words come near its target: its documents lie in strata of like size, a
stratum's first documents by a hash get the copy, and how many they are is the expected number rounded up or down. The
roundings of a source's strata are drawn together (a balanced sample): up in one makes down in others likelier, as
their sizes ask for, and each stays up with its own probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_unit, stage_table, table, text_or_empty

#: Up to so many strata of all sources, their thresholds are broadcast (some 60 bytes each); beyond, they are joined.
BROADCAST_STRATA = 500_000
#: Strata of sizes to a doubling; slices of a stratum's hashes, of which one is ranked.
STRATA, SLICES = 4, 1024
CYCLE = (5.0, 2.0, 1.0)


def n_words(text):
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """sources(source, source_size) with weight: by code point of the source, null last, the cycle repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def fill_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size, weight) with target and rate.

    All targets together are share times all sizes; each is in proportion to its weight but at most `most` times its
    source's size, and the excess goes to the others by weight until none is above. With sources in ascending order of
    most * size / weight, those before some point are full and the others share what is left at one level, so a single
    running sum gives the result of the repeated resharing: the level is the first, and largest, that lies at or below
    its own source's ratio. The table has one row a source.
    """
    cap = F.col("source_size") * F.lit(float(most))
    up = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    out = sources.withColumn("_cap", cap).withColumn("_ratio", cap / F.col("weight"))
    out = out.withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
    out = out.withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.col("_open"))
    out = out.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    level = F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))
    out = out.withColumn("target", F.least(F.col("_cap"), level))
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return out.select("source", "source_size", "weight", "target", "rate")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized(source, size) to one row a source. The hot source is summed before the shuffle."""
    return fill_targets(cyclic_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), share, most)


def _source_key() -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _stratum(size: str = "size") -> Column:
    return F.coalesce(F.floor(F.log2(F.col(size).cast("double")) * STRATA), F.lit(-1)).cast("int")  # no logarithm of 0


def balanced(p: list[float], size: list[float], draw) -> list[int]:
    """0 or 1 for each unit, 1 with probability p, and the sum of sizes of those with 1 near its expected value. Two open
    units at a time: one's probability goes up and the other's down, so that the expected sum stays, until one is at 0
    or 1. draw() gives numbers in [0, 1)."""
    p, at, tiny = list(p), None, 1e-9
    for j in sorted((k for k in range(len(p)) if tiny < p[k] < 1 - tiny), key=lambda k: (-size[k], k)):
        if at is None:
            at = j
            continue
        up = min((1 - p[at]) / size[j], p[j] / size[at])
        down = min(p[at] / size[j], (1 - p[j]) / size[at])
        step = up if draw() * (up + down) < down else -down
        p[at], p[j] = p[at] + step * size[j], p[j] - step * size[at]
        if not tiny < p[at] < 1 - tiny:
            at = j if tiny < p[j] < 1 - tiny else None
    if at is not None:
        p[at] = float(draw() < p[at])
    return [round(x) for x in p]


def thresholds(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """sized(source, size, h) and targets to (key, stratum, source_size, target, rate, least): documents of the stratum with
    h <= least get the copy. Rows are counted by slices of h before anything is ranked, and of a stratum's slices only one
    is, so that no task has a hot source's documents."""
    rows = sized.select(_source_key().alias("key"), _stratum().alias("stratum"), "size", "h", F.floor(F.col("h") * SLICES).cast("int").alias("slice"))
    slices = stage_table(rows.groupBy("key", "stratum", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "slices")
    strata = slices.groupBy("key", "stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    strata = strata.join(targets.select(_source_key().alias("key"), "source_size", "target", "rate"), "key")

    def rounded(key, pdf):
        import xxhash

        pdf = pdf.sort_values("stratum")
        want = (pdf["n"] * (pdf["rate"] % 1.0)).tolist()
        calls = iter(range(1 << 30))
        draw = lambda: (xxhash.xxh64_intdigest(f"{key[0]}\x00{next(calls)}", seed) >> 11) / (1 << 53)
        size = [w / n for w, n in zip(pdf["words"].tolist(), pdf["n"].tolist())]
        more = balanced([x % 1.0 if s > 0 else 0.0 for x, s in zip(want, size)], size, draw)
        pdf["taken"] = [int(x) + m for x, m in zip(want, more)]
        return pdf[["key", "stratum", "source_size", "target", "rate", "taken"]]

    taken = strata.groupBy("key").applyInPandas(rounded, "key string, stratum int, source_size long, target double, rate double, taken long")
    taken = stage_table(taken, "strata")
    order = Window.partitionBy("key", "stratum").orderBy("slice")
    upto = slices.withColumn("upto", F.sum("n").over(order)).join(taken.select("key", "stratum", "taken"), ["key", "stratum"])
    edge = upto.where((F.col("upto") >= F.col("taken")) & (F.col("upto") - F.col("n") < F.col("taken")))
    edge = edge.select("key", "stratum", "slice", (F.col("taken") - F.col("upto") + F.col("n")).alias("rank"))
    place = F.row_number().over(Window.partitionBy("key", "stratum").orderBy("h"))
    least = rows.join(edge, ["key", "stratum", "slice"]).withColumn("place", place).where("place = rank").select("key", "stratum", F.col("h").alias("least"))
    return taken.drop("taken").join(least, ["key", "stratum"], "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """(row, size, source_size, target, copies): every row of docs as a struct, so that no name of its columns clashes."""
    h, size = hash_unit("doc_id", seed=seed), n_words(F.col("text"))
    sized = stage_table(docs.select("source", size.alias("size"), h.alias("h")), "sizes")
    limits = stage_table(thresholds(sized, stage_table(source_targets(sized), "targets"), seed), "thresholds")
    small = F.broadcast(limits) if limits.count() <= BROADCAST_STRATA else limits
    rows = docs.select(F.struct("*").alias("row"), _source_key().alias("key"), size.alias("size"), h.alias("h")).withColumn("stratum", _stratum())
    copies = F.floor("rate") + (F.col("h") <= F.col("least")).cast("long")
    return rows.join(small, ["key", "stratum"]).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_table(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken.

    Null text has size 0; a null source is a source of its own, last in order; sources without words have target 0
    and their documents are not taken. Repeated rows are separate documents that share the draw. Other columns, whatever
    their names, have no effect. An empty table gives no rows.
    """
    out = _drawn(docs.select("doc_id", "source", "text"), seed)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents: every row of docs as often as it is taken, with the columns of docs, whatever their names. Rows
    without words may be taken, as they cost nothing; null sources and repeated rows are as in mix_table."""
    out = _drawn(docs, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))
