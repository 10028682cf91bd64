"""A proximity graph found by repeated joins of neighbours' neighbours (NN-descent), and search along it.

First lists come from blocks of vectors that lie on the same sides of random planes. In a round every vector's list, with a
bounded number of those that list the vector, is joined with itself: two neighbours of one vector are likely to be each
other's. Only pairs with an entry that is new since the last round are measured, only those better than the worst entry of a
full list are passed on, and the best of each vector stay. No list has more than width + 2 * reverse entries, however many
list the same vector; cells with many vectors are dealt over blocks of a bounded number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import settled
from .knn import _known, knn

#: Entries of a list while the graph is built; of those that list a vector, so many new and old ones each meet in a round.
WIDTH, REVERSE = 24, 16
#: Sets of planes for the first lists, vectors of a block, and planes at most, so that cells are at most 2**16 a set.
TREES, LEAF, MOST_PLANES = 2, 96, 16
#: Sets and block sizes at most, for many vectors: distances within a block cost little beside those of a round, and lists
#: that begin well save rounds. Vectors of a cell for which blocks are made as large as that by half; rows measured at once.
MOST_TREES, MOST_LEAF, LEAF_ROWS = 16, 4096, 512
#: Entry points of a search in each cell.
ENTRIES = 16
#: Up to so many targets a search takes all distances as products of blocks, at some 10 nanoseconds each: a walk moves a
#: vector for each of the thousands of distances that a query asks for, which costs thousands of times as much for each.
DENSE = 1 << 21


def _distances(x, y, space: str):
    """All distances between rows of x and y, both moved to the mean of y."""
    import numpy as np

    if space == "ip":
        return 1 - x @ y.T
    middle = y.mean(0)
    x, y = x - middle, y - middle
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0)


def _usual(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with an id and a vector of the commonest length, one for each id, written; their number and that length."""
    v = settled(_known(vectors).withColumn("dim", F.size("v")).dropDuplicates(["id"]), "vectors")
    found = v.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    return (v.where(F.col("dim") == found["dim"]), found["count"], found["dim"]) if found else (v, 0, 0)


def _rows(column):
    """A column of lists of one length as a matrix."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _cells(vectors: DataFrame, planes, middle) -> DataFrame:
    """vectors(id, v) with tree and cell, a row for each set of planes: on which side of each plane v lies."""
    import pyarrow as pa

    def place(batches):
        import numpy as np

        for b in batches:
            x = _rows(b.column("v")) - middle if b.num_rows else np.zeros((0, len(middle)))
            for tree, p in enumerate(planes):
                cell = ((x @ p > 0) * (1 << np.arange(p.shape[1]))).sum(1).astype("i4")
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(np.full(len(x), tree, "i4")), pa.array(cell)], ["id", "v", "tree", "cell"])

    return vectors.select("id", "v").mapInArrow(place, "id long, v array<double>, tree int, cell int")


def _planes(vectors: DataFrame, n: int, dim: int, trees: int, leaf: int, seed: int):
    """Random directions, and the mean of a bounded sample that planes go through."""
    import numpy as np

    bits = min(MOST_PLANES, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    share = min(1.0, 2000 / max(1, n))
    unit = F.xxhash64("id", F.lit(seed)).bitwiseAND(F.expr("9007199254740991L")) / F.lit(float(1 << 53))
    sample = [r["v"] for r in vectors.where(unit < share).select("v").orderBy(F.xxhash64("v")).collect()]  # about 2,000
    rng = np.random.default_rng(seed)
    return rng.normal(size=(trees, dim, bits)), np.mean(sample, 0) if sample else np.zeros(dim)


def _grouped(batches, key: str):
    """Rows of Arrow batches, sorted by key, as one batch for each run of equal keys."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)
        rest = b.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _best(edges: DataFrame, width: int) -> DataFrame:
    """Of each source the nearest entries; an entry that was known (new false) stays known."""
    once = edges.groupBy("src", "tgt").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "tgt"))
    return once.withColumn("_r", place).where(F.col("_r") <= width).drop("_r")


def _first_blocks(n: int) -> tuple[int, int]:
    """Sets of planes and vectors of a block for the first lists of n vectors."""
    return min(MOST_TREES, max(TREES, n // 4096)), min(MOST_LEAF, max(LEAF, n // 24 - LEAF))


def _first_lists(vectors: DataFrame, planes, middle, width: int, leaf: int, space: str) -> DataFrame:
    placed = settled(_cells(vectors, planes, middle), "cells")
    sizes = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (leaf + leaf // 2)).alias("parts"))  # at most trees * 2**MOST_PLANES rows
    blocks = placed.join(F.broadcast(sizes), ["tree", "cell"]).withColumn("block", F.xxhash64("tree", "cell", F.pmod(F.xxhash64("id", "tree"), "parts")))

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for b in _grouped(batches, "block"):
            ids, x = b.column("id").to_numpy(), _rows(b.column("v"))
            if len(ids) < 2:
                continue
            m = min(width, max(8, 6 * width // len(planes)), len(ids) - 1)  # of many sets each finds a part of the list
            for lo in range(0, len(ids), LEAF_ROWS):
                d = _distances(x[lo : lo + LEAF_ROWS], x, space)
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + LEAF_ROWS], m)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], ["src", "tgt", "dist"])

    return blocks.repartition("block").sortWithinPartitions("block", "id").select("block", "id", "v").mapInArrow(near, "src long, tgt long, dist double").withColumn("new", F.lit(True))


def neighbour_graph(vectors: DataFrame, k: int = 10, space: str = "l2", width: int | None = None, rounds: int = 10, stop: float = 0.02, seed: int = 7, report: dict | None = None) -> DataFrame:
    """(src, tgt, dist): for each vector about its k nearest others, approximately; equal distances by id.

    vectors(id, v): rows without either, and those of another length than most, take no part; of several rows with one id
    one does. Rounds end when fewer than `stop` of all entries are new. report, if given, gets n, rounds and distances, the
    number of distances that were measured (pairs that several lists have count each time)."""
    width = width or max(WIDTH, 2 * k)
    v, n, dim = _usual(vectors)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "src long, tgt long, dist double")
    trees, leaf = _first_blocks(n)
    planes, middle = _planes(v, n, dim, trees, leaf, seed)
    graph = settled(_best(_first_lists(v, planes, middle, width, leaf, space), width), "graph")
    measured, done = 0, 0
    if report is not None:
        cell = _cells(v, planes, middle).groupBy("tree", "cell").count()
        measured = int(cell.agg(F.sum(F.col("count") * F.least("count", F.lit(leaf + leaf // 2)))).first()[0])

    def join_lists(batches):
        import numpy as np
        import pyarrow as pa

        for b in _grouped(batches, "u"):
            ids, new, far, x = b.column("member").to_numpy(), b.column("new").to_numpy(zero_copy_only=False), b.column("far").to_numpy(), _rows(b.column("v"))
            fresh = np.flatnonzero(new)
            if not len(fresh) or len(ids) < 2:
                continue
            d = _distances(x[fresh], x, space)
            d[np.arange(len(fresh)), fresh] = np.inf
            i, j = np.nonzero(d < far[None, :])  # better for the list of j
            p, q = np.nonzero(d < far[fresh][:, None])  # better for the list of the fresh one
            src, tgt = np.r_[ids[j], ids[fresh[p]]], np.r_[ids[fresh[i]], ids[q]]
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(tgt), pa.array(np.r_[d[i, j], d[p, q]])], ["src", "tgt", "dist"])

    for done in range(1, rounds + 1):
        place = F.row_number().over(Window.partitionBy("tgt", "new").orderBy(F.xxhash64("src", F.lit(done))))
        back = graph.withColumn("_r", place).where(F.col("_r") <= REVERSE).select(F.col("tgt").alias("u"), F.col("src").alias("member"), "new")
        lists = graph.select(F.col("src").alias("u"), F.col("tgt").alias("member"), "new").unionByName(back)
        lists = lists.groupBy("u", "member").agg(F.max("new").alias("new"))
        lists = settled(lists.withColumn("_any", F.max("new").over(Window.partitionBy("u"))).where("_any").drop("_any"), "lists")
        if report is not None:
            per = lists.groupBy("u").agg(F.count_if("new").alias("a"), F.count("*").alias("n"))
            measured += int(per.agg(F.sum(F.expr("a * (a - 1) div 2 + a * (n - a)"))).first()[0] or 0)
        worst = graph.groupBy("src").agg(F.max("dist").alias("far"), F.count("*").alias("n")).select(F.col("src").alias("id"), F.when(F.col("n") >= width, F.col("far")).alias("far"))
        known = v.select("id", "v").join(worst, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        given = lists.join(known, F.col("member") == F.col("id")).repartition("u").sortWithinPartitions("u", "member")
        found = given.select("u", "member", "new", "far", "v").mapInArrow(join_lists, "src long, tgt long, dist double").withColumn("new", F.lit(True))
        graph = settled(_best(graph.withColumn("new", F.lit(False)).unionByName(found), width), "graph")
        left = graph.agg(F.count_if("new").alias("new"), F.count("*").alias("n")).first()
        if left["new"] <= stop * left["n"]:
            break
    if report is not None:
        report.update(n=n, rounds=done, distances=measured)
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 10), "tgt"))
    return graph.withColumn("_r", place).where(F.col("_r") <= k).select("src", "tgt", "dist")


def search_graph(queries: DataFrame, targets: DataFrame, graph: DataFrame, k: int = 10, space: str = "l2", width: int | None = None, rounds: int = 30, seed: int = 7, dense: int | None = None) -> DataFrame:
    """(src, tgt, dist): for each of queries(id, v) about its k nearest of targets(id, v), a target with the query's id
    included, along a graph of the targets; exactly, from products of blocks, where the targets are at most `dense` (DENSE),
    as that costs less than the walk and misses none. A walk starts at hashed entry points of the query's cells and of the whole,
    keeps the `width` nearest that it has measured, and goes on to the neighbours of those that it has not left yet, in
    either direction; it ends when none are left, after `rounds` at most. Rows as for neighbour_graph; queries of another
    length than the targets find nothing."""
    width = width or max(2 * WIDTH, 4 * k)
    t, n, dim = _usual(targets)
    q = settled(_known(queries).where(F.size("v") == dim).dropDuplicates(["id"]), "queries")
    if n <= (DENSE if dense is None else dense):
        return knn(q, t.select("id", "v"), k, space).select("src", "tgt", "dist")
    planes, middle = _planes(t, n, dim, TREES, LEAF, seed)
    place = F.row_number().over(Window.partitionBy("tree", "cell").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    entries = _cells(t, planes, middle).drop("v").withColumn("_r", place).where(F.col("_r") <= ENTRIES).select("tree", "cell", F.col("id").alias("tgt"))
    some = t.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(ENTRIES).select(F.col("id").alias("tgt"))  # for cells without a target
    to_visit = _cells(q, planes, middle).drop("v").join(entries, ["tree", "cell"]).select(F.col("id").alias("src"), "tgt")
    to_visit = to_visit.unionByName(q.select(F.col("id").alias("src")).crossJoin(F.broadcast(some))).distinct()
    back = Window.partitionBy("tgt").orderBy("dist", "src")
    near = graph.select("src", "tgt").unionByName(graph.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= REVERSE).select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    near = settled(near.distinct().select(F.col("src").alias("tgt"), F.col("tgt").alias("next")), "links")

    def measure(batches):
        import numpy as np
        import pyarrow as pa

        for b in _grouped(batches, "src"):
            ids = b.column("tgt")
            own, x = b.slice(0, 1), b.slice(1)  # the query's vector comes first
            if ids[0].is_valid or not x.num_rows:
                continue
            d = _distances(_rows(own.column("v")), _rows(x.column("v")), space)[0]
            yield pa.RecordBatch.from_arrays([x.column("src"), x.column("tgt"), pa.array(np.asarray(d, "f8"))], ["src", "tgt", "dist"])

    own = q.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("tgt"), "v")
    beam = None
    for _ in range(rounds):
        asked = to_visit.join(t.select(F.col("id").alias("tgt"), "v"), "tgt").select("src", "tgt", "v").unionByName(own)
        found = asked.repartition("src").sortWithinPartitions("src", F.col("tgt").asc_nulls_first()).mapInArrow(measure, "src long, tgt long, dist double").withColumn("new", F.lit(True))
        beam = settled(_best(found if beam is None else beam.withColumn("new", F.lit(False)).unionByName(found), width), "beam")
        if beam.where("new").isEmpty():
            break
        # What a query has measured and dropped is farther than all it keeps; measuring it again changes nothing.
        ahead = beam.where("new").select("src", "tgt").join(near, "tgt").select("src", F.col("next").alias("tgt")).distinct()
        to_visit = ahead.join(beam.select("src", "tgt"), ["src", "tgt"], "left_anti")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 10), "tgt"))
    return beam.withColumn("_r", place).where(F.col("_r") <= k).select("src", "tgt", "dist")
