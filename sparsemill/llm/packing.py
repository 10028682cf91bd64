"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces; pieces that fill a sequence need no search. The others are dealt by a hash to problems of
a bounded number of pieces. Each problem has several islands, one Spark row group each, whose populations start from
best-fit packings in different orders. Crossover injects a parent's well-filled bins into another, removes the bins
that held the same pieces and the least filled ones, and fits the displaced pieces best into new bins, one bin after
another by the sums that they can make. Between rounds each island's elite moves to the next one. A search ends where
the number of bins is a lower bound; how many crossovers it may try depends on the size of the problem.
Pieces of the poorly filled bins of all problems are dealt anew, once, to fewer problems.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_at_once, give_back, in_small_batches, stage_table, table
from .encoding import Encoder, tokenizer_path

CAPACITY = 1024
END_ID = 2
PROBLEM_PIECES, ISLANDS, ROUNDS, POPULATION = 4096, 3, 2, 6
#: Generations of two crossovers that an island may have a round, times the number of pieces; at least FEW of them.
WORK, FEW, MANY = 200_000, 4, 400
#: A crossover injects at most so many bins, so that it costs little and many can be tried.
INJECTED = 32
#: Bins filled below this share are packed again together with those of other problems.
POOR = 0.97
#: A worker keeps the ids of at most twice so many units, about 200 bytes each, as nearly each new one costs a merge.
KEPT_UNITS = 400_000
PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens; only one longer than capacity is cut, its first piece may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, cut: str = "gaps", capacity: int = CAPACITY, kept: int = KEPT_UNITS) -> DataFrame:
    """Rows of PIECES for every document; null text has the end id only. item tells repeated rows apart. kept: a worker keeps
    the ids of at most twice so many units."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, item = Encoder.of(path, cut, END_ID, kept), TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), few_at_once(b.column("text"))):
                ids = encoder.encode(text)
                for piece, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    out.append((item, doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    item += 1
            names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names)
            give_back()

    in_small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encode, PIECES)


def best_fit(order, lengths, bins, room, capacity: int) -> int:
    """Put the items of order, one after another, into the open bin that they fill best. bins: bin of each item, changed;
    room: what is left in each bin, extended. The open bins of each room are held as stacks, and a bit for each that
    has one, so that the best bin is one shift away."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in order:
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask ^= 1 << r
            left = r - n
        else:
            b, left = len(room), capacity - n
            room.append(left)
        room[b] = left
        bins[i] = b
        if left:
            if left in stacks and stacks[left]:
                stacks[left].append(b)
            else:
                stacks[left] = [b]
                mask |= 1 << left
    return len(room)


def cost(bins, lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many, the ones that are filled more unevenly."""
    import numpy as np

    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float(np.square(fill / capacity).sum())


def least_bins(lengths, capacity: int) -> int:
    """A lower bound: pieces above half a bin have one each, and what the smaller ones need beyond their room; the best
    over all sizes from which on pieces are counted."""
    import numpy as np

    x = np.sort(np.asarray(lengths))
    if not len(x):
        return 0
    sums, half = np.r_[0, np.cumsum(x)], int(np.searchsorted(x, capacity // 2, "right"))
    best = max(math.ceil(sums[-1] / capacity), len(x) - half)
    for k in np.unique(x[:half]).tolist():
        from_ = int(np.searchsorted(x, k))  # pieces of k and more
        large = int(np.searchsorted(x, capacity - k, "right"))  # above that share a bin with none of them
        room = (len(x) - half) * capacity - (sums[-1] - sums[half])
        lone = (len(x) - large) * capacity - (sums[-1] - sums[large])
        best = max(best, len(x) - half + max(0, math.ceil((sums[half] - sums[from_] - (room - lone)) / capacity)))
    return best


def refilled(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins for a few displaced pieces: each time the largest one left and those others that together fill its bin best, so
    that what is not filled gathers in the last bins. The sums that can be reached are the bits of a number."""
    left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out = []
    while left:
        first, *left = left
        room = capacity - lengths[first]
        below, reach = (2 << room) - 1, [1]
        for i in left:
            reach.append((reach[-1] | reach[-1] << lengths[i]) & below)
        at, taken, rest = reach[-1].bit_length() - 1, [first], []
        for k in range(len(left), 0, -1):
            if reach[k - 1] >> at & 1:
                rest.append(left[k - 1])
            else:
                taken.append(left[k - 1])
                at -= lengths[left[k - 1]]
        out.append(taken)
        left = rest[::-1]
    return out


def crossover(giver, taker, lengths, capacity: int, rng):
    """The taker's packing with well-filled bins of the giver in it. Bins of the taker that held the same pieces are taken
    apart, and so are the least filled ones and a few others; the displaced pieces fill new bins as well as they can."""
    import numpy as np

    fill = np.bincount(giver, weights=lengths)
    good = np.flatnonzero(fill >= np.median(fill))
    chosen = rng.choice(good, size=max(1, min(len(good) // 4, INJECTED)), replace=False)
    flag = np.zeros(len(fill), bool)
    flag[chosen] = True
    injected = flag[giver]
    held = np.bincount(taker, weights=lengths)
    broken = np.zeros(len(held), bool)
    broken[taker[injected]] = True
    broken[rng.choice(len(held), max(1, min(len(held) // 8, INJECTED // 4)))] = True
    few = min(len(held) - 1, int(rng.integers(1, 5)))
    broken[np.argpartition(held, few)[: few + 1]] = True
    number = np.cumsum(~broken) - 1  # of the bins that stay whole
    bins = np.where(broken[taker], -1, number[taker])
    n = int(number[-1]) + 1
    bins[injected] = n + np.searchsorted(np.sort(chosen), giver[injected])
    n += len(chosen)
    displaced = np.flatnonzero(bins < 0)
    for held_together in refilled(lengths[displaced].tolist(), capacity):
        bins[displaced[held_together]] = n
        n += 1
    return bins


def first_packings(lengths, capacity: int, rng, how_many: int):
    """Best fit in descending order, and in orders that are disturbed a little."""
    import numpy as np

    plain = lengths.tolist()
    for k in range(how_many):
        noise = 0 if k == 0 else rng.uniform(0, capacity * 0.02 * k, len(lengths))
        out = [0] * len(lengths)
        best_fit(np.argsort(-(lengths + noise), kind="stable").tolist(), plain, out, [], capacity)
        yield np.array(out)


def evolve(lengths, capacity: int, seed: int, elites: list, population: int = POPULATION, work: int = WORK):
    """The best packing that one island finds. It ends early where the number of bins is the least possible one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    lengths = np.asarray(lengths)
    least = least_bins(lengths, capacity)
    pool = [(cost(b, lengths, capacity), b) for b in elites]
    for b in first_packings(lengths, capacity, rng, max(1, population - len(elites))):
        pool.append((cost(b, lengths, capacity), b))
        if pool[-1][0][0] <= least:
            break
    pool.sort(key=lambda x: x[0])
    for _ in range(min(MANY, max(FEW, work // max(1, len(lengths))))):
        if pool[0][0][0] <= least or len(pool) < 2:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        pairs = [(pool[a][1], pool[b][1]), (pool[rng.integers(1, len(pool))][1], pool[0][1])]
        for giver, taker in pairs:
            child = crossover(giver, taker, lengths, capacity, rng)
            pool.append((cost(child, lengths, capacity), child))
        pool = sorted(pool, key=lambda x: x[0])[:population]
    return pool[0][1], pool[0][0]


def search(items: DataFrame, capacity: int, problems: int, level: int) -> DataFrame:
    """items(PIECES) to rows with problem, bin and filled (the bin's share that is used)."""
    lean = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(problems)).cast("int").alias("problem"))
    spread = lean.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
    elites = None
    kind = "problem int, island int, n_bins int, score double, bins binary"

    def run(key, pdf, came=None):
        import numpy as np
        import pandas as pd

        if not len(pdf):
            return pd.DataFrame(columns=["problem", "island", "n_bins", "score", "bins"])
        pdf = pdf.sort_values("item")
        elite = [np.frombuffer(x, "<i4").astype(int) for x in came["bins"]] if came is not None else []
        best, (n, score) = evolve(pdf["length"].to_numpy(), capacity, zlib.crc32(f"{key}{level}{len(elite)}".encode()), elite)
        return pd.DataFrame({"problem": [key[0]], "island": [key[1]], "n_bins": [n], "score": [score], "bins": [best.astype("<i4").tobytes()]})

    for _ in range(ROUNDS):
        if elites is None:
            found = spread.groupBy("problem", "island").applyInPandas(lambda key, pdf: run(key, pdf), kind)
        else:
            moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).unionByName(elites)
            found = spread.groupBy("problem", "island").cogroup(moved.groupBy("problem", "island")).applyInPandas(run, kind)
        elites = stage_table(found, "elites")
    best = elites.groupBy("problem").agg(F.min_by("bins", F.struct("n_bins", "score", "island")).alias("bins"))

    def assign(key, pdf, best_):
        import numpy as np
        import pandas as pd

        if not len(pdf):
            return pd.DataFrame(columns=["item", "problem", "bin", "filled"])
        pdf = pdf.sort_values("item")
        bins = np.frombuffer(best_["bins"].iloc[0], "<i4").astype(int)
        fill = np.bincount(bins, weights=pdf["length"].to_numpy())
        return pd.DataFrame({"item": pdf["item"], "problem": key[0], "bin": bins, "filled": fill[bins] / capacity})

    return lean.groupBy("problem").cogroup(best.groupBy("problem")).applyInPandas(assign, "item long, problem int, bin int, filled double")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, problem_pieces: int = PROBLEM_PIECES) -> DataFrame:
    """pieces(PIECES), stored, to item and sequence_id for those shorter than capacity."""
    short = pieces.where(F.col("length") < capacity)
    problems = max(1, math.ceil(short.count() / problem_pieces))
    first = stage_table(search(short, capacity, problems, 0), "packed")
    ids = (F.col("problem").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id")
    if problems == 1:
        return first.select("item", ids)
    poor = first.where(F.col("filled") < POOR)
    again = short.join(poor.select("item"), "item", "left_semi")
    again = stage_table(again, "again")
    second = search(again, capacity, max(1, math.ceil(again.count() / problem_pieces)), 1)
    ids2 = ((F.col("problem").cast("long") * (1 << 24) + F.col("bin")) + F.lit(1 << 60)).alias("sequence_id")
    return first.where(F.col("filled") >= POOR).select("item", ids).unionByName(second.select("item", ids2))


def pack(docs: DataFrame, tokenizer: str, cut: str = "gaps", capacity: int = CAPACITY, kept: int = KEPT_UNITS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of one token (the end id); repeated rows are packed as often as they occur; rows
    without doc_id keep a null one. An empty table gives no rows. Bins hold at most `capacity` pieces, so the running
    sum within a sequence is over a bounded group. kept is a worker's memory of units, see token_pieces; the result does not
    depend on it.
    """
    pieces = stage_table(token_pieces(docs, tokenizer, cut, capacity, kept), "pieces")
    short = pieces.join(pack_pieces(pieces, capacity), "item")
    place = F.col("length").cast("long")
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("offset", F.coalesce(F.sum(place).over(before), F.lit(0)).cast("long"))
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("item") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(*names).unionByName(full.select(*names))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
