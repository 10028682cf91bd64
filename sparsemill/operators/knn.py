"""Nearest neighbours of vectors, exact, by blocks, or by lists around centres; graphs of reciprocal neighbours and their
weights.

Vectors are packed into blocks of a bounded number, every query block meets every target block once (that is what exact
search asks for), a task multiplies two blocks and passes on the k nearest of each query only, and the lists are merged.
`knn_indexed` is the way for sizes at which all pairs of blocks are too many: a query meets the blocks of some lists; see
also the graph of graph.py. Rows without id or vector take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import running, settled

BLOCK = 2048
#: Blocks that a task of a product of blocks reads of either side; rows of a product of vectors that are made at once, and
#: pairs whose distance is; entries that a task keeps before it passes them on.
BLOCKS_A_TASK, ROWS_AT_ONCE, PAIRS_AT_ONCE, KEPT_ENTRIES = 8, 256, 1 << 16, 1 << 22
#: Stands for no id beside an infinite distance.
NOBODY = (1 << 63) - 1
#: Centres of an index are found from at most so many vectors for each, drawn by a hash of the id.
SAMPLED = 64
#: An index is measured with about so many vectors, and meets as many lists as find this share of their neighbours.
MEASURED, RECALL = 256, 0.96


def _known(vectors: DataFrame, group: str | None = None) -> DataFrame:
    more = [F.col(group).alias("group")] if group else []
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())
    return vectors.where(F.col("id").isNotNull() & whole).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *more)


def _blocks(vectors: DataFrame, prefix: str, parts) -> DataFrame:
    """vectors(id, v[, group]) to one row a block: ids and values as bytes, the vectors' length, and the group if there is
    one. parts: among how many blocks (of each group and length) a vector's are dealt."""
    keys = [F.pmod(F.xxhash64("id"), parts).alias("part"), F.size("v").alias("dim")] + (["group"] if "group" in vectors.columns else [])
    kind = f", {prefix}_group {vectors.schema['group'].dataType.simpleString()}" if "group" in vectors.columns else ""

    def pack(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        out = {f"{prefix}_dim": [int(key[1])], f"{prefix}_ids": [pdf["id"].to_numpy("i8").tobytes()], f"{prefix}_vs": [np.stack(pdf["v"]).astype("f8").tobytes()]}
        return pd.DataFrame(out | ({f"{prefix}_group": [key[2]]} if kind else {}))

    return vectors.groupBy(*keys).applyInPandas(pack, f"{prefix}_dim int, {prefix}_ids binary, {prefix}_vs binary{kind}")


def _dealt(vectors: DataFrame, prefix: str, block: int) -> DataFrame:
    """_blocks of about `block` vectors of one group and length each. They are written by a shuffle, as a product reads them
    many times."""
    keys = {"_dim": F.size("v")} | ({"_group": F.col("group")} if "group" in vectors.columns else {})
    sizes = vectors.groupBy(*[x.alias(c) for c, x in keys.items()]).agg(F.ceil(F.count("*") / block).alias("parts"))
    n = sizes.agg(F.sum("parts")).first()[0] or 0
    same = [x.eqNullSafe(F.col(c)) for c, x in keys.items()]
    known = vectors.join(F.broadcast(sizes), same).drop(*keys)  # a row a group and length
    return _blocks(known, prefix, F.col("parts")).repartition(max(1, math.ceil(n / BLOCKS_A_TASK)))


def block_distances(x, y, k: int, space: str):
    """Places in y of the k nearest of each row of x, and the distances. The product that picks them is less exact than the
    distance, so rows whose next ones come within its error are searched with the distance itself."""
    import numpy as np

    inner = space == "ip"
    near = -x @ y.T if inner else (y * y).sum(1)[None, :] - 2 * x @ y.T
    n, m = len(y), min(len(y), k + 8)
    at = np.argpartition(near, m - 1, axis=1)[:, :m]
    exact = lambda a, b: 1 - (a * b).sum(-1) if inner else ((a - b) ** 2).sum(-1)
    d = exact(y[at], x[:, None, :])
    order = np.lexsort((at, np.round(d, 10)), axis=1)[:, :k]
    rows = np.arange(len(x))[:, None]
    at, last = at[rows, order], np.take_along_axis(near, at, 1).max(1)
    d = d[rows, order]
    if m < n:
        size, most = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1).max())
        error = 8 * x.shape[1] * 2.0**-53 * (size + most) ** 2 + 2e-10
        beyond = last + (1 if inner else size * size) - error  # no distance that was not looked at is smaller
        for i in np.flatnonzero(d[:, -1] >= beyond):
            whole = exact(y, x[i])
            own = np.lexsort((np.arange(n), np.round(whole, 10)))[:k]
            at[i], d[i] = own, whole[own]
    return at, d


def nearer(x, y, ids, k: int, space: str, best, tgt) -> None:
    """best and tgt have for each row of x the k smallest distances so far, ascending (to ten places, then by id), and whose
    they are; infinite ones stand for none. Brings in the rows of y, named by ids. A product in single precision, with its
    error taken off, tells which pairs can be among the k; these get the distance itself."""
    import numpy as np

    inner, dim = space == "ip", x.shape[1]
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    single = max(xx.max(), yy.max()) < 1e30 and dim < 50_000
    kind = np.float32 if single else np.float64
    off = (dim + 8) * (2.0**-23 if single else 2.0**-52)  # products are wrong by this times xx + yy at most
    y_side = (-off * yy if inner else (1 - off) * yy).astype(kind)
    xs, ys = ((-1 if inner else -2) * x).astype(kind), np.ascontiguousarray(y.astype(kind).T)
    lanes = max(64, 4 * k)
    found = []
    for lo in range(0, len(x), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        low, size, most = xs[part] @ ys, xx[part], best[part, -1]
        low += y_side
        if np.isinf(most).any() and len(y) >= k:
            per = len(y) // lanes
            least = low[:, : per * lanes].reshape(len(low), per, lanes).min(1) if per > 1 else low
            kth = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64)
            most = np.minimum(most, 1 + kth + off * (2 * yy.max() + size) if inner else (kth + (1 + 5 * off) * size) / (1 - 4 * off))
        level = most + 1e-10 + (off * size - 1 if inner else -(1 - off) * size)
        level = (level + 2 * abs(level) * (2.0**-23 if single else 2.0**-52)).astype(kind)
        at = np.flatnonzero(low <= level[:, None])
        found.append((at // len(y) + lo, at % len(y)))
    i, j = (np.concatenate(f) for f in zip(*found))
    if not len(i):
        return
    d = np.empty(len(i))
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        a, b = x[i[lo : lo + PAIRS_AT_ONCE]], y[j[lo : lo + PAIRS_AT_ONCE]]
        d[lo : lo + PAIRS_AT_ONCE] = 1 - np.einsum("ij,ij->i", a, b) if inner else np.einsum("ij,ij->i", a - b, a - b)
    order = np.lexsort((ids[j], np.round(d, 10), i))
    i, j, d = i[order], j[order], d[order]
    rows, first, many = np.unique(i, return_index=True, return_counts=True)
    place = np.arange(len(i)) - np.repeat(first, many)
    some = place < k
    at = np.repeat(np.arange(len(rows)), many)[some], place[some] + k
    both, whose = (np.concatenate([old[rows], np.full((len(rows), k), none)], axis=1) for old, none in ((best, np.inf), (tgt, NOBODY)))
    both[at], whose[at] = d[some], ids[j[some]]
    order = np.lexsort((whose, np.round(both, 10)), axis=1)[:, :k]
    best[rows], tgt[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)


def _search(pairs: DataFrame, k: int, space: str, kind: str | None) -> DataFrame:
    """Pairs of blocks to (src, tgt, dist[, tgt_group]), the k nearest for each query (and group). Vectors of different
    lengths are no neighbours. Squared distances are taken from the mean of a block of targets. A task keeps the k nearest
    of a block of queries as long as the next pairs are of that block, so that one list a query, group and run is passed on."""

    def nearest(batches):
        import numpy as np
        import pandas as pd

        def out(src, tgt, d, group):
            named = {"src": src, "tgt": tgt, "dist": d}
            return pd.DataFrame(named | ({"tgt_group": [group] * len(src)} if kind else {}))

        def kept():
            for group, (best, tgt) in lists.items():
                i, j = np.nonzero(np.isfinite(best))
                yield out(ai[i], tgt[i, j], best[i, j], group)
            lists.clear()

        lists, asked, ai = {}, None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if asked != row.q_ids or len(lists) * len(ai) * k > KEPT_ENTRIES:
                    yield from kept()
                    asked, ai = row.q_ids, np.frombuffer(row.q_ids, "i8")
                bi = np.frombuffer(row.t_ids, "i8")
                x, y = (np.frombuffer(v, "f8").reshape(-1, row.q_dim) for v in (row.q_vs, row.t_vs))
                if not max(abs(x).max(), abs(y).max()) < 1e150:  # nan, inf, or squares that are
                    at, d = block_distances(x, y, k, space)
                    yield out(np.repeat(ai, at.shape[1]), bi[at].ravel(), d.ravel(), row.t_group if kind else None)
                    continue
                if space == "l2":
                    middle = y.mean(0)
                    x, y = x - middle, y - middle
                group = row.t_group if kind else None
                if group not in lists:
                    lists[group] = np.full((len(ai), k), np.inf), np.full((len(ai), k), NOBODY)
                nearer(x, y, bi, k, space, *lists[group])
        yield from kept()

    same = pairs.where(F.col("q_dim") == F.col("t_dim"))
    found = same.mapInPandas(nearest, "src long, tgt long, dist double" + (f", tgt_group {kind}" if kind else ""))
    by = ["src"] + (["tgt_group"] if kind else [])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("dist", 10), "tgt"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def knn(queries: DataFrame, targets: DataFrame, k: int, space: str = "l2", group: str | None = None, other_groups: bool = False, block: int = BLOCK, wanted: DataFrame | None = None) -> DataFrame:
    """(src, tgt, dist[, tgt_group]): for every query its k nearest targets, the query itself included if it is one; equal
    distances (to ten places) by id. space l2: squared distance; ip: 1 - x.y. With group (a column of targets), k nearest
    in each group; with other_groups too (a column of both), only groups other than the query's own, and with
    wanted(q_group, t_group), only these pairs of groups. Rows without id or vector, or with a hole in it, take no part;
    vectors of different lengths are no neighbours; a null group has targets of its own and no query of another group."""
    q, t = _known(queries, group if other_groups else None), _known(targets, group)
    left, right = _dealt(q, "q", block), _dealt(t, "t", block)
    if wanted is not None:
        pairs = left.join(wanted.select("q_group", "t_group").distinct(), "q_group").join(right, "t_group")
    else:
        pairs = left.crossJoin(right)  # blocks, not rows
        if other_groups:
            pairs = pairs.where(F.col("q_group") != F.col("t_group"))
    return _search(pairs, k, space, targets.schema[group].dataType.simpleString() if group else None)


def _hash_unit(seed: int):
    return F.xxhash64("id", F.lit(seed)).bitwiseAND(F.expr("9007199254740991L")) / F.lit(float(1 << 53))


def knn_indexed(queries: DataFrame, targets: DataFrame, k: int, space: str = "l2", lists: int | None = None, probes: int | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """knn without groups, approximate: targets lie in lists around centres and a query meets those of its `probes` nearest
    centres; with as many probes as lists the result is exact. Centres come from a bounded sample (SAMPLED for each), every
    target is in a list, and a large list is as many blocks as it needs, so that a hot one is no bottleneck.

    Without probes their number is measured: for about MEASURED targets the k nearest are found exactly, and as many lists
    are met as hold RECALL of them. Vectors without structure ask for many lists, clustered ones for few. Targets of
    another length than most are left out of the index."""
    import numpy as np

    t = settled(_known(targets).withColumn("dim", F.size("v")), "indexed")
    usual = t.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    n, dim = (usual["count"], usual["dim"]) if usual else (0, 0)
    t, q = t.where(F.col("dim") == dim).drop("dim"), _known(queries).where(F.size("v") == dim)
    lists = max(1, min(lists or min(4096, math.isqrt(n)), n))
    share = min(1.0, SAMPLED * lists / max(1, n))
    sample = np.array([r["v"] for r in t.where(_hash_unit(seed) < share).select("v").orderBy(F.xxhash64("v")).collect()])  # about SAMPLED * lists rows
    if not len(sample):
        return _search(_blocks(q, "q", F.lit(1)).crossJoin(_blocks(t, "t", F.lit(1))), k, space, None)  # one block each
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(8):
        own = ((centres * centres).sum(1)[None, :] - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)

    def order(x):
        far = -x @ centres.T if space == "ip" else (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        return np.argsort(far, axis=1, kind="stable")

    def placed(vectors: DataFrame, most: int) -> DataFrame:
        def place(batches):
            for pdf in batches:
                if len(pdf):
                    pdf["group"] = order(np.stack(pdf["v"]))[:, :most].astype("i4").tolist()
                    yield pdf[["id", "v", "group"]]

        return vectors.mapInPandas(place, "id long, v array<double>, group array<int>").withColumn("group", F.explode("group"))

    t = settled(placed(t, 1), "lists")
    if probes is None:
        asked = t.where(_hash_unit(seed + 1) < min(1.0, MEASURED / n)).select("id", "v")
        near = knn(asked, t.select("id", "v"), k + 1, space).where("src <> tgt")
        near = near.join(t.select(F.col("id").alias("tgt"), "group"), "tgt").select("src", "group").collect()  # about MEASURED * k rows
        vectors = {r["id"]: r["v"] for r in asked.collect()}
        if near:
            rank = order(np.array(list(vectors.values()))).argsort(1)
            row = {i: at for at, i in enumerate(vectors)}
            probes = 1 + int(np.quantile([rank[row[r["src"]], r["group"]] for r in near], RECALL, method="higher"))
        else:
            probes = len(centres)
    q = placed(q, probes)
    sizes = t.groupBy("group").agg(F.ceil(F.count("*") / block).alias("parts"))
    in_lists = t.join(F.broadcast(sizes), "group")  # a row a list
    left = _blocks(q, "q", F.lit(max(1, math.ceil(queries.count() * min(probes, len(centres)) / len(centres) / block))))
    right = _blocks(in_lists.select("id", "v", "group", "parts"), "t", F.col("parts"))
    return _search(left.join(right, F.col("q_group") == F.col("t_group")), k, space, None)


def knn_named(queries: DataFrame, targets: DataFrame, k: int, space: str = "l2", valid: DataFrame | None = None) -> DataFrame:
    """knn of queries(id, name, v) among targets(id, name, v) as (src_name, tgt_name, dist); valid(name), if given, are the
    only targets."""
    if valid is not None:
        targets = targets.join(valid.select("name").distinct(), "name", "left_semi")
    found = knn(queries, targets, k, space)
    a, b = queries.select(F.col("id").alias("src"), F.col("name").alias("src_name")), targets.select(F.col("id").alias("tgt"), F.col("name").alias("tgt_name"))
    return found.join(a, "src").join(b, "tgt").select("src_name", "tgt_name", "dist")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    from ..functions.vector import unit

    return vectors.withColumn("v", unit(F.col("v").cast("array<double>")))


def balanced_knn(vectors: DataFrame, k: int, batch: str = "batch") -> DataFrame:
    """(src, tgt, dist, src_batch, tgt_batch): of each batch max(1, min(k, its size) div the number of batches) nearest,
    then the query itself is left out. Rows without batch take no part, as queries or targets."""
    vectors = vectors.where(F.col(batch).isNotNull())
    sizes = vectors.groupBy(batch).agg(F.count("*").alias("n"))
    batches = max(1, sizes.count())
    quota = sizes.select(F.col(batch).alias("tgt_group"), F.greatest(F.lit(1), F.expr(f"least({max(k, 1)}, n) div {batches}")).alias("quota"))
    found = knn(vectors, vectors, max(1, k // batches), "l2", batch)
    place = F.row_number().over(Window.partitionBy("src", "tgt_group").orderBy(F.round("dist", 10), "tgt"))
    found = found.join(quota, "tgt_group").withColumn("_r", place).where("_r <= quota and src <> tgt")
    own = vectors.select(F.col("id").alias("src"), F.col(batch).alias("src_batch"))
    return found.join(own, "src").select("src", "tgt", "dist", "src_batch", F.col("tgt_group").alias("tgt_batch"))


def reciprocal(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """Edges whose unordered pair occurs in both directions; undirected: each once, from the smaller id."""
    pair = Window.partitionBy(F.least("src", "tgt"), F.greatest("src", "tgt"))
    out = edges.withColumn("_n", F.count("*").over(pair)).where("_n > 1").drop("_n")
    return out.where("src < tgt") if undirected else out


def weights_of(distances) -> list[float]:
    """Weights exp(-l (d - least d)) with l such that they sum to log2 of their number; 1 for a single one. The search for
    l starts at 10, goes up or down by a tenth for at most 100 steps and ends when it gets worse."""
    import numpy as np

    d = np.asarray(distances, float)
    if len(d) < 2:
        return [1.0] * len(d)
    d, goal = d - d.min(), math.log2(len(d))
    level, before = 10.0, None
    for _ in range(100):
        off = np.exp(-level * d).sum() - goal
        if before is not None and abs(off) > abs(before) or abs(off) < 1e-10:
            break
        before, level = off, level * (1.1 if off > 0 else 0.9)
    return np.exp(-level * d).tolist()


def with_weights(edges: DataFrame, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """edges(keys, tgt, dist) with weight, for each source by itself. A source has at most some hundred neighbours, so a list
    of them is small."""
    lists = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dist", "tgt"))).alias("near"))
    kinds = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in keys)

    def weigh(batches):
        for pdf in batches:
            pdf["weight"] = [weights_of([x["dist"] for x in near]) for near in pdf["near"]]
            yield pdf[[*keys, "near", "weight"]]

    done = lists.mapInPandas(weigh, kinds + "near array<struct<dist:double,tgt:long>>, weight array<double>")
    flat = done.select(*keys, F.explode(F.arrays_zip("near", "weight")).alias("x"))
    return flat.select(*keys, F.col("x.near.tgt").alias("tgt"), F.col("x.near.dist").alias("dist"), F.col("x.weight").alias("weight"))


def reweighted(edges: DataFrame, vectors: DataFrame, k: int, order: str = "index") -> DataFrame:
    """Distances as the mean squared difference, the first k neighbours by id (or the nearest k), and weights."""
    from ..functions.vector import squared_distance

    a = vectors.select(F.col("id").alias("src"), F.col("v").cast("array<double>").alias("x"))
    b = vectors.select(F.col("id").alias("tgt"), F.col("v").cast("array<double>").alias("y"))
    d = edges.select("src", "tgt").join(a, "src").join(b, "tgt").withColumn("dist", squared_distance(F.col("x"), F.col("y")) / F.size("x"))
    by = ["tgt"] if order == "index" else ["dist", "tgt"]
    place = F.row_number().over(Window.partitionBy("src").orderBy(*by))
    return with_weights(d.withColumn("_r", place).where(F.col("_r") <= k).select("src", "tgt", "dist"))


def nearest_records(pairs: DataFrame) -> DataFrame:
    """pairs(src, tgt, dist): of the records of an unordered pair the nearest, the smaller src first among equals."""
    order = Window.partitionBy(F.least("src", "tgt"), F.greatest("src", "tgt")).orderBy("dist", "src")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def group_profiles(vectors: DataFrame, group: str) -> DataFrame:
    """(group, v): sums of the vectors of each group, divided by their length across groups for each factor, then to unit
    length."""
    long = vectors.select(F.col(group).alias("group"), F.posexplode(F.col("v").cast("array<double>")).alias("f", "x"))
    sums = long.groupBy("group", "f").agg(F.sum("x").alias("x"))
    lengths = sums.groupBy("f").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-8)).alias("l"))
    scaled = sums.join(lengths, "f").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("f", (F.col("x") / F.col("l")).alias("x")))).alias("s"))
    return unit_vectors(scaled.select("group", F.transform("s", lambda s: s["x"]).alias("v")))


def match_groups(vectors: DataFrame, group: str, k: int = 1, weighted: bool = False, profiles: DataFrame | None = None) -> DataFrame:
    """(src, tgt, dist[, weight]): for each group, named by any type, its k nearest other groups by inner product of their
    profiles; equal ones in order of the names. weighted: with the weights of weights_of among a group's matches."""
    known = profiles if profiles is not None else group_profiles(vectors, group)
    known = settled(running(settled(known.where("group is not null"), "profiles"), ["group"], None, "id"), "profiles")
    found = knn(known, known, k + 1, "ip").where("src <> tgt")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 10), "tgt"))
    found = found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
    if weighted:
        found = with_weights(found)
    a, b = (known.select(F.col("id").alias(x), F.col("group").alias(f"{x}_name")) for x in ("src", "tgt"))
    more = ["weight"] if weighted else []
    return found.join(a, "src").join(b, "tgt").select(F.col("src_name").alias("src"), F.col("tgt_name").alias("tgt"), "dist", *more)
