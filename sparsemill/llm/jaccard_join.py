"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document's set is that of its distinct five-word shingles. Shingles are ordered by how common they are, rare ones
first, and the first part of a set (its prefix) must share a shingle with that of every set it links to. Documents with
the same prefix and size are one group; an inverted index over the groups' prefixes gives group pairs, filtered by size
and position and then by how much of the prefixes they share. Pairs that are left are expanded to the groups' distinct
sets and verified exactly.

For components, sets that are already connected are not compared again. Each group is first compared with one other, a
star that it shares much of its prefix with, which connects nearly all copies of a text. Sets that have the same star but
are still apart are compared in blocks, as differences from the star; the last round takes every other pair of groups
that is still apart, and where a posting has more of these than a few a row, its groups meet in blocks as well. For the join itself, all sets of a component are compared in blocks, as every link lies within one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_small_batches, small, stage_table, table, text_or_empty

SHINGLE, PERCENT = 5, 80
#: The order of shingles knows at most so many common ones (12 bytes each in every task); all others count as rare.
#: It decides how much work is done, never what is found.
COMMON_SHINGLES = 1 << 18
#: Components of more sets than this are compared in blocks of two parts of about so many.
LINK_BLOCK = 512
#: A posting whose rows make more pairs than so many a row has its groups compared in blocks.
DENSE = 4
#: Stands for the component of a group whose sets are in several.
APART = -(1 << 63)
#: Texts are hashed in chunks of about so many bytes.
CHUNK = 1 << 19

# Odd numbers for multiplicative hashing modulo 2**64.
_P = 0x9E3779B97F4A7C15
_M = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_tables: dict = {}


def _powers(n: int):
    """Powers of _P and of its inverse up to n."""
    import numpy as np

    if len(_tables.get("up", ())) < n:
        n = max(n, CHUNK)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
        lower, space = np.arange(256, dtype=np.uint64) + 1, np.zeros(256, bool)
        lower[65:91] += 32
        space[[9, 10, 11, 12, 13, 32]] = True
        _tables["lower"], _tables["space"] = lower, space
    return _tables


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _chunk_sets(data, offsets) -> list:
    """Ascending distinct shingle hashes of the texts data[offsets[i]:offsets[i + 1]] (UTF-8), A-Z read as a-z.

    A word's hash comes from running sums of byte times power, so that all words of a chunk are hashed at once.
    """
    import numpy as np

    n, docs = len(data), len(offsets) - 1
    t = _powers(n + 1)
    nothing = np.array([], np.int64)
    space = t["space"][data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(~space & (np.r_[True, space[:-1]] | edge[:-1])) if n else nothing
    if not len(begin):
        return [nothing] * docs
    end = np.flatnonzero(~space & (np.r_[space[1:], True] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(t["lower"][data] * t["up"][:n], out=sums[1:])
    word = _mixed((sums[end] - sums[begin]) * t["down"][begin])
    first = np.searchsorted(begin, offsets)  # of each text, among all words
    m = [np.uint64(x) for x in _M]
    window = np.array([], np.uint64)
    if len(word) >= SHINGLE:
        k = len(word) - SHINGLE + 1
        window = _mixed(sum(word[j : k + j] * m[j] for j in range(SHINGLE))).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(window[a : b - SHINGLE + 1]))
        elif b > a:
            few = sum(word[a + j : a + j + 1] * m[j] for j in range(b - a)) + np.uint64(b - a)
            out.append(_mixed(few).view(np.int64))
        else:
            out.append(nothing)
    return out


def text_sets(column):
    """The sets of an Arrow column of texts, some at a time; null texts have empty ones."""
    import numpy as np
    import pyarrow as pa

    for begin in range(0, len(column), 1024):
        part = column.slice(begin, 1024).cast(pa.large_string()).fill_null("")
        _, at, data = part.buffers()
        at = np.frombuffer(at, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.array([], np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
            yield from _chunk_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lo = hi


def common_shingles(docs: DataFrame):
    """The most common shingles as (ascending hashes, their ranks, the most common last).

    Each task counts all shingles of its rows, once for texts with the same set, and passes on those it has seen more than
    once; their sums tell the common ones apart. What reaches the driver is bounded by COMMON_SHINGLES.
    """
    import numpy as np

    def repeated(batches):
        import pyarrow as pa

        kept, n, seen = [], 0, set()

        def condensed():
            values, counts = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.array([], "i8"), np.array([], "i8"))
            return pa.RecordBatch.from_arrays([pa.array(values[counts > 1], pa.int64()), pa.array(counts[counts > 1], pa.int64())], ["s", "n"])

        for b in batches:
            for own in text_sets(b.column("text")):
                if len(own) and (digest := hash(own.tobytes())) not in seen:
                    seen.add(digest)
                    kept.append(own)
                    n += len(own)
            if n >= 1_500_000:  # a task's memory is bounded, whatever its input
                yield condensed()
                kept, n, seen = [], 0, set()
        yield condensed()
        kept.clear()
        give_back()

    found = docs.select("text").mapInArrow(repeated, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = found.where("n >= 4").orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).toPandas()
    top = top.assign(rank=np.arange(len(top), 0, -1)).sort_values("s")
    return top["s"].to_numpy("i8"), top["rank"].to_numpy("i4")


def prefix_length(n: int) -> int:
    """Sets that link with one of n elements share at least ceil(0.8 n) of them."""
    return n - (n * PERCENT + 99) // 100 + 1


def prefixes(docs: DataFrame, common) -> DataFrame:
    """(doc_id, n, d1, d2, g, rank, prefix) of every document with a set: its size, digests of the set, group, the rank of
    the prefix's last shingle, and the prefix. A task gives a group's prefix once, so that a large group of copies is a few rows a task before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    kinds = "doc_id long, n int, d1 long, d2 long, g long, rank int, prefix array<long>"

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        hashes, ranks = shared.value
        seen: set[int] = set()
        signed = lambda x: x - (1 << 63)
        for b in batches:
            out = []
            for doc_id, own in zip(b.column("doc_id").to_pylist(), text_sets(b.column("text"))):
                n = len(own)
                if not n:
                    continue
                raw = own.tobytes()
                d1, d2 = signed(xxhash.xxh3_64_intdigest(raw)), signed(xxhash.xxh64_intdigest(raw, 1))
                at = np.searchsorted(hashes, own)
                at[at == len(hashes)] = 0
                known = hashes[at] == own if len(hashes) else np.zeros(n, bool)
                last = prefix_length(n)
                rank = 0
                if known.any():
                    own_ranks = np.where(known, ranks[at], 0)
                    order = np.lexsort((own, own_ranks))
                    own, rank = own[order], int(own_ranks[order[last - 1]])
                prefix = own[:last].copy()  # else the whole set is kept
                g = signed(xxhash.xxh3_64_intdigest(prefix.tobytes(), n))
                out.append((doc_id, n, d1, d2, g, rank, None if g in seen else prefix))
                if len(seen) < 200_000:  # beyond, repeats are only left out later
                    seen.add(g)
            if out:
                *plain, lists = zip(*out)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, types)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "g", "rank", "prefix"])
        give_back()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(cut, kinds)


def _runs(batches, names: list[str]):
    """Columns as numpy arrays of whole postings (rows of one s, which come together), some batches at a time."""
    import numpy as np

    held = None
    for b in batches:
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        s = now[0]
        if len(s) == 0:
            continue
        last = int(np.searchsorted(s, s[-1]))  # the last posting may go on in the next batch
        if last:
            yield [x[:last] for x in now]
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield held


def _bounds(s):
    import numpy as np

    return np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])


def shared_postings(rows: DataFrame) -> DataFrame:
    """rows(g, n, prefix) to (s, g, n, pos) of those postings' rows that may link to another row of the posting, by their
    sizes and by what is left of both sets after the places of s."""
    at = rows.select("g", "n", F.posexplode("prefix").alias("pos", "s"))

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        for s, g, n, pos in _runs(batches, ["s", "g", "n", "pos"]):
            new = np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]  # a group may come from several tasks
            s, g, n, pos = s[new], g[new], n[new].astype("i8"), pos[new].astype("i8")
            ok = np.zeros(len(s), bool)
            edges = _bounds(s)
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            fit = _may_link(n[two], pos[two], n[two + 1], pos[two + 1])
            ok[two[fit]] = ok[two[fit] + 1] = True
            for lo, k in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = slice(lo, lo + k)
                if k > 400:  # told apart later
                    ok[own] = True
                else:
                    fit = _may_link(n[own, None], pos[own, None], n[None, own], pos[None, own])
                    np.fill_diagonal(fit, False)
                    ok[own] = fit.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(s[ok]), pa.array(g[ok]), pa.array(n[ok], pa.int32()), pa.array(pos[ok], pa.int32())], ["s", "g", "n", "pos"])

    dealt = at.select("s", "g", "n", "pos").repartition("s").sortWithinPartitions("s", "n", "g")
    return dealt.mapInArrow(keep, "s long, g long, n int, pos int")


def _may_link(n, pos, m, at):
    """Whether sets of n and m elements may be PERCENT alike if the first they share is at these places of both."""
    import numpy as np

    small, large = np.minimum(n, m), np.maximum(n, m)
    most = 1 + np.minimum(n - pos - 1, m - at - 1)
    return (100 * small >= PERCENT * large) & (most * (100 + PERCENT) >= PERCENT * (n + m))


def group_pairs(postings: DataFrame, stars: bool) -> DataFrame:
    """postings(s, g, n, pos, comp, shared, pivot, far) to pairs (a, b) of groups in different components; comp is null for
    a group with sets in more than one.

    With stars, one pair (star, b) for each b: in every run of sets near in size, the star is of those with the largest part
    of their prefix in postings the one whose size is next to the run's median; of a group's stars the one with the most
    postings is taken. Without: all pairs a < b whose sizes and positions allow a link, but for those with distances (far)
    to the same pivot. A posting with more than DENSE of these a row gives no pairs but one row (pivot, b) with dense for
    each group b that has one: all groups with the same such pivot, which is the most common one of the posting, must meet.
    """
    most = DENSE

    def pairs(batches):
        import numpy as np

        for s, g, n, pos, comp, shared, pivot, far in _runs(batches, ["s", "g", "n", "pos", "comp", "shared", "pivot", "far"]):
            edges = _bounds(s)
            n, pos, size = n.astype("i8"), pos.astype("i8"), np.diff(edges)
            # postings of two, which most are
            i = edges[:-1][size == 2]
            fit = ((comp[i] != comp[i + 1]) | (comp[i] == APART)) & _may_link(n[i], pos[i], n[i + 1], pos[i + 1])
            i = i[fit if stars else fit & ((pivot[i] != pivot[i + 1]) | np.isnan(far[i] + far[i + 1]))]
            star = i + (shared[i + 1] >= shared[i] - 0.1)
            left, right, homes, guests = [g[star]], [g[2 * i + 1 - star]], [g[:0]], [g[:0]]
            for lo, hi in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist()):
                own = comp[lo:hi]
                if own[0] != APART and (own == own[0]).all():
                    continue
                if not stars:
                    met, few, made = np.zeros(hi - lo, bool), [], 0
                    for i in range(lo, hi - 1):  # ascending in size
                        end = lo + int(np.searchsorted(n[lo:hi], 5 * n[i] // 4, "right"))
                        j = np.arange(i + 1, end)
                        j = j[(comp[j] != comp[i]) | (comp[j] == APART)]
                        j = j[_may_link(n[i], pos[i], n[j], pos[j])]
                        j = j[(pivot[j] != pivot[i]) | np.isnan(far[j] + far[i])]
                        if len(j):
                            met[i - lo] = met[j - lo] = True
                            made += len(j)
                            if made <= most * (hi - lo):
                                few.append((np.full(len(j), g[i]), g[j]))
                            else:
                                few.clear()
                    if made > most * (hi - lo):
                        at = lo + np.flatnonzero(met)
                        pivots, count = np.unique(pivot[at], return_counts=True)
                        mixed = pivots.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
                        homes.append(np.full(len(at), pivots[np.lexsort((mixed ^ (mixed >> np.uint64(29)), count))[-1]]))
                        guests.append(g[at])
                    else:
                        left += [x for x, _ in few]
                        right += [x for _, x in few]
                    continue
                i = lo
                while i < hi:
                    end = lo + int(np.searchsorted(n[lo:hi], 5 * n[i] // 4, "right"))
                    if end - i > 1:
                        run = slice(i, end)
                        at = i + np.flatnonzero(shared[run] >= shared[run].max() - 0.1)
                        mixed = g[at].astype("u8") * np.uint64(0x9E3779B97F4A7C15)
                        star = at[int(np.lexsort((mixed ^ (mixed >> np.uint64(29)), -np.abs(n[at] - n[i + (end - i) // 2])))[-1])]
                        fit = (comp[run] != comp[star]) | (comp[run] == APART)
                        fit &= _may_link(n[star], pos[star], n[run], pos[run])
                        fit[star - i] = False
                        left.append(np.full(int(fit.sum()), g[star]))
                        right.append(g[run][fit])
                    i = end
            both = np.stack([np.concatenate(left), np.concatenate(right)])
            if both.size:
                if not stars:
                    both.sort(axis=0)
                yield batch(both, False)
            if len(homes) > 1:
                yield batch(np.stack([np.concatenate(homes), np.concatenate(guests)]), True)

    def batch(both, dense):
        import numpy as np
        import pyarrow as pa

        both, k = np.unique(both, axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(k, pa.int64()), pa.array(np.full(len(k), dense))], ["a", "b", "k", "dense"])

    dealt = postings.select("s", "g", "n", "pos", F.coalesce("comp", F.lit(APART)).alias("comp"), "shared", "pivot", "far")
    found = dealt.repartition("s").sortWithinPartitions("s", "n", "g").mapInArrow(pairs, "a long, b long, k long, dense boolean")
    if not stars:
        return found.select("a", "b", "dense").distinct()
    return found.groupBy("b", "a").agg(F.sum("k").alias("k")).groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a")).select("a", "b")


def _hinted(df: DataFrame) -> DataFrame:
    """df, for a broadcast if the written tables that it is read from are small; else it is joined by shuffle."""
    return F.broadcast(df) if small(df) else df


def overlapping(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs (a, b) of groups whose prefixes have enough in common for a link.

    Of two prefixes, the one that ends first in the order of shingles has all it shares with the other set in the other
    one's prefix. So no more is shared than what both prefixes have and what comes after that prefix.
    """
    wanted = _hinted(pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct())
    rows = cut.where("prefix is not null").join(wanted, "g").dropDuplicates(["g"])
    a, b = (rows.select(F.col("g").alias(x), F.struct("rank", F.element_at("prefix", -1).alias("s"), (F.col("n") - F.size("prefix")).alias("rest"), "n", "prefix").alias(f"of_{x}")) for x in "ab")
    both = a.join(_hinted(pairs), "a").join(b, "b")
    end = lambda x: F.struct(f"of_{x}.rank", f"of_{x}.s")
    rest = F.when(end("a") <= end("b"), F.col("of_a.rest")).otherwise(F.col("of_b.rest"))
    most = F.size(F.array_intersect("of_a.prefix", "of_b.prefix")) + rest
    return both.where((100 + PERCENT) * most >= PERCENT * (F.col("of_a.n") + F.col("of_b.n"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with far, the Jaccard distance of their whole sets(cid, set), and whether they link. b's set moves to a."""
    b = sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")).join(_hinted(pairs), "b")
    a = sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")).join(_hinted(pairs.select("a").distinct()), "a", "left_semi")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = b.join(a, "a").select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), both.alias("i"))
    return joined.select("a", "b", (1 - F.col("i") / (F.col("n") - F.col("i"))).alias("far"), (100 * F.col("i") >= PERCENT * (F.col("n") - F.col("i"))).alias("linked"))


def needed_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, set) of classes(cid, d1), from the texts. Rows that share a doc_id but not a text are told by digests."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def batch(out):
            flat = np.concatenate([x for _, x in out])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for _, x in out)]), pa.int32()), pa.array(flat, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), lists], ["cid", "set"])

        for b in batches:
            ids, want, out, n = b.column("doc_id").to_pylist(), b.column("d1").to_pylist(), [], 0
            for doc_id, d1, own in zip(ids, want, text_sets(b.column("text"))):
                if xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) == d1:
                    out.append((doc_id, own))
                    n += len(own)
                if n > 1_000_000:
                    yield batch(out)
                    out, n = [], 0
            if out:
                yield batch(out)
        give_back()

    return docs.join(_hinted(classes.select(F.col("cid").alias("doc_id"), "d1")), "doc_id").select("doc_id", "d1", "text").mapInArrow(cut, "cid long, set array<long>")


def needed_sets_of(pairs: DataFrame, known: DataFrame | None, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, set) of those classes in pairs(a, b) whose set is not known yet, as a table."""
    missing = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    if known is not None:
        missing = missing.join(known.select("cid"), "cid", "left_anti")
    return stage_table(needed_sets(docs, stage_table(classes.select("cid", "d1").join(missing, "cid"), "needed")), "sets")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links(a, b) to (v, comp): the smallest number that each one reaches. Rounds of least neighbours and of jumps to
    the label's label; each round's labels are a written table."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stage_table(both.where("u <> v").distinct(), f"{name}-edges")
    labels = edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("comp"))
    while True:
        near = edges.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        low = labels.join(near, "v", "left").select("v", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("further"))
        after = stage_table(low.join(jump, "low", "left").select("v", F.least("low", F.coalesce("further", "low")).alias("comp"), F.col("comp").alias("was")), name)
        if after.where("comp <> was").isEmpty():
            return after.select("v", "comp")
        labels = after.select("v", "comp")


def _blocks(batches, keys: list[str]):
    """Tables of whole blocks (rows with the same keys, which come together)."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = b.slice(lo, hi - lo)
            if held and lo == 0 and any(held[-1].column(c)[-1] != part.column(c)[0] for c in keys) or lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def dealt_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members(cid, n, copies, comp, key, root) to the rows of blocks (key, lo, hi), in which all members of a key meet.

    A set is kept as what it and the root's set do not share: two sets differ by what these differences differ by. Members
    are dealt to parts of about LINK_BLOCK by a hash; every two parts of a key meet in one block.
    """
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / LINK_BLOCK).cast("int").alias("parts"), F.first("root").alias("cid"))
    root = sets.join(_hinted(parts), "cid").select("key", "parts", F.col("set").alias("base"))
    rows = sets.join(_hinted(members), "cid").join(root, "key")
    off = F.concat(F.array_except("set", "base"), F.array_except("base", "set"))
    rows = rows.select("cid", "n", "copies", "comp", "key", "parts", off.alias("off"), F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("p"))
    rows = stage_table(rows, "differences").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cid", "n", "copies", "comp", "off", "key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("right"))
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


class _Block:
    """The sets of a block by their differences from the root."""

    def __init__(self, table):
        import numpy as np

        self.cid, n, self.copies, self.comp, right = (table.column(c).to_numpy() for c in ("cid", "n", "copies", "comp", "right"))
        self.n = n.astype("i8")
        off = table.column("off").combine_chunks()
        self.size = off.value_lengths().to_numpy().astype("i8")
        self.same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        self.left, self.other = (np.arange(len(n)),) * 2 if self.same else (np.flatnonzero(~right), np.flatnonzero(right))
        self.ids = np.unique(off.flatten().to_numpy(), return_inverse=True)[1]
        self.at = np.r_[0, np.cumsum(self.size)]
        self.theirs = np.concatenate([self.ids[:0], *(self.ids[self.at[j] : self.at[j + 1]] for j in self.other)])
        self.until = np.cumsum(self.size[self.other])
        self.mask = np.zeros(int(self.ids.max(initial=0)) + 1, bool)

    def linked(self, i):
        """The members of the other part that link to member i."""
        import numpy as np

        own, n, other = self.ids[self.at[i] : self.at[i + 1]], self.n, self.other
        self.mask[own] = True
        seen = np.r_[0, np.cumsum(self.mask[self.theirs])]
        self.mask[own] = False
        common = seen[self.until] - seen[self.until - self.size[other]]
        both = (n[i] + n[other] - self.size[i] - self.size[other] + 2 * common) // 2
        return other[(100 * both >= PERCENT * (n[i] + n[other] - both)) & (other != i)]


def links_near_stars(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members(cid, n, copies, comp, key, root) to links (a, b) that connect what members of one key have apart: a block
    gives no more of them than it has components, less one."""

    def connect(batches):
        import numpy as np
        import pyarrow as pa

        for table in _blocks(batches, ["key", "lo", "hi"]):
            block, out = _Block(table), []
            now = np.unique(block.comp, return_inverse=True)[1]
            for i in block.left:
                if (now == now[i]).all():
                    continue
                j = block.linked(i)
                while len(j := j[now[j] != now[i]]):
                    out.append((block.cid[i], block.cid[j[0]]))
                    now[now == now[j[0]]] = now[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt_blocks(members, sets).mapInArrow(connect, "a long, b long")


def class_links(classes: DataFrame, labels: DataFrame, sets: DataFrame, links: DataFrame, list_partners: bool = True) -> DataFrame:
    """classes(cid, n, copies), labels(v, comp), sets(cid, set) and links(a, b) to (cid, partners, n_links): all links of
    each class to others, in one or more rows a class, and the copies of these others. Every link is in both of its
    classes' rows. partners is empty unless it is asked for. The root of a component is its set with the most of links.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("degree"))
    of = labels.withColumnRenamed("v", "cid").join(degree, "cid", "left")
    roots = of.groupBy("comp").agg(F.max_by("cid", F.struct(F.coalesce("degree", F.lit(0)), "cid")).alias("root"), F.count("*").alias("k"))
    of = stage_table(of.join(roots, "comp").select("cid", "comp", F.col("comp").alias("key"), "root", "k").join(classes.select("cid", "n", "copies"), "cid"), "linked-classes")
    two = of.where("k = 2").groupBy("comp").agg(F.collect_list(F.struct("cid", "copies")).alias("x"))  # their link is known
    side = lambda i: F.struct(F.col("x")[i]["cid"].alias("cid"), (F.array(F.col("x")[1 - i]["cid"]) if list_partners else F.array().cast("array<bigint>")).alias("partners"), F.col("x")[1 - i]["copies"].alias("n_links"))
    two = two.select(F.explode(F.array(side(0), side(1))).alias("r")).select("r.*")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        out = []

        def batch():
            columns = [[x[0] for x in out], [x[1] for x in out], [x[2] for x in out]]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.int64()))], ["cid", "partners", "n_links"])

        for table in _blocks(batches, ["key", "lo", "hi"]):
            block = _Block(table)
            found = [(i, j) for i in block.left if len(j := block.linked(i))]
            if found and not block.same:  # the other direction
                i, j = (np.concatenate(x) for x in zip(*((np.full(len(j), i), j) for i, j in found)))
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                cuts = np.flatnonzero(np.r_[True, j[1:] != j[:-1], True])
                found += [(j[a], i[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            out += [(block.cid[i], block.cid[j] if list_partners else (), int(block.copies[j].sum())) for i, j in found]
            if len(out) >= 20_000:
                yield batch()
        yield batch()

    blocks = dealt_blocks(of.where("k > 2").drop("k"), sets)
    return blocks.mapInArrow(compare, "cid long, partners array<long>, n_links long").unionByName(two)


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join: (a, b), a < b, of all pairs of classes that link, and (doc_id, cid), the class of each row of docs with words.

    A class has the rows of one set. Two rows link if they are of one class or of two that link.
    """
    cut, classes, known, labels, links = _connected(docs)
    pairs = class_links(classes, labels, known, links).select(F.col("cid").alias("a"), F.explode("partners").alias("b")).where("a < b").distinct()
    return stage_table(pairs, "class-links"), cut.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "cid")


def _connected(docs: DataFrame) -> tuple[DataFrame, ...]:
    """docs(doc_id, text) to their rows' digests, classes of the same set, sets of those that may link, (v, comp), links."""
    in_small_batches(docs.sparkSession)
    cut = stage_table(prefixes(docs, common_shingles(docs)), "prefixes")
    classes = stage_table(cut.groupBy("n", "d1", "d2", "g").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")), "classes")
    index = stage_table(shared_postings(cut.where("prefix is not null").select("g", "n", "prefix")), "postings")
    groups = stage_table(classes.groupBy("g").agg(F.min("cid").alias("first"), F.count("*").alias("k")), "groups")
    within = classes.join(groups.where("k > 1"), "g").select("g", "first", "cid", "n")
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    shared = index.groupBy("g", "n").agg(F.count("*").alias("k")).select("g", (F.col("k") / length).alias("shared"))
    of = classes.select("g", "cid")

    # a star for each group
    marked = index.join(shared, "g").withColumns({"comp": F.col("g"), "pivot": F.col("g"), "far": F.lit(math.nan)})
    pairs = stage_table(group_pairs(marked, True), "group-pairs")
    pairs = stage_table(overlapping(pairs, cut), "kept-pairs")
    star = groups.select(F.col("g").alias("ga"), F.col("first").alias("a"))
    wide = pairs.select(F.col("a").alias("ga"), F.col("b").alias("g")).join(star, "ga").join(of, "g").select("a", F.col("cid").alias("b"))
    wide = stage_table(wide.unionByName(within.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))).distinct(), "pairs")
    known = needed_sets_of(wide, None, docs, classes)
    tests = stage_table(verified(wide, known), "tested")
    found = tests.where("linked").select("a", "b")

    # what the same star was compared with
    stars = tests.select(F.col("b").alias("cid"), F.col("a").alias("pivot"), "far", "linked").dropDuplicates(["cid"])
    apart = stars.groupBy("pivot").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("left")).where("k > 1 and left > 0").select("pivot")
    members = stars.join(apart, "pivot").join(classes.select("cid", "n", "copies"), "cid")
    comp = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("cid"))
    members = stage_table(members.select("cid", "n", "copies", comp.alias("comp"), F.col("pivot").alias("key"), F.col("pivot").alias("root")), "star-members")
    found = stage_table(found.unionByName(links_near_stars(members, known)), "star-links")

    # what is still apart: as far as a class's star and that one's star tell
    to = stars.where("linked").select("cid", F.col("pivot").alias("star"))
    up = lambda of, name: to.select(F.col("cid").alias(of), F.col("star").alias(name))
    state = of.join(stars.select("cid", "pivot", "far"), "cid", "left").join(up("cid", "c1"), "cid", "left").withColumn("c1", F.coalesce("c1", "cid"))
    state = state.join(up("c1", "c2"), "c1", "left").withColumn("c2", F.coalesce("c2", "c1"))
    state = state.join(up("c2", "c3"), "c2", "left").withColumn("comp", F.least("c1", "c2", F.coalesce("c3", "c2")))
    state = stage_table(state.select("g", "cid", "comp", F.coalesce("pivot", "cid").alias("pivot"), F.coalesce("far", F.lit(math.nan)).alias("far")), "state")
    one = F.count("*") == 1
    grouped = state.groupBy("g").agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("comp"), F.when(one, F.min("pivot")).otherwise(F.min("cid")).alias("pivot"), F.when(one, F.min("far")).otherwise(F.lit(math.nan)).alias("far"))
    met = stage_table(group_pairs(index.join(grouped, "g").withColumn("shared", F.lit(0.0)), False), "group-pairs")
    pairs = stage_table(overlapping(met.where("not dense").select("a", "b"), cut), "kept-pairs")
    a, b = (state.select(F.col("g").alias(f"g{x}"), F.col("cid").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    wide = pairs.select(F.col("a").alias("ga"), F.col("b").alias("gb")).join(a, "ga").join(b, "gb").where("comp_a <> comp_b").select("a", "b")
    inner = within.select("cid", "n", F.col("g").alias("s")).join(state.select("cid", "comp", "pivot", "far"), "cid")
    inner = inner.select("s", F.col("cid").alias("g"), "n", F.lit(0).alias("pos"), "comp", F.lit(0.0).alias("shared"), "pivot", "far")
    old = tests.select("a", "b").unionByName(tests.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met_inner = stage_table(group_pairs(inner, False), "class-pairs")
    wide = stage_table(wide.unionByName(met_inner.where("not dense").select("a", "b")).distinct().join(old, ["a", "b"], "left_anti"), "pairs")

    # where very many are
    guests = met.where("dense").select(F.col("a").alias("key"), F.col("b").alias("g")).join(of, "g").select("key", "cid")
    guests = guests.unionByName(met_inner.where("dense").select(F.col("a").alias("key"), F.col("b").alias("cid"))).distinct()
    guests = guests.join(state.select("cid", "comp"), "cid").join(classes.select("cid", "n", "copies"), "cid")
    guests = stage_table(guests.select("cid", "n", "copies", "comp", "key", F.col("key").alias("root")), "guests")
    wanted = wide.unionByName(guests.select(F.col("key").alias("a"), F.col("cid").alias("b")))
    known = known.unionByName(needed_sets_of(wanted, known, docs, classes))
    found = found.unionByName(stage_table(verified(wide, known).where("linked").select("a", "b"), "links"))
    found = found.unionByName(stage_table(links_near_stars(guests, known), "guest-links"))
    return cut, classes, known, components(found), found


def link_components(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id[, n_links]) of every row of docs(doc_id, text).

    n_links is the number of other rows that a row links to, copies among them; it asks for the whole join. Texts without
    words (and null ones) have no shingles and are linked with nothing; component_id is then the row's own doc_id. Rows without doc_id get no component and connect nothing. Repeated rows are returned as often as they
    occur. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    cut, classes, known, labels, links = _connected(docs)
    named = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left")
    more = []
    if count_links:
        total = stage_table(class_links(classes, labels, known, links, False).groupBy("cid").agg(F.sum("n_links").alias("more")), "link-counts")
        named = named.join(total, "cid", "left").withColumn("n_links", F.coalesce("more", F.lit(0)) + F.col("copies") - 1)
        more = ["n_links"]
    named = named.select("n", "d1", "d2", F.coalesce("comp", "cid").alias("component_id"), *more)
    linked = cut.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", *more)

    def wordless(batches):
        import pyarrow as pa

        for b in batches:
            out = [(i, len(x)) for i, x in zip(b.column("doc_id").to_pylist(), text_sets(b.column("text"))) if i is None or not len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64()), pa.array([i for i, _ in out], pa.int64())], ["doc_id", "n_shingles", "component_id"])

    bare = docs.where(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).mapInArrow(wordless, "doc_id long, n_shingles long, component_id long")
    return linked.unionByName(bare.withColumn("n_links", F.lit(0).cast("long")) if count_links else bare)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id, with the columns of docs, whatever their names.

    Rows without words all stay, and so do rows without doc_id; of several rows with one doc_id, one stays. An empty table
    gives no rows.
    """
    out = link_components(docs).where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("k"))
    out = stage_table(out, "kept")
    kept = docs.join(_hinted(out.select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    if not out.where("k > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), count_links=True)
