"""Cross-tokenizer alignment: which tokens of two tokenizers lie over the same bytes, and which ids belong together.

Token occurrences whose byte ranges overlap are linked. Links are counted for each pair of ids in dense matrices: pairs are
partitioned by the id of side B into stripes (id modulo STRIPES), a task adds a stripe's pairs to one block of rows by B and
columns by A, and each row's maximum is the best count of its B id. Links lie in the same stripes and are scored there.

A map task reads chunks of documents and writes for each chunk and stripe two blobs: its pairs with their counts, which is
all that the counting moves, and its links by document, each pair once a document with its number. Stripes with many bytes
of either are dealt over several parts, so that one id, however common, is no one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, stage_table, table, text_or_empty
from .encoding import Encoder, byte_letters, tokenizer_path

STRIPES = 512
#: A chunk ends with so many code points or documents.
CHUNK_CHARS, CHUNK_DOCS = 3 << 20, 1024
#: A part of a stripe holds about so many bytes of blobs.
PART_BYTES = 16 << 20
CHUNKS = "part int, number int, stripe int, ids array<long>, counts binary, groups array<string>, pairs binary, links binary"


def packed(*columns) -> bytes:
    """Arrays of one length as one compressed blob."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(columns[0]).to_bytes(8, "little"), *(c.tobytes() for c in columns)]))


def unpacked(blob: bytes, *kinds: str) -> list:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * out[-1].itemsize
    return out


class Sides:
    """The two tokenizers, and the bytes of their tokens."""

    _made: dict[tuple, Sides] = {}

    def __init__(self, a_path: str, b_path: str):
        import numpy as np
        import sentencepiece

        self.a, self.b = Encoder.of(a_path, "gaps", None), sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of, tokenizer = {c: b for b, c in byte_letters().items()}, self.a.units.tokenizer
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Byte-level tokens without a normalizer are the text's own bytes.
        self.lossless = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.a_long, self.b_long = (np.array([len(x) for x in known]) for known in (self.a_bytes, self.b_bytes))
        # Ids in writing, with what follows: within a side, after the last of side A in its group, after the last of B.
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(names), len(pieces)))]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Sides:
        """One for each worker process."""
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def document(self, text: str):
        """Number of ids of A and of B, number of groups, linked ids (A times 2**32 plus B, one for each link), and the groups
        in writing. Nothing of these for an empty text and one whose tokens' bytes are not those of a blank and the text."""
        import numpy as np

        none = 0, 0, 0, np.zeros(0, "u8"), ""
        if not text:
            return none
        a, b, data = np.frombuffer(self.a.encode(" " + text), "<u4"), np.array(self.b.encode(text), "<u4"), (" " + text).encode()
        ends_a, ends_b = self.a_long[a].cumsum(), self.b_long[b].cumsum()
        if not len(a) or not len(b) or ends_a[-1] != len(data) or ends_b[-1] != len(data) or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return none
        if not self.lossless and b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data:
            return none
        at_a, at_b = (np.zeros(len(data) + 1, bool) for _ in "ab")
        at_a[ends_a] = at_b[ends_b] = True
        ends, both = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)  # up to each end, bytes belong to one token of either side
        links = (a[ends_a.searchsorted(ends)].astype("u8") << np.uint64(32)) | b[ends_b.searchsorted(ends)]
        last_a, last_b = ends_a.searchsorted(both), ends_b.searchsorted(both)
        mark_a, mark_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
        mark_a[last_a], mark_b[last_b] = 1, 2
        size, order = len(self.written) // 3, np.empty(len(a) + len(b), "i8")
        # Tokens of A stand after those of B in the groups before theirs, tokens of B after those of A up to their group.
        order[np.arange(len(a)) + np.r_[0, last_b + 1][both.searchsorted(ends_a)]] = a + size * mark_a
        order[np.arange(len(b)) + last_a[both.searchsorted(ends_b)] + 1] = b + size * mark_b
        return len(a), len(b), len(both), links, "".join(map(self.written.__getitem__, order.tolist()))[:-1]


def chunk_rows(part: int, number: int, docs: list, stripes: int):
    """The rows of a chunk as columns of CHUNKS. docs: id, number of ids of A and of B, groups, distinct links and how often,
    and groups in writing or their hash."""
    import numpy as np
    import pyarrow as pa

    of = np.repeat(np.arange(len(docs), dtype="u4"), [len(d[4]) for d in docs])
    code, n = np.concatenate([d[4] for d in docs]), np.concatenate([d[5] for d in docs])
    a, b = (code >> np.uint64(32)).astype("u4"), (code & np.uint64(0xFFFFFFFF)).astype("u4")
    stripe, row = b % stripes, b // stripes
    order = np.lexsort((of, a, row, stripe))
    a, stripe, row, of, n = a[order], stripe[order], row[order], of[order], n[order]
    cuts = [0, *(np.flatnonzero(np.diff(stripe)) + 1).tolist(), len(a)] if len(a) else []
    counts = np.array([[d[1], d[2], d[3], d[5].sum()] for d in docs], "i8")
    rows = [(part, number, -1, [d[0] for d in docs], counts.tobytes(), [d[6] for d in docs], None, None)]
    for lo, hi in zip(cuts, cuts[1:]):
        first = np.flatnonzero(np.r_[True, (np.diff(a[lo:hi]) != 0) | (np.diff(row[lo:hi]) != 0)])
        pairs = packed(row[lo:hi][first], a[lo:hi][first], np.add.reduceat(n[lo:hi], first).astype("u8"))
        rows.append((part, number, int(stripe[lo]), None, None, None, pairs, packed(row[lo:hi], a[lo:hi], of[lo:hi], n[lo:hi].astype("u4"))))
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "number", "stripe", "ids", "counts", "groups", "pairs", "links"])


def chunks(docs: DataFrame, a_path: str, b_path: str, hashed: bool, stripes: int = STRIPES) -> DataFrame:
    """A written table of CHUNKS: for each chunk of documents a row with stripe -1, which has what is known of each, and a row
    for each stripe with pairs and links."""

    def read(batches):
        import hashlib

        import numpy as np
        from pyspark import TaskContext

        sides, part, number, now, size = Sides.of(a_path, b_path), TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist()):
                    n_a, n_b, groups, links, written = sides.document(text)
                    code, n = np.unique(links, return_counts=True)
                    if hashed and written:
                        written = hashlib.sha256(written.encode()).hexdigest()
                    now.append((doc_id, n_a, n_b, groups, code, n, written))
                    size += len(text) + (0 if hashed else 2 * len(written))
                    if size >= CHUNK_CHARS or len(now) >= CHUNK_DOCS:
                        yield chunk_rows(part, number, now, stripes)
                        number, now, size = number + 1, [], 0
        if now:
            yield chunk_rows(part, number, now, stripes)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("_text"))
    return stage_table(given.mapInArrow(read, CHUNKS), "chunks")


def parts_of(blobs: DataFrame, what: str) -> DataFrame:
    """(stripe, parts): over how many parts the blobs of a stripe are dealt; a row a stripe."""
    return blobs.groupBy("stripe").agg(F.ceil(F.sum(F.octet_length(what)) / PART_BYTES).cast("int").alias("parts"))


def dealt(blobs: DataFrame, parts: DataFrame) -> DataFrame:
    """blobs with part_, a number below that of their stripe's parts."""
    return blobs.join(F.broadcast(parts), "stripe").withColumn("part_", F.pmod(F.xxhash64("part", "number"), "parts").cast("int")).drop("parts")


def counted(pairs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """pairs(stripe, part_, pairs) to one row for each (stripe, part_): the counts that are not zero of its block, and best,
    the highest of each row."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        def row(key, block):
            at = np.flatnonzero(block)
            r, c = np.unravel_index(at, shape)
            blob = packed(r.astype("u4"), c.astype("u4"), block.ravel()[at].astype("u8"))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([blob], pa.binary())], ["stripe", "part_", "pairs"])

        key, block = None, np.zeros(shape, "i8")
        for b in batches:
            for stripe, part, blob in zip(*(b.column(c).to_pylist() for c in ("stripe", "part_", "pairs"))):
                if (stripe, part) != key:
                    if key is not None:
                        yield row(key, block)
                        block[:] = 0
                    key = stripe, part
                r, c, n = unpacked(blob, "u4", "u4", "u8")
                np.add.at(block, (r, c), n.astype("i8"))
        if key is not None:
            yield row(key, block)

    by_stripe = pairs.select("stripe", "part_", "pairs").repartition("stripe", "part_").sortWithinPartitions("stripe", "part_")
    return by_stripe.mapInArrow(add, "stripe int, part_ int, pairs binary")


def pair_counts(made: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """A written table, one row a stripe: all counts of its block that are not zero. Parts are counted by themselves first."""
    pairs = made.where("stripe >= 0").select("part", "number", "stripe", "pairs")
    some = counted(dealt(pairs, parts_of(pairs, "pairs")), shape)
    return stage_table(counted(some.withColumn("part_", F.lit(0)), shape).drop("part_"), "pair-counts")


def scored(made: DataFrame, counts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(part, number, scores): for each chunk and stripe the places of its documents in the chunk, how many of their links
    are their B id's best, and the sum of the links' counts. Each part of a stripe gets the stripe's counts first, then links."""
    links = made.where("stripe >= 0").select("part", "number", "stripe", "links")
    parts = parts_of(links, "links")
    copies = counts.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_"), "pairs")
    both = dealt(links, parts).unionByName(copies, allowMissingColumns=True)
    by_stripe = both.repartition("stripe", "part_").sortWithinPartitions("stripe", "part_", F.col("pairs").isNull())

    def score(batches):
        import numpy as np
        import pyarrow as pa

        block = np.zeros(shape, "i8")
        best = block.max(1)
        for b in batches:
            out = []
            for part, number, blob, pairs in zip(*(b.column(c).to_pylist() for c in ("part", "number", "links", "pairs"))):
                if pairs is not None:
                    r, c, n = unpacked(pairs, "u4", "u4", "u8")
                    block[:] = 0
                    np.add.at(block, (r, c), n.astype("i8"))
                    best = block.max(1)
                    continue
                r, c, of, n = unpacked(blob, "u4", "u4", "u4", "u4")
                n, count = n.astype("i8"), block[r, c]
                docs, at = np.unique(of, return_inverse=True)
                sums = np.zeros((2, len(docs)), "i8")
                np.add.at(sums[0], at, n * (count == best[r]))
                np.add.at(sums[1], at, n * count)
                out.append((part, number, packed(docs, sums[0], sums[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["part", "number", "scores"])

    return by_stripe.select("part", "number", "links", "pairs").mapInArrow(score, "part int, number int, scores binary")


def _shape(a_path: str, b_path: str, stripes: int) -> tuple[int, int]:
    sides = Sides.of(a_path, b_path)
    return -(-len(sides.b_bytes) // stripes), len(sides.a_bytes)


def align(docs: DataFrame, a_path: str, b_path: str, hashed: bool = False, stripes: int = STRIPES) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, which are what
    lies between the bytes where tokens of both sides end: `a1,a2|b1;a3|b2,b3` (hashed: its SHA-256).

    A is a byte-level tokenizer that encodes a blank and the text, B a piece model that adds the blank itself; special
    tokens are plain text. Null and empty texts, and those whose tokens' bytes differ from the blank and the text (as when B
    writes another character), have no tokens: zeros and no groups. Repeated rows and rows without doc_id are rows like
    others, and count. An empty table gives no rows. Other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    shape, made = _shape(a_path, b_path, stripes), chunks(docs, a_path, b_path, hashed, stripes)
    scores = scored(made, pair_counts(made, shape), shape)
    known = made.where("stripe = -1").select("part", "number", "ids", "counts", "groups")
    both = known.unionByName(scores, allowMissingColumns=True).repartition("part", "number").sortWithinPartitions("part", "number", F.col("ids").isNull())

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        def rows(ids, counts, groups, sums):
            columns = [ids, *(pa.array(c) for c in counts.T), *(pa.array(c) for c in sums), groups]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

        chunk = None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("ids")[i].is_valid:
                    if chunk:
                        yield rows(*chunk)
                    counts = np.frombuffer(b.column("counts")[i].as_py(), "i8").reshape(-1, 4)
                    chunk = b.column("ids")[i].values, counts, b.column("groups")[i].values, np.zeros((2, len(counts)), "i8")
                else:
                    docs, best, total = unpacked(b.column("scores")[i].as_py(), "u4", "i8", "i8")
                    chunk[3][0][docs] += best
                    chunk[3][1][docs] += total
        if chunk:
            yield rows(*chunk)

    return both.select("ids", "counts", "groups", "scores").mapInArrow(gather, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def best_pairs(docs: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES) -> DataFrame:
    """(b_id, a_id, n): for each id of B that has links, the ids of A that it is linked with most often, ties included."""
    in_small_batches(docs.sparkSession)
    shape = _shape(a_path, b_path, stripes)

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for stripe, pairs in zip(b.column("stripe").to_pylist(), b.column("pairs").to_pylist()):
                r, c, n = unpacked(pairs, "u4", "u4", "u8")
                most = np.zeros(shape[0], "u8")
                np.maximum.at(most, r, n)
                at = n == most[r]
                yield pa.RecordBatch.from_arrays([pa.array(r[at].astype("i8") * stripes + stripe), pa.array(c[at].astype("i8")), pa.array(n[at].astype("i8"))], ["b_id", "a_id", "n"])

    return pair_counts(chunks(docs, a_path, b_path, True, stripes), shape).mapInArrow(best, "b_id long, a_id long, n long")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), hashed=True)
    return out.withColumnRenamed("groups", "groups_sha256")
