"""Token-id files: each document's ids compressed separately with one zstandard dictionary trained on id arrays.

A block is one file image:

    8 bytes   magic b"TOKBLK01"
    32 bytes  sha256 of the dictionary (all zero without one)
    u32       bytes an id takes (2 or 4)
    u32       documents
    u64       ids of the part before this block
    documents times (i64 doc_id, u8 has_id, u64 offset, u32 ids), then u64 end offset: the index
    frames    one zstandard frame a document, at its offset from the end of the index

All numbers are little endian. Blocks are rows of a Parquet folder, which any store that Spark reads can hold; the
dictionary lies beside it. One document is read by its index entry and one small frame.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_at_exit, few_at_once, shared_dir, table, text_or_empty
from .encoding import Encoder, tokenizer_path

MAGIC = b"TOKBLK01"
HEAD = struct.Struct("<8s32sIIQ")
ENTRY = struct.Struct("<qBQI")
END_ID = 2
#: The dictionary is trained on the first ids of about so many documents, those with the least hash of doc_id.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 32 << 10
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Units that a worker's encoder keeps, twice: a quarter of all words are new ones.
KEPT_UNITS = 400_000
BLOCKS = "part int, number long, n_ids long, lo long, hi long, block binary"


def serialize(ids32: bytes, width: int) -> bytes:
    import numpy as np

    return ids32 if width == 4 else np.frombuffer(ids32, "<u4").astype("<u2").tobytes()


def restore(raw: bytes, width: int) -> bytes:
    import numpy as np

    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def build_block(docs: list[tuple[int | None, int, bytes]], before: int, dictionary: bytes, width: int) -> bytes:
    """docs: doc_id, number of ids and frame of each."""
    sha = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    out, at = [HEAD.pack(MAGIC, sha, width, len(docs), before)], 0
    for doc_id, n, frame in docs:
        out.append(ENTRY.pack(doc_id or 0, doc_id is not None, at, n))
        at += len(frame)
    return b"".join([*out, at.to_bytes(8, "little"), *(d[2] for d in docs)])


class BlockReader:
    def __init__(self, block: bytes, dictionary: bytes):
        import zstandard

        self.block = block
        magic, sha, self.width, self.n_docs, self.before = HEAD.unpack_from(block)
        if magic != MAGIC or sha != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("not a block of this dictionary")
        self.frames = HEAD.size + self.n_docs * ENTRY.size + 8
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def entry(self, i: int) -> tuple[int | None, int, int, int]:
        """doc_id, number of ids, begin and end of the frame."""
        at = HEAD.size + i * ENTRY.size
        doc_id, has, offset, n = ENTRY.unpack_from(self.block, at)
        end = ENTRY.unpack_from(self.block, at + ENTRY.size)[2] if i + 1 < self.n_docs else int.from_bytes(self.block[self.frames - 8 : self.frames], "little")
        return doc_id if has else None, n, self.frames + offset, self.frames + end

    def ids(self, i: int) -> bytes:
        """The ids of document i as little-endian unsigned 32-bit integers."""
        _, n, begin, end = self.entry(i)
        return restore(self.unpack.decompress(self.block[begin:end], max_output_size=n * self.width), self.width)


def train_dictionary(docs: DataFrame, path: str, cut: str, width: int, n: int, size: int = DICTIONARY_BYTES) -> bytes:
    """From the documents of a bounded sample; empty if there are too few for one. Runs in one task, over the sample."""
    every = max(1, n // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("_text")

    def train(batches):
        import zstandard

        encoder, samples = Encoder.of(path, cut, END_ID, KEPT_UNITS), []
        for b in batches:
            samples += [serialize(encoder.encode(t)[: 4 * SAMPLE_IDS], width) for t in b.column("_text").to_pylist() if len(samples) < 4 * SAMPLE_DOCS]
        try:
            found = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:  # too little to learn from
            found = b""
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"d": pa.array([found], pa.binary())})

    found = sample.repartition(1).mapInArrow(train, "d binary").first()
    return bytes(found["d"]) if found else b""


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, cut: str = "words", vocabulary: int = 49_408) -> str:
    """Encode every text of docs(doc_id, text) and write blocks in ascending doc_id order. Returns the folder.

    Null text counts as empty: such documents hold the end id only. Rows without doc_id come first; equal doc_ids are
    ordered by their texts. An empty table gives an empty folder of blocks.
    """
    spark, path, width = docs.sparkSession, tokenizer, 2 if vocabulary <= 1 << 16 else 4
    docs = docs.select("doc_id", text_or_empty(F.col("text")).alias("_text"))
    dictionary = train_dictionary(docs, path, cut, width, docs.count())
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered = docs.withColumn("_tie", F.xxhash64("_text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "_text").select("doc_id", "_text")

    def blocks(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder = Encoder.of(path, cut, END_ID, KEPT_UNITS)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, number, before, now, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block():
            n, known = sum(x[1] for x in now), [x[0] for x in now if x[0] is not None]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()), pa.array([build_block(now, before, dictionary, width)], pa.binary())], ["part", "number", "n_ids", "lo", "hi", "block"]), n

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), few_at_once(b.column("_text"))):
                ids = encoder.encode(text)
                frame = pack.compress(serialize(ids, width))
                now.append((doc_id, len(ids) // 4, frame))
                size += len(frame)
                if len(now) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    out, n = block()
                    yield out
                    number, before, now, size = number + 1, before + n, [], 0
        if now:
            yield block()[0]

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_token_files(spark, folder: str) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian u32).

    Parts are in ascending doc_id order, so a document's start is the ids of the parts before, of the blocks before in
    its part (in the block's head) and of the documents before in its block. Only one number a part is summed at once.
    """
    dictionary = bytes(spark.read.schema("sha256 string, dictionary binary").parquet(f"{folder}/dictionary").first()["dictionary"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))

    def documents(batches):
        import pyarrow as pa

        for b in batches:
            for part, block in zip(b.column("part").to_pylist(), b.column("block").to_pylist()):
                reader = BlockReader(block, dictionary)
                at, rows = reader.before, []
                for i in range(reader.n_docs):
                    ids = reader.ids(i)
                    n = len(ids) // 4
                    rows.append((part, reader.entry(i)[0], at, n, zlib.crc32(ids), ids))
                    at += n
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)

    read = blocks.select("part", "block").mapInArrow(documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return read.join(parts, F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_document(spark, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id. Only blocks whose range of doc_ids holds it are read (lo and hi are
    statistics of the Parquet files), the entry is found by halving the index, and other frames stay packed."""
    dictionary = bytes(spark.read.schema("sha256 string, dictionary binary").parquet(f"{folder}/dictionary").first()["dictionary"])

    def find(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for block in b.column("block").to_pylist():
                reader = BlockReader(block, dictionary)
                i = bisect.bisect_left(range(reader.n_docs), doc_id, key=lambda i: -math.inf if (d := reader.entry(i)[0]) is None else d)
                while i < reader.n_docs and reader.entry(i)[0] == doc_id:
                    found.append(reader.ids(i))
                    i += 1
            yield pa.RecordBatch.from_pydict({"ids": pa.array(found, pa.binary())})

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where((F.col("lo") <= doc_id) & (F.col("hi") >= doc_id)).select("block")
    return [list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) for r in blocks.mapInArrow(find, "ids binary").collect()]


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, folder).drop("ids")
