"""What Python workers keep: the workers of one stage serve the next ones too."""

from __future__ import annotations

import subprocess
import sys

import pytest

import corpus_pipeline
from sparsemill.llm import packing
from sparsemill.llm.encoding import tokenizer_path

WORDS = 150_000


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of distinct words, in one task."""
    rows = [(i, " ".join(f"zq{chr(97 + k % 26)}{k // 26:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(i * 500, i * 500 + 500))) for i in range(WORDS // 500)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_packing_stage_bounds_what_a_worker_keeps(spark, docs):
    corpus_pipeline.packing_stage(spark, docs, "").count()

    def look(batches):
        import pyarrow as pa

        from sparsemill.llm.encoding import Encoder

        list(batches)
        kept = [sum(u.startswith(" zq") for units in (e.units, e.units.elder) for u in units) for e in Encoder._made.values()]
        yield pa.RecordBatch.from_pydict({"n": pa.array([max(kept, default=0)], pa.int64())})

    most = max(r["n"] for r in spark.range(64).repartition(16).mapInArrow(look, "n long").collect())
    assert 0 < most <= 2 * corpus_pipeline.KEPT_UNITS < WORDS


def test_pieces_do_not_depend_on_what_is_kept(spark, docs):
    some = docs.where("doc_id < 12")
    few, many = ({tuple(r) for r in packing.token_pieces(some, tokenizer_path("byte_bpe_50k.json"), kept=n).collect()} for n in (7, packing.KEPT_UNITS))
    assert few == many and len({r[1] for r in few}) == 12


def test_freed_memory_goes_back():
    """Many blocks of a size that the C library keeps when they are freed, with one in use above them."""
    code = """if True:
        import ctypes, re
        from sparsemill.llm.common import give_back
        mb = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
        blocks = [bytearray(100_000) for _ in range(2_000)]
        for b in blocks:
            b[::4096] = b"x" * len(b[::4096])
        last = blocks[-1]
        del blocks, b
        before = mb()
        give_back()
        print(before, mb(), hasattr(ctypes.CDLL(None), "malloc_trim"))
    """
    before, after, can = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    if can == "False":
        pytest.skip("the C library has no malloc_trim")
    assert int(before) > 150 and int(after) < int(before) - 100
