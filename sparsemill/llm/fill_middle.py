"""Fill-in-middle: texts are cut into prefix, middle and suffix and written in another order between sentinels.

The Split pre-tokenizer of the tokenizers library, with its regex matches isolated and nothing trained, gives the code-point
offsets of a text's units. Their number is n, and where units of two hashed ranks end, the text is sliced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, table, text_or_empty

#: A unit: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts meet the pre-tokenizer in blocks of about so many code points, as it holds a map of them.
BLOCK_CHARS = 1 << 19
_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Rows that are Python objects at a time.
ROWS = 128


def unit_ends(text: str, splitter, block: int = BLOCK_CHARS) -> list[int]:
    """Where the units of a text end, in code points. Blocks end where a word does, so that no unit lies in two."""
    ends, at = [], 0
    while at < len(text):
        found = _WORD_END.search(text, at + block - 1) if at + block < len(text) else None
        to = found.end() if found else len(text)
        ends += [at + end for _, (_, end) in splitter.pre_tokenize_str(text[at:to])]
        at = to
    return ends


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNIT), "isolated")


def arranged(text: str, digest: str, split, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[str, int, str, int | None, int | None]:
    """output, n, form, code points of prefix and of middle. digest: hexadecimal digits, of which the first 32 decide."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    ends = unit_ends(text, split)
    n = len(ends)
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return text, n, "plain", None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (lo, hi))
    p, s, m = sentinels
    if h4 % 100 < spm:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", n, "spm", a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", n, "psm", a, b - a


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs(doc_id, text, ...) with output, n, form (plain, psm or spm), prefix_chars and middle_chars; columns of docs with
    these names are replaced, all others stay.

    rate: in how many of a hundred texts the order changes; spm: in how many of a hundred of these the suffix comes first.
    Both, and the cuts, depend on seed and doc_id alone, so that repeated rows are cut alike; rows without doc_id share the
    hash of the seed. A null text counts as empty: plain, an empty output, n = 0. Texts that hold a sentinel stay plain. An
    empty table stays empty.
    """
    in_small_batches(docs.sparkSession)
    own = ["output", "n", "form", "prefix_chars", "middle_chars", "_fim_hash", "_fim_text"]
    docs = docs.drop(*own)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    given = docs.withColumn("_fim_hash", digest).withColumn("_fim_text", text_or_empty(F.col("text")))
    names = docs.columns
    made = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in (("output", T.StringType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())))])

    def cut(batches):
        import pyarrow as pa

        split = splitter()
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                rows = [arranged(t, h, split, rate, spm, sentinels) for t, h in zip(b.column("_fim_text").to_pylist(), b.column("_fim_hash").to_pylist())]
                new = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, *own[:5]])

    return given.mapInArrow(cut, made)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from: sentinels occur once each, in the order of the form. They must
    start with a character that they have nowhere else, so that none can arise where text and sentinel meet."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        i = F.instr(body, second)
        rest = F.substring(body, i + len(second), F.length(body))
        j = F.instr(rest, m)
        return F.substring(body, F.lit(1), i - 1), F.substring(rest, F.lit(1), j - 1), F.substring(rest, j + len(m), F.length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
