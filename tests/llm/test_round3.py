"""Fill-in-middle, token alignment and sharding against plain versions, with nulls, empty and long texts, ties, repeated rows
and clashing names."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill.llm import fill_middle, fingerprints, queries, sharding, token_alignment
from sparsemill.llm.common import table
from sparsemill.llm.encoding import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, source string, n long, form string, shard int, slot string, `_text` string, output string, stripe int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeénopß世") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 30, 300]))) for _ in range(80)]
    texts += [None, "", " ", "  \n\t ", "one", "one ", " one", "a▁b", "it's <P> marked", "ends in <", "<S", "M> x <M", "x <S>", "</s> <|endoftext|> <unk>", "a\x00b \x85c  d　e", "tabs\tand\nlines\r\n\r\n  more   blanks ", "🤦🏼‍♂️ 👍 naïve ﬁ", "z" * 3000, " ".join(word() for _ in range(20_000))]
    out = [(i, t, ["x", None][i % 2], 1, "f", 3, "s", "clash", "o", 1) for i, t in enumerate(texts)]
    out += [(7, texts[7], "x", 1, "f", 3, "s", "clash", "o", 1)] * 40 + [(None, "no id", None, None, None, None, None, None, None, None)] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def plain_fim(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_fill_in_middle(docs, rows, rate, spm):
    made = fill_middle.fill_in_middle(docs, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "text", "source", "shard", "slot", "_text", "stripe", "output", "n", "form", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(((r[0], *plain_fim(r[0], r[1], rate, spm)) for r in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got) and all(r["source"] in ("x", None) for r in got)


def test_blocks_of_long_texts_cut_no_unit():
    split, text = fill_middle.splitter(), "  ab \n c  déf   " * 50 + "g" * 40 + " h  "
    whole = [end for _, (_, end) in split.pre_tokenize_str(text)]
    assert all(fill_middle.unit_ends(text, split, block) == whole for block in (1, 2, 3, 7, 50, 10_000))
    assert fill_middle.unit_ends("", split) == []


# 12


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer_path(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    a_model.encode_special_tokens = True
    from sparsemill.llm.encoding import byte_letters

    back, out, counts = {c: b for b, c in byte_letters().items()}, [], collections.Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        a = a_model.encode(data.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        at = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        bt = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if not text or b"".join(at) != data or b"".join(bt) != data:
            out.append(([], [], [], ""))
            continue
        i = j = x = y = 0
        links, groups, now = [], [], ([], [])
        while i < len(a):  # walk both sides; x and y are where the tokens begin
            links.append((a[i], b[j]))
            end_a, end_b = x + len(at[i]), y + len(bt[j])
            if end_a <= end_b:
                now[0].append(a[i])
                i, x = i + 1, end_a
            if end_b <= end_a:
                now[1].append(b[j])
                j, y = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(map(str, now[0])) + "|" + ",".join(map(str, now[1])))
                now = ([], [])
        counts.update(links)
        out.append((a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), g.count(";") + bool(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), g) for a, b, links, g in out], counts, best


@pytest.mark.parametrize("parts", [token_alignment.PART_BYTES, 200])
def test_alignment(docs, rows, monkeypatch, parts):
    monkeypatch.setattr(token_alignment, "PART_BYTES", parts)  # small: stripes of several parts
    monkeypatch.setattr(token_alignment, "CHUNK_DOCS", 7)
    want, counts, best = plain_alignment([r[1] for r in rows])
    got = token_alignment.align(docs, tokenizer_path(A), tokenizer_path(B), stripes=60).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert sum(w[0] == 0 for w in want) >= 3  # null, empty, and a text with the blank's own sign


def test_best_pairs(docs, rows):
    _, counts, best = plain_alignment([r[1] for r in rows])
    got = {(r["b_id"], r["a_id"], r["n"]) for r in token_alignment.best_pairs(docs, tokenizer_path(A), tokenizer_path(B), stripes=100).collect()}
    assert got == {(b, a, n) for (a, b), n in counts.items() if n == best[b]}


def test_blobs():
    x, y = np.array([3, 1], "u4"), np.array([2**40, 5], "u8")
    assert [c.tolist() for c in token_alignment.unpacked(token_alignment.packed(x, y), "u4", "u8")] == [[3, 1], [2**40, 5]]
    assert [len(c) for c in token_alignment.unpacked(token_alignment.packed(x[:0], y[:0]), "u4", "u8")] == [0, 0]


# 13


def check_law(rows, shards):
    """rows: (shard, slot); slots have no gaps, counts differ by at most one."""
    by = collections.defaultdict(list)
    for shard, slot in rows:
        by[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("shards,size", [(16, 32 << 20), (3, 2000), (1, 500), (300, 1 << 20)])
def test_shards(docs, rows, tmp_path, shards, size):
    folder = sharding.write_shards(docs, f"file://{tmp_path}/a", shards, bucket_bytes=size)
    got = sharding.read_shards(docs.sparkSession, folder, docs)
    assert got.columns == ["doc_id", "text", "source", "n", "form", "_text", "output", "stripe", "slot", "shard"]
    got = got.collect()
    check_law([(r["shard"], r["slot"]) for r in got], shards)
    assert collections.Counter((r["doc_id"], r["text"], r["source"], r["n"]) for r in got) == collections.Counter(r[:4] for r in rows)
    again = sharding.read_shards(docs.sparkSession, sharding.write_shards(docs, f"file://{tmp_path}/b", shards, bucket_bytes=size), docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    files = [f for f in os.listdir(tmp_path / "a") if f.startswith("shard=")]
    assert len(files) == min(shards, len(rows))


def test_order_is_that_of_a_plain_shuffle(spark, docs, tmp_path):
    """The scatter keys, one bucket after the other, and a plain Fisher-Yates."""
    rows = sharding.scattered(docs.where("doc_id <> 7"), 42).withColumn("bucket", F.pmod(F.xxhash64("_sh_h", "_sh_n", "_sh_p", F.lit(42)), F.lit(16))).collect()
    order = []
    for k in range(16):
        held = sorted((r for r in rows if r["bucket"] == k), key=lambda r: (r["_sh_h"], r["_sh_n"], r["_sh_p"]))
        with_ = np.random.default_rng([42, k]).integers(0, np.arange(1, len(held) + 1)).tolist() if held else []
        for i in range(len(held) - 1, 0, -1):
            held[i], held[with_[i]] = held[with_[i]], held[i]
        order += [r["doc_id"] for r in held]
    folder = sharding.write_shards(docs.where("doc_id <> 7"), f"file://{tmp_path}/x")
    got = sharding.read_shards(spark, folder, docs).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == order


def test_fisher_yates_is_even():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(k))) for k in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400 and sharding.fisher_yates(0, np.random.default_rng(1)) == [] and sharding.fisher_yates(1, np.random.default_rng(1)) == [0]


def test_copies_of_a_row_spread(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(3)
    rows = sharding.scattered(docs, 42).withColumn("b", F.pmod(F.xxhash64("_sh_h", "_sh_n", "_sh_p", F.lit(42)), F.lit(16)))
    sizes = [r["count"] for r in rows.where("doc_id = 1").groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_empty_tables(empty, tmp_path):
    assert fill_middle.fill_in_middle(empty).collect() == []
    assert token_alignment.align(empty, tokenizer_path(A), tokenizer_path(B)).collect() == []
    assert sharding.read_shards(empty.sparkSession, sharding.write_shards(empty, f"file://{tmp_path}/none"), empty).collect() == []


# 5, 9 and 10 beside plain versions


def plain_clauses(text, words, stems):
    """Weights of clauses by counters for what came before a word, without transducers."""
    from sparsemill.llm import toxicity as t

    kinds, out = {w: c for c, ws in (("T", t.TARGETS), ("N", t.NEGATIONS), ("R", t.REPORTS), ("H", t.THREATS)) for w in ws}, []
    for clause in re.split(r"[.!?;\n]+", (text or "").lower()):
        negated = aimed = hit = 0
        quoted, strength, total = False, 1.0, 0.0
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause):
            stem = max([stems.get(w[:k], 0.0) for k in t.STEMS])
            x, s = ("I", words[w]) if w in words else ("I", stem) if stem > 0 else (kinds.get(w, "o"), 1.0)
            strength = s if x in "IH" else strength
            if x == "N":
                negated = 3
            elif negated:
                x, negated = {"I": "i", "H": "h"}.get(x, x), negated - 1
            if x == "R":
                quoted = True
            elif quoted:
                x = {"I": "q", "i": "q", "H": "p", "h": "p"}.get(x, x)
            if x == "T":
                x, aimed, hit = "B" if hit else "T", 3, 0
            elif x in ("I", "H"):
                x, aimed, hit = ({"I": "A", "H": "K"}[x] if aimed else x), max(0, aimed - 1), 2
            else:
                aimed, hit = max(0, aimed - 1), max(0, hit - 1)
            total += {"I": 1.0, "A": 1.3, "B": 0.3, "i": 0.25, "q": 0.4, "H": 0.3, "K": 1.1, "h": 0.05, "p": 0.15}.get(x, 0.0) * strength
        if total:
            out.append(total)
    return out


def test_clauses_as_by_counters():
    from sparsemill.llm import toxicity as t

    lexicon = {"idiot": 1.0, "scum": 0.7, "lowei*": 0.5, "brut*": 0.9}
    scorer, rng = t.Scorer(lexicon), random.Random(7)
    words, stems = {"idiot": 1.0, "scum": 0.7}, {"lowei": 0.5, "brut": 0.9}
    pool = [*t.TARGETS[:4], *t.THREATS[:4], *t.NEGATIONS[:4], *t.REPORTS[:4], "idiot", "scum", "loweia", "brutal", "house", "and", "tree", "idiotic", "Idiot", "x1", "isn't"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) + rng.choice(["", "", "", ",", ".", "!", "\n", " ;"]) for _ in range(rng.randint(0, 40)))
        assert np.allclose(scorer.clauses(text), plain_clauses(text, words, stems)), text


def test_em_as_document_by_document():
    """Label model from counted patterns, beside one that goes over every document's votes."""
    from sparsemill.llm import weak_quality as wq

    rng = np.random.default_rng(2)
    names, n = list(wq.LABELLERS), 400
    bad = rng.random(n) < 0.2
    votes = np.array([np.where(rng.random(n) < np.where(bad, 0.4, 0.05), rng.integers(0, 2, n), 2) for _ in names])
    patterns = (votes * 3 ** np.arange(len(names))[:, None]).sum(0)
    known, counts = np.unique(patterns, return_counts=True)
    got = wq.estimate(known, counts)
    start = [np.array(wq.PROSE if m == "prose" else wq.DEFECT) for m in names]
    prior, table = 0.15, [t.copy() for t in start]
    for _ in range(wq.EM_ROUNDS):
        post = []
        for j in range(n):
            p = [1 - prior, prior]
            for i in range(len(names)):
                p = [p[y] * table[i][y][votes[i, j]] for y in (0, 1)]
            post.append(p[1] / (p[0] + p[1]))
        prior = min(0.5, max(0.005, (sum(post) + 1.5) / (n + 10)))
        for i, m in enumerate(names):
            for y in (0, 1):
                weight = [q if y else 1 - q for q in post]
                own = [sum(w for w, v in zip(weight, votes[i]) if v == k) + (5 + wq.BELIEF[m == "prose"][y] * sum(weight)) * start[i][y][k] for k in range(3)]
                table[i][y] = np.array(own) / sum(own)
    assert abs(got.prior - prior) < 1e-9 and all(np.allclose(a, b, atol=1e-9) for a, b in zip(got.table, table))


def test_packing_query_beats_best_fit(spark):
    """With the crossovers that the query itself spends, on a whole table."""
    from sparsemill.llm import packing

    pieces = queries.queries()["op9_best_fit_packing"](spark, "/root/testdata/sf0.01").select("length", "sequence_id").collect()
    lengths = np.array([r["length"] for r in pieces])
    n = packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), [0] * len(lengths), [], 1024)
    assert -(-int(lengths.sum()) // 1024) <= len({r["sequence_id"] for r in pieces}) < n


@pytest.mark.parametrize("name", ["mixing_targets", "text_statistics", "fingerprint_texts", "op11_fill_in_middle"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    path = f"{sf}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in queries.queries()[name](spark, sf).select(*names).collect())


@pytest.mark.parametrize("rows,bounds", [(10, 4), (7, 1000), (50, 1), (10_000, 4)])
def test_ranges_ascend_and_are_short(spark, rows, bounds):
    """Even and uneven keys, repeated ones, nulls and negative ones; more ranges than bounds in the plan."""
    made = [(i,) for i in range(-300, 300)] + [(10**15 + 1000 * i,) for i in range(100)] + [(5,)] * 40 + [(None,)] * 9
    df = spark.createDataFrame(made, "doc_id long").repartition(3)
    got = df.withColumn("r", fingerprints.range_number(df, "doc_id", rows, bounds)).collect()
    got = sorted(got, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0))
    assert all(a["r"] <= b["r"] for a, b in zip(got, got[1:])) and all(x["r"] == got[0]["r"] for x in got if x["doc_id"] is None)
    sizes = collections.Counter(x["r"] for x in got)
    assert len(sizes) == 1 if rows > 1000 else len(sizes) > (5 if bounds > 1 else 1)
    if bounds == 1000:
        assert max(sizes.values()) < 60


def test_every_range_has_its_guests(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 40)
    monkeypatch.setattr(fingerprints, "BOUNDS", 9)
    df = spark.range(0, 5000, 3).select((F.col("id") * F.col("id")).alias("doc_id")).unionByName(spark.createDataFrame([(None,), (9,)], "doc_id long"))
    rows = fingerprints.with_guests(df.repartition(4)).collect()
    assert sum(not r["_guest"] for r in rows) == df.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["_range"]].append((r["_guest"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(by) > 9
    order = [sorted(by[k]) for k in sorted(k for k, v in by.items() if any(not x[0] for x in v))]
    for a, b in zip(order, [*order[1:], order[0]]):
        first = [x[1:] for x in b if not x[0]][0]
        assert {x[1:] for x in a if x[0]} == {first}


def test_queries(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    named = queries.queries()
    fim = {r["doc_id"]: r for r in named["op11_fill_in_middle"](spark, sf).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        n, form, p, m, output = plain_fim(r["doc_id"], r["text"])
        assert tuple(fim[r["doc_id"]])[1:] == (n, form, p, m, sha(output), sha(r["text"] or ""))
    want, _, _ = plain_alignment([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r)[1:] for r in named["op12_token_alignment"](spark, sf).collect()}
    assert got == {r["doc_id"]: (*w[:6], w[6] and sha(w[6])) for r, w in zip(docs, want)}
    shards = named["op13_sharding"](spark, sf).collect()
    check_law([(r["shard"], r["slot"]) for r in shards], 16)
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in shards} == {(k, len(v) + 1, zlib.crc32(v), "rows", None) for k, v in data.items()}


def far_group(rng, n):
    """Near copies of one text of which many are too far from any one of them, chains of others and a shared passage."""
    base = [f"v{rng.randint(0, 9999)}" for _ in range(150)]
    made = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(0, 150, 5), rng.choice([1, 2, 3, 4, 5])):
            text[at] = f"new{i}-{at}"
        made.append((i, " ".join(text)))
    return made


def test_pairs_of_a_large_group_grow_with_its_rows(spark):
    from sparsemill.llm import jaccard_join

    for n in (60, 240):  # one posting, each row with a star of its own: all pairs may link
        rows = [(7, 100 + i, 50, 0, 100 + i, 0.0, 1000 + i, 0.5) for i in range(n)]
        frame = spark.createDataFrame(rows, "s long, g long, n int, pos int, comp long, shared double, pivot long, far double")
        met = jaccard_join.group_pairs(frame, False).collect()
        assert len(met) <= jaccard_join.DENSE * n and {r["b"] for r in met if r["dense"]} == {r[1] for r in rows} and len({r["a"] for r in met}) == 1


@pytest.mark.parametrize("dense", [0, 4, 10**6])
def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch, dense):
    from sparsemill.llm import jaccard_join
    from test_operators import plain_components, shingle_set

    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", 40)
    seen = []
    whole = jaccard_join.links_near_stars
    monkeypatch.setattr(jaccard_join, "links_near_stars", lambda members, sets: seen.append(members.count()) or whole(members, sets))
    rng = random.Random(4)
    made = far_group(rng, 130)
    made += [(1000 + i, t + " and one more") for i, t in made[:20]] + [(2000, made[3][1])]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = jaccard_join.link_components(frame, count_links=True).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(made))
    sets = {i: shingle_set(t) for i, t in made}
    links = lambda i: sum(j != i and 100 * len(x & sets[i]) >= 80 * len(x | sets[i]) for j, x in sets.items())
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links(i) for i in sets}
    assert len(seen) == 2 and (seen[1] > 0 or dense > 4) and (seen[1] == 0 or dense <= 4)


def test_plain_texts_and_kept_units_of_packing():
    from tokenizers import Tokenizer

    from sparsemill.llm import encoding, packing

    odd = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad]|[^\x00-\xff]")
    for x in [*map(chr, range(0x180)), "", "plain text", "é\n\r\tè", "a\U0001f600"]:
        assert encoding.is_plain(x) == (not odd.search(x)) and encoding.is_plain(f"a {x} b") == (not odd.search(x))
    e = encoding.Encoder.of(tokenizer_path(A), "gaps", 2, packing.KEPT_UNITS)
    whole = Tokenizer.from_file(tokenizer_path(A))
    for x in [*map(chr, range(0x100)), "  two\n\n  blanks\t é ", "a\rb", " 'll 12 ½ x!? "]:
        for text in (x, f"a{x}b", f"a {x}  b", f"{x}\n {x}"):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
    for i in range(300_000):  # more than a generation had before; those seen first are still there
        e.units.keep(f" unit{i}", b"")
    assert " unit0" in e.units
