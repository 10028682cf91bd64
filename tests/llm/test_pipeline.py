"""Each stage works on all that the one before kept; its decisions take effect; run() gives packed sequences."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from sparsemill.llm import jaccard_join, queries, source_mixing
from sparsemill.llm.common import stage_table, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r for r in table(spark, sf, "labels").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage_table(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        kept[name] = docs
        ids = [r["doc_id"] for r in docs.collect()]
        if name in ("toxicity", "quality"):
            clean = {i for i, r in labels.items() if not r["toxic"] and r["quality"]}
            assert len(clean & set(ids)) >= 0.97 * len(clean)
        if name == "near_copies":
            comps = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(before).collect()}
            assert sorted(ids) == sorted(set(comps.values()))
        if name == "mixing":
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in source_mixing.mix_table(before).where("size > 0").collect()}
            assert collections.Counter(ids) == {k: v for k, v in taken.items() if v}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    first = collections.Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert first == collections.Counter(r["doc_id"] for r in docs.collect())
    full = collections.Counter()
    for r in out:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 1024


def test_run_on_odd_rows(spark, tmp_path):
    """run() on nulls, repeats, a very long text, clashing names; and on empty tables."""
    words = "the of and river stone garden winter letter between morning quiet window because small light against paper never house along summer after bread other voice water under every road people town slowly friend evening".split()
    rng = random.Random(8)
    long = " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(40_000))
    plain = "The old mill stands by the river and its wheel turns slowly through the long afternoon of early summer."
    rows = [(1, plain, "a", 1), (1, plain, "a", 1), (2, None, None, 2), (3, "", "a", 3), (None, "no number here", "b", 4), (5, long, "b", 5), (6, plain + " Indeed.", "b", 6), (7, "some other words that nobody else has said so far", None, 7)]
    kinds = "doc_id long, text string, source string, `_n` int, rate double, lang string, `key` string"
    for name, made in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame([(*r, 0.5, "xx", "k") for r in made], kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)] if made else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        full = collections.Counter()
        for r in got:
            full[r["sequence_id"]] += r["length"]
        assert max(full.values(), default=0) <= 1024 and bool(got) == bool(made)
        if made:
            assert {r["doc_id"] for r in got} <= {r[0] for r in made} and any(r["piece"] > 10 for r in got if r["doc_id"] == 5)


def test_all_queries_are_listed(spark):
    found = queries.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in found)] == [] and "pipeline" in found


def test_near_copies_stage_lists_few_pairs_of_a_large_group(spark, sf, monkeypatch):
    from test_operators import plain_components
    from test_round3 import far_group

    made, seen, whole = far_group(random.Random(9), 360), [], jaccard_join.group_pairs

    def pairs(postings, stars):
        found = whole(postings, stars)
        if not stars:
            seen.append((found.count(), postings.count()))
        return found

    monkeypatch.setattr(jaccard_join, "group_pairs", pairs)
    frame = spark.createDataFrame(made, "doc_id long, text string")
    kept = corpus_pipeline.near_copies_stage(spark, frame, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in plain_components(made)})
    assert len(seen) == 2 and seen[0][0] > 0 and all(n <= jaccard_join.DENSE * k for n, k in seen)
