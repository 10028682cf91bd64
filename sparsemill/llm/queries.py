"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_html_extraction": "html_extract",
    "op2_license_scan": "license_scan",
    "op3_source_mixing": "source_mixing",
    "op4_ngram_jaccard_join": "jaccard_join",
    "op5_toxicity": "toxicity",
    "op6_quality_rules": "quality_rules",
    "op7_token_files": "token_files",
    "op8_document_fingerprints": "fingerprints",
    "op9_best_fit_packing": "packing",
    "op10_quality_classifier": "weak_quality",
    "op11_fill_in_middle": "fill_middle",
    "op12_token_alignment": "token_alignment",
    "op13_sharding": "sharding",
}


def _lazy(name: str, module: str):
    def query(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _lazy(name, module) for name, module in _WHERE.items()} | {"pipeline": pipeline, "mixing_targets": mixing_targets, "text_statistics": text_statistics, "fingerprint_texts": fingerprint_texts}


# The columns of three operators that SQL can express.


def mixing_targets(spark, sf_dir):
    """op3 without what it draws."""
    from pyspark.sql import functions as F

    return queries()["op3_source_mixing"](spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def text_statistics(spark, sf_dir):
    """op6 without what it learns."""
    from .common import table
    from .quality_rules import base_failed, text_statistics

    out = text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def fingerprint_texts(spark, sf_dir):
    """op8 without its sketches."""
    return queries()["op8_document_fingerprints"](spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {
        # All pairs that share a shingle, and what each document reaches by those that link.
        "op4_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
    SELECT r.v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, coalesce(any_value(k), 0) AS n_links FROM r LEFT JOIN n ON n.doc_id = r.v LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY 1) k ON k.a = r.v GROUP BY r.v""",
        "mixing_targets": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY 1),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 1.5::DOUBLE * sum(n) OVER () AS share FROM s),
    c AS (SELECT *, 2.0::DOUBLE * n / w AS stop, coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
    l AS (SELECT arg_min((share - before) / rest, stop) FILTER (WHERE (share - before) / rest <= stop) AS level FROM c),
    t AS (SELECT source, n, least(w * level, 2.0::DOUBLE * n) AS target FROM c, l)
    SELECT doc_id, size, n AS source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
        "text_statistics": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    v AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {'i': i, 's': array_to_string(w[i : i + 4], ' ')})) AS x FROM d),
    r AS (SELECT doc_id, x.i AS i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, x.s) > 1),
    k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(5) o(o) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN k USING (doc_id)""",
        "fingerprint_texts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS x, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS f FROM documents)
    SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(coalesce(x, f), length(t) // 2)) AS edited_sha256 FROM d""",
        "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS d, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    }
