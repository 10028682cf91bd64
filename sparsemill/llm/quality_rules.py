"""Quality rules: a decision list learned by sequential covering, with DataFrame functions only.

Each rule is a conjunction of thresholds on a document's statistics that rejects it. Rules are grown on one part of the
labelled rows by information gain, pruned on another, and kept while they are precise; the rows that a rule covers are
then set aside. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_unit, stage_table, table, text_or_empty, window_hashes, without_spaces, word_hashes, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Rules are learned from at most about so many labelled rows, drawn by a hash of doc_id.
TRAIN_ROWS = 200_000
BINS, MOST_RULES, MOST_LITERALS, LEAST_PRECISION, LEAST_COVER = 16, 6, 3, 0.9, 4
FEATURES = ("symbols_per_word", "mean_word", "dup_lines", "repeats", "upper", "marks_per_word", "digits")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks and n_digits.

    Null text counts as empty: all numbers are 0. Repeats are words in five-word windows whose hash occurs twice or
    more in the text; only texts that have such windows get theirs sorted.
    """

    def without(letters: str) -> Column:
        return (F.length("_text") - F.length(F.translate("_text", letters, ""))).cast("long")

    d = docs.withColumn("_text", text_or_empty(F.col(text)))
    d = d.withColumn("_words", word_hashes(words(F.col("_text")))).withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_windows", window_hashes(F.col("_words")))
    sorted_ = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_)).drop("_words", "_windows")
    s = F.col("_sorted")
    again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))
    d = d.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + 5 - F.greatest(x, a["end"])).alias("n"), (x + 5).alias("end")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_lines", F.size("_lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    d = d.withColumn("word_chars", F.length(without_spaces(F.col("_text"))).cast("long"))
    d = d.withColumn("n_symbols", without(SYMBOLS)).withColumn("n_upper", without(string.ascii_uppercase))
    d = d.withColumn("n_marks", without("!?")).withColumn("n_digits", without(string.digits))
    return d.drop("_text", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Statistics on which rules may set thresholds; without words or letters they are 0."""

    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbols_per_word": over("n_symbols", "n_words"),
        "mean_word": over("word_chars", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "upper": over("n_upper", "word_chars"),
        "marks_per_word": over("n_marks", "n_words"),
        "digits": over("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """False by the first rule that holds, else true."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(covers(rule), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "".join(f"reject if {' and '.join(map(str, r))}\n" for r in self.rules) + "keep\n"


def covers(rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.holds()
    return out


def thresholds(rows: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Cut points between quantiles of each feature, of all rows and of the bad ones. A bounded list a feature."""
    at = [i / bins for i in range(1, bins)]
    cuts = [F.percentile_approx(c, at, 10_000).alias(f"{n}_{k}") for n in FEATURES for k, c in (("all", F.col(n)), ("bad", F.when(F.col("bad") == 1, F.col(n))))]
    got = rows.agg(*cuts).first()
    out = {}
    for n in FEATURES:
        all_, bad = got[f"{n}_all"] or [], got[f"{n}_bad"] or []
        between = [(a + b) / 2 for a in all_[-1:] for b in bad]  # between the bulk and the bad rows
        out[n] = sorted({*all_, *bad, *between})
    return out


def best_literal(rows: DataFrame, cuts: dict[str, list[float]]) -> Literal | None:
    """The threshold with the largest information gain over rows(bad, features). One aggregation with a row for each
    feature and bin, whose running sums give every threshold's cover."""
    def bin_of(n: str) -> Column:  # cut points below the value
        return F.size(F.filter(F.array(*map(F.lit, cuts[n])), lambda c: c < F.col(n))) if cuts[n] else F.lit(0)

    long = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), bin_of(n).alias("b")) for n in FEATURES])).alias("x"))
    cells = long.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    by, upto = Window.partitionBy("f"), Window.partitionBy("f").orderBy("b")
    cells = cells.select("f", "b", *[F.sum(c).over(w).alias(f"{c}_{k}") for c in ("p", "n") for k, w in (("all", by), ("le", upto))])
    sides = cells.select("f", "b", "p_all", "n_all", F.explode(F.array(F.struct(F.lit(False).alias("above"), F.col("p_le").alias("p"), F.col("n_le").alias("n")), F.struct(F.lit(True).alias("above"), (F.col("p_all") - F.col("p_le")).alias("p"), (F.col("n_all") - F.col("n_le")).alias("n")))).alias("s"))
    p, n = F.col("s.p"), F.col("s.n")
    gain = p * (F.log2((p + 0.5) / (p + n + 1)) - F.log2((F.col("p_all") + 0.5) / (F.col("p_all") + F.col("n_all") + 1)))
    best = sides.where(p + n >= LEAST_COVER).select("f", "b", "s.above", gain.alias("gain")).orderBy(F.desc("gain"), "f", "b", "above").limit(1).first()
    if best is None or best["gain"] <= 0 or best["b"] >= len(cuts[best["f"]]):
        return None
    return Literal(best["f"], best["above"], cuts[best["f"]][best["b"]])


def learn_rules(rows: DataFrame) -> DecisionList:
    """rows(doc_id, bad 0/1, features). Without rows of both kinds the list has no rule and keeps all."""
    rows = rows.withColumn("grow", hash_unit("doc_id", seed=5) < 2 / 3)
    cuts, learned, left = thresholds(rows), DecisionList(), rows
    while len(learned.rules) < MOST_RULES:
        rule: tuple[Literal, ...] = ()
        while len(rule) < MOST_LITERALS:
            found = best_literal(left.where("grow").where(covers(rule)), cuts)
            if found is None or found in rule:
                break
            rule += (found,)
        if not rule:
            break
        # prune: the shortest beginning with the best (bad - good) / (bad + good) on the other rows
        sums = [F.sum(F.when(covers(rule[:k]) & side, v)).alias(f"{name}{k}") for k in range(1, len(rule) + 1) for name, v, side in (("p", F.col("bad"), ~F.col("grow")), ("n", 1 - F.col("bad"), ~F.col("grow")), ("P", F.col("bad"), F.lit(True)), ("N", 1 - F.col("bad"), F.lit(True)))]
        got = left.agg(*sums).first()
        worth = [((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        k = 1 + worth.index(max(worth))
        bad, good = got[f"P{k}"] or 0, got[f"N{k}"] or 0
        if bad + good < LEAST_COVER or (bad + 1) / (bad + good + 2) < LEAST_PRECISION:
            break
        learned.rules.append(rule[:k])
        left = left.where(~covers(rule[:k]))
    return learned


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_table(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of every document, and the list. labels(doc_id, quality): 0 is bad; rows whose
    crc32(doc_id) is divisible by 5 are left for tests. Documents that fail the base rules are not learned from."""
    stats = text_statistics(docs.select("doc_id", "text")).drop("text").withColumn("base_failed", base_failed())
    stats = stage_table(stats.select("*", *[c.alias(n) for n, c in features().items()]), "quality")
    known = labels.select("doc_id", (1 - F.col("quality")).cast("long").alias("bad")).where("bad in (0, 1)").where(~held_out())
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    known = known.where(hash_unit("doc_id", seed=3) < share)
    rows = stats.where(~F.col("base_failed")).join(known, "doc_id").select("doc_id", "bad", *FEATURES)
    learned = learn_rules(stage_table(rows, "quality-labelled"))
    return stats.withColumn("kept", ~F.col("base_failed") & learned.verdict()), learned


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out, _ = quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
