"""Quality classifier from weak labels: heuristic labellers that overlap, their accuracies by expectation-maximisation,
and a hashed linear scorer trained on the posterior labels.

No document's true label is used. The votes of all documents are counted by pattern; there are at most 3 to the number
of labellers of those, so the estimation works on a table of bounded size however many documents there are.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_once, give_back, hash_unit, in_small_batches, stage_table, table

GOOD, BAD, NONE = 0, 1, 2
#: The scorer is fitted on at most about so many documents, drawn by a hash of doc_id.
FIT_DOCS = 6000
BUCKETS = 1 << 12
EM_ROUNDS = 60


def _classes():
    """Class of each byte: space, line end, digit, lower, upper, beyond ASCII, and each mark for itself."""
    import numpy as np

    out = np.zeros(256, np.uint32)
    out[128:] = 1
    for low, high, c in (("a", "z", 2), ("A", "Z", 3), ("0", "9", 4)):
        out[ord(low) : ord(high) + 1] = c
    out[[9, 11, 12, 13, 32]] = 5
    out[10] = 6
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[ord(c)] = 7 + i
    return out


CLASSES = 64  # more than _classes() gives; three classes make a trigram's number


def byte_classes(text: str | None):
    import numpy as np

    return _LUT()[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


_lut: list = []


def _LUT():
    if not _lut:
        _lut.append(_classes())
    return _lut[0]


def repeats(text: str | None) -> tuple[float, float]:
    """Shares of words equal to the one before, and of lines with text equal to an earlier one."""
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
    return sum(map(operator.eq, words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))


def measures(classes, again=(0.0, 0.0)) -> dict[str, float]:
    """Shares that the labellers look at; all 0 for an empty text."""
    import numpy as np

    n = np.bincount(classes, minlength=CLASSES)
    letters, spaces, lines = n[1] + n[2] + n[3], n[5], n[6]
    words = max(1, int(spaces + lines))
    mark = {c: int(n[7 + i]) for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}
    symbols = sum(mark[c] for c in "#*$%&<>~^=+@\\{}[]")
    return {
        "bytes": float(len(classes)),
        "letters": letters / max(1, len(classes)),
        "symbols": symbols / words,
        "bars": mark["|"] / words,
        "upper": n[3] / max(1, letters),
        "shouts": (mark["!"] + mark["?"]) / words,
        "stops": (mark["."] + mark[","]) / words,
        "digits": n[4] / max(1, len(classes)),
        "lines": lines / words,
        "same": again[0],
        "twice": again[1],
        "word": (len(classes) - spaces - lines) / words,
    }


#: Each labeller votes on a document's measures: BAD where it finds its defect, else NONE; the last one votes GOOD.
LABELLERS = {
    "symbols": lambda m: BAD if m["symbols"] > 0.3 else NONE,
    "letters": lambda m: BAD if m["letters"] < 0.62 else NONE,
    "upper": lambda m: BAD if m["upper"] > 0.4 else NONE,
    "shouts": lambda m: BAD if m["shouts"] > 0.3 else NONE,
    "bars": lambda m: BAD if m["bars"] > 0.2 else NONE,
    "digits": lambda m: BAD if m["digits"] > 0.3 else NONE,
    "same": lambda m: BAD if m["same"] > 0.15 else NONE,
    "twice": lambda m: BAD if m["twice"] > 0.3 else NONE,
    "words": lambda m: BAD if m["word"] > 25 else NONE,
    "prose": lambda m: GOOD if 0.05 <= m["stops"] <= 0.5 and m["shouts"] + m["symbols"] + m["bars"] < 0.15 and m["same"] < 0.05 else NONE,
}


def votes(classes, again=(0.0, 0.0)) -> int:
    """All labellers' votes as one number in base 3."""
    m, out = measures(classes, again), 0
    if m["bytes"] < 1:
        return sum(NONE * 3**i for i in range(len(LABELLERS)))
    for i, f in enumerate(LABELLERS.values()):
        out += f(m) * 3**i
    return out


_AGAIN = [zlib.crc32(name) % BUCKETS for name in (b"same", b"twice")]


def features(classes, again=(0.0, 0.0)):
    """(bucket, value): hashed byte-class trigrams, square roots of shares so that their norm is 1, and hashed repeats."""
    import numpy as np

    if len(classes) < 3:
        return np.array([], np.int32), np.array([], np.float32)
    code = (classes[:-2] * np.uint32(CLASSES) + classes[1:-1]) * np.uint32(CLASSES) + classes[2:]
    n = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    value = np.sqrt(n / n.sum())
    value[_AGAIN] += np.sqrt(again)
    at = np.flatnonzero(value)
    return at.astype(np.int32), value[at].astype(np.float32)


@dataclass
class LabelModel:
    prior: float
    table: list  # for each labeller, P(vote | good), P(vote | bad)

    def posterior(self, patterns):
        """P(bad) of each pattern of votes."""
        import numpy as np

        p = np.asarray(patterns, np.int64)
        good, bad = np.full(len(p), np.log(1 - self.prior)), np.full(len(p), np.log(self.prior))
        for i, t in enumerate(self.table):
            v = p // 3**i % 3
            good, bad = good + np.log(t[0])[v], bad + np.log(t[1])[v]
        return 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))


#: P(vote | good) and P(vote | bad) to start from, in the order GOOD, BAD, NONE: a defect is rarely found where there is
#: none, each labeller knows only some of the defects, and most good documents read like prose.
DEFECT = ((1e-6, 0.005, 0.994999), (1e-6, 0.35, 0.649999))
PROSE = ((0.8, 1e-6, 0.199999), (0.1, 1e-6, 0.899999))
#: What is believed beforehand about defects counts as so many documents for each that is thought to be of the kind.
#: Without it, one kind of defect alone may become the bad class and the others pass for good.
BELIEF = ((3.0, 0.1), (0.1, 0.1))


def estimate(patterns, counts, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over counted vote patterns; without documents the start is returned."""
    import numpy as np

    p, c = np.asarray(patterns, np.int64), np.asarray(counts, float)
    starts = [np.array(PROSE if name == "prose" else DEFECT) for name in LABELLERS]
    model = LabelModel(0.15, [start.copy() for start in starts])
    for _ in range(rounds if len(p) else 0):
        bad = model.posterior(p)
        model.prior = float(np.clip((c @ bad + 1.5) / (c.sum() + 10), 0.005, 0.5))
        for i, (name, start) in enumerate(zip(LABELLERS, starts)):
            v, belief = p // 3**i % 3, BELIEF[name == "prose"]
            for y, w in ((0, c * (1 - bad)), (1, c * bad)):
                n = np.bincount(v, weights=w, minlength=3) + (5 + belief[y] * w.sum()) * start[y]
                model.table[i][y] = n / n.sum()
    return model


def fit_scorer(features: list, soft, weight, epochs: int = 60):
    """Logistic regression with hashed inputs on soft labels over a bounded sample: weights of BUCKETS and a constant."""
    import numpy as np

    rows = np.concatenate([np.full(len(a), i) for i, (a, _) in enumerate(features)]) if features else np.array([], int)
    cols = np.concatenate([a for a, _ in features]) if features else np.array([], int)
    vals = np.concatenate([v for _, v in features]) if features else np.array([])
    w, b, n = np.zeros(BUCKETS), 0.0, max(1, len(features))
    mom, momb = np.zeros(BUCKETS), 0.0
    weight = np.asarray(weight) / max(1e-9, np.mean(weight)) if len(features) else np.array([])
    for _ in range(epochs * 5):
        z = np.bincount(rows, weights=vals * w[cols], minlength=len(features)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / n
        gw, gb = np.bincount(cols, weights=vals * g[rows], minlength=BUCKETS) + 1e-5 * w, g.sum()
        mom, momb = 0.9 * mom + gw, 0.9 * momb + gb
        w, b = w - 6.0 * mom, b - 6.0 * momb
    return w, float(b)


def train(docs: DataFrame):
    """(weights, constant, label model) from docs(doc_id, text)."""
    import numpy as np

    in_small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, FIT_DOCS / max(1, docs.count()))
    marked = docs.withColumn("_fit", F.coalesce(hash_unit("doc_id", seed=23) < share, F.lit(False)))

    def vote(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for fit, text in zip(b.column("_fit").to_pylist(), few_at_once(b.column("text"))):
                classes, again = byte_classes(text), repeats(text)
                a, v = features(classes, again) if fit else (None, None)
                out.append((votes(classes, again), None if a is None else a.tobytes(), None if v is None else v.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["votes", "at", "value"])

    voted = stage_table(marked.mapInArrow(vote, "votes int, at binary, value binary"), "votes")
    counted = voted.groupBy("votes").count().toPandas()  # at most 3 ** labellers rows
    model = estimate(counted["votes"], counted["count"])
    sample = voted.where("at is not null").select("votes", "at", "value").toPandas()  # about FIT_DOCS rows
    soft = model.posterior(sample["votes"])
    inputs = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(sample["at"], sample["value"])]
    balance = np.where(soft > 0.5, 0.5 / max(1e-3, float(np.mean(soft > 0.5)) if len(soft) else 1), 1.0)
    w, b = fit_scorer(inputs, soft, np.minimum(balance, 5.0))
    return w.astype(np.float32), b, model


#: A text of so many bytes counts as half its own evidence and half that of all documents.
HALF_KNOWN = 20


def _scorer(w, b, prior: float):
    import math

    usual = math.log(prior / (1 - prior))

    def score(text) -> float:
        classes = byte_classes(text)
        at, v = features(classes, repeats(text))
        own = len(classes) / (len(classes) + HALF_KNOWN)
        z = own * (float(v @ w[at]) + b) + (1 - own) * usual if len(at) else usual
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    return score


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, bad (score in 0 to 1) and kept (bad < 0.5) of every row.

    Short texts are drawn towards the share of bad documents, and those of fewer than three bytes, empty and null ones
    have that share as their score and are kept. Repeated rows are scored each; an empty table gives no rows.
    """
    w, b, model = train(docs)
    prior = model.prior

    def run(batches):
        import pyarrow as pa

        score = _scorer(w, b, prior)
        for batch in batches:
            bad = [score(t) for t in few_at_once(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bad, pa.float64()), pa.array([x < 0.5 for x in bad], pa.bool_())], ["doc_id", "bad", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, bad double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, with the columns of docs, whatever their names. Null and empty texts, and those
    of fewer than three bytes, have the share of bad documents as their score and stay; repeated rows are judged each; an
    empty table stays empty."""
    w, b, model = train(docs)
    prior = model.prior

    def run(batches):
        import pyarrow as pa

        score = _scorer(w, b, prior)
        for batch in batches:
            yield batch.filter(pa.array([score(t) < 0.5 for t in few_at_once(batch.column("text"))], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
