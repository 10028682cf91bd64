"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four transducers rewrite a clause's words, given as classes (insult, threat, target, negation, report, other): negation
marks insults it precedes, reported speech marks those it quotes, target marks those aimed at somebody, and the last
one weighs what is left. Their composition is one transducer that is run over every clause with a listed word. Lists of
insults are learned from labelled documents, as words and as stems; a document's score comes from its clauses' weights.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_once, give_back, hash_unit, in_small_batches, stage_table, table, text_or_empty, window_hashes, word_hashes, words

# Word lists that the grammar starts from.
INSULTS = "idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb imbecile dummkopf idiotin abschaum crétin imbécile connard abruti estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy strangle stab töten umbringen vernichten tuer détruire matar destruir".split()
TARGETS = "you your yours u he she they him her them du dich dir ihr euch sie tu te toi vous il elle ils tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie niemals pas jamais nunca jamás tampoco".split()
REPORTS = "said says say called calls quoted wrote writes claimed reported sagte sagt nannte schrieb zitierte dit disait appelle écrit dijo dice llamó escribió".split()

#: At most so many labelled documents of either kind are learned from, drawn by a hash of doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 8000
MOST_ENTRIES, STEMS = 2000, (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
BREAK = re.compile(r"[.!?;\n]+")


class Transducer:
    """Arcs by state and label: (next state, output label, weight). A label without an arc stays as it is; the label None
    stands for any other one, and the output None for the label that was read."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, label):
        after, out, weight = self.arcs.get((state, label)) or self.arcs.get((state, None)) or (state, label, 0.0)
        return after, label if out is None else out, weight

    def then(self, other: Transducer, labels: str) -> Transducer:
        """The composition: other reads what this one writes; weights add up."""
        start = (self.start, other.start)
        arcs, open_ = {}, [start]
        seen = {start}
        while open_:
            a, b = open_.pop()
            for x in labels:
                na, y, wa = self.step(a, x)
                nb, z, wb = other.step(b, y)
                arcs[((a, b), x)] = ((na, nb), z, wa + wb)
                if (na, nb) not in seen:
                    seen.add((na, nb))
                    open_.append((na, nb))
        return Transducer(arcs, start)


def negation(reach: int = 3) -> Transducer:
    """I and H within so many words after N become i and h."""
    arcs: dict = {(0, "N"): (reach, "N", 0.0)}
    for k in range(1, reach + 1):
        arcs |= {(k, None): (k - 1, None, 0.0), (k, "N"): (reach, "N", 0.0), (k, "I"): (k - 1, "i", 0.0), (k, "H"): (k - 1, "h", 0.0)}
    return Transducer(arcs)


def reported() -> Transducer:
    """After R, insults become q and threats p up to the clause's end."""
    return Transducer({(0, "R"): (1, "R", 0.0), **{(1, a): (1, b, 0.0) for a, b in ("Iq", "iq", "Hp", "hp")}})


def target(before: int = 3, after: int = 2) -> Transducer:
    """I and H with T shortly before become A and K; T shortly after one becomes B."""
    arcs: dict = {}
    for t in range(before + 1):
        for i in range(after + 1):
            at, on = (t, i), (max(0, t - 1), max(0, i - 1))
            arcs[(at, None)] = (on, None, 0.0)
            arcs[(at, "T")] = ((before, 0), "B" if i else "T", 0.0)
            arcs[(at, "I")] = ((on[0], after), "A" if t else "I", 0.0)
            arcs[(at, "H")] = ((on[0], after), "K" if t else "H", 0.0)
    return Transducer(arcs, (0, 0))


WEIGHTS = {"I": 1.0, "A": 1.3, "B": 0.3, "i": 0.25, "q": 0.4, "H": 0.3, "K": 1.1, "h": 0.05, "p": 0.15}
LABELS = "IHTNRo"


def grammar() -> Transducer:
    read = negation().then(reported(), LABELS)
    aimed = Transducer(read.arcs, read.start).then(target(), LABELS)
    return aimed.then(Transducer({(0, x): (0, x, w) for x, w in WEIGHTS.items()}), LABELS)


class Scorer:
    """Clause weights of a text. lexicon: entry to strength; an entry that ends in * is a stem."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.words = {w: ("I", s) for w, s in lexicon.items() if w[-1] != "*"}
        self.stems = {w[:-1]: s for w, s in lexicon.items() if w[-1] == "*"}
        self.classes = {w: (c, 1.0) for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in ws}
        self.run, self.find = grammar(), ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self.find.add_word(w, len(w))
        if len(self.find):
            self.find.make_automaton()

    def label(self, word: str) -> tuple[str, float]:
        if found := self.words.get(word):
            return found
        if (s := max((self.stems.get(word[:k], 0.0) for k in STEMS), default=0.0)) > 0:
            return "I", s
        return self.classes.get(word, ("o", 1.0))

    def clause(self, text: str) -> float:
        state, total, strength = self.run.start, 0.0, 1.0
        for word in LETTERS.findall(text):
            label, s = self.label(word)
            if label in "IH":
                strength = s
            state, _, w = self.run.step(state, label)
            total += w * strength
        return total

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the clauses that hold a listed word, wherever in the text they are."""
        if not text or not len(self.find):
            return []
        low, out, done = text.lower(), [], 0
        for end, n in self.find.iter(low):
            begin = end + 1 - n
            if begin < done or begin and low[begin - 1].isalpha():
                continue
            start = done
            for m in BREAK.finditer(low, done, begin):
                start = m.end()
            close = BREAK.search(low, end)
            done = close.end() if close else len(low)
            if weight := self.clause(low[start : close.start() if close else done]):
                out.append(weight)
        return out


def document_features(weights: list[float]) -> tuple[float, float]:
    return max(weights, default=0.0), math.log1p(sum(weights))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, weight): labelled, not held out, a bounded number of either kind; of texts that share their
    least shingle hash one is kept, so that copies don't count as so many authors. weight makes up for the draw."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out()).dropDuplicates(["doc_id"])
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / max(1, n.get(y, 0))) for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))}
    by = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    known = known.where(hash_unit("doc_id", seed=11) < by).withColumn("weight", 1 / by)
    # known is drawn to a bounded number of rows, so that texts need not move to it
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("_w", word_hashes(words(F.lower("text")))).withColumn("_least", F.array_min(window_hashes(F.col("_w"))))
    rows = rows.withColumn("_least", F.coalesce(F.col("_least"), F.xxhash64("text"))).drop("_w")
    return rows.groupBy("_least").agg(F.min_by(F.struct("doc_id", "text", "toxic", "weight"), F.struct("doc_id", "text")).alias("r")).select("r.*")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems that tell toxic documents from others by more than the number of candidates explains. Strength
    grows with the log-odds. Listed insults are in it unless the labels speak against them."""
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    strength = {w: 1.0 for w in INSULTS}
    if not kinds.get(1) or not kinds.get(0):
        return strength
    base = kinds[1] / (kinds[0] + kinds[1])
    ws = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))
    ws = F.filter(ws, lambda w: F.length(w) >= 3)
    stems = [F.transform(F.filter(ws, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    entry = F.explode(F.array_distinct(F.flatten(F.array(ws, *stems))))
    found = rows.select("toxic", entry.alias("entry")).groupBy("entry").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("n >= 3")
    found = stage_table(found, "toxic-words")
    candidates = max(1, found.count())
    share = (F.col("a") + 0.5) / (F.col("n") + 1)
    likelihood = F.col("a") * F.log(share / base) + (F.col("n") - F.col("a")) * F.log((1 - share) / (1 - base))
    good = found.where((share > 0.8) & (likelihood > math.log(candidates) + 2))
    for r in good.select("entry", "a", "n", likelihood.alias("l")).orderBy(F.desc("l"), "entry").limit(MOST_ENTRIES).collect():
        odds = math.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5) * (1 - base) / base)
        strength[r["entry"]] = min(1.5, max(0.5, odds / 5))
    against = found.where(F.col("entry").isin(INSULTS) & (share < base) & (F.col("n") >= 20)).select("entry").collect()
    return {w: s for w, s in strength.items() if w not in {r["entry"] for r in against}}


def fit_logistic(x, y, w, penalty: float = 1.0, steps: int = 30):
    """Weights of a logistic regression with constant, by Newton's method, over a bounded number of rows."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[penalty * 1e-1] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return b


def clause_features(docs: DataFrame, lexicon: dict[str, float], carry: list[str]) -> DataFrame:
    """docs(text and carry) to carry and the document's features, in one pass over whole texts."""
    schema = docs.select(*carry).schema

    def score(batches):
        import pyarrow as pa

        scorer = Scorer(lexicon)
        for b in batches:
            f = [document_features(scorer.clauses(t)) for t in few_at_once(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], [*carry, "strongest", "total"])

    return docs.select(*carry, text_or_empty(F.col("text")).alias("text")).mapInArrow(score, schema.add("strongest", "double").add("total", "double"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon and weights. Without labels of both kinds, listed insults alone decide."""
    import numpy as np

    in_small_batches(docs.sparkSession)
    rows = stage_table(training_rows(docs, labels), "toxic-labelled")
    lexicon = learn_lexicon(rows)
    got = clause_features(rows, lexicon, ["toxic", "weight"]).toPandas()  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    if got["toxic"].nunique() < 2:
        return lexicon, [-3.0, 5.0, 1.0]
    x = got[["strongest", "total"]].to_numpy()
    return lexicon, [float(v) for v in fit_logistic(x, got["toxic"].to_numpy(), got["weight"].to_numpy() / got["weight"].mean())]


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts have no clause and get the score of such texts; rows without doc_id count as held out; repeated
    rows are scored each; an empty table gives no rows. Labels, lang, source and doc_id are not inputs of a score.
    """
    lexicon, (a, b, c) = fit(docs, labels)
    out = clause_features(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("strongest") + F.lit(c) * F.col("total")))))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs, whatever their names. Null and empty texts have
    no clause and stay; repeated rows and rows without doc_id are judged like others; an empty table stays empty."""
    lexicon, (a, b, c) = fit(docs, labels)
    scorer_input = docs.select("*")

    def keep(batches):
        import pyarrow as pa

        scorer = Scorer(lexicon)
        for batch in batches:
            f = [document_features(scorer.clauses(t)) for t in few_at_once(batch.column("text"))]
            yield batch.filter(pa.array([a + b * x + c * y < 0 for x, y in f], pa.bool_()))
        give_back()

    return scorer_input.mapInArrow(keep, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
