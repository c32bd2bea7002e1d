"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as a string of word classes: insult, threat, target, negation, reported speech, other, and the marks between them. Three small
transducers carry what the words before say (reported speech so far, which a colon hands on; a negation within the last words; a target so far) and
are composed into one machine. Two more read from the clause's end (a target within the next words; a reporting verb behind the last comma, as in
"..., he said") and are composed into another. On insult and threat words both machines' states emit a match with these marks. A match weighs the
word's own weight times a factor for its marks, so "not an idiot", "he said: idiot" or "idiot, he said" weighs less than "you idiot". Insult words and
stems, the weights of threats and the factors are learnt from labelled rows; the function words are fixed lists in four languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_texts, release_tables, slices, written

# Fixed word lists: English, German, French, Spanish.
TARGET = "you your yours yourself he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils elles tú usted ustedes él ella ellos ellas".split()
NEGATION = "not no never isn aren wasn don doesn didn nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTED = "said says wrote claims claimed quoted called sagte sagt schrieb behauptet dit disait écrit dijo dice escribió".split()
THREAT = "kill murder hurt destroy strangle töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
INSULT_CLASS, THREAT_CLASS, TARGET_CLASS, NEGATION_CLASS, REPORTED_CLASS, OTHER_CLASS, COMMA_CLASS, COLON_CLASS, END_CLASS = range(9)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
MARKS = dict.fromkeys(".!?;\n", END_CLASS) | {",": COMMA_CLASS, ":": COLON_CLASS}
REACH = 3  # words over which a negation holds, and within which a target may follow
THREAT_WEIGHT = 3.0  # of threat words that the sample lacks
STEMS = (4, 5, 6)
N_MARKS = 16  # kind x reported x negated x targeted


def before_machine() -> tuple[list[list[int]], list[int]]:
    """(next state by state and class, mark of each state), read forwards: the product of the transducers for reported speech, negation and target."""
    states = list(product((0, 1), range(REACH + 1), (0, 1)))  # reported, words left under negation, target seen
    index = {s: k for k, s in enumerate(states)}

    def after(s: tuple, c: int) -> tuple:
        reported, negated, target = s
        if c == END_CLASS:
            return 0, 0, 0
        if c == COLON_CLASS:
            return reported, 0, 0
        if c == COMMA_CLASS:
            return reported, 0, target
        return 1 if c == REPORTED_CLASS else reported, REACH if c == NEGATION_CLASS else max(0, negated - 1), 1 if c == TARGET_CLASS else target

    return [[index[after(s, c)] for c in range(9)] for s in states], [4 * r + 2 * (n > 0) + t for r, n, t in states]


def behind_machine() -> tuple[list[list[int]], list[int]]:
    """The same, read backwards from a clause's end: the product of the transducers for a target that follows and for attribution behind the last comma."""
    nothing, verb, attributed, closed = range(4)
    states = list(product(range(REACH + 1), range(4)))  # words left within a target's reach, what has been seen of an attribution
    index = {s: k for k, s in enumerate(states)}

    def after(s: tuple, c: int) -> tuple:
        near, tail = s
        if c in (END_CLASS, COLON_CLASS):
            return 0, nothing
        if c == COMMA_CLASS:
            return 0, {nothing: closed, verb: attributed}.get(tail, tail)
        return REACH if c == TARGET_CLASS else max(0, near - 1), verb if c == REPORTED_CLASS and tail == nothing else tail

    return [[index[after(s, c)] for c in range(9)] for s in states], [4 * (t == attributed) + (n > 0) for n, t in states]


BEFORE, BEFORE_MARK = before_machine()
BEHIND, BEHIND_MARK = behind_machine()
#: Factors before training: by reported, negated, targeted.
PRIOR = np.array([(0.4 if m & 4 else 1.0) * (0.3 if m & 2 else 1.0) * (1.25 if m & 1 else 1.0) for m in range(N_MARKS)])


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREAT, THREAT_WEIGHT))
    bias: float = -2.0
    factors: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self.heads = {w[: STEMS[0]] for w in (*self.words, *self.stems)} | {w[: STEMS[0]] for w in THREAT}
        self.context = dict.fromkeys(TARGET, TARGET_CLASS) | dict.fromkeys(NEGATION, NEGATION_CLASS) | dict.fromkeys(REPORTED, REPORTED_CLASS) | MARKS

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) if len(word) >= k else 0.0 for k in STEMS))

    def features(self, text: str) -> np.ndarray | None:
        """Weight of the matches by their marks; None where no word can begin a match."""
        tokens = TOKEN.findall(text.lower())
        known: dict[str, float] = {}
        for w in set(tokens):
            if w[: STEMS[0]] in self.heads and (x := self.threats[w] if w in self.threats else self.weight(w)) > 0:
                known[w] = x
        if not known:
            return None
        kinds = self.context | {w: THREAT_CLASS if w in self.threats else INSULT_CLASS for w in known}
        classes = [kinds.get(w, OTHER_CLASS) for w in tokens]
        marks, state = {}, 0
        for k, c in enumerate(classes):
            if c <= THREAT_CLASS:
                marks[k] = 8 * c | BEFORE_MARK[state]
            state = BEFORE[state][c]
        out, state = np.zeros(N_MARKS), 0
        for k in range(len(classes) - 1, min(marks) - 1, -1):
            if k in marks:
                out[marks[k] | BEHIND_MARK[state]] += known[tokens[k]]
            state = BEHIND[state][classes[k]]
        return np.log1p(out)

    def score(self, text: str) -> float:
        x = self.features(text)
        margin = self.bias + (float(x @ self.factors) if x is not None else 0.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, margin))))


def _terms(text: str) -> set[str]:
    """Words, and stems marked by a star."""
    words = {w for w in TOKEN.findall(text.lower()) if w not in MARKS}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def learn(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 3000, most_clean: int = 12000) -> Grammar:
    """A grammar from rows of ``docs`` with a label for which ``training`` (on the id) holds.

    At most ``most_toxic`` and ``most_clean`` rows are used (which bounds the broadcast of their ids), the first by a hash of the id; null labels are left out, of several labels
    the greatest counts. A word or stem joins the lexicon if its share of toxic rows is too high for chance (Chernoff bound,
    over as many terms as there are), so the lexicon is bounded by the sample. A threat word weighs what its shares of toxic and clean rows say, nothing if
    it is no commoner in toxic ones. Without labels of both kinds the lexicon is empty and the fixed factors and weights remain. Other columns are not read.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(training).groupBy(id_col).agg(F.max(label_col).alias("y"))
    ranked = lambda y, n: labelled.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = ranked(1, most_toxic).union(ranked(0, most_clean))
    sample = written(docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "y"), "toxicity-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Grammar(bias=math.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 4.5)))

    def counted(batches):
        release_tables()
        for batch in (part for b in batches for part in slices(b, 0)):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(_terms(text or ""))
            keys = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["term", "a", "b"])

    terms = written(sample.mapInArrow(counted, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") >= 3) | F.col("term").isin(THREAT)), "toxicity-terms")
    base = n[1] / (n[0] + n[1])
    tests = max(2, terms.count())
    share = F.col("a") / (F.col("a") + F.col("b"))
    rest = F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.col("a") * F.log(share / base) + rest
    weight = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    strong = terms.where(share > base).withColumn("evidence", evidence).withColumn("weight", weight).where((F.col("evidence") >= math.log(tests)) & (F.col("weight") >= 1.5))
    lexicon = {r["term"]: r["weight"] for r in strong.where("a >= 3").collect()}
    threats = {r["term"]: max(0.0, r["weight"]) for r in terms.where(F.col("term").isin(THREAT)).withColumn("weight", weight).collect()}
    words, stems = ({t: w for t, w in lexicon.items() if (t[-1] == "*") == star} for star in (False, True))
    grammar = Grammar(words, {t[:-1]: w for t, w in stems.items()}, dict.fromkeys(THREAT, THREAT_WEIGHT) | threats)

    # The factors: logistic regression on the sample's matches, drawn towards the fixed factors. Equal matches are one row.
    def seen(batches):
        for batch in batches:
            rows = [grammar.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[] if r is None else r.round(4).tolist() for r in rows], pa.list_(pa.float64())), pa.array(batch.column(1).to_pylist(), pa.int32())], names=["x", "y"])

    rows = sample.mapInArrow(seen, "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.array([r["x"] or [0.0] * N_MARKS for r in rows])
    grammar.bias, grammar.factors = _fit(x, np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float))
    return grammar


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 1.0) -> tuple[float, np.ndarray]:
    """Weighted logistic regression by Newton steps; ``pull`` draws the factors to PRIOR and keeps them finite."""
    design = np.column_stack([np.ones(len(x)), x])
    center = np.concatenate([[-2.0], PRIOR])
    strength = np.concatenate([[1e-2], np.full(N_MARKS, pull)])
    w = center.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (n * (p - y)) + strength * (w - center)
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(strength)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. Null and empty texts get the grammar's bias alone; repeated rows stay; other columns are not
    read. One pass without shuffle; the grammar is bounded by the sample that it was learnt from."""
    return map_texts(docs, id_col, text_col, "score double", lambda texts: [[grammar.score(t) for t in texts]])


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents below the threshold, all columns as they are; null texts stay if an empty text does."""
    at = docs.columns.index(text_col)

    def kept(batches):
        release_tables()
        for batch in (part for b in batches for part in slices(b, at)):
            yield batch.filter(pa.array([grammar.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
