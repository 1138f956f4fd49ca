"""Operator 9: toxicity by a weighted finite-state pattern grammar.

Words and marks become signs: insult, threat, target, negation, report, quote,
clause end, other. Small transducers are composed, each reading what the one
before it writes: one marks what is negated, one what is reported or quoted,
one what is aimed at a person, one threats that a target follows, and one says
at a clause's end whether it held a match. The weights lie on the transitions of
the composed machine, so whole clauses are scored, and the same word counts
differently alone, addressed, negated or reported. Insult words and stems, their
weights and the weights of the clause kinds are learned from a bounded sample of
labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.runtime import plain, restored, spool, text_column

#: Labelled rows that the model learns from at most, chosen by a hash of their id.
SAMPLE = 20_000
#: Terms that the grammar holds at most, the most telling first.
TERMS = 4_000
#: Terms that a task counts before it hands the counts on.
HELD_TERMS = 50_000
#: Rows of a class that must hold a term, its log odds and its log-likelihood ratio at least.
LEAST_ROWS, LEAST_ODDS, LEAST_RATIO = 5, 1.5, 25.0
STEMS = (4, 5, 6)
WORDS_KEPT = 300_000

# Small closed word classes in four languages.
TARGETS = "you your yours u he she him her they them their people man woman guy du dich dir ihr euch sie er tu te toi vous il elle eux usted tú él ella ellos vosotros".split()
NEGATIONS = "not no never none neither nor isn don doesn aren wasn nicht kein keine nie pas jamais non ni nunca jamás".split()
REPORTS = "said says say told reported reports quoted quote claims claimed wrote called sagte sagt meinte dit disait dijo dice".split()
THREATS = "kill hurt destroy beat attack burn murder punish töten schlagen tuer frapper matar golpear".split()
SEEDS = "idiot moron stupid scum trash loser pathetic disgusting worthless clown".split()
SEED_WEIGHT = 4.0

SIGNS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, COLON, LINE = range(10)
#: What the transducers write besides signs: insults by kind, threats that are aimed, and clauses that held a match.
NEGATED, REPORTED, TARGETED, AIMED, CLAUSE = range(10, 15)
SYMBOLS = range(15)
#: Where a clause ends, and of these, where a sentence does.
CLAUSE_ENDS, SENTENCE_ENDS = (END, COLON, LINE), (END, LINE)
_QUOTES, _ENDS, _COLON, _LINE = '"“”«»', ".!?;", ":", "\n"
_TOKEN = re.compile(r"[^\W\d_]+|[" + _ENDS + _COLON + _LINE + _QUOTES + "]")


class Transducer:
    """Deterministic: ``step`` maps (state, symbol) to (state, symbol written); the start is 0, and a line's end leads back to it."""

    def __init__(self, states: int, step: dict[tuple[int, int], tuple[int, int]]):
        self.states, self.step = states, step

    @classmethod
    def of(cls, states: int, move) -> Transducer:
        """From a rule ``move(state, symbol)``."""
        return cls(states, {(q, s): move(q, s) for q in range(states) for s in SYMBOLS})

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        step = {}
        for (q, s), (q2, written) in self.step.items():
            for r in range(other.states):
                r2, out = other.step[r, written]
                step[q * other.states + r, s] = q2 * other.states + r2, out
        return Transducer(self.states * other.states, step)


def _negation(left: int, s: int) -> tuple[int, int]:
    """A negation reaches over three signs; a negated threat is none."""
    after = 0 if s in CLAUSE_ENDS else 3 if s == NEGATION else max(0, left - 1)
    return after, {INSULT: NEGATED, THREAT: OTHER}.get(s, s) if left else s


def _reported(state: int, s: int) -> tuple[int, int]:
    """Speech is reported from a verb of saying to the sentence's end, past colons, and between quotes, past sentences, to the line's end.

    State: 1 reported, 2 quoted. All ends of clauses are the same for those that read on.
    """
    after = {END: state & 2, LINE: 0, REPORT: state | 1, QUOTE: state ^ 2}.get(s, state)
    return after, REPORTED if state and s == INSULT else END if s in CLAUSE_ENDS else s


def _targeted(state: int, s: int) -> tuple[int, int]:
    """What follows a person in the clause is aimed at them."""
    after = 0 if s == END else 1 if s == TARGET else state
    return after, {INSULT: TARGETED, THREAT: AIMED}.get(s, s) if state else s


def _aimed(state: int, s: int) -> tuple[int, int]:
    """A threat right before a person is aimed at them, too."""
    return int(s == THREAT), AIMED if state and s == TARGET else s


def _matched(state: int, s: int) -> tuple[int, int]:
    """At its end, a clause that held an insult or an aimed threat is told."""
    if s == END:
        return 0, CLAUSE if state else OTHER
    return int(state or s in (INSULT, NEGATED, REPORTED, TARGETED, AIMED)), s


FEATURES = ("plain", "targeted", "negated", "reported", "threats", "strongest", "clauses", "density")
#: The feature that a written symbol adds to, and whether by the weight of the term read or by one.
_ADDS = {INSULT: ("plain", True), TARGETED: ("targeted", True), NEGATED: ("negated", True), REPORTED: ("reported", True), AIMED: ("threats", False), CLAUSE: ("clauses", False)}


def _parts() -> list[Transducer]:
    return [Transducer.of(n, f) for n, f in ((4, _negation), (4, _reported), (2, _targeted), (2, _aimed), (2, _matched))]


def _machine() -> dict[tuple[int, int], tuple[int, str | None, float, float]]:
    """The composed grammar as (state, sign) to (state, feature, weight a unit of the term's weight, weight besides)."""
    whole = reduce(Transducer.then, _parts())
    out = {}
    for (q, s), (after, written) in whole.step.items():
        if s in SIGNS:
            feature, by_term = _ADDS.get(written, (None, False))
            out[q, s] = after, feature, float(by_term), float(feature is not None and not by_term)
    return out


MACHINE = _machine()
#: The state at a sentence's start within quotes.
QUOTED = MACHINE[0, QUOTE][0]


def terms_of(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class Grammar:
    """The composed machine with a lexicon of weighted insult words and stems."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        closed = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (_QUOTES, QUOTE), (_ENDS, END), (_COLON, COLON), (_LINE, LINE))
        self.closed = {w: (sign, 0.0) for ws, sign in closed for w in ws}
        self.seen: dict[str, tuple[int, float]] = {}

    def sign(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            get = self.terms.get
            weight = max(get(word, 0.0), *(get(word[:k] + "*", 0.0) if len(word) > k else 0.0 for k in STEMS))
            found = (INSULT, weight) if weight > 0 else self.closed.get(word, (OTHER, 0.0))
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            self.seen[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums of matched clauses' weights by kind; see FEATURES."""
        signs = [self.sign(t) for t in _TOKEN.findall(text.lower())]
        return self.of_signs(signs)

    @staticmethod
    def of_signs(signs: list[tuple[int, float]]) -> list[float]:
        """Runs the machine over the sentences that hold an insult or a threat; of all others only the quotes of a line count."""
        out = dict.fromkeys(FEATURES, 0.0)
        n, done, at, quoted = len(signs), -1, 0, False
        for h in [i for i, (s, _) in enumerate(signs) if s in (INSULT, THREAT)]:
            if h <= done:
                continue
            i = h
            while i > 0 and signs[i - 1][0] not in SENTENCE_ENDS:
                i -= 1
            for s, _ in signs[at:i]:
                quoted = s != LINE and quoted != (s == QUOTE)
            at = i
            state, s = QUOTED if quoted else 0, OTHER
            while s not in SENTENCE_ENDS:
                s, w = signs[i] if i < n else (END, 0.0)
                state, feature, by_term, besides = MACHINE[state, s]
                if feature:
                    out[feature] += by_term * w + besides
                    if by_term:
                        out["strongest"] = max(out["strongest"], w)
                i += 1
            done = i - 1
        weight = out["plain"] + out["targeted"] + out["negated"] + out["reported"]
        out["density"] = weight / math.sqrt(n + 1)
        return [*(math.log1p(out[k]) for k in FEATURES)]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by five; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text, toxic of one row each of at most ``sample`` labelled ids that are not held out (a fixed choice by hash)."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col).alias("text"))
    # the sample is at most ``sample`` pairs of an id and a label, whatever the table's size
    found = source.join(F.broadcast(chosen), source["id"] == chosen["label_id"])
    # one row of each id, a fixed choice by hash, so rows are bounded, too
    return found.groupBy("label_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def telling(counts: DataFrame, p: float, n: float) -> DataFrame:
    """term, odds and ratio of the terms (term, bad, good) that pass all thresholds; p and n: toxic and clean rows."""
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    share = (bad + good) / (p + n)
    cells = ((bad, p * share), (good, n * share), (p - bad, p * (1 - share)), (n - good, n * (1 - share)))
    ratio = sum((F.when(seen > 0, 2 * seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))
    odds = F.log((bad + 0.5) / (p + 1)) - F.log((good + 0.5) / (n + 1))
    passed = (F.col("bad") >= LEAST_ROWS) & (F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO)
    return counts.select("term", "bad", odds.alias("odds"), ratio.alias("ratio")).where(passed).select("term", "odds", "ratio")


class Model:
    def __init__(self, terms: dict[str, float], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, float).reshape(-1, len(FEATURES))
        z = np.clip(x @ self.weights[1:] + self.weights[0], -35, 35)
        return 1 / (1 + np.exp(-z))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn terms and weights from at most ``sample`` labelled rows.

    Terms are counted in parallel; only those above the thresholds, at most
    TERMS, and the sample's numbers reach the driver. Without labels of both
    classes, the seed words alone make the model.
    """
    rows = training_rows(docs, labels, sample, id_col, text_col)

    def count(batches):
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        sizes = [0, 0]

        def parts():
            terms = [*(tally[0].keys() | tally[1].keys())]
            for i in range(0, len(terms), HELD_TERMS):
                part = terms[i : i + HELD_TERMS]
                yield pd.DataFrame({"term": part, "bad": [tally[1][t] for t in part], "good": [tally[0][t] for t in part]})
            for t in tally:
                t.clear()

        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                y = int(y > 0)
                sizes[y] += 1
                tally[y].update(terms_of(set(_TOKEN.findall(text.lower()))))
                if len(tally[0]) + len(tally[1]) >= HELD_TERMS:
                    yield from parts()
        yield from parts()
        yield pd.DataFrame({"term": ["", ""], "bad": [0, sizes[1]], "good": [sizes[0], 0]})

    counts = rows.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = spool(counts, "terms")
    sizes = counts.where("term = ''").agg(F.sum("bad"), F.sum("good")).first()
    p, n = (float(x or 0) for x in sizes)
    neutral = np.array([-2.0, 1.0, 1.2, 0.2, 0.2, 1.0, 0.5, 0.0, 0.5])
    seeds = dict.fromkeys(SEEDS, SEED_WEIGHT)
    if not p or not n:
        return Model(seeds, neutral)
    # the thresholds come before the limit, so that it only meets the least telling terms
    told = telling(counts.where("term <> ''"), p, n).orderBy(F.desc("ratio"), "term").limit(TERMS).toPandas()
    terms = dict(zip(told["term"].tolist(), told["odds"].tolist(), strict=True))
    if not terms:
        return Model(seeds, neutral)

    def featured(batches):
        grammar = Grammar(terms)
        for pdf in batches:
            yield pd.DataFrame([[float(y > 0), *grammar.features(t)] for t, y in zip(pdf["text"], pdf["toxic"], strict=True)], columns=["toxic", *FEATURES])

    data = rows.mapInPandas(featured, ", ".join(f"{c} double" for c in ("toxic", *FEATURES))).toPandas()  # at most ``sample`` rows of numbers
    return Model(terms, _fit(data[[*FEATURES]].to_numpy(), data["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row.

    Null and empty texts get the score of no matched clause; null ids stay and
    count as held out by the crc of an empty text; repeated rows repeat; an
    empty table gives an empty one. Nothing but the text enters a score.
    """

    def run(batches):
        grammar = Grammar(model.terms)
        for pdf in batches:
            s = model.score([grammar.features(t) for t in pdf["text"]])
            yield pd.DataFrame({"id": pdf["id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    found = restored(plain(docs, id_col, text_col).mapInPandas(run, "id string, score double, predicted int"), docs, id_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns and other rows stay as they are.

    Null and empty texts score as those without a match, null ids and repeated
    rows stay or go by their text, texts of any length are read whole, and an
    empty table gives an empty one.
    """
    model = train(docs, labels, sample, id_col, text_col)

    def toxic(texts: pd.Series) -> pd.Series:
        grammar = Grammar(model.terms)
        return pd.Series(model.score([grammar.features(t) for t in texts]) >= 0.5)

    return docs.where(~F.pandas_udf(toxic, "boolean")(text_column(docs, text_col)))
