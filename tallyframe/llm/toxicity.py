"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read into symbols by weighted lexicon arcs, and a transducer composed of four parts runs over each
clause: insult (a lexicon word), threat (a threat word), target (a second-person word or a naming verb within
reach) and the modifiers negation and reported speech (a cue before the hit within reach). It emits matched
clauses, each with its kind - ``insult``, ``aimed insult``, ``negated``, ``reported``, ``threat``, ``aimed
threat`` - and the weight of the word that made it. A document's score is the logistic sum of its clause weights
times the weight of their kinds: isolated words count only through the clause they stand in.

The weights are learned from labelled rows: a word's arc weight is its smoothed log-odds of standing in a toxic
document (counts over about ``LABELS`` labelled rows, added up before the shuffle); stems of ``STEMS`` letters stand
in for forms that were not met. Fixed cue lists give target, negation, report and threat words of four languages.
The intercept and the kind weights are fitted on about ``FIT_ROWS`` labelled rows, chosen by a hash of the text;
each of them is scored as if it had not been counted, so chance words are not trusted.

Defined cases: a null or empty text has no clause and gets the base score; a model without toxic training rows
scores by the cue lists alone; repeated rows are scored alike; very long texts are read word by word with a
bounded state; other columns are never read, so clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import begin_memos, free_name, stored

#: Cue words of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tus".split())
NEGATIONS = frozenset("not no never isn't aren't don't nobody without nicht kein keine keinen nie ne pas jamais aucun aucune sin nunca nadie".split())
REPORTS = frozenset("said says say called calls quoted wrote claims reported sagte schrieb nannte behauptet dit écrit appelé cité dijo escribió llamó".split())
THREATS = frozenset("kill hurt destroy murder strangle shoot stab töten umbringen schlagen tuer frapper matar golpear".split())

KINDS = ("insult", "aimed insult", "negated", "reported", "threat", "aimed threat")
#: Starting weights of the kinds; the fit moves them only as far as labelled rows ask for.
PRIOR = np.array([1.0, 1.3, 0.7, 0.7, 1.0, 1.5])
REACH = 4  # words over which a cue or target acts
STEMS = (4, 5, 6, 7)
LABELS = 40_000  # labels that the model learns from, about
FIT_ROWS = 20_000
MIN_DOCS = 3  # toxic documents a lexicon form is met in at least
MIN_WEIGHT = 1.5
LEXICON = 20_000  # lexicon forms at most; by weight
CAP = 12.0  # what a kind adds to a score levels off here, so that length alone does not convict
_MEMO = 300_000

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+", re.UNICODE)
_PLAIN, _END, _STOP, _TARGET, _NEGATION, _REPORT, _THREAT = 0, -1, -2, -3, -4, -5, -6


def log_odds(bad: float, good: float, toxic: int, other: int) -> float:
    """Smoothed log-odds less one standard error. A form weighs nothing if it is met too seldom, or if a rate of
    its own does not explain its labels better than the common rate by the logarithm of the documents."""
    if bad < MIN_DOCS:
        return 0.0
    weight = math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (other + 1)) - math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    share, own = toxic / (toxic + other), bad / (bad + good)
    gain = bad * math.log(own / share) + (good * math.log((1 - own) / (1 - share)) if good else 0.0)
    return weight if weight >= MIN_WEIGHT and gain >= math.log(toxic + other) else 0.0


@dataclass
class Model:
    """Counts (toxic, other) of words and of stems in labelled documents, and the weights of the kinds."""

    toxic: int = 0
    other: int = 0
    words: dict[str, tuple[int, int]] = field(default_factory=dict)
    stems: dict[str, tuple[int, int]] = field(default_factory=dict)
    kinds: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    intercept: float = -4.0

    def __post_init__(self) -> None:
        cues = ((TARGETS, _TARGET), (NEGATIONS, _NEGATION), (REPORTS, _REPORT), (THREATS, _THREAT))
        self.cues = {word: symbol for words, symbol in cues for word in words}
        self.memo: dict[str, float] = {}

    def symbol(self, token: str) -> float:
        """The input symbol of a token: a cue, the end of a clause or sentence, or the arc weight of a word."""
        if not token[0].isalpha():
            return _STOP if "\n" in token or "." in token else _END
        return self.cues.get(token) or self.arc(token)

    def arc(self, word: str, without: dict[str, int] | None = None, label: bool = False) -> float:
        """The weight of a word, or of its longest known stem; ``without`` are counts of a document to leave out."""
        for form, counts in ((word, self.words.get(word)), *((word[:n], self.stems.get(word[:n])) for n in reversed(STEMS) if len(word) > n)):
            if counts is not None:
                bad, good = counts
                if without is not None:
                    own = 1 if form == word else without.get(form, 0)
                    bad, good = (bad - own, good) if label else (bad, good - own)
                if w := log_odds(bad, good, self.toxic - (without is not None and label), self.other - (without is not None and not label)):
                    return w
        return 0.0

    def symbols(self, tokens: list[str]) -> Iterator[float]:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo = self.memo
        for t in tokens:
            s = memo.get(t)
            if s is None:
                s = memo[t] = self.symbol(t)
            yield s

    def symbols_without(self, tokens: list[str], label: bool) -> Iterator[float]:
        """As if the document with these tokens had not been counted."""
        words = {t for t in tokens if t[0].isalpha()}
        own: dict[str, int] = {}
        for w in words:
            for n in STEMS:
                if len(w) > n:
                    own[w[:n]] = own.get(w[:n], 0) + 1
        for t in tokens:
            yield self.symbol(t) if t not in words or t in self.cues else self.arc(t, own, label)


def clauses(symbols: Iterator[float]) -> Iterator[tuple[int, float]]:
    """(kind, weight) of every matched clause, by one pass with a state of a few positions."""
    never = -(10**9)
    target = negation = report = never
    pending: list[tuple[int, float]] = []  # hits that a target close behind may still make aimed
    for at, s in enumerate(symbols):
        if s == _PLAIN:
            continue
        if s > 0:
            if at - negation <= REACH:
                yield 2, s
            elif at - report <= 2 * REACH:
                yield 3, s
            elif at - target <= REACH:
                yield 1, s
            else:
                pending.append((at, s))
        elif s in (_END, _STOP):
            for _, w in pending:
                yield 0, w
            pending = []
            target = negation = never
            report = never if s == _STOP else report
        elif s == _TARGET:
            target = at
            for was, w in pending:
                yield int(at - was <= REACH), w
            pending = []
        elif s == _NEGATION:
            negation = at
        elif s == _REPORT:
            report = at
        elif at - negation <= REACH:
            yield 2, 1.0
        elif at - report <= 2 * REACH:
            yield 3, 1.0
        else:
            yield (5 if at - target <= REACH else 4), 1.0
    for _, w in pending:
        yield 0, w


def features(text: str | None, model: Model, label: bool | None = None) -> np.ndarray:
    """What each kind adds; with a label, as if this document had not been counted."""
    tokens = _TOKEN.findall((text or "").lower())
    sums = np.zeros(len(KINDS))
    for kind, weight in clauses(model.symbols(tokens) if label is None else model.symbols_without(tokens, label)):
        sums[kind] += weight
    return CAP * np.tanh(sums / CAP)


def score(text: str | None, model: Model) -> float:
    z = model.intercept + float(features(text, model) @ model.kinds)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def count_forms(rows: DataFrame, model: Model) -> None:
    """Fill the model's counts from all rows of (text, toxic): one row a document and distinct word, added up
    before the shuffle; stems are made from the words' counts. Few forms pass, ``LEXICON`` at most."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+(?:'\p{L}+)?)"), F.lit(1))))
    totals = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    model.toxic, model.other = totals.get(True, 0), totals.get(False, 0)
    if not model.toxic:
        return
    forms = F.array(
        F.struct(F.lit(0).alias("stem"), F.col("word").alias("form")),
        *[F.struct(F.lit(n).alias("stem"), F.when(F.length("word") > n, F.substring("word", 1, n)).alias("form")) for n in STEMS],
    )
    weight = (
        F.log((F.col("bad") + 0.5) / (model.toxic + 1)) - F.log((F.col("good") + 0.5) / (model.other + 1)) - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    )
    share, own = model.toxic / (model.toxic + model.other), F.col("bad") / (F.col("bad") + F.col("good"))
    gain = F.col("bad") * F.log(own / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - own) / (1 - share))).otherwise(0.0) if model.other else F.lit(0.0)
    one = F.col("toxic").cast("long")
    found = (
        rows.select("toxic", word.alias("word")).groupBy("word").agg(F.sum(one).alias("bad"), F.sum(1 - one).alias("good"))
        .select(F.explode(forms).alias("e"), "bad", "good").select("e.*", "bad", "good").where("form IS NOT NULL")
        .groupBy("stem", "form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((F.col("bad") >= MIN_DOCS) & (weight >= MIN_WEIGHT) & (gain >= math.log(model.toxic + model.other)))
        .orderBy(F.desc(weight), "stem", "form").limit(LEXICON).collect()
    )
    model.words = {r["form"]: (r["bad"], r["good"]) for r in found if not r["stem"]}
    model.stems = {r["form"]: (r["bad"], r["good"]) for r in found if r["stem"]}


def held_out(key: Column) -> Column:
    """Rows that no model learns from: a quarter, by the CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents; rows of any split have to be left out before.

    Of the labels about ``LABELS`` are taken, by a hash of the id, so their broadcast is bounded and no text is
    shuffled; the documents they mark are stored once.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") > 0).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, LABELS / max(marks.count(), 1))
    marks = F.broadcast(marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(marks, "id").select("text", "toxic"))
    model = Model()
    count_forms(rows, model)
    if not model.toxic or not model.other:
        return model
    share = min(1.0, FIT_ROWS / (model.toxic + model.other))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))

    @F.pandas_udf("array<double>")
    def kind_sums(text: pd.Series, toxic: pd.Series) -> pd.Series:
        begin_memos("toxicity")
        return pd.Series([features(t, model, bool(y)).tolist() for t, y in zip(text, toxic)])

    sample = chosen.select(kind_sums("text", "toxic").alias("x"), "toxic").groupBy("x", "toxic").count().collect()
    if len({r["toxic"] for r in sample}) == 2:
        _fit_weights(model, *(np.array([r[c] for r in sample], float) for c in ("x", "toxic", "count")))
    return model


def _fit_weights(model: Model, x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60, pull: float = 2.0) -> None:
    """Penalised logistic regression by Newton steps; the kind weights are drawn to their starting values."""
    a = np.column_stack([np.ones(len(x)), x])
    centre, strength = np.r_[model.intercept, PRIOR], np.r_[0.01, np.full(x.shape[1], pull)]
    def loss(beta: np.ndarray) -> float:
        z = a @ beta
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (strength * (beta - centre) ** 2).sum())

    beta = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (n * (p - y)) + strength * (beta - centre)
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag(strength)
        step, size, before = np.linalg.solve(hessian, gradient), 1.0, loss(beta)
        while size > 1e-6 and loss(beta - size * step) > before:  # the loss is convex: a short enough step lowers it
            size /= 2
        beta = beta - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    model.intercept, model.kinds = float(beta[0]), np.maximum(beta[1:], 0.0)


def scored(text: Column, model: Model) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def rate(column: pd.Series) -> pd.Series:
        begin_memos("toxicity")
        return pd.Series([score(t, model) for t in column], dtype="float64")

    return rate(text.cast("string"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with their own columns only."""
    name = free_name(docs.columns, "score")
    return docs.withColumn(name, scored(F.col(f"`{text_col}`"), model)).where(F.col(name) < threshold).drop(name)
