"""Toxicity from a lexicon that also catches misspelled terms and tells quotation from abuse.

The lexicon is learned: whole words and word beginnings that are frequent in documents marked toxic
and rare in others. It is held as a trie, and one automaton runs words through the trie and a
Levenshtein automaton at once: a state is a set of (trie node, edits so far), made when first needed,
so a word costs one dictionary lookup a character and dies early if no term is near. Short terms
must match exactly, longer ones within one edit. A near word that occurs in documents marked clean is
ordinary language and no misspelling.

Each hit is weighed by the window of words around it: inside quotation marks, or with a word of
reporting nearby, it counts less, and addressing somebody makes it count more. The weights of a
document's hits are added up, and a logistic curve fitted to the labels gives the score.

Fitting reads at most ``SAMPLE`` labelled documents, drawn by a hash of their ids; scoring reads every
whole text. Ids, languages, sources and labels are never part of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from covertile.plans.workspace import Workspace

SAMPLE = 12_000
TERMS = 256
CANDIDATES = 4_000
LEAST_DOCS = 3
LEAST_SHARE = 0.02
LEAST_RATIO = 4.0
LEAST_WORTH = 15.0
LEAST_WORTH_SHARE = 0.1
FULL_RATIO = 300.0
WINDOW = 8
KEPT_WORDS = 200_000
PREFIXES = (4, 5, 6)

# Quotation marks, words of reporting and of address in some languages.
OPEN = "\"“„«‹‘‚「『"
CLOSE = "\"”“»›’’」』"
REPORTING = frozenset(
    "said says say word words term terms called calls call quote quoted quotes wrote writes "
    "sagte sagt wort wörter nannte zitat schrieb dit mot mots appelle cita citation écrit "
    "dijo dice palabra palabras llamó escribió disse parola parole ha detto palavra".split()
)
ADDRESS = frozenset(
    "you your yours u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre "
    "tú ti tus usted vosotros voi tuo tua você seu sua".split()
)


# -- the automaton ------------------------------------------------------------------------------


class LexiconAutomaton:
    """The trie of the terms, walked together with a Levenshtein automaton.

    Terms are words, or beginnings if they end in ``*``.
    """

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # edits that some term below a node allows
        self.allowed = []
        for number, term in enumerate(self.terms):
            letters = term.removesuffix("*")
            edits = int(len(letters) >= (6 if term.endswith("*") else 5))
            self.allowed.append(edits)
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append(number)
        self._clear()

    def _clear(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The state for some (node, edits), with letters of the term left out added."""
        todo = list(found)
        while todo:
            node, edits = todo.pop()
            if edits < 1:
                for child in self.children[node].values():
                    if self.reach[child] > edits and (child, edits + 1) not in found:
                        found.add((child, edits + 1))
                        todo.append((child, edits + 1))
        key = frozenset(found)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, edits))
            if edits < self.reach[node]:
                after.add((node, edits + 1))  # a letter too many
                for other in self.children[node].values():
                    if edits < self.reach[other]:
                        after.add((other, edits + 1))  # another letter
        return self._state(after)

    def _hits(self, state: int, whole: bool) -> Iterator[tuple[int, int]]:
        for node, edits in self.states[state]:
            for number in self.ends[node]:
                if edits <= self.allowed[number] and (whole or self.terms[number].endswith("*")):
                    yield edits, number

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term, ties by number, or None."""
        if len(self.states) > KEPT_WORDS:
            self._clear()
        state, best = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            state = to
            if not self.states[state]:
                return best
            best = min([*([best] if best else []), *self._hits(state, False)], default=None)
        return min([*([best] if best else []), *self._hits(state, True)], default=None)


# -- a text -------------------------------------------------------------------------------------


@dataclass
class Model:
    """What fitting gives: a few hundred terms and exceptions, and the two numbers of the curve."""

    terms: list[str]
    worth: list[float] = field(default_factory=list)  # of each term, at most 1
    ordinary: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0)
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None, "_known": {}}

    def look_up(self, token: str) -> tuple[int, int] | None:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        if len(self._known) >= KEPT_WORDS:
            self._known.clear()
        word = token if token.isalnum() else trimmed(token)
        hit = self._automaton.match(word) if len(word) > 2 else None
        if hit and hit[0] and word in self.ordinary:
            hit = None
        self._known[token] = hit
        return hit

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
        """(tokens, hits as (place, edits, number of the term))."""
        tokens = text.lower().split() if text else []
        known = self._known
        found = {}
        for token in set(tokens):
            hit = known[token] if token in known else self.look_up(token)
            if hit:
                found[token] = hit
        return tokens, [(i, *found[t]) for i, t in enumerate(tokens) if t in found] if found else []

    def judge(self, text: str | None) -> tuple[float, int, int, int, int, list[str]]:
        """(weight of all hits, words, hits, misspelled ones, quoted ones, terms)."""
        tokens, hits = self.hits(text)
        total, quoted = 0.0, 0
        for place, edits, number in hits:
            weight, inside = context(tokens, place)
            quoted += inside
            total += weight * (0.7 if edits else 1.0) * (self.worth[number] if self.worth else 1.0)
        terms = sorted({self.terms[number] for _, _, number in hits})
        return total, len(tokens), len(hits), sum(e > 0 for _, e, _ in hits), quoted, terms

    def score(self, weight: float, words: int) -> float:
        at = sum(a * b for a, b in zip(self.curve, features(weight, words)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, at))))


def features(weight: float, words: int) -> tuple[float, float, float]:
    """What the curve is over: one, the weight of the hits, and their density."""
    return 1.0, math.log1p(weight), math.log1p(50 * weight / (words + 50))


def trimmed(token: str) -> str:
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while start < end and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


def context(tokens: list[str], place: int) -> tuple[float, bool]:
    """(weight of a hit by the words around it, whether it is quoted)."""
    low, high = max(0, place - WINDOW), min(len(tokens), place + WINDOW + 1)
    opened = closed = False
    for i in range(place, low - 1, -1):
        if i < place and tokens[i][-1] in CLOSE:
            break
        if tokens[i][0] in OPEN:
            opened = True
            break
    for i in range(place, high):
        if i > place and tokens[i][0] in OPEN:
            break
        if tokens[i].rstrip(".,;:!?")[-1:] in set(CLOSE):
            closed = True
            break
    around = {trimmed(t) for t in tokens[low:high]}
    reported = not around.isdisjoint(REPORTING)
    if opened and closed:
        return (0.1 if reported else 0.3), True
    weight = 0.8 if reported else 1.0
    return weight * (1.25 if not around.isdisjoint(ADDRESS) else 1.0), False


# -- fitting and scoring ------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text, modulo five, is zero."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (text, toxic) -> (term, documents with it by class), added up in the task."""
    seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

    def rows() -> pa.RecordBatch:
        terms = list(seen[True].keys() | seen[False].keys())
        counts = [pa.array([seen[k][t] for t in terms], pa.int64()) for k in (True, False)]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], ["term", "bad", "good"])

    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            words = {trimmed(t) for t in set((text or "").lower().split())}
            words = {w for w in words if 2 < len(w) < 30}
            begins = {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}
            seen[bool(toxic)].update(words | begins)
            if len(seen[True]) + len(seen[False]) > 2_000_000:
                yield rows()
                seen = {False: Counter(), True: Counter()}
    yield rows()


def choose_terms(rows: list[tuple[str, int, float, float]], limit: int = TERMS) -> dict[str, float]:
    """term -> ratio out of (term, toxic documents, worth, ratio), best first, without repeats.

    The ratio is how much more frequent a term is in toxic documents.
    """
    ratios = {r[0]: r[3] for r in rows}
    chosen: dict[str, int] = {}
    for term, docs, *_ in sorted(rows, key=lambda r: (-round(r[2], 6), r[0].endswith("*"), -len(r[0]), r[0])):
        stem = term.removesuffix("*")
        if any(c.endswith("*") and stem.startswith(c[:-1]) for c in chosen):
            continue
        # A beginning must bring more than the chosen terms that start with it.
        covered = sum(n for c, n in chosen.items() if c.startswith(stem))
        if term.endswith("*") and docs <= 1.15 * covered:
            continue
        chosen[term] = docs
        if len(chosen) == limit:
            break
    return {c: ratios[c] for c in chosen}


def _curve(x: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """The logistic curve over the features, by damped Newton steps.

    Hits never lower a score, and a text without any stays below one half whatever the labels are.
    """
    beta, penalty = np.array([-2.0, 0.0, 0.0]), np.diag([0.01, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (toxic - p) - penalty @ beta
        beta = beta + np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, gradient)
        beta = np.clip(beta, [-8, 0, 0], [-0.02, 20, 20])
    return tuple(map(float, beta))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from the labelled documents that are not held out, at most ``sample`` labels.

    Ids or labels that are null are left out; an id labelled twice counts as toxic if one label says
    so. Without any toxic document the lexicon is empty and every score is the same low number.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    marked = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("toxic"))
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .where("toxic IS NOT NULL")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    drawn = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # At most ``sample`` rows of two numbers.
    drawn = ws.write(drawn.join(F.broadcast(marked), "id").select("text", "toxic"), "drawn")
    sizes = drawn.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_bad, n_good = (int(n or 0) for n in sizes)
    if not n_bad:
        return Model([])
    counted = drawn.mapInArrow(_count_terms, "term string, bad bigint, good bigint").groupBy("term")
    counted = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_bad))
    best = (
        counted.where((F.col("bad") >= least) & (ratio >= LEAST_RATIO))
        .select("term", "bad", (F.col("bad") * F.log(ratio)).alias("worth"), ratio.alias("ratio"))
        .where(F.col("worth") >= max(LEAST_WORTH, LEAST_WORTH_SHARE * n_bad))
        .orderBy(F.desc("worth"), "term")
        .limit(CANDIDATES)
        .collect()
    )
    terms = choose_terms([tuple(r) for r in best])
    model = Model(list(terms), [min(1.0, math.log(r) / math.log(FULL_RATIO)) for r in terms.values()])
    clean = drawn.where("toxic = 0").select("text")
    near = clean.mapInArrow(_near_words(model), "word string").distinct().collect()
    model.ordinary = frozenset(r.word for r in near)
    seen = drawn.select("toxic", _weigher(model)(F.col("text")).alias("x")).collect()
    model.curve = _curve(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float))
    return model


def _near_words(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = set()
            for text in batch.column(0).to_pylist():
                tokens, hits = model.hits(text)
                words |= {trimmed(tokens[place]) for place, edits, _ in hits if edits}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

    return run


def _weigher(model: Model):
    @F.arrow_udf(ArrayType(DoubleType()))
    def weight(texts: pa.Array) -> pa.Array:
        rows = [features(*model.judge(t.as_py())[:2]) for t in texts]
        return pa.array(rows, pa.list_(pa.float64()))

    return weight


_TYPE = StructType(
    [
        StructField("score", DoubleType()),
        StructField("hits", LongType()),
        StructField("misspelled", LongType()),
        StructField("quoted", LongType()),
        StructField("terms", ArrayType(StringType())),
    ]
)


def scorer(model: Model):
    """A column function: text -> struct of score (0 to 1), hits, misspelled, quoted and terms."""

    @F.arrow_udf(_TYPE)
    def toxicity(texts: pa.Array) -> pa.Array:
        rows = [model.judge(t.as_py()) for t in texts]
        score = [model.score(*r[:2]) for r in rows]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        columns = [pa.array([r[i + 2] for r in rows], t) for i, t in enumerate(types)]
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), *columns], _TYPE.names)

    return toxicity
