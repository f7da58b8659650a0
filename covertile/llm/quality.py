"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). What a
vote is worth is not set by hand: the hidden quality of a document is one of two classes, and
expectation-maximisation over all documents estimates how often each rule casts each vote on good
and on bad documents (its accuracy) and the share of good ones. A document is kept if the posterior
probability of good is at least one half; no single rule decides. Base rules that must hold in any
case come before.

Defects exclude rather than follow each other, so most rules only vote bad, and an abstention is
no evidence. A rule may turn out weak but not upside down: a vote counts at least ``LEAST`` to one
for what it says. That keeps the classes from changing places, and rare defects from being taken
for a trait of good documents. Only vote patterns matter to EM: documents are counted by pattern in
Spark, and the driver sees at most 3^9 counts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from covertile.plans.workspace import Workspace

from .texts import WORD_HASHES, gram_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEAST = 4.0

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for it was on with as be by at this are from or an not but have "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
        "le la les et du des un une est que qui dans pour sur pas au avec par ce il "
        "el los las y en por con una su para como más al lo se "
        "di che è per non sono della nel dei gli os uma não com dos da em"
    ).split()
)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_exclaims", "n_stops", "n_distinct",
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found twice or more, exactly."""
    if len(words) <= WINDOW:
        return 0
    h = np.sort(gram_hashes(WORD_HASHES.of(words), WINDOW))
    if not (h[1:] == h[:-1]).any():
        return 0  # equal windows have equal hashes
    numbers: dict[bytes, int] = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    for k in (1, 2, 4):  # numbers of windows of 2, 4 and 8 words
        a = np.unique(a[:-k] * (a.max() + 1) + a[k:], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(a)[a] >= 2)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    low = raw.lower().split()
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_LOWER)),
        text.count("!"),
        sum(map(STOP_WORDS.__contains__, low)),
        len(set(low)),
    )


_TYPE = StructType([StructField(n, LongType()) for n in COUNTS])


@F.arrow_udf(_TYPE)
def counts(texts: pa.Array) -> pa.Array:
    rows = [counts_of(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(c=F.col) -> dict[str, Column]:
    """The voting rules over the counts; ratios are compared by products, so none divides by zero."""
    n = c("n_words")
    letters = c("n_upper") + c("n_lower")
    return {
        "length": _vote(n < 30, F.lit(False)),
        "word_length": _vote((c("word_chars") < 2 * n) | (c("word_chars") > 12 * n), F.lit(False)),
        "symbols": _vote(c("n_symbols") * 10 > n, F.lit(False)),
        "lines": _vote(c("n_dup_lines") * 10 > 4 * c("n_lines"), F.lit(False)),
        "repeats": _vote(c("n_repeat_words") * 5 > n, F.lit(False)),
        "case": _vote(c("n_upper") * 2 > letters, F.lit(False)),
        "exclaims": _vote(c("n_exclaims") * 4 > n, F.lit(False)),
        "variety": _vote((n >= 20) & (n <= 500) & (c("n_distinct") * 5 < 2 * n), F.lit(False)),
        "function_words": _vote((n >= 30) & (c("n_stops") * 50 < n), c("n_stops") * 12 >= n),
    }


def pattern(votes: list[Column]) -> Column:
    """The votes as digits of one number in base three."""
    out = F.lit(0)
    for v in votes:
        out = out * 3 + (v + 1)
    return out.cast("int")


def fit(patterns: np.ndarray, weights: np.ndarray, n_rules: int, rounds: int = 500):
    """(posterior of good by pattern, share of good, rates[class, rule, vote]) by EM.

    ``patterns`` are numbers in base three, ``weights`` the documents that have each. ``rates``
    are how often a rule votes bad, abstains and votes good on bad (0) and on good (1) documents.
    """
    votes = np.stack([patterns // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)], axis=1)
    cast = np.eye(3)[votes]  # pattern, rule, vote
    # Ten imagined documents of each class, on which a vote is right four times in five.
    belief = np.array([[4.0, 5.0, 1.0], [1.0, 5.0, 4.0]])[:, None, :].repeat(n_rules, axis=1)
    rates, size, share = belief / 10, np.array([10.0, 10.0]), 0.5
    for _ in range(rounds):
        worth = np.log(rates[1] / rates[0])
        worth[:, 1] = 0
        log = np.einsum("pjv,jv->p", cast, worth) + np.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        mass = np.stack([weights * (1 - good), weights * good])
        counts = belief + np.einsum("cp,pjv->cjv", mass, cast)
        size = mass.sum(axis=1) + 10
        rates = counts / size[:, None, None]
        for vote, right in ((0, 0), (2, 1)):
            wrong = 1 - right
            upside = rates[right, :, vote] < LEAST * rates[wrong, :, vote]
            least = counts[:, :, vote].sum(axis=0) / (LEAST * size[right] + size[wrong])
            least = np.minimum(least, 0.999 / LEAST)
            rates[right, upside, vote], rates[wrong, upside, vote] = LEAST * least[upside], least[upside]
        new = size[1] / size.sum()
        if abs(new - share) < 1e-12:
            break
        share = new
    return good, share, rates


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``posterior`` and ``kept``.

    Null texts count as empty: they have no words and fail the base rules. Repeated rows and null
    ids stay as rows of their own.
    """
    ws = Workspace(docs.sparkSession, "quality")
    whole = f"counts_{uuid.uuid4().hex}"
    counted = docs.select(F.col(doc_id).alias("doc_id"), counts(F.col(text)).alias(whole))
    counted = counted.select("doc_id", f"{whole}.*")
    counted = ws.write(
        counted.select("*", pattern(list(rules().values())).alias("votes")), "counts"
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    # At most 3^9 rows: EM runs on the counts of vote patterns over all documents.
    seen = sorted(map(tuple, counted.groupBy("votes").count().collect()))
    if not seen:
        return counted.select(
            "doc_id", *COUNTS, base.alias("base_failed"), F.lit(0.0).alias("posterior"), base.alias("kept")
        )
    patterns, weights = (np.array(x) for x in zip(*seen))
    good, _, _ = fit(patterns, weights.astype(float), len(rules()))
    judged = docs.sparkSession.createDataFrame(
        [(int(p), float(g)) for p, g in zip(patterns, good)], "votes int, posterior double"
    )
    return counted.join(F.broadcast(judged), "votes").select(
        "doc_id",
        *COUNTS,
        base.alias("base_failed"),
        "posterior",
        (~base & (F.col("posterior") >= 0.5)).alias("kept"),
    )
