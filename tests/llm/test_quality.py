"""Counts against plain Python, the vote model on drawn votes and on hand-made junk."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from covertile.llm import quality as q

W = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(W, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(W, line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_counts_equal_plain(spark):
    rng = random.Random(4)
    vocabulary = ["a", "Été", "x#", "|", "the", "b\x1cc", "d\xa0e", "<f>", "G!"]
    texts = [None, "", "\n\n", "a\n a\na \na", "x " * 9, "x " * 8, "a b c d e f g h a b c d e f g h"]
    for _ in range(120):
        n = rng.choice([3, 9, 40, 120])
        part = [rng.choice(vocabulary) for _ in range(n)]
        if rng.random() < 0.5:
            part += part[: rng.randrange(1, n)]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in part))
    texts.append("long " * 20_000)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (0, "a b"), (0, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumn("votes", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = q.quality(docs).collect()
    want = {t: plain(t) for _, t in rows if t is None or len(t) < 50_000}
    want["long " * 20_000] = (20_000, 80_000, 0, 0, 20_000)
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr)
    assert mine == sorted(((d, *want[t]) for d, t in rows), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_em_finds_the_classes():
    """Votes drawn from known rates: the posterior separates and the rates come back."""
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    bad_rate, good_rate = [0.5, 0.4, 0.3, 0.6], [0.01, 0.02, 0.01, 0.05]
    votes = np.ones((20_000, 5), int)
    for j, (b, g) in enumerate(zip(bad_rate, good_rate)):
        votes[rng.random(20_000) < np.where(good, g, b), j] = 0
    says = rng.random(20_000)
    votes[:, 4] = np.where(says < np.where(good, 0.9, 0.2), 2, 1)
    number = votes @ 3 ** np.arange(4, -1, -1)
    patterns, weights = np.unique(number, return_counts=True)
    post, share, rates = q.fit(patterns, weights.astype(float), 5)
    found = post[np.searchsorted(patterns, number)] >= 0.5
    # What the true rates would give by the same rule (votes count, abstentions do not).
    odds = np.full(20_000, np.log(0.8 / 0.2))
    for j, (b, g) in enumerate(zip(bad_rate, good_rate)):
        odds += np.where(votes[:, j] == 0, np.log(g / b), 0)
    odds += np.where(votes[:, 4] == 2, np.log(0.9 / 0.2), 0)
    best = ((odds >= 0) == good).mean()
    # Leaving abstentions out biases the share of good documents down; it costs a few points here.
    assert (found == good).mean() > best - 0.05 and 0.6 < share < 0.9
    assert np.all(rates[0, :4, 0] > rates[1, :4, 0]) and rates[1, 4, 2] > rates[0, 4, 2]


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choices(["the", "of", "and", *(f"word{i}" for i in range(300))], [40, 40, 40] + [1] * 300, k=120))
    rows = [(i, prose() + ".\n" + prose()) for i in range(200)]
    rows += [(1000 + i, " | ".join(prose().split()[:60]).replace("the", "t#")) for i in range(15)]
    rows += [(2000 + i, "!! ".join(prose().upper().split())) for i in range(15)]
    got = q.quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_empty_table(spark):
    assert q.quality(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
