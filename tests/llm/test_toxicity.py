"""The automaton against plain edit distance, contexts, and accuracy on held-out rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from covertile.llm import queries
from covertile.llm import toxicity as tx

SF_DIR = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(terms, word):
    found = []
    for number, term in enumerate(terms):
        stem = term.removesuffix("*")
        allowed = int(len(stem) >= (6 if term.endswith("*") else 5))
        parts = [word] if stem == term else [word[:k] for k in range(1, len(word) + 1)]
        best = min((distance(stem, p) for p in parts), default=9)
        if best <= allowed:
            found.append((best, number))
    return min(found, default=None)


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = ["abcde", "abcab", "bad", "cabba*", "baca*", "abcdee", "eeeee", "deabcd*"]
    automaton = tx.LexiconAutomaton(terms)
    for _ in range(4000):
        word = "".join(rng.choices("abcde", k=rng.randrange(1, 9)))
        if rng.random() < 0.5:
            word = list(rng.choice(terms).removesuffix("*"))
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(word))
                word[i : i + rng.randrange(2)] = rng.choice(["", "a", "e"])
                word = word or ["a"]
            word = "".join(word)
        assert automaton.match(word) == nearest(terms, word), word


def test_context_tells_quotation_from_abuse():
    model = tx.Model(["idiot", "worthless"])
    weight = lambda t: model.judge(t)[0]
    abuse, plain = weight("you are an idiot and worthless"), weight("an idiot and a worthless one")
    quoted = weight('the word "idiot" was used')
    assert abuse > plain > weight("an “idiot of a kind” here") > quoted > 0
    assert model.judge("such an idi0t")[3] == 1 and weight("such an idi0t") < weight("such an idiot")
    assert weight("") == weight(None) == weight("\n") == 0.0
    assert model.judge('x "\n" idiot "')[2] == 1


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(3)
    vocabulary = [f"w{c}{d}ord" for c in "abcdefgh" for d in "xyz"] + ["maron"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.choice([8, 60]))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["moron", "Scum,", f"lowei{rng.choice('abcdef')}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "moron"), (702, "a moronn"), (703, "maron " * 90_000), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(7)).repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")


def test_learns_and_scores(spark, toy):
    docs, labels = toy
    model = tx.fit(docs, labels)
    assert {"moron", "scum", "lowei*"} <= set(model.terms) and "maron" in model.ordinary
    rows = docs.select("doc_id", "text", tx.scorer(model)("text").alias("t")).collect()
    assert len(rows) == 606
    for r in rows:
        bad = r.doc_id in (None, 702) or (r.doc_id < 600 and r.doc_id % 4 == 0)
        assert 0 <= r.t.score <= 1 and (r.t.score >= 0.5) == bad, r


def test_no_labels(spark, toy):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tx.fit(toy[0], none)
    assert model.terms == [] and model.score(0.0, 0) < 0.5
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tx.fit(empty, toy[1]).terms == []
    assert empty.select(tx.scorer(model)("text")).collect() == []


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver tables are not here")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, SF_DIR).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.toxic for r in rows) > 0.97 * len(rows)


def test_labels_of_one_class(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(40)] + [(41, None), (42, "")], "doc_id bigint, text string")
    for value in (0, 1):
        labels = spark.createDataFrame([(i, value) for i in range(40)], "doc_id bigint, toxic int")
        model = tx.fit(docs, labels)
        rows = docs.select("text", tx.scorer(model)("text").alias("t")).collect()
        assert all(r.t.score < 0.5 for r in rows if not r.t.hits)
