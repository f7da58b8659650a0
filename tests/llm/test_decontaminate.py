"""Containment search against plain sets of shingles."""

import random

import pytest
from pyspark.sql import functions as F

from covertile.llm import decontaminate as dc


def plain(docs, items):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [x for x in low.split(" ") if x]

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            n = min(5, len(words(item)))
            s, own = (runs(words(item), n), runs(w, n)) if n else (set(), set())
            if i is not None and s and 5 * len(s & own) >= 4 * len(s):
                out.append((d, i, len(s & own), len(s)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)] + ["Été", "ß", "OF", "The"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([5, 6, 8, 14, 30, 59, 200]))) for i in range(60)]
    items += [(60, items[3][1]), (61, "Too; short"), (65, "v7"), (66, "a b c d"), (67, items[3][1].split(" ")[0]), (62, None), (None, text(20)), (63, ""), (64, "a b c d e")]
    docs = [(0, None), (1, ""), (2, "a b c d"), (3, "A, b; c\nd (e)!"), (4, items[2][1]), (4, items[2][1])]
    for d in range(10, 150):
        words = text(rng.choice([10, 300, 3000])).split(" ")
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items[:60])[1].split(" ")
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, ", ".join(words)))
    long = text(150_000).split(" ")
    long[70_000:70_000] = items[5][1].split(" ")
    docs.append((500, " ".join(long)))
    return docs, items


@pytest.mark.parametrize("block", [2_000_000, 400])
def test_equals_plain_sets(spark, data, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    docs, items = data
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = rows.withColumn("item_id", F.lit("clash")).withColumn("matches", F.lit(0)).repartition(3)
    test = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.contamination(rows, test)
    assert got.columns == ["doc_id", "text", "item_id", "matches"] and got.count() == len(docs)
    pairs = got.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    assert sorted((tuple(r) for r in pairs), key=repr) == plain(docs, items)


def test_empty_tables(spark, data):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame(data[0][:3], "doc_id bigint, text string")
    test = spark.createDataFrame(data[1], "item_id bigint, text string")
    assert dc.contamination(none, test).collect() == []
    assert [r.matches for r in dc.contamination(some, no_items).collect()] == [[], [], []]
