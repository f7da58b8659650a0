"""License scans against plain windows of shingles."""

import random

import pytest
from pyspark.sql import functions as F

from covertile.llm import license_scan as ls


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [x for x in low.split(" ") if x]


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain(docs, templates):
    """(doc, template) -> most shared shingles in a window, where that is enough."""
    out = {}
    for d, text in docs:
        own = shingles(words_of(text))
        for name, template in templates:
            t = set(shingles(words_of(template)))
            if not t or name is None:
                continue
            w = 1
            while w < len(t):
                w *= 2
            best = max((len(t & set(own[g : g + 2 * w])) for g in range(0, len(own), w)), default=0)
            if 5 * best >= 4 * len(t):
                out[d, name] = max(best, out.get((d, name), 0))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(60)] + ["Été", "the", "License"]
    templates = [*ls.NOTICES.items(), ("short", "too short"), (None, "a b c d e f"), ("five", "a b c d e"), ("none", None)]
    docs = [(0, None), (1, ""), (2, "a, b, C. d"), (3, "a b\nc-d e"), (4, ls.NOTICES["MIT"]), (4, ls.NOTICES["MIT"])]
    for d in range(10, 160):
        words = rng.choices(vocabulary, k=rng.choice([0, 30, 400]))
        for _ in range(rng.randrange(3)):
            passage = rng.choice(list(ls.NOTICES.values())).split(" ")
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    long = rng.choices(vocabulary, k=100_000)
    long[99_000:99_000] = ls.NOTICES["BSD conditions"].upper().split(" ")
    return [*docs, (500, " ".join(long))], templates


@pytest.mark.parametrize("block", [500_000, 60])
def test_equals_plain_windows(spark, data, monkeypatch, block):
    monkeypatch.setattr(ls, "BLOCK_WORDS", block)
    docs, templates = data
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = rows.withColumn("licenses", F.lit("clash")).withColumn("name", F.lit("clash"))
    given = spark.createDataFrame(templates, "name string, template string")
    got = ls.license_scan(rows, given)
    assert got.columns == ["doc_id", "text", "name", "licenses"] and got.count() == len(docs)
    best, texts = {}, dict(docs)
    for r in got.select("doc_id", F.explode("licenses").alias("m")).select("doc_id", "m.*").collect():
        best[r.doc_id, r.license] = max(r.shared, best.get((r.doc_id, r.license), 0))
        span = words_of(texts[r.doc_id])[r.first_word : r.last_word + 1]
        template = shingles(words_of(dict(templates)[r.license]))
        assert len(set(template) & set(shingles(span))) >= r.shared and r.shingles == len(set(template))
    assert best == plain(docs, templates)


def test_bands_guarantee_the_collision():
    for w in (1, 2, 8, 64, 512):
        s = ls.least_jaccard(w)
        n, rows = ls.bands(s)
        assert 1 - (1 - s**rows) ** n >= ls.COLLIDES - 1e-12


def test_empty_tables(spark, data):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame(data[0][:3], "doc_id bigint, text string")
    no_templates = spark.createDataFrame([], "name string, template string")
    assert ls.license_scan(none, ls.notices(spark)).collect() == []
    assert [r.licenses for r in ls.license_scan(some, no_templates).collect()] == [[], [], []]
