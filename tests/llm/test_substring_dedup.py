"""Repeated spans against plain Python, with hot anchors and small shards forced on."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from covertile.llm import queries
from covertile.llm import substring_dedup as sd


def plain(rows):
    """Rows in order of (id, place): (id, kept, words, removed)."""
    seen, out = set(), []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, kept, len(words), len(gone)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(150)] + ["Été", "x\x1cy", "a\xa0b", "的"]
    text = lambda n: rng.choices(vocabulary, k=n)
    passages = [text(rng.choice([19, 20, 21, 35, 80])) for _ in range(12)]
    out = [(None, "a " * 45), (-5, None), (-4, ""), (-3, "a b"), (-2, "a " * 20), (0, "a " * 19)]
    for d in range(1, 160):
        words = text(rng.choice([5, 19, 60, 200]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if d % 7 == 0:
            words = out[-3][1].split(" ")
            words[len(words) // 2] = "edited"
        out.append((d, (" " if d % 2 else "\n").join(words)))
    for d in range(200, 240):
        out.append((d, " ".join([f"head{d}", *text(4), *passages[-1], *passages[3], f"tail{d}"])))
    out += [(300 + i, out[40][1]) for i in range(5)] + [(310, " ".join(text(30_000))), (311, "a b " * 15_000)]
    return [*out, (312, out[50][1]), (312, out[50][1])]


@pytest.mark.parametrize("forced", [False, True])
def test_equals_plain(spark, rows, monkeypatch, forced):
    if forced:
        monkeypatch.setattr(sd, "HOT_ROWS", 20)
        monkeypatch.setattr(sd, "SAMPLE", 2)
        monkeypatch.setattr(sd, "SHARD", 6)
        monkeypatch.setattr(sd, "SALTS", 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    docs = docs.withColumn("key", F.lit("clash")).withColumn("start", F.lit(1)).withColumn("id", F.lit("x"))
    got = sd.drop_repeated_spans(docs).collect()
    want = plain(rows)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_rare_contexts_of_a_hot_anchor(spark, monkeypatch):
    """Rows of a hot anchor that lie alone in their partition, between rows of other anchors."""
    monkeypatch.setattr(sd, "HOT_ROWS", 30)
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "SALTS", 2)
    rng = random.Random(29)
    passage = [f"p{i}" for i in range(20)]
    rare = [(d, " ".join([f"head{d}", *passage, f"tail{d}"])) for d in range(10)]
    common = [(100 + d, " ".join(passage)) for d in range(60)]
    others = [(200 + d, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for d in range(60)]
    rows = rare + common + others
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sd.drop_repeated_spans(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == sorted(plain(rows))


@pytest.mark.parametrize("hot_rows", [20, 200_000])
def test_equal_rows_leave_one(spark, monkeypatch, hot_rows):
    """Rows doubled in id and text: alone, with a context met elsewhere, repeated earlier, null ids."""
    monkeypatch.setattr(sd, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "SHARD", 3)
    rng = random.Random(31)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, whole = text(40), " ".join(text(70))
    rows = [(1, " ".join(text(90)))] * 2 + [(2, " ".join(text(5) + shared + text(30)))] * 3
    rows += [(3, " ".join(text(9) + shared + text(4)))] * 2 + [(4, whole), (5, whole), (5, whole)]
    rows += [(6, " ".join(["a", "b"] * 30))] * 40 + [(None, " ".join(text(50)))] * 2 + [(7, "few words")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sd.drop_repeated_spans(docs).collect()
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_matching_statistics():
    rng = random.Random(2)
    automaton, added = sd.SuffixAutomaton(), []
    for _ in range(30):
        words = rng.choices(range(4), k=rng.randrange(1, 25))
        sizes = automaton.matching(words)
        for i, n in enumerate(sizes):
            best = 0
            for k in range(1, i + 2):
                part = words[i + 1 - k : i + 1]
                if any(part == a[j : j + k] for a in added for j in range(len(a))):
                    best = k
            assert n == best
        automaton.add(words)
        added.append(words)


def test_query_digest(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows[:80], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256(kept.encode()).hexdigest() for d, kept, _, _ in plain(rows[:80])}


def test_empty_table(spark):
    assert sd.drop_repeated_spans(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
