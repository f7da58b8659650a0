"""Importance resampling against a plain-Python version of its rules."""

import hashlib
import math
import random
import re
import zlib

import pytest

from covertile.llm import resample as rs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_buckets(text):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % 10_000 for r in runs]


def plain_resample(docs, targets):
    s, t = [0] * 10_000, [0] * 10_000
    made = [(i, *plain_buckets(text)) for i, text in docs]
    for _, _, bs in made:
        for b in bs:
            s[b] += 1
    for text in targets:
        for b in plain_buckets(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, bs in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        rows.append((i, n, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], (r[0] is not None, r[0]), r[3], r[2]))
    drawn = able[: 5 * len(able) // 100]
    out = [(r[0], r[2], r[3], r[4], k) for k, r in enumerate(drawn, 1)]
    left = list(rows)
    for r in drawn:
        left.remove(r)
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in left], key=repr)


def tables():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["É", "naïve", "ABC", "x9", "a_b", "q-r", "非常", "z" * 300]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 19, 20, 60])))) for i in range(900)]
    docs += [(5, docs[5][1]), (7, None), (8, ""), (9, " .,\x00\n"), (None, "w1 " * 30), (None, "w1 " * 30), (77, "w1 w2 w3 " * 20_000)]
    docs += [(5000, docs[500][1])] * 40
    return docs, [" ".join(rng.choices(words[:20], k=50)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("margin", [rs.MARGIN, 1e-9, 1.0])
def test_equals_plain_version(spark, margin):
    docs, targets = tables()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    bench = spark.createDataFrame([(t,) for t in targets], "text string")
    got = rs.resample(df, bench, margin=margin)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, targets)


def test_ties_at_the_cutoff_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(rs, "noise", lambda doc_id, seed: rs.F.lit(0).cast("bigint"))
    docs = [(i, "same words here " * 10) for i in range(100, 0, -1)]
    got = rs.resample(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("same",)], "text string")
    )
    assert sorted((r["rank"], r["doc_id"]) for r in got.collect() if r["rank"]) == [(i, i) for i in range(1, 6)]


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([("a b", 1)], "text string, score int")
    assert rs.resample(none, bench).count() == 0
    df = spark.createDataFrame(
        [(i, f"w{i} " * 25, 1, 2, 3) for i in range(40)], "doc_id bigint, text string, id int, score int, rank int"
    )
    for target in (bench, none):
        got = rs.resample(df, target).collect()
        assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 40


def test_long_and_short_words_hash_like_their_runs():
    rng = random.Random(1)
    words = ["a", "bc", "é", "x9", "hello" * 20, "z" * 255, "y" * 256]
    for most in (6, 7):
        for n in (0, 1, 2, 3, 4, 50):
            text = " ".join(rng.choices(words[:most], k=n))
            assert sorted(rs.buckets_of(text).tolist()) == sorted(plain_buckets(text)[1])
