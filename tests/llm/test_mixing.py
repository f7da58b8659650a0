"""Mixes: targets, quotas filled, least repetition cost, reruns."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from covertile.llm import mixing


def check(rows, docs, exact=True):
    assert len(rows) == len(docs)
    size, got, target = Counter(), Counter(), {}
    source_of = defaultdict(list)
    for d, t, s in docs:
        source_of[d].append((s, len((t or "").split())))
    for r in rows:
        s, n = source_of[r.doc_id].pop(next(i for i, x in enumerate(source_of[r.doc_id]) if x[1] == r["size"]))
        size[s] += n
        got[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = mixing.targets(dict(size))
    for r in rows:
        assert r.source_size in size.values()
    for s in size:
        assert target[s] == pytest.approx(want[s])
        if exact:
            assert abs(got[s] - want[s]) < 1.001
    return got


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    sources = ["a", "b", "c", "é", "Z", None]
    text = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([1, 5, 40, 300])))
    rows = [(i, text(), rng.choices(sources, [9, 2, 2, 1, 1, 1])[0]) for i in range(600)]
    shared = [text() for _ in range(40)]
    rows += [(1000 + i, rng.choice(shared), rng.choice(sources)) for i in range(300)]
    rows += [(5000 + i, "hot " * 50, rng.choice(sources)) for i in range(200)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, " \n", None), (9003, "w", "b"), (9003, "w", "b"), (None, "x y", "c")]
    return rows + [(9100, "long " * 90_000, "b")]


def test_quotas_are_filled(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    df = df.withColumn("size", F.lit("clash")).withColumn("rank", F.lit("clash")).repartition(4)
    first = mixing.mix(df).collect()
    check(first, docs)
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    check(mixing.mix(df).collect(), docs)
    whole = mixing.mix(df, whole=True).collect()
    check(whole, docs, exact=False)
    assert all(r["size"] == 0 or r.taken % r["size"] == 0 for r in whole)


def test_every_pattern_takes_part(spark, monkeypatch):
    """All subsets of five sources, more arcs than ``PATTERNS``: the same mix."""
    texts = [(m, f"{m} {k} " + "w " * 8) for m in range(1, 32) for k in range(3)]
    docs = [(t, "abcde"[s]) for m, t in texts for s in range(5) if m >> s & 1]
    docs = [(i, t, s) for i, (t, s) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    want = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    got = mixing.mix(df).collect()
    check(got, docs)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_targets():
    got = mixing.targets({"b": 100, "a": 100, None: 100})
    assert got == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    assert mixing.targets({}) == {}


def cost(uses, words):
    total, level, price = 0, 0, 1
    edge = words
    while uses > level:
        step = min(uses, edge) - level
        total += price * step
        level, edge, price = level + step, edge * 2, price * 2
    return total


def test_flow_is_least_cost():
    """Against all ways to split small supplies."""
    rng = random.Random(3)
    for _ in range(40):
        supply, words = {}, {}
        for p in [(0,), (1,), (0, 1)]:
            copies = {s: rng.randrange(1, 3) for s in p}
            n = rng.randrange(1, 4)
            supply[p], words[p] = {s: n * c for s, c in copies.items()}, n
        room = {s: 2 * sum(v.get(s, 0) for v in supply.values()) for s in (0, 1)}
        quotas = {s: rng.randrange(room[s] + 1) for s in room}
        got = mixing.route(supply, words, quotas)
        arcs = [(p, s) for p in supply for s in supply[p]]
        for s in quotas:
            assert sum(x for (_, t), x in got.items() if t == s) == quotas[s]
        assert all(got[a] <= 2 * supply[a[0]][a[1]] for a in arcs)
        price = lambda x: sum(cost(sum(x[a] for a in arcs if a[0] == p), words[p]) for p in supply)
        best = min(
            price(x)
            for amounts in itertools.product(*(range(2 * supply[p][s] + 1) for p, s in arcs))
            for x in [dict(zip(arcs, amounts))]
            if all(sum(v for (_, t), v in x.items() if t == s) == quotas[s] for s in quotas)
        )
        assert price(got) == best


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(none).collect() == []
