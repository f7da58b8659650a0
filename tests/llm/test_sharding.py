"""Shards: groups together, near-equal sizes, slots without gaps."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from covertile.llm import sharding


def check(rows, docs, shards):
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter(
        (d, zlib.crc32((t or "").encode())) for d, t in docs
    )
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in docs)
    groups, by = defaultdict(set), defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        groups[r.text_crc32].add(r.shard)
        by[r.shard].append(r)
    assert all(len(s) == 1 for s in groups.values())
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return {s: sum(r["size"] for r in rs) for s, rs in by.items()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    text = lambda: "".join(rng.choices("abcdé \n", k=rng.choice([0, 3, 50, 900])))
    rows = [(i, text()) for i in range(3000)]
    rows += [(10_000 + i, "copy " * 40) for i in range(400)]
    return rows + [(None, None), (None, "x"), (5, None), (5, ""), (6, "copy " * 40), (6, "copy " * 40)]


@pytest.mark.parametrize("packs", [1024, 20])
def test_sizes_are_near_equal(spark, docs, monkeypatch, packs):
    monkeypatch.setattr(sharding, "PACKS", packs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    df = df.withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))
    sizes = check(sharding.shard_table(df, shards=8).collect(), docs, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < mean * (0.02 if packs > 20 else 0.1)


def test_one_group_with_most_of_the_rows(spark, docs):
    rows = docs[:300] + [(i, "same " * 90) for i in range(20_000, 20_900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = check(sharding.shard_table(df, shards=4).collect(), rows, 4)
    rest = sorted(sizes.values())[:-1]
    assert max(sizes.values()) >= 900 * 451 and max(rest) - min(rest) < 0.05 * max(rest)


def test_longest_first_is_the_rule():
    jobs = [(7, ("a",)), (5, ("b",)), (5, ("c",)), (4, ("d",)), (3, ("e",))]
    assert sharding.longest_first(jobs, 2) == {("a",): 0, ("b",): 1, ("c",): 1, ("d",): 0, ("e",): 1}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard_table(none).collect() == []
