"""The pipeline on small tables against plain versions of its stages."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from covertile.llm import mixing
from covertile.plans.workspace import Workspace

from test_decontaminate import plain as plain_matches
from test_simhash import plain_fingerprint, plain_groups


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}le" for a in "bcdfgh" for b in ("an", "er", "on", "it", "us")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(20)) for i in range(8)]
    rows, labels = [], []
    for i in range(300):
        t, bad = text(rng.choice([30, 80])), i % 9 == 0
        if bad:
            t += " idiot scum"
        elif i % 10 == 1:
            t = text(10) + " " + items[i % 8][1] + " " + text(10)
        rows.append((i, t, rng.choice(["s1", "s2", "s3", None])))
        labels.append((i, int(bad)))
    near = text(80).split()
    for i in range(30):
        near[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(near), "s1"))
    rows += [(2000, None, "s1"), (2001, "", "s2"), (2002, "\n", None), (None, text(50), "s2")]
    rows += [rows[4], rows[4], (rows[7][0], text(40), "s3"), (3000, text(60_000), "s2")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs = docs.select(
        "doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"),
        F.lit("clash").alias("shard"), F.lit("clash").alias("size"), F.lit(5).alias("matches"),
    )
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_equal_plain_versions(spark, tables):
    path, rows, items = tables
    ws, docs = Workspace(spark, "test"), spark.read.parquet(f"{path}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.write(stage(spark, docs, path), name)
        assert name == "shard" or docs.columns == columns
        out[name] = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    count = lambda x: Counter(x)
    toxic = [r for r in rows if "idiot" in (r[1] or "")]
    assert count(out["toxicity"]) == count(rows) - count(toxic) and len(toxic) > 20
    # One of each group, and the smallest id (null is smaller than any)
    given = out["toxicity"]
    fps = [plain_fingerprint(t) for _, t, _ in given]
    group = plain_groups(list(enumerate(fps)))
    first = {}
    for g, r in zip(group, given):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(r[0] or -1 for r in out["near_dedup"]) == sorted(r[0] or -1 for r in first.values())
    assert not count(out["near_dedup"]) - count(given)
    given = out["near_dedup"]
    leaks = {d for d, _ in ((m[0], 0) for m in plain_matches([(k, r[1]) for k, r in enumerate(given)], items))}
    assert count(out["decontaminate"]) == count(r for k, r in enumerate(given) if k not in leaks) and leaks
    given, words = out["decontaminate"], lambda t: len((t or "").split())
    size = Counter()
    for _, t, s in given:
        size[s] += words(t)
    want, got = mixing.targets(dict(size)), Counter()
    for _, t, s in out["mix"]:
        got[s] += words(t)
    largest = {s: max(words(t) for _, t, x in given if x == s) for s in size}
    assert all(abs(got[s] - want[s]) <= largest[s] / 2 + 1 for s in size)
    assert all(n <= 2 * count(given)[r] for r, n in count(out["mix"]).items())
    assert count(out["shard"]) == count(out["mix"])
    last = docs.select("shard", "slot", "text").collect()
    shards = {}
    for r in last:
        shards.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    of = {}
    assert all(of.setdefault(zlib.crc32(r.text.encode()), r.shard) == r.shard for r in last)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_are_told_apart_with_and_without_a_scan(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for rule in (corpus_pipeline.simhash.keep_one, mixing.mixed_rows):
        kept = [Counter(map(tuple, rule(docs, scan=scan).collect())) for scan in (True, False)]
        assert kept[0] == kept[1] and len(kept[0]) > 50
