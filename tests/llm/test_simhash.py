"""SimHash groups against a plain-Python version that compares all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from covertile.llm import simhash as sh


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """(id, fp) -> smallest reachable id, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "x\x1cy", "非"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 200]))) for _ in range(40)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append("\t".join(w))
    long = " ".join(rng.choices(vocabulary, k=90_000))
    return [*out, None, "", "  \n", "one", "ONE", base[0].upper(), long, long + " end", base[1], base[1]]


@pytest.fixture(scope="module")
def rows():
    return [(7 * i % 1000, t) for i, t in enumerate(texts())] + [(None, "two words"), (3, "two words")]


@pytest.mark.parametrize("exact_blocks,bucket", [(1, 512), (2, 512), (1, 2)])
def test_groups_equal_all_pairs(spark, rows, exact_blocks, bucket):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1)).repartition(3)
    got = sh.near_duplicates(docs, exact_blocks=exact_blocks, bucket=bucket).collect()
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = [(d, fp, c) for (d, fp), c in zip(fps, plain_groups(fps))]
    key = lambda r: repr(r)
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=key) == sorted(want, key=key)


def test_dense_cloud_of_fingerprints(spark):
    """Fingerprints around few centres: chains of links, and keys above the bucket size."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from covertile.llm.components import components
    from covertile.plans.workspace import Workspace

    want = plain_groups(list(enumerate(fps)))
    for bucket in (512, 20):
        ws = Workspace(spark, "test")
        found = sh.links(ws, spark.createDataFrame(signed, "fp bigint"), 1, bucket)
        group = {r.node % (1 << 64): r.root for r in components(ws, found).collect()}
        label = [group.get(f, i) for i, f in enumerate(fps)]
        assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


@pytest.mark.parametrize("broadcast_stars", [0, 100_000])
def test_words_of_crowded_fingerprints_are_not_broadcast(spark, monkeypatch, broadcast_stars):
    """Each crowded fingerprint has some 1,300 words: they are dealt to tasks, however small their source."""
    from covertile.plans.workspace import Workspace

    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(80)}
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(20)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    plans = {}
    write = Workspace.write

    def watched(self, df, name, split=None):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return write(self, df, name, split)

    monkeypatch.setattr(Workspace, "write", watched)
    monkeypatch.setattr(sh, "TASK_CROWD", 50, raising=False)
    monkeypatch.setattr(sh, "BROADCAST_STARS", broadcast_stars, raising=False)
    ws = Workspace(spark, "test")
    found = sh.links(ws, spark.createDataFrame(signed, "fp bigint").coalesce(1), 1, 20).collect()
    joined = [line for line in plans["links"].splitlines() if "Join [word" in line]
    assert len(joined) == 1 and "BuildLeft" not in joined[0]
    assert ("BroadcastHashJoin" in joined[0]) == bool(broadcast_stars)
    for name in ("stars", "links"):
        dealt = re.findall(r"hashpartitioning\(fp#\d+L?, (\d+)\), REPARTITION_BY_NUM", plans[name])
        assert dealt and int(dealt[0]) > 1
    label, want = {f: f for f in fps}, plain_groups(list(enumerate(fps)))
    for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in found):
        assert (a ^ b).bit_count() <= 4
        old, new = label[a], label[b]
        label = {f: new if x == old else x for f, x in label.items()}
    label = [label[f] for f in fps]
    assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


def test_two_words_near_each_other_share_a_codeword():
    import numpy as np

    rng = random.Random(1)
    tables = sh.code_tables()
    a = np.array([rng.getrandbits(23) for _ in range(3000)], np.uint32)
    b = a ^ np.array([sum(1 << i for i in rng.sample(range(23), rng.randrange(3))) for _ in a], np.uint32)
    ka, kb = (sh.neighbour_codewords(x, tables) for x in (a, b))
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sh.near_duplicates(none).collect() == []
