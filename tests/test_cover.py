import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import covertile as ct
from covertile.operators import exact_cover
from covertile.plans.workspace import Workspace
from graphs import greedy_cover

FILE_EXAMPLE = {1: [11, 12, 13, 14, 15, 16, 21, 22], 2: [11, 12, 13, 31, 32]}


def random_pairs(seed, sets=30, elems=60, n=260):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(sets), rnd.randrange(elems)) for _ in range(n)]
    # A set with a large share of the pairs, and an element in most sets.
    pairs += [(0, e) for e in range(0, elems, 2)] + [(s, 1) for s in range(sets - 4)]
    return pairs + pairs[:15]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "set_id bigint, elem_id bigint")


def picks(df, name="set_id"):
    return [(r["step"], r[name], r["gain"]) for r in df.orderBy("step").collect()]


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"head_sets": 6, "compact_rows": 1},
        {"head_pairs": 1},
        {"head_pairs": 40, "compact_rows": 1},
    ],
    ids=str,
)
@pytest.mark.parametrize("seed", [1])
def test_exact_cover_equals_sequential_greedy(spark, seed, options):
    pairs = random_pairs(seed)
    assert picks(ct.greedy_set_cover(frame(spark, pairs), **options)) == greedy_cover(pairs)


def test_disjoint_groups_take_few_rounds(spark):
    # 40 groups that share nothing: one round picks the winner of each.
    pairs = [(10 * g + s, 100 * g + e) for g in range(40) for s in range(3) for e in range(s + 2)]
    found = ct.greedy_set_cover(frame(spark, pairs), max_rounds=2)
    assert picks(found) == greedy_cover(pairs)


def test_a_round_settles_thousands_of_sets(spark):
    pairs = [(s, 2 * s + e) for s in range(2500) for e in range(2)]
    found = ct.greedy_set_cover(frame(spark, pairs), max_rounds=1)
    assert picks(found) == [(s + 1, s, 2) for s in range(2500)]


@pytest.mark.parametrize("options", [{}, {"head_sets": 6, "compact_rows": 1}], ids=str)
def test_stored_lists_are_cut_and_lose_no_pair(spark, monkeypatch, options):
    """Pairs are stored as lists of bounded length, also those of a set or an element in most pairs."""
    monkeypatch.setattr(exact_cover, "LIST", 3)
    lists = []
    write = Workspace.write

    def watch(self, df, name, *args, **kw):
        out = write(self, df, name, *args, **kw)
        if name in ("sorted", "holders"):
            lists.append([len(r[0]) for r in out.select("elems" if name == "sorted" else "sets").collect()])
        return out

    monkeypatch.setattr(Workspace, "write", watch)
    pairs = random_pairs(5)
    assert picks(ct.greedy_set_cover(frame(spark, pairs), **options)) == greedy_cover(pairs)
    assert [sum(n) for n in lists] == [len(set(pairs))] * 2
    assert all(max(n) < 12 for n in lists)


def test_hitting_set_is_the_dual(spark):
    pairs = random_pairs(3)
    expected = greedy_cover([(e, s) for s, e in pairs])
    assert picks(ct.greedy_hitting_set(frame(spark, pairs)), "elem_id") == expected


def test_tie_rules(spark):
    pairs = [(s, e) for e in range(12) for s in (e, e + 12, e + 24)]
    by_hash = ct.greedy_set_cover(frame(spark, pairs), ties="hash", seed=9)
    md5 = lambda s: hashlib.md5(f"9:{s}".encode()).hexdigest()
    assert picks(by_hash) == greedy_cover(pairs, md5)
    drawn = random.Random(9).randint(-9, 9)
    near = ct.greedy_set_cover(frame(spark, pairs), ties="distance", seed=9)
    assert picks(near) == greedy_cover(pairs, lambda s: abs(drawn - s % 10))


@pytest.mark.parametrize("options", [{}, {"hot_rows": 5, "compact_rows": 1}], ids=str)
@pytest.mark.parametrize("batch", [0.2, 0.6])
def test_batched_cover_is_complete(spark, batch, options):
    pairs = random_pairs(4)
    df = frame(spark, pairs)
    found = ct.greedy_set_cover(df, batch=batch, **options)
    rows = picks(found)
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert len({r[1] for r in rows}) == len(rows)
    assert sum(r[2] for r in rows) == len({e for _, e in pairs})
    assert ct.uncovered(df, found).count() == 0
    # The size stays near that of exact greedy.
    assert len(rows) <= 2 * len(greedy_cover(pairs))


def test_batches_save_rounds(spark):
    pairs = [(s, 100 * s + e) for s in range(50) for e in range(20)]
    pairs += [(s, 100 * (s + 1)) for s in range(49)]
    found = ct.greedy_set_cover(frame(spark, pairs), batch=0.5, max_rounds=3)
    assert sum(r[2] for r in picks(found)) == len({e for _, e in pairs})


def redrawn_cover(pairs, seed):
    """Sequential greedy that draws the number of its tie rule for every pick."""
    left, out = {}, []
    for s, e in pairs:
        left.setdefault(s, set()).add(e)
    while left:
        draw = random.Random(f"{seed}:{len(out) + 1}").randint(-9, 9)
        pick = min(left, key=lambda s: (-len(left[s]), abs(draw - s % 10), s))
        gone = left.pop(pick)
        out.append((len(out) + 1, pick, len(gone)))
        left = {s: e - gone for s, e in left.items() if e - gone}
    return out


@pytest.mark.parametrize("options", [{}, {"head_sets": 5}, {"head_pairs": 40, "compact_rows": 1}], ids=str)
@pytest.mark.parametrize("seed", [2])
def test_ties_redrawn_for_every_pick(spark, seed, options):
    pairs = random_pairs(seed) + [(s, 1000 + e) for e in range(12) for s in (e, e + 12, e + 24)]
    found = ct.greedy_set_cover(frame(spark, pairs), ties="redraw", seed=seed, **options)
    assert picks(found) == redrawn_cover(pairs, seed)


def test_string_and_struct_ids(spark):
    pairs = random_pairs(3)
    df = frame(spark, pairs).selectExpr("format_string('s%03d', set_id) AS set_id", "named_struct('a', elem_id) AS elem_id")
    assert picks(ct.greedy_set_cover(df)) == [(n, f"s{s:03d}", g) for n, s, g in greedy_cover(pairs)]


def test_rounds_do_not_shuffle_the_stored_pairs(spark, monkeypatch):
    """Heads and newly covered elements are broadcast to the scan of the pairs."""
    plans = []
    measured = Workspace.measured

    def watch(self, df, name, *args, **kw):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return measured(self, df, name, *args, **kw)

    monkeypatch.setattr(Workspace, "measured", watch)
    pairs = random_pairs(1)
    assert picks(ct.greedy_set_cover(frame(spark, pairs), head_sets=5)) == greedy_cover(pairs)
    rounds = [p for n, p in plans if n.startswith(("won", "gains")) and n != "gains0"]
    assert len(rounds) > 4
    for plan in rounds:
        scans = [part for part in plan.split("Exchange hashpartitioning") if "/sorted" in part]
        assert all("BroadcastHashJoin" in part for part in scans)


def test_trials(spark):
    pairs = [(s, e) for e in range(10) for s in (e, e + 10, e // 2 + 40)]
    result = ct.cover_trials(frame(spark, pairs), trials=3, seed=6)
    for trial in (1, 2, 3):
        md5 = lambda s: hashlib.md5(f"6:{trial}:{s}".encode()).hexdigest()  # noqa: B023, E731
        assert picks(result.where(f"trial = {trial}")) == greedy_cover(pairs, md5)
    batched = ct.cover_trials(frame(spark, pairs), trials=2, seed=6, batch=0.3)
    sizes = {r["trial"]: r["size"] for r in ct.trial_sizes(batched).collect()}
    assert set(sizes) == {1, 2}
    gains = batched.groupBy("trial").sum("gain").collect()
    assert {r[1] for r in gains} == {10}


def test_example_of_the_text_format(spark):
    pairs = [(s, e) for s, members in FILE_EXAMPLE.items() for e in members]
    assert picks(ct.greedy_set_cover(frame(spark, pairs))) == [(1, 1, 8), (2, 2, 2)]


def test_bad_arguments(spark):
    df = frame(spark, [(1, 1)])
    with pytest.raises(ValueError):
        ct.greedy_set_cover(df, batch=1.0)
    with pytest.raises(ValueError):
        ct.greedy_set_cover(df, ties="coin")
    with pytest.raises(ValueError):
        ct.cover_trials(df, trials=0)
    with pytest.raises(RuntimeError):
        ct.greedy_set_cover(frame(spark, random_pairs(1)), max_rounds=1, head_sets=1)
    with pytest.raises(RuntimeError):
        ct.greedy_set_cover(frame(spark, random_pairs(1)), batch=0.5, max_rounds=1)
    with pytest.raises(ValueError):
        ct.greedy_set_cover(df, ties="redraw", batch=0.5)
    assert picks(ct.greedy_set_cover(df.where("set_id > 5"))) == []


def plain_batch(pairs, eps):
    """The rule of batched rounds, on sets in memory."""
    left = {}
    for s, e in pairs:
        left.setdefault(e, set()).add(s)
    order = lambda s: (hashlib.md5(f"0:{s}".encode()).hexdigest(), s)
    out, keep = [], 1 - eps
    while left:
        gain = {}
        for sets in left.values():
            for s in sets:
                gain[s] = gain.get(s, 0) + 1
        floor = max(gain.values()) * keep
        able = {s for s, g in gain.items() if g >= floor}
        first = [min(sets & able, key=order) for sets in left.values() if sets & able]
        accepted = {s for s in able if first.count(s) >= floor * keep}
        taken = {e: min(sets & accepted, key=order) for e, sets in left.items() if sets & accepted}
        round_ = [(-list(taken.values()).count(s), s) for s in set(taken.values())]
        out += [(s, -g) for g, s in sorted(round_)]
        left = {e: sets for e, sets in left.items() if e not in taken}
    return [(i + 1, s, g) for i, (s, g) in enumerate(out)]


@pytest.mark.parametrize("batch", [0.2, 0.5])
def test_batched_picks_follow_the_rule(spark, batch):
    pairs = random_pairs(8)
    assert picks(ct.greedy_set_cover(frame(spark, pairs), batch=batch)) == plain_batch(pairs, batch)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_certificate_is_a_lower_bound(spark, by):
    pairs = random_pairs(2, sets=9, elems=12, n=40)
    df = frame(spark, pairs).withColumn("k", F.lit(1))
    found = ct.certified(df, ct.greedy_set_cover(df, batch=0.5, by=by), by=by).collect()
    held = {}
    for s, e in pairs:
        held.setdefault(s, set()).add(e)
    every = set().union(*held.values())
    least = next(
        n for n in range(1, 10) if any(set().union(*(held[s] for s in c)) == every for c in combinations(held, n))
    )
    # The bound by fractions, from the picks in order.
    price, left = {}, set(every)
    for row in sorted(found, key=lambda r: r["step"]):
        for e in held[row["set_id"]] & left:
            price[e] = 10**12 // row["gain"]
        left -= held[row["set_id"]]
    most = max(sum(price[e] for e in members) for members in held.values())
    assert {r["at_least"] for r in found} == {-(-sum(price.values()) // most)}
    assert 1 <= found[0]["at_least"] <= least <= len(found)


@pytest.mark.parametrize("batch", [None, 0.5])
def test_null_pairs_and_no_pairs(spark, batch):
    df = spark.createDataFrame([(None, 1), (2, 3), (4, None)], "set_id bigint, elem_id bigint")
    assert picks(ct.greedy_set_cover(df, batch=batch)) == [(1, 2, 1)]
    assert picks(ct.greedy_set_cover(df.where("set_id IS NULL"), batch=batch)) == []


@pytest.mark.parametrize("options", [{}, {"head_sets": 5, "compact_rows": 1}], ids=str)
def test_trials_share_stored_pairs(spark, options):
    pairs = random_pairs(6)
    df = frame(spark, pairs)
    got = ct.cover_trials(df, trials=3, seed=4, **options).collect()
    for trial in (1, 2, 3):
        md5 = lambda s, t=trial: hashlib.md5(f"4:{t}:{s}".encode()).hexdigest()
        own = sorted((r["step"], r["set_id"], r["gain"]) for r in got if r["trial"] == trial)
        assert own == greedy_cover(pairs, md5)
