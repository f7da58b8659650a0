import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

import covertile as ct
from covertile.functions import hash_priority

from graphs import FIXTURES, first_fit, longest_path, neighbours, repair

LAYOUTS = [
    {},
    {"join": "broadcast"},
    {"layout": "adjacency"},
    {"compact_rows": 1, "hot_rows": 2},
    {"layout": "adjacency", "neighbours": 2, "compact_rows": 1},
]


def frames(spark, priority, edges):
    v = spark.createDataFrame(list(priority.items()), "id bigint, priority bigint")
    return v, spark.createDataFrame(edges, "src bigint, dst bigint")


def colors(df):
    rows = df.collect()
    found = {r["id"]: r["color"] for r in rows}
    assert len(found) == len(rows)
    return found


def random_graph(seed, n=24, m=36):
    rnd = random.Random(seed)
    # Equal priorities on purpose: the id decides. Vertex 0 touches everything.
    priority = {v: rnd.randint(1, 9) for v in range(n)}
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    return priority, edges + [(0, v) for v in range(n - 3)] + edges[:10]


@pytest.mark.parametrize("name", FIXTURES)
def test_fixture_colors(spark, name):
    priority, edges, expected = FIXTURES[name]
    v, e = frames(spark, priority, edges)
    asked = {
        "greedy": ct.color_greedy(v, e),
        "rounds": ct.color_rounds(v, e),
        "repair": ct.color_repair(v, e),
    }
    for rule, result in asked.items():
        found = colors(result)
        assert [found[i] for i in sorted(priority)] == expected[rule], rule
    assert colors(ct.color_repair(v, e, freeze=False)) == colors(asked["repair"])


@pytest.mark.parametrize("options", LAYOUTS, ids=str)
def test_physical_choices_do_not_change_greedy(spark, options):
    priority, edges = random_graph(1)
    v, e = frames(spark, priority, edges)
    assert colors(ct.color_greedy(v, e, **options)) == first_fit(priority, edges)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("covertile")]


@pytest.mark.parametrize(
    "options", [{"hot_rows": 2}, {"compact_rows": 1}], ids=str
)
def test_rounds_equal_longest_path(spark, options):
    priority, edges = random_graph(2)
    v, e = frames(spark, priority, edges)
    assert colors(ct.color_rounds(v, e, **options)) == longest_path(priority, edges)


@pytest.mark.parametrize("freeze", [True, False])
def test_repair_equals_simulation(spark, freeze):
    priority, edges = random_graph(3, n=40, m=50)
    v, e = frames(spark, priority, edges)
    found = colors(ct.color_repair(v, e, freeze=freeze))
    assert found == repair(priority, edges, freeze)


def test_repair_by_keys(spark):
    graphs = {k: random_graph(k, n=20, m=25) for k in ("7", "8")}
    v = [(k, i, p) for k, (priority, _) in graphs.items() for i, p in priority.items()]
    e = [(k, a, b) for k, (_, edges) in graphs.items() for a, b in edges]
    found = ct.color_repair(
        spark.createDataFrame(v, "k string, id bigint, priority bigint"),
        spark.createDataFrame(e, "k string, src bigint, dst bigint"),
        by=["k"],
        freeze=False,
    )
    rows = found.collect()
    for k, (priority, edges) in graphs.items():
        assert {r["id"]: r["color"] for r in rows if r["k"] == k} == repair(priority, edges, False)


@pytest.mark.parametrize("rule", [ct.color_greedy, ct.color_repair])
def test_a_vertex_given_twice_has_its_least_priority(spark, rule):
    priority, edges = random_graph(1)
    v, e = frames(spark, priority, edges)
    more = v.union(v.selectExpr("id", "priority + 3").where("id % 3 = 0")).union(v.where("id < 4"))
    assert colors(rule(more, e)) == colors(rule(v, e))


def test_edges_without_an_end(spark):
    v, e = frames(spark, {1: 1, 2: 2, 3: 3}, [(1, 2), (2, None), (None, None)])
    flat = v.selectExpr("id", "int(id) AS color")
    bad = ct.validate_coloring(flat, e).collect()
    assert sorted((r.src, r.dst, r.color) for r in bad if r.src) == [(2, None, None)] and len(bad) == 2
    for rule in (ct.color_greedy, ct.color_rounds, ct.color_repair):
        with pytest.raises(Exception, match="null end"):
            rule(v, e)
    with pytest.raises(Exception, match="null end"):
        ct.undirected(e).collect()


def test_freezing_is_a_different_rule():
    differing = 0
    for seed in range(20):
        priority, edges = random_graph(seed, n=40, m=50)
        differing += repair(priority, edges, True) != repair(priority, edges, False)
    assert differing


def test_hashed_priority_needs_no_vertices(spark):
    _, edges = random_graph(4)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    ids = {v for edge in edges if edge[0] != edge[1] for v in edge}
    priority = {v: hashlib.md5(f"7:{v}".encode()).hexdigest() for v in ids}
    assert colors(ct.color_greedy(None, e, seed=7)) == first_fit(priority, edges)


def test_validity_and_counts(spark):
    priority, edges = random_graph(5)
    v, e = frames(spark, priority, edges)
    found = ct.color_greedy(v, e)
    assert ct.validate_coloring(found, e).count() == 0
    counts = ct.n_colors(found).first()
    degree = max(len(n) for n in neighbours(priority, edges).values())
    assert counts["colors"] == counts["max_color"] <= degree + 1
    flat = v.selectExpr("id", "1 AS color")
    bad = ct.validate_coloring(flat, e).count()
    assert bad == sum(a != b for a, b in edges)


def test_trials_match_single_runs(spark):
    _, edges = random_graph(6)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    for algo, rule in [("color_greedy", first_fit), ("color_rounds", longest_path)]:
        result = ct.coloring_trials(None, e, trials=3, seed=5, algo=algo)
        rows = result.collect()
        ids = {r["id"] for r in rows}
        for trial in (1, 2, 3):
            priority = {v: hashlib.md5(f"5:{trial}:{v}".encode()).hexdigest() for v in ids}
            found = {r["id"]: r["color"] for r in rows if r["trial"] == trial}
            assert found == rule(priority, edges)
        sizes = {r["trial"]: r["size"] for r in ct.trial_sizes(result).collect()}
        best = ct.best_of_trials(result)
        kept = {r["trial"] for r in best.collect()}
        assert kept == {min(sizes, key=lambda t: (sizes[t], t))}


def test_round_limit_and_bad_input(spark):
    priority, edges, _ = FIXTURES["petersen"]
    v, e = frames(spark, priority, edges)
    with pytest.raises(ct.NotConverged):
        ct.color_greedy(v, e, max_rounds=2)
    with pytest.raises(ct.NotConverged):
        ct.color_repair(v, e, max_rounds=1)
    with pytest.raises(ValueError):
        ct.color_greedy(v, e, join="cartesian")
    with pytest.raises(ValueError):
        ct.color_greedy(v, e, layout="matrix")
    with pytest.raises(ValueError):
        ct.color_greedy(v, e, max_rounds=0)
    with pytest.raises(ValueError):
        ct.color_greedy(v.select("id").where("id > 3"), e)


def test_no_edges(spark):
    v = spark.range(5)
    e = spark.createDataFrame([], "src bigint, dst bigint")
    for rule in (ct.color_greedy, ct.color_rounds, ct.color_repair):
        assert set(colors(rule(v, e)).values()) == {1}


def test_priority_is_reproducible(spark):
    a = ct.assign_priority(spark.range(50), 3).collect()
    assert a == ct.assign_priority(spark.range(50), 3).collect()
    assert a != ct.assign_priority(spark.range(50), 4).collect()
    assert len({r["priority"] for r in a}) == 50
    plain = spark.range(1).select(hash_priority(F.col("id"))).first()[0]
    assert plain == hashlib.md5(b"0").hexdigest()


@pytest.mark.parametrize("n,v,t", [(3, 2, 2), (4, 3, 2), (4, 2, 3)])
def test_tuples_are_coloured_without_edges(spark, n, v, t):
    tuples = ct.all_tuples(ct.synthetic_domain(spark, n, v), t)
    edges = ct.conflict_graph(tuples)
    ids = tuples.selectExpr("tuple_id AS id")
    found = ct.color_tuples(tuples, seed=1)
    assert colors(found) == colors(ct.color_greedy(ids, edges, seed=1))
    rows = ct.rows_from_coloring(tuples, found, [f"p{i:02d}" for i in range(1, n + 1)])
    # Every tuple is contained in the row of its colour.
    made = {r["color"]: r.asDict() for r in rows.collect()}
    for row in tuples.withColumnRenamed("tuple_id", "id").join(found, "id").collect():
        assert all(made[row["color"]][i["var"]] == i["value"] for i in row["items"])
    assert v**t <= len(made)


@pytest.mark.parametrize("rule", [ct.color_greedy, ct.color_rounds, ct.color_repair])
@pytest.mark.parametrize("edge", [(2, 99), (99, 2), (-1, 1)])
def test_edges_of_unknown_vertices_raise(spark, rule, edge):
    e = spark.createDataFrame([(1, 2), edge], "src bigint, dst bigint")
    for v in ("id bigint", "id bigint, priority bigint"):
        rows = [(1, 1), (2, 2)] if "," in v else [(1,), (2,)]
        with pytest.raises(ValueError, match="not among the vertices"):
            rule(spark.createDataFrame(rows, v), e)


def test_uncoloured_ends_are_not_valid(spark):
    e = spark.createDataFrame([(1, 2), (3, 4), (1, 5)], "src bigint, dst bigint")
    c = spark.createDataFrame([(1, 1), (3, 2), (4, 2), (5, 3)], "id bigint, color int")
    found = {tuple(r) for r in ct.validate_coloring(c, e).collect()}
    assert found == {(1, 2, None), (3, 4, 2)}


def test_conflicting_tuples_do_not_merge(spark):
    items = "array<struct<var:string,value:string>>"
    t = spark.createDataFrame([("p", [("x", "1")]), ("q", [("x", "2")])], f"tuple_id string, items {items}")
    c = spark.createDataFrame([("p", 1), ("q", 1)], "id string, color int")
    with pytest.raises(Exception, match="differ in"):
        ct.rows_from_coloring(t, c, ["x"]).collect()


@pytest.mark.parametrize("rule", [ct.color_greedy, ct.color_rounds, ct.color_repair])
def test_no_edges(spark, rule):
    e = spark.createDataFrame([], "src bigint, dst bigint")
    assert rule(None, e).collect() == []
    v = spark.createDataFrame([(4,)], "id bigint")
    assert [tuple(r) for r in rule(v, e).collect()] == [(4, 1)]


def test_rounds_are_folded_and_stages_deleted(spark, monkeypatch):
    from covertile.plans import workspace

    monkeypatch.setattr(workspace, "FOLD", 2)
    made = []
    finish = workspace.Workspace.finish
    monkeypatch.setattr(
        workspace.Workspace, "finish", lambda self, *kept: (made.append((self, kept)), finish(self, *kept))
    )
    priority, edges = random_graph(7)
    v, e = frames(spark, priority, edges)
    assert colors(ct.color_greedy(v, e)) == first_fit(priority, edges)
    ws, kept = made[-1]
    left = {p.name for p in pathlib.Path(ws.root.removeprefix("file://")).iterdir()}
    assert kept == ("result",) and left == {"result"}


def test_round_join_uses_all_shuffle_partitions(spark, capsys, monkeypatch):
    """Without broadcasts the edges of a round are dealt to as many tasks as any other exchange."""
    priority, edges = random_graph(8)
    v, e = frames(spark, priority, edges)
    plans = []
    from covertile.operators import coloring

    sent = coloring._sent
    monkeypatch.setattr(coloring, "_sent", lambda ws, *a: plans.append(ws) or sent(ws, *a))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        measured = coloring.Workspace.measured
        texts = []

        def watch(self, df, name, *a, **k):
            if name == "state2":
                df.explain("simple")
                texts.append(capsys.readouterr().out)
            return measured(self, df, name, *a, **k)

        monkeypatch.setattr(coloring.Workspace, "measured", watch)
        ct.color_greedy(v, e)
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)
    joined = [line for line in texts[0].splitlines() if "Exchange hashpartitioning(id" in line]
    assert joined and all(", 7)" in line for line in joined)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 2, "compact_rows": 1}, {"layout": "adjacency", "neighbours": 2}], ids=str)
def test_trials_share_stored_edges(spark, options):
    _, edges = random_graph(9)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    ids = {v for edge in edges for v in edge}
    v = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = ct.coloring_trials(v, e, trials=3, seed=5, **options).collect()
    for trial in (1, 2, 3):
        priority = {i: hashlib.md5(f"5:{trial}:{i}".encode()).hexdigest() for i in ids}
        assert {r["id"]: r["color"] for r in got if r["trial"] == trial} == first_fit(priority, edges)


def matched_classes(tuples, largest_first):
    """Batch colouring in memory: tuples are (id, rank, {var: value})."""
    subsets = {}
    for id_, rank, held in tuples:
        subsets.setdefault(tuple(sorted(held)), []).append((rank, id_, held))
    classes, out = {}, {}
    for vars_ in sorted(subsets, key=lambda s: (-len(subsets[s]) if largest_first else 0, s)):
        waiting = sorted(subsets[vars_], key=lambda t: t[:2])
        before = {c: set(h) & set(vars_) for c, h in classes.items()}
        for shape in sorted({tuple(sorted(b)) for b in before.values()}, key=lambda p: (-len(p), p)):
            open_ = {}
            for c in sorted(c for c, b in before.items() if b == set(shape)):
                open_.setdefault(tuple(classes[c][v] for v in shape), []).append(c)
            left = []
            for t in waiting:
                fits = open_.get(tuple(t[2][v] for v in shape), [])
                if fits:
                    out[t[1]] = fits.pop(0)
                    classes[out[t[1]]].update(t[2])
                else:
                    left.append(t)
            waiting = left
        for t in waiting:
            out[t[1]] = len(classes) + 1
            classes[out[t[1]]] = dict(t[2])
    return out


@pytest.mark.parametrize("largest_first", [True, False])
def test_color_tuples_in_batches(spark, largest_first):
    rnd = random.Random(2)
    rows = [tuple(rnd.choice("abcdef"[: n + 2]) for n in range(4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "p string, q string, r string, s string")
    tuples = ct.tway_tuples(df, ["p", "q", "r", "s"], 2)
    found = ct.color_tuples(tuples, seed=3, batch=True, largest_first=largest_first)
    plain = [
        (r["tuple_id"], hashlib.md5(f"3:{r['tuple_id']}".encode()).hexdigest(), {i["var"]: i["value"] for i in r["items"]})
        for r in tuples.collect()
    ]
    assert colors(found) == matched_classes(plain, largest_first)
    # A valid colouring: every class merges into one row.
    merged = ct.rows_from_coloring(tuples, found, ["p", "q", "r", "s"]).count()
    assert merged == max(colors(found).values()) >= max(len({(r[2], r[3]) for r in rows}), 1)


@pytest.mark.parametrize("batch", [False, True])
def test_color_tuples_by_groups(spark, batch):
    rnd = random.Random(5)
    parts = []
    for k in ("x", "y"):
        rows = [tuple(rnd.choice("abc") for _ in range(3)) for _ in range(9)]
        df = spark.createDataFrame(rows, "p string, q string, r string")
        parts.append(ct.tway_tuples(df, ["p", "q", "r"], 2).withColumn("k", F.lit(k)))
    found = ct.color_tuples(parts[0].union(parts[1]), batch=batch, by=["k"]).collect()
    for k, part in zip("xy", parts):
        alone = ct.color_tuples(part.drop("k"), batch=batch)
        if batch:
            # Subsets are ordered by their tuples in all groups; sizes decide nothing here but the order.
            assert ct.validate_coloring(
                spark.createDataFrame([(r["id"], r["color"]) for r in found if r["k"] == k], "id string, color int"),
                ct.conflict_graph(part.drop("k")),
            ).count() == 0
        else:
            assert {r["id"]: r["color"] for r in found if r["k"] == k} == colors(alone)
