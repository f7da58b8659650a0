import hashlib
from itertools import combinations, product
from math import comb

import pytest

import covertile as ct
from covertile.operators.tuples import column_subsets
from covertile.plans.ranks import ranked
from covertile.plans.workspace import Workspace
from pyspark.sql import functions as F

ROWS = [
    ("x", 1, "p|q", None),
    ("x", 2, "p:q", "u"),
    ("y", 1, "p\\q", "u"),
    ("x", 1, "p|q", "u"),
    ("x", 1, "p|q", None),
    (None, 3, "r", "w"),
]
COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "a string, b int, c string, d string")


def clean(v):
    return str(v).replace("\\", "\\\\").replace("|", "\\|").replace(":", "\\:")


def text(row, subset):
    return "|".join(f"{c}:{clean(row[COLS.index(c)])}" for c in subset)


def observed(t):
    found = {}
    for row in ROWS:
        for s in combinations(COLS, t):
            if all(row[COLS.index(c)] is not None for c in s):
                found[text(row, s)] = found.get(text(row, s), 0) + 1
    return found


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.mark.parametrize("t", [2, 3, 4])
def test_tuples_with_support(df, t):
    rows = ct.tway_tuples(df, COLS, t).collect()
    assert {r["tuple_id"]: r["support"] for r in rows} == {md5(k): n for k, n in observed(t).items()}


def test_sliding_subsets():
    assert column_subsets(["a", "b", "c", "d"], 3, "sliding") == [
        ("a", "b", "c"), ("a", "c", "d"), ("b", "c", "d"),
    ]
    assert set(column_subsets(COLS, 2, "sliding")) == set(column_subsets(COLS, 2))


@pytest.mark.parametrize("t,n,v,conflicts", [
    (2, 3, 2, 42), (2, 4, 3, 864), (3, 4, 2, 400), (2, 5, 3, 1980), (3, 6, 2, 7760), (3, 3, 2, 28),
])
def test_closed_forms(spark, t, n, v, conflicts):
    tuples = ct.all_tuples(ct.synthetic_domain(spark, n, v), t)
    assert tuples.count() == comb(n, t) * v**t
    edges = ct.conflict_graph(tuples)
    assert edges.count() == edges.distinct().count() == conflicts
    assert edges.where("src >= dst").count() == 0


def test_full_factorial_and_its_incidence(spark):
    rows = ct.all_rows(ct.synthetic_domain(spark, 4, 3))
    names = [c for c in rows.columns if c != "row_id"]
    made = {tuple(r[c] for c in names) for r in rows.collect()}
    assert made == set(product("123", repeat=4))
    pairs = ct.incidence(rows, names, 2, row_id="row_id")
    assert pairs.count() == comb(4, 2) * 3**4
    swapped = ct.incidence(rows, names, 2, row_id="row_id", by="tuple")
    assert swapped.select("elem_id", "set_id").exceptAll(pairs.select("set_id", "elem_id")).isEmpty()
    assert ct.incidence(rows, names, 2).exceptAll(pairs).isEmpty()


def test_conflicts_with_cells_and_lanes(spark, df, monkeypatch):
    tuples = ct.tway_tuples(df, COLS, 2)
    rows = {r["tuple_id"]: {i["var"]: i["value"] for i in r["items"]} for r in tuples.collect()}
    expected = {
        (a, b)
        for a, b in combinations(sorted(rows), 2)
        if any(rows[a][v] != rows[b][v] for v in rows[a].keys() & rows[b].keys())
    }
    for cell in (4096, 2):
        monkeypatch.setattr("covertile.operators.graphs.CELL", cell)
        found = [tuple(r) for r in ct.conflict_graph(tuples).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_coverage_and_missing(spark, df):
    covered = {r["variables"]: r for r in ct.coverage(df, COLS, 2).collect()}
    seen = observed(2)
    domain = {c: {clean(r[i]) for r in ROWS if r[i] is not None} for i, c in enumerate(COLS)}
    absent = set()
    for s in combinations(COLS, 2):
        every = {
            f"{s[0]}:{x}|{s[1]}:{y}" for x, y in product(domain[s[0]], domain[s[1]])
        }
        row = covered[",".join(s)]
        assert (row["covered"], row["possible"]) == (len(every & seen.keys()), len(every))
        assert row["ratio"] == row["covered"] / row["possible"]
        absent |= every - seen.keys()
    found = {r["tuple_id"] for r in ct.missing_tuples(df, COLS, 2).collect()}
    assert found == {md5(x) for x in absent}


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_missing_tuples_are_the_gaps(spark, monkeypatch, piece):
    monkeypatch.setattr("covertile.operators.tuples.PIECE", piece)
    rows = [(str(i % 7), str(i % 5), "z") for i in range(0, 35, 3)] + [("9", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = ct.missing_tuples(df, ["a", "b", "c"], 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Join Cross" not in plan
    found = {tuple(sorted((i["var"], i["value"]) for i in r["items"])) for r in got.collect()}
    domain = {c: {r[i] for r in rows if r[i] is not None} for i, c in enumerate("abc")}
    want = set()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y = "abc"[i], "abc"[j]
        want |= {((x, p), (y, q)) for p, q in product(domain[x], domain[y])} - {((x, r[i]), (y, r[j])) for r in rows}
    assert found == want and got.count() == len(want)
    empty = df.where("a = 'none'")
    assert ct.missing_tuples(empty, ["a", "b", "c"], 2).count() == 0


def test_coverage_of_a_given_domain(spark, df):
    domain = spark.createDataFrame(
        [("a", "x"), ("a", "z"), ("b", "1"), ("b", "7")], "var string, value string"
    )
    row = ct.coverage(df, ["a", "b"], 2, domain).first()
    assert (row["covered"], row["possible"]) == (1, 4)
    assert ct.missing_tuples(df, ["a", "b"], 2, domain).count() == 3


def test_graph_helpers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 5)], "src bigint, dst bigint")
    assert {tuple(r) for r in ct.undirected(edges).collect()} == {(1, 2), (2, 5)}
    assert ct.both_ways(edges).count() == 6
    assert {r[0] for r in ct.vertices_of(edges).collect()} == {1, 2, 3, 5}
    found = {r["id"]: r for r in ct.adjacency(edges, spark.range(7)).collect()}
    assert found[2]["nbrs"] == [1, 5] and found[2]["degree"] == 2
    assert found[6]["nbrs"] == [] and found[0]["degree"] == 0


def test_long_adjacency_is_cut_into_blocks(spark):
    star = spark.range(1, 101).selectExpr("CAST(0 AS BIGINT) AS src", "id AS dst")
    blocks = [r for r in ct.adjacency(star, neighbours=10).collect() if r["id"] == 0]
    assert len(blocks) > 5 and {r["degree"] for r in blocks} == {100}
    assert sorted(x for r in blocks for x in r["nbrs"]) == list(range(1, 101))


def test_ranks_over_partitions(spark):
    ws = Workspace(spark, "test")
    df = spark.range(500).selectExpr("IF(id < 400, 'big', 'small') AS g", "(id * 7919) % 500 AS x")
    got = ranked(ws, df, ["g"], [F.col("x").desc()], "r", "rank").collect()
    for g in ("big", "small"):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [r["x"] for r in rows] == sorted((r["x"] for r in rows), reverse=True)


def test_sweeps(spark):
    found = ct.synthetic_sweep(spark, ts=[2, 3], ns=[2, 3], vs=[2, 3], trials=2, seed=3)
    rows = {(r["t"], r["n"], r["v"], r["trial"]): r["size"] for r in found.collect()}
    assert len(rows) == 2 * 2 * 3
    for (t, n, v, _), size in rows.items():
        assert size >= v**t and (t < n or size == v**t)
    cover = ct.synthetic_sweep(spark, ts=[2], ns=[3], vs=[2], algo="cover").first()
    assert cover["size"] >= 4 and cover["seconds"] > 0


def test_bad_arguments(spark, df):
    for call in (
        lambda: ct.tway_tuples(df, COLS, 1),
        lambda: ct.tway_tuples(df, COLS, 5),
        lambda: ct.tway_tuples(df, ["a"], 2),
        lambda: ct.tway_tuples(df, ["a", "a"], 2),
        lambda: ct.tway_tuples(df, COLS, 2, mode="some"),
        lambda: ct.incidence(df, COLS, 2, by="column"),
        lambda: ct.synthetic_domain(spark, 1, 2),
        lambda: ct.synthetic_domain(spark, 2, 1),
        lambda: ct.sweep(df, COLS, ts=[2], ns=[9]),
        lambda: ct.sweep(df, COLS, ts=[3], ns=[2]),
    ):
        with pytest.raises(ValueError):
            call()
