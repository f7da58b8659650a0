import pytest

import covertile as ct

EXAMPLE = """2
11 12 13 14 15 16 21 22
# a comment

11 12 13 31 32
"""
GRAPHVIZ = """graph roads {
4 [label="crossing -- 9"];
9;
4 -- 9;
4 -- 9 [w=1];
5--4;
4 -> 6; // one way
7 -- 8 -- 9;
3 to 5
}
"""
GRAPHVIZ_EDGES = [(3, 5), (4, 6), (4, 9), (4, 9), (5, 4), (7, 8), (8, 9)]
DIMACS = """c example
p edge 5 4
e 1 2
e 2 1 7
e 2 3 weight 0.5

e 3 5
"""


def sets(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["set_id"], set()).add(r["elem_id"])
    return found


def test_hyperedge_text(spark, tmp_path):
    (tmp_path / "h.txt").write_text(EXAMPLE)
    found = sets(ct.read_hyperedges(spark, str(tmp_path)))
    assert found == {1: {11, 12, 13, 14, 15, 16, 21, 22}, 2: {11, 12, 13, 31, 32}}
    assert sets(ct.read_hyperedges(spark, str(tmp_path), header=False))[1] == {2}
    strings = spark.createDataFrame([("k", EXAMPLE)], "key string, text string")
    parsed = ct.parse_hyperedges(strings)
    assert sets(parsed) == found and parsed.columns == ["key", "set_id", "elem_id"]
    assert sets(ct.parse_hyperedges(strings, header=False))[1] == {2}


def test_first_line_is_dropped_even_as_comment(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# no count\n5 6\n7\n")
    assert sets(ct.read_hyperedges(spark, str(tmp_path))) == {1: {5, 6}, 2: {7}}


def test_numbers_run_through_the_splits_of_a_file(spark, tmp_path):
    for name, first in (("a.txt", 0), ("b.txt", 10_000)):
        lines = [f"{first + i} {first + i + 1}" for i in range(600)]
        lines[300:300] = ["# half", ""]
        (tmp_path / name).write_text("600\n" + "\n".join(lines) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = ct.read_hyperedges(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 2 * 600 * 2
    for name, first in (("a.txt", 0), ("b.txt", 10_000)):
        own = {}
        for r in rows:
            if r["path"].endswith(name):
                own.setdefault(r["set_id"], set()).add(r["elem_id"])
        assert own == {i + 1: {first + i, first + i + 1} for i in range(600)}


@pytest.mark.parametrize("header", [True, False])
def test_round_trip(spark, tmp_path, header):
    pairs = [(s, e) for s in range(1, 40) for e in range(s % 7 + 1)]
    df = spark.createDataFrame(pairs, "set_id bigint, elem_id bigint")
    path = str(tmp_path / "out")
    ct.write_hyperedges(df, path, header=header, files=3)
    back = ct.read_hyperedges(spark, path, header=header)
    got = {}
    for r in back.collect():
        got.setdefault((r["path"], r["set_id"]), set()).add(r["elem_id"])
    want = {}
    for s, e in pairs:
        want.setdefault(s, set()).add(e)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if header:
        counts = [f.read_text().split("\n")[0] for f in (tmp_path / "out").rglob("*.txt")]
        assert sum(map(int, counts)) == 39


def test_graphviz(spark, tmp_path):
    for name in ("a.dot", "b.dot"):
        (tmp_path / name).write_text(GRAPHVIZ)
    read = ct.read_graphviz(spark, str(tmp_path / "a.dot"))
    assert sorted(tuple(r) for r in read.collect()) == GRAPHVIZ_EDGES
    by_path = ct.read_graphviz(spark, str(tmp_path), by_path=True)
    assert by_path.columns == ["path", "src", "dst"]
    assert sorted((r[0][-5:], r[1], r[2]) for r in by_path.collect()) == [
        (f, *e) for f in ("a.dot", "b.dot") for e in GRAPHVIZ_EDGES
    ]
    strings = spark.createDataFrame([(7, GRAPHVIZ)], "key int, text string")
    assert sorted(tuple(r) for r in ct.parse_graphviz(strings).collect()) == [(7, *e) for e in GRAPHVIZ_EDGES]


@pytest.mark.parametrize(
    "line", ["1 -- x;", "1 2;", "1 -- ;", "1 --", "1 -- 2 -- {3 4};", '1 -- 2 -- "3";', "1 -- {2 3};", "1 -> 2 -> 3 ->"]
)
def test_graphviz_edges_are_not_lost(spark, line):
    strings = spark.createDataFrame([(line,)], "text string")
    with pytest.raises(Exception, match="not an edge line"):
        ct.parse_graphviz(strings).collect()


def test_dimacs(spark, tmp_path):
    (tmp_path / "g.col").write_text(DIMACS)
    edges = {tuple(r) for r in ct.read_dimacs(spark, str(tmp_path)).collect()}
    assert edges == {(1, 2), (2, 3), (3, 5)}
    assert [r[0] for r in ct.dimacs_vertices(spark, str(tmp_path)).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    strings = spark.createDataFrame([(7, DIMACS)], "key int, text string")
    assert {tuple(r) for r in ct.parse_dimacs(strings).collect()} == {(7, a, b) for a, b in edges}
    (tmp_path / "h.col").write_text("p edge 2 1\ne 1 2\n")
    both = ct.read_dimacs(spark, str(tmp_path), by_path=True).collect()
    assert sorted((r[0][-5:], r[1], r[2]) for r in both) == [
        ("g.col", 1, 2), ("g.col", 2, 3), ("g.col", 3, 5), ("h.col", 1, 2),
    ]
    counts = ct.dimacs_vertices(spark, str(tmp_path), by_path=True).groupBy("path").count().collect()
    assert sorted(r[1] for r in counts) == [2, 5]
    (tmp_path / "h.col").write_text("e 1 two\n")
    with pytest.raises(Exception, match="not an edge line"):
        ct.read_dimacs(spark, str(tmp_path)).collect()
    (tmp_path / "g.col").write_text("e 1 2\n")
    with pytest.raises(ValueError):
        ct.dimacs_vertices(spark, str(tmp_path / "g.col"))


def test_results_are_appended(spark, tmp_path):
    row = spark.createDataFrame(
        [(2, 3, 2, "cover", 0.5, 4)], "t int, n int, v int, algo string, seconds double, size bigint"
    )
    for _ in range(2):
        ct.write_results(row, str(tmp_path / "r"))
    lines = [l for f in (tmp_path / "r").glob("*.csv") for l in f.read_text().splitlines()]
    assert lines == ["2;3;2;cover;0.5;4"] * 2


def test_graphviz_statements_of_one_line(spark):
    from covertile.sources import graphs

    text = "\n".join(
        [
            "1; 2 -- 3;",
            '4 -- 5; 6 -- 7 -- 8 [label="a]; 9 -- 9"]; 10 -> 11',
            "12 -- 13 // no; 14 -- 15",
            "16 -- 17 # no; 18 -- 19",
            '20 [label="x; 21 -- 22"];',
            '23 [label="open; 24 -- 25',
        ]
    )
    got = graphs.parse_graphviz(spark.createDataFrame([(text,)], "text string")).collect()
    want = [(2, 3), (4, 5), (6, 7), (7, 8), (10, 11), (12, 13), (16, 17)]
    assert sorted((r.src, r.dst) for r in got) == want
