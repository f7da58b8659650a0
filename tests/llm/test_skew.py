"""Joins on hot keys meet a written table, not an aggregate of their own key.

A join to an aggregate of the same key shares its exchange, and adaptive execution then leaves a hot
key in one task; against a scan it splits it.
"""

import pytest

from covertile.llm import line_dedup, simhash
from covertile.llm.components import components
from covertile.plans.workspace import Workspace


def subtree(lines, at):
    """The lines of a plan below the one at ``at``."""
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    end = at + 1
    while end < len(lines) and depth(lines[end]) > depth(lines[at]):
        end += 1
    return lines[at + 1 : end]


def aggregates_under_joins(df, key):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, s in enumerate(lines) if s.lstrip(" :+-").startswith("Join") and key in s]
    return len(joins), [s for i in joins for s in subtree(lines, i) if "Aggregate [" in s and key in s]


@pytest.fixture
def written(monkeypatch):
    seen = {}
    write = Workspace.write

    def watch(self, df, name, split=None):
        seen[name] = df
        return write(self, df, name, split)

    monkeypatch.setattr(Workspace, "write", watch)
    return seen


def test_components_of_a_hub(spark, written):
    edges = spark.range(1, 3000).selectExpr("id AS a", "0L AS b").union(spark.range(5000, 5050).selectExpr("id AS a", "id + 1 AS b"))
    got = components(Workspace(spark, "hub"), edges)
    assert {(r.root) for r in got.collect()} == {0, 5000} and got.count() == 3051
    for name in ("large_1", "edges_1"):
        joins, below = aggregates_under_joins(written[name], "a#")
        assert joins and not below, below


def test_simhash_and_line_joins(spark, written):
    docs = [(i, f"one line {i % 3}\nanother line\nand a third\n" + f"own words number {i} of this text") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    simhash.near_duplicates(df).count()
    assert "smallest" in written
    line_dedup.drop_repeated_windows(df).count()
    assert written.pop("firsts").columns == ["h1", "h2", "first"]
