"""Conflict graphs, vertices, adjacency and vertex priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_priority
from ..plans.lanes import Lanes
from ..plans.workspace import Workspace

# Rows of one value taken together by one side of a conflict cell.
CELL = 4096
# Neighbours held in one adjacency row.
NEIGHBOURS = 10_000


def conflict_graph(tuples: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(src, dst)`` with ``src < dst`` for tuples that give one variable different values.

    The pairs are the result itself, so the aim is to make no other ones. Per variable the
    distinct values are paired first; tuples are then joined to the value pairs by equality on
    both sides. Two tuples with the same value never meet, and a pair that differs in several
    variables is kept at the first of them, so no final ``distinct`` is needed. Values with many
    tuples are cut into cells, so that a value held by a third of the tuples is spread.

    To colour the graph without writing its edges, use ``color_tuples``.
    """
    by = list(by)
    # The tuples are used several times below; their source is read once.
    ws = Workspace(tuples.sparkSession, "conflicts")
    tuples = ws.write(tuples.select(*by, "tuple_id", "items"), "tuples")
    # The earlier items, and their variables, decide whether an earlier variable conflicts.
    flat = tuples.select(
        *by, "tuple_id", "items", F.posexplode("items").alias("at", "item")
    ).select(
        *by,
        "tuple_id",
        F.col("item.var").alias("var"),
        F.col("item.value").alias("value"),
        F.slice("items", F.lit(1), F.col("at")).alias("earlier"),
    )
    flat = flat.withColumn("earlier_vars", F.transform("earlier", lambda x: x["var"]))
    cells = flat.groupBy(*by, "var", "value").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(CELL)).alias("cells")
    )
    # A variable with many values is split as well: one side by lane, the other copied per lane.
    lanes = cells.groupBy(*by, "var").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(CELL)).alias("lanes")
    )
    laned = cells.join(lanes, [*by, "var"])
    left = laned.select(
        *by,
        "var",
        F.pmod(F.xxhash64("value"), F.col("lanes")).alias("lane"),
        F.col("value").alias("value_a"),
        F.col("cells").alias("cells_a"),
    )
    right = laned.select(
        *by,
        "var",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lanes") - 1)).alias("lane"),
        F.col("value").alias("value_b"),
        F.col("cells").alias("cells_b"),
    )
    value_pairs = (
        left.join(right, [*by, "var", "lane"])
        .where(F.col("value_a") < F.col("value_b"))
        .withColumn("cell_a", F.explode(F.expr("sequence(0L, cells_a - 1)")))
        .withColumn("cell_b", F.explode(F.expr("sequence(0L, cells_b - 1)")))
        .select(*by, "var", "value_a", "cell_a", "value_b", "cell_b")
    )
    placed = flat.join(cells, [*by, "var", "value"]).withColumn(
        "cell", F.pmod(F.xxhash64("tuple_id"), F.col("cells"))
    )

    def side(s: str) -> DataFrame:
        return placed.select(
            *by,
            "var",
            F.col("value").alias(f"value_{s}"),
            F.col("cell").alias(f"cell_{s}"),
            F.col("tuple_id").alias(f"id_{s}"),
            F.col("earlier").alias(f"earlier_{s}"),
            F.col("earlier_vars").alias(f"earlier_vars_{s}"),
        )

    pairs = value_pairs.join(side("a"), [*by, "var", "value_a", "cell_a"]).join(
        side("b"), [*by, "var", "value_b", "cell_b"]
    )
    first = F.size(F.array_intersect("earlier_vars_a", "earlier_vars_b")) == F.size(
        F.array_intersect("earlier_a", "earlier_b")
    )
    return pairs.where(first).select(
        *by,
        F.least("id_a", "id_b").alias("src"),
        F.greatest("id_a", "id_b").alias("dst"),
    )


def proper(edges: DataFrame) -> DataFrame:
    """The edges without self loops. An edge with a null end raises when rows are taken."""
    missing = F.raise_error(F.lit("an edge has a null end")).cast("boolean")
    return edges.where(F.coalesce(F.col("src") != F.col("dst"), missing))


def undirected(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each edge once with ``src < dst``; self loops and repeats removed."""
    return (
        proper(edges)
        .select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .dropDuplicates([*by, "src", "dst"])
    )


def both_ways(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each edge in both directions, in one pass over the edges."""
    return proper(edges).select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("src"), F.col("dst")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
            )
        ),
    )


def vertices_of(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """``id`` of every vertex that has an edge."""
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()


def assign_priority(vertices: DataFrame, seed: int | str | None = None) -> DataFrame:
    """Add the random rank ``priority``: the same for the same seed, with no global sort."""
    return vertices.withColumn("priority", hash_priority(F.col("id"), seed))


def adjacency(
    edges: DataFrame, vertices: DataFrame | None = None, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """``(id, block, degree, nbrs)``: sorted neighbour ids of every vertex; the key is (id, block).

    A vertex with more than ``neighbours`` neighbours takes several rows, one per block, and its
    pairs go to several tasks: the block is a lane of the pairs before they are exchanged. The
    degree is that of the vertex. Isolated vertices of ``vertices`` have one empty row.
    """
    ws = Workspace(edges.sparkSession, "adjacency")
    pairs, seen = ws.measured(both_ways(edges).dropDuplicates(["src", "dst"]), "pairs")
    lanes = Lanes(ws, "src", pairs, ["src"], "dst", neighbours, seen["rows"])
    packed = (
        lanes.tag(pairs)
        .groupBy(*lanes.on)
        .agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        .withColumn("size", F.size("nbrs").cast("bigint"))
    )
    if lanes.count:
        # Only blocks, not pairs, meet the degrees.
        packed = ws.write(packed, "blocks")
        degrees = packed.groupBy("src").agg(F.sum("size").alias("degree"))
        packed = packed.join(degrees, "src").withColumnRenamed(lanes.lane, "block")
    else:
        packed = packed.withColumn("degree", F.col("size")).withColumn("block", F.lit(0))
    packed = packed.select(F.col("src").alias("id"), "block", "degree", "nbrs")
    if vertices is None:
        return packed
    return (
        vertices.select("id")
        .join(packed, "id", "left")
        .select(
            "id",
            F.coalesce("block", F.lit(0)).alias("block"),
            F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"),
            F.coalesce("nbrs", F.array().cast(packed.schema["nbrs"].dataType)).alias("nbrs"),
        )
    )
