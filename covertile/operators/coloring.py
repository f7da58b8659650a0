"""Graph colouring in rounds of joins and aggregations.

All three operators are deterministic: vertices are compared by ``(priority, id)``, a total order.
Colours start at 1 and isolated vertices get 1. Self loops are ignored.

``color_greedy`` and ``color_rounds`` fix a vertex once all its smaller neighbours are fixed. Only
smaller neighbours can matter, so every edge is stored once, from the smaller to the larger end,
and is used once: in the round its smaller end becomes fixed. A waiting vertex keeps the number of
smaller neighbours it still waits for and the colours it may not take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_priority, mex, precedes
from ..plans.lanes import HOT_ROWS, Lanes
from ..plans.workspace import Workspace
from .checks import check_at_least
from .graphs import NEIGHBOURS, both_ways, proper, vertices_of

# ``join='broadcast'`` sends freshly fixed vertices of at most so many bytes; beyond, Spark decides.
BROADCAST_BYTES = 32 << 20
# The stored edges are written anew when half are used up and at least this many are stored.
COMPACT_ROWS = 4_000_000


class NotConverged(RuntimeError):
    """The round limit was reached before the colouring was finished."""


def color_greedy(
    vertices: DataFrame | None,
    edges: DataFrame,
    join: str = "auto",
    layout: str = "edges",
    **options,
) -> DataFrame:
    """``(id, color)``: each vertex takes the smallest colour its smaller neighbours leave free.

    Equals first-fit in ``(priority, id)`` order. ``join='broadcast'`` sends the freshly fixed
    vertices to the edges instead of shuffling, as long as the written rows are small enough
    (checked every round, after hot vertices are copied). ``layout='adjacency'`` stores neighbour arrays, cut to bounded length, instead of
    edge rows. Neither changes the result.
    """
    return _scheduled(vertices, edges, join, layout, first_fit=True, **options)


def color_rounds(
    vertices: DataFrame | None,
    edges: DataFrame,
    join: str = "auto",
    layout: str = "edges",
    **options,
) -> DataFrame:
    """``(id, color)``: the colour is the round in which the vertex was fixed.

    That is one more than the largest colour among the smaller neighbours: the length of the
    longest increasing path that ends at the vertex.
    """
    return _scheduled(vertices, edges, join, layout, first_fit=False, **options)


def _priority_of(seed, priority: Callable[[Column], Column] | None, by: list[str]):
    return priority or (lambda id_: hash_priority(id_, seed))


def _shared(edges: DataFrame, by: list[str]) -> list[str]:
    """Key columns the edges lack: every edge then belongs to all values the vertices have."""
    return [c for c in by if c not in edges.columns]


def _with_vertices(ws, vertices, edges, by, seed, priority):
    """Vertices with a priority, and the priorities of both edge ends as ``ps`` and ``pd``.

    An edge end that is null or not among the given vertices raises. A vertex given more than once has the
    least of its priorities.

    A priority that is computed from the id costs no join; a stored one is joined to both ends.
    """
    key = [*by, "id"]
    edges = ws.write(proper(edges).select(*by, "src", "dst"), "given")
    if vertices is None:
        vertices = vertices_of(edges, by)
    else:
        known = vertices.select(*key).distinct()
        if vertices_of(edges, by).join(known, key, "left_anti").limit(1).count():
            raise ValueError("an edge names a vertex that is not among the vertices")
    if "priority" in vertices.columns:
        vertices = vertices.groupBy(*key).agg(F.min("priority").alias("priority"))

        def end(name: str, p: str) -> DataFrame:
            return vertices.select(*by, F.col("id").alias(name), F.col("priority").alias(p))

        edges = edges.join(end("src", "ps"), [*by, "src"]).join(end("dst", "pd"), [*by, "dst"])
    else:
        rank = _priority_of(seed, priority, by)
        vertices = vertices.select(*key, rank(F.col("id")).alias("priority"))
        edges = edges.withColumns({"ps": rank(F.col("src")), "pd": rank(F.col("dst"))})
    return vertices, edges


def _scheduled(
    vertices,
    edges,
    join,
    layout,
    first_fit,
    by: list[str] = (),
    seed: int | str | None = None,
    priority: Callable[[Column], Column] | None = None,
    max_rounds: int = 100_000,
    hot_rows: int = HOT_ROWS,
    neighbours: int = NEIGHBOURS,
    compact_rows: int = COMPACT_ROWS,
) -> DataFrame:
    if join not in ("auto", "broadcast"):
        raise ValueError(f"join must be 'auto' or 'broadcast', got {join!r}")
    if layout not in ("edges", "adjacency"):
        raise ValueError(f"layout must be 'edges' or 'adjacency', got {layout!r}")
    check_at_least("max_rounds", max_rounds, 1)
    by = list(by)
    shared = _shared(edges, by)
    rule = (join, layout, first_fit, by, shared, max_rounds, hot_rows, neighbours, compact_rows)
    with Workspace(edges.sparkSession, "coloring") as ws:
        if not shared:
            vertices, edges = _with_vertices(ws, vertices, edges, by, seed, priority)
            return _fix_in_rounds(ws, vertices, edges, None, *rule)
        if vertices is None or "priority" in vertices.columns:
            raise ValueError(f"edges without {shared} need vertices whose priority is computed")
        own = [c for c in by if c not in shared]
        _, edges = _with_vertices(ws, vertices.select(*own, "id").distinct(), edges, own, None, F.hash)
        rank = _priority_of(seed, priority, by)
        ahead = precedes(rank(F.col("id")), F.col("id"), rank(F.col("dst")), F.col("dst"))
        return _fix_in_rounds(ws, vertices, edges, ahead, *rule)


def _fix_in_rounds(
    ws,
    vertices,
    edges,
    ahead,
    join,
    layout,
    first_fit,
    by,
    shared,
    max_rounds,
    hot_rows,
    neighbours,
    compact_rows,
) -> DataFrame:
    """The rounds. Edges that several keys share are stored once, in both directions, and their
    direction under a key, ``ahead``, is worked out when they meet a vertex of it.
    """
    key = [*by, "id"]
    own = [c for c in by if c not in shared]
    if shared:
        directed = both_ways(edges.select(*own, "src", "dst"), own).withColumnRenamed("src", "id")
    else:
        up = precedes(F.col("ps"), F.col("src"), F.col("pd"), F.col("dst"))
        directed = edges.select(
            *by,
            F.when(up, F.col("src")).otherwise(F.col("dst")).alias("id"),
            F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        )
    down, seen = ws.measured(directed, "down")
    limit = hot_rows if layout == "edges" else neighbours
    lanes = Lanes(ws, "src", down, [*own, "id"], "dst", limit, seen["rows"])
    stored = _store(ws, down, lanes, layout, "stored")

    def meeting(sent: DataFrame) -> DataFrame:
        met = stored.join(sent, lanes.on)
        if layout == "adjacency":
            met = met.withColumn("dst", F.explode("nbrs"))
        return met if ahead is None else met.where(ahead)

    # State of a vertex: smaller neighbours still open, colours taken around it, own colour.
    smaller = meeting(lanes.copy(vertices.select(*key).distinct())) if shared else down
    waits = smaller.groupBy(*by, F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    taken = F.array().cast("array<int>")
    state = (
        vertices.select(*key)
        .distinct()
        .join(waits, key, "left")
        .select(
            *key,
            F.coalesce("open", F.lit(0).cast("bigint")).alias("open"),
            *([taken.alias("taken")] if first_fit else []),
        )
        .withColumn("color", F.when(F.col("open") == 0, F.lit(1)))
        .withColumn("round", F.lit(1))
    )

    names: list[str] = []
    number, kept_edges = 0, seen["rows"]
    while True:
        number += 1
        now = f"state{number}"
        written, seen = ws.measured(
            state.withColumn("fixed", F.col("color").isNotNull()),
            now,
            split="fixed",
            fixed=F.count_if("fixed"),
            edges=F.sum("open"),
        )
        if number > 1:
            ws.drop(f"state{number - 1}/fixed=false")
            ws.drop(f"sent{number - 1}")
        left = seen["rows"] - seen["fixed"]
        if shared and number == 1:
            kept_edges = seen["edges"]
        if seen["fixed"]:
            names = ws.fold(written.schema, [*names, now], "fixed", True, f"fixed{number}")
        if not left:
            break
        if number >= max_rounds:
            raise NotConverged(f"{left} vertices are uncoloured after {max_rounds} rounds")
        fresh = ws.half(written.schema, names[-1:], "fixed", True)
        if names[-1] != now:  # the rounds were just folded; the others send nothing new
            fresh = fresh.where(F.col("round") == number)
        waiting = ws.half(written.schema, [now], "fixed", False)
        if kept_edges >= compact_rows and 2 * seen["edges"] < kept_edges:
            # Only edges towards waiting vertices are used from here on.
            ends = waiting.select(*own, F.col("id").alias("dst"))
            down = ws.write(down.join(ends, [*own, "dst"], "left_semi"), f"down{number}")
            kept_edges = seen["edges"]
            stored = _store(ws, down, lanes, layout, f"stored{number}")
        met = meeting(_sent(ws, lanes, fresh.select(*key, "color"), join, number))
        told = [F.count(F.lit(1)).alias("done")]
        if first_fit:
            told.append(F.collect_set("color").alias("news"))
        news = met.groupBy(*by, F.col("dst").alias("id")).agg(*told)
        union = F.array_union("taken", F.coalesce("news", taken)).alias("taken")
        state = waiting.join(news, key, "left").select(
            *key,
            (F.col("open") - F.coalesce("done", F.lit(0).cast("bigint"))).alias("open"),
            *([union] if first_fit else []),
        )
        color = mex(F.col("taken")) if first_fit else F.lit(number + 1)
        state = state.withColumn("color", F.when(F.col("open") == 0, color))
        state = state.withColumn("round", F.lit(number + 1))
    result = ws.write(
        ws.half(written.schema, names, "fixed", True).select(*key, "color"), "result"
    )
    ws.finish("result")
    return result


def _sent(ws, lanes, fresh, join, number) -> DataFrame:
    """The freshly fixed vertices as the edges meet them, broadcast if asked for and small."""
    sent = lanes.copy(fresh)
    if join != "broadcast":
        return sent
    sent = ws.write(sent, f"sent{number}")
    return F.broadcast(sent) if ws.bytes(f"sent{number}") <= BROADCAST_BYTES else sent


def _store(ws, down, lanes, layout, name) -> DataFrame:
    """The edges as the rounds read them: rows, or bounded arrays per vertex and lane."""
    if layout == "edges":
        return ws.write(lanes.tag(down), name) if lanes.count else down
    packed = lanes.tag(down).groupBy(*lanes.on).agg(F.collect_list("dst").alias("nbrs"))
    return ws.write(packed, name)


def color_repair(
    vertices: DataFrame | None,
    edges: DataFrame,
    freeze: bool = True,
    by: list[str] = (),
    seed: int | str | None = None,
    priority: Callable[[Column], Column] | None = None,
    max_rounds: int = 100_000,
) -> DataFrame:
    """``(id, color)``: start with one colour everywhere and repair conflicts in rounds.

    In a round every vertex looks at the colours of its neighbours. If a neighbour has its own
    colour and the vertex precedes all of those, it keeps it; otherwise it moves to the smallest
    colour no neighbour has. The end is a round without a change. With ``freeze`` a vertex that
    kept its colour once keeps it for good; without, it may still move, which gives different
    colours. Stopping at ``max_rounds`` raises: an unfinished colouring is never returned.

    Every vertex keeps a multiset of its neighbours' colours: how many have a colour, and how many of
    those precede it. That is all the rule needs, and both numbers add up, so a round sends only what
    changed: each vertex that moved takes one from its old colour and adds one to its new colour around
    its neighbours. Edges of vertices that did not move are not met, and with ``freeze`` a vertex that
    did not move is written once and read by the result only.
    """
    check_at_least("max_rounds", max_rounds, 1)
    with Workspace(edges.sparkSession, "repair") as ws:
        vertices, edges = _with_vertices(ws, vertices, edges, list(by), seed, priority)
        return _repair_in_rounds(ws, vertices, edges, freeze, list(by), max_rounds)


def _repair_in_rounds(ws, vertices, edges, freeze, by, max_rounds) -> DataFrame:
    key = [*by, "id"]
    ends = [("src", "dst", "up"), ("dst", "src", "NOT up")]
    both = F.array(*[F.expr(f"struct({a} AS id, {b} AS dst, {up} AS ahead)") for a, b, up in ends])
    up = precedes(F.col("ps"), F.col("src"), F.col("pd"), F.col("dst"))
    pairs = ws.write(edges.withColumn("up", up).select(*by, F.inline(both)).distinct(), "pairs")

    # All begin with colour 1: one entry for each vertex that has neighbours.
    around = pairs.groupBy(*by, F.col("dst").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ahead").alias("less")
    )
    around = around.select(*key, F.create_map(F.lit(1), F.struct("n", "less")).alias("around"))
    state = vertices.select(*key).distinct().withColumn("color", F.lit(1)).join(around, key, "left")

    same = F.try_element_at("around", F.col("color"))
    keeps = F.coalesce(same["less"] == 0, F.lit(False)) | F.col("around").isNull()
    target = F.when(keeps, F.col("color")).otherwise(mex(F.map_keys("around")))
    total = lambda a, b, f: F.coalesce(a[f], F.lit(0)) + F.coalesce(b[f], F.lit(0))
    merged = F.map_filter(
        F.map_zip_with(
            "around", "news", lambda _, a, b: F.struct(total(a, b, "n").alias("n"), total(a, b, "less").alias("less"))
        ),
        lambda _, v: v["n"] > 0,
    )
    names: list[str] = []
    for number in range(1, max_rounds + 1):
        now = f"round{number}"
        decided = state.select(*key, "around", F.col("color").alias("old"), target.alias("color"))
        written, seen = ws.measured(
            decided.withColumn("changed", F.col("old") != F.col("color")),
            now,
            split="changed",
            moved=F.count_if("changed"),
        )
        schema, stayed = written.schema, seen["rows"] - seen["moved"]
        if number > 1:
            ws.drop(f"round{number - 1}/changed=true" if freeze else f"round{number - 1}")
        if not freeze:
            names = [now] if stayed else []
        elif stayed:
            names = ws.fold(schema, [*names, now], "changed", False, f"fixed{number}")
        if not seen["moved"]:
            result = ws.write(ws.half(schema, names, "changed", False).select(*key, "color"), "result")
            ws.finish("result")
            return result
        moved = ws.half(schema, [now], "changed", True)
        ahead = F.col("ahead").cast("bigint")
        sent = F.array(
            F.struct(F.col("old").alias("color"), F.lit(-1).alias("n"), (-ahead).alias("less")),
            F.struct(F.col("color").alias("color"), F.lit(1).alias("n"), ahead.alias("less")),
        )
        told = (
            pairs.join(moved.select(*key, "old", "color"), key)
            .select(*by, F.col("dst").alias("id"), F.inline(sent))
            .groupBy(*key, "color")
            .agg(F.sum("n").alias("n"), F.sum("less").alias("less"))
            .groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("color", F.struct("n", "less")))).alias("news"))
        )
        going_on = moved
        if not freeze and stayed:
            going_on = moved.union(ws.half(schema, [now], "changed", False))
        state = going_on.select(*key, "color", "around").join(told, key, "left").select(
            *key, "color", F.when(F.col("news").isNull(), F.col("around")).otherwise(merged).alias("around")
        )
    raise NotConverged(f"{seen['moved']} vertices still changed in round {max_rounds}")


def n_colors(coloring: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(colors, max_color)``: the number of distinct colours and the largest one."""
    used = coloring.groupBy(*by, "color").agg(F.count(F.lit(1)).alias("n"))
    return used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("colors"), F.max("color").alias("max_color")
    )


def validate_coloring(coloring: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(src, dst, color)`` of the edges that break a colouring; empty if it is valid.

    These are edges whose ends have the same colour, and edges with an end that has none or is null:
    their ``color`` is null.
    """
    by = list(by)

    def end(name: str, color: str) -> DataFrame:
        return coloring.select(*by, F.col("id").alias(name), F.col("color").alias(color))

    same = F.col("color") == F.col("other")
    return (
        edges.where(~F.col("src").eqNullSafe(F.col("dst")) | F.col("src").isNull())
        .select(*by, "src", "dst")
        .join(end("src", "color"), [*by, "src"], "left")
        .join(end("dst", "other"), [*by, "dst"], "left")
        .where(same | F.col("color").isNull() | F.col("other").isNull())
        .select(*by, "src", "dst", F.when(same, F.col("color")).alias("color"))
    )


def rows_from_coloring(tuples: DataFrame, coloring: DataFrame, cols: list[str]) -> DataFrame:
    """One test row per colour: the tuples of a colour class agree, so they merge.

    A variable no tuple of the class assigns stays null: any value will do. A class whose tuples
    give a variable different values is no valid colour class, and raises when rows are taken.
    """
    held = tuples.select(F.col("tuple_id").alias("id"), F.inline("items"))
    return (
        held.join(coloring, "id")
        .groupBy("color", "var")
        .agg(F.max("value").alias("value"), F.min("value").alias("least"))
        .withColumn(
            "value",
            F.when(F.col("value") == F.col("least"), F.col("value")).otherwise(
                F.raise_error(F.concat(F.lit("tuples of one colour differ in "), "var"))
            ),
        )
        .groupBy("color")
        .pivot("var", sorted(cols))
        .agg(F.max("value"))
    )
