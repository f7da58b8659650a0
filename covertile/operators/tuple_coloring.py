"""First-fit colouring of a conflict graph whose edges are never written.

A conflict graph has an edge for every two tuples that give one variable different values, so its
edges grow with the square of the tuples. The two questions a colouring round asks can be
answered from the values instead:

* Is a smaller open neighbour left? Per variable only two open tuples matter: the smallest one,
  and the smallest one with another value. A tuple is ready if it has the value of the former in
  all its variables and is smaller than all of the latter.
* Which colours are taken around a tuple? The ready tuples of a round all agree, so per variable
  they hold one value. Whoever holds another value may no longer take their colours.

Both answers hold at most a few entries per variable. They come back to the driver as one small
row set per round, as a pick does, and enter the next round as constants; the tuples themselves
stay where they are, and a round needs no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_priority, mex
from ..plans.workspace import FOLD, Workspace
from .class_matching import match_classes
from .coloring import NotConverged


def color_tuples(
    tuples: DataFrame,
    seed: int | str | None = None,
    max_rounds: int = 100_000,
    batch: bool = False,
    by: list[str] = (),
    priority: Callable[[Column], Column] | None = None,
    largest_first: bool = True,
) -> DataFrame:
    """``(by, id, color)``: equal to ``color_greedy`` on the tuples and their conflict graph.

    Tuples are ranked by ``priority(tuple_id)``, else by their column ``priority``, else by a hash of the
    id. Work per round is linear in the open tuples. The tuples of one variable subset all conflict with
    each other, so at least as many rounds are needed as that subset has value combinations.

    ``batch`` gives another valid colouring in as many rounds as there are variable subsets, whatever
    the number of values (see :mod:`.class_matching`); subsets are taken by falling number of tuples, or
    by name without ``largest_first``. ``by`` colours independent groups of tuples together.
    """
    by = list(by)
    if priority is not None:
        tuples = tuples.withColumn("priority", priority(F.col("tuple_id")))
    elif "priority" not in tuples.columns:
        tuples = tuples.withColumn("priority", hash_priority(F.col("tuple_id"), seed))
    with Workspace(tuples.sparkSession, "color_tuples") as ws:
        if batch:
            ranked_ = tuples.select(*by, F.col("tuple_id").alias("id"), "priority", "items")
            return match_classes(ws, ranked_, by, largest_first)
        if by:
            # Groups have variables of their own, so their tuples never conflict.
            group = F.to_json(F.struct(*by))
            own = F.transform("items", lambda x: F.struct(F.concat(group, x["var"]).alias("var"), x["value"].alias("value")))
            tuples = tuples.withColumn("items", own)
        return _first_fit(ws, tuples, by, max_rounds)


def _first_fit(ws: Workspace, tuples: DataFrame, by: list[str], max_rounds: int) -> DataFrame:
    state, seen = ws.measured(
        tuples.select(
            *by,
            F.col("tuple_id").alias("id"),
            "items",
            "priority",
            F.array().cast("array<int>").alias("taken"),
            F.lit(None).cast("int").alias("color"),
            F.lit(False).alias("fixed"),
        ),
        "state0",
        split="fixed",
    )
    schema, names, fresh, number = state.schema, [], None, 0
    if not seen["rows"]:
        return state.select(*by, "id", "color")
    while True:
        number += 1
        if number > max_rounds:
            raise NotConverged(f"tuples are left uncoloured after {max_rounds} rounds")
        waiting = ws.half(schema, [f"state{number - 1}"], "fixed", False)
        ready, taken = _conditions(waiting, fresh)
        now = f"state{number}"
        color = F.when(ready, mex(F.col("taken")))
        _, seen = ws.measured(
            waiting.withColumn("taken", taken)
            .withColumn("color", color)
            .withColumn("fixed", F.col("color").isNotNull())
            .select(*schema.names),
            now,
            split="fixed",
            fixed=F.count_if("fixed"),
        )
        ws.drop(f"state{number - 1}/fixed=false")
        names.append(now)
        if seen["rows"] == seen["fixed"]:
            done = ws.write(ws.half(schema, names, "fixed", True).select(*by, "id", "color"), "result")
            ws.finish("result")
            return done
        fresh = ws.half(schema, [now], "fixed", True)
        if len(names) >= FOLD:
            # The next round reads this one apart from those it is folded with.
            fresh = ws.write(fresh, f"fresh{number}")
        names = ws.fold(schema, names, "fixed", True, f"folded{number}")


def _conditions(waiting: DataFrame, fresh: DataFrame | None) -> tuple[Column, Column]:
    """When a waiting tuple is ready, and its taken colours after the tuples just fixed."""
    by_rank = Window.partitionBy("var").orderBy("low")
    facts = (
        waiting.select(F.struct("priority", "id").alias("rank"), F.inline("items"))
        .groupBy("var", "value")
        .agg(F.min("rank").alias("low"))
        # Only two rows per variable and task are exchanged.
        .withColumn("place", F.row_number().over(by_rank))
        .where(F.col("place") <= 2)
        .select("var", "value", "low", "place", F.array().cast("array<int>").alias("colors"))
    )
    if fresh is not None:
        # At most one tuple per variable subset was fixed, all of them with the same values.
        facts = facts.union(
            fresh.select("color", F.inline("items"))
            .groupBy("var", "value")
            .agg(F.collect_set("color").alias("colors"))
            .select(
                "var",
                "value",
                F.lit(None).cast(facts.schema["low"].dataType).alias("low"),
                F.lit(0).alias("place"),
                "colors",
            )
        )
    found = facts.collect()
    holder = _map((r["var"], F.lit(r["value"])) for r in found if r["place"] == 1)
    second = _map(
        (r["var"], F.struct(F.lit(r["low"]["priority"]).alias("priority"), F.lit(r["low"]["id"]).alias("id")))
        for r in found
        if r["place"] == 2
    )
    rank = F.struct("priority", "id")
    ready = F.forall("items", lambda i: F.try_element_at(holder, i["var"]) == i["value"])
    if second is not None:
        ready &= F.forall(
            "items", lambda i: F.coalesce(rank < F.try_element_at(second, i["var"]), F.lit(True))
        )
    gone = [r for r in found if r["place"] == 0]
    if not gone:
        return ready, F.col("taken")
    value = _map((r["var"], F.lit(r["value"])) for r in gone)
    colors = _map((r["var"], F.array(*[F.lit(c) for c in sorted(r["colors"])])) for r in gone)
    none = F.array().cast("array<int>")
    lost = F.transform(
        "items",
        lambda i: F.when(
            F.try_element_at(value, i["var"]) != i["value"], F.try_element_at(colors, i["var"])
        ).otherwise(none),
    )
    return ready, F.array_union("taken", F.flatten(lost))


def _map(pairs) -> Column | None:
    flat = [c for name, column in pairs for c in (F.lit(name), column)]
    return F.create_map(*flat) if flat else None
