"""Colour classes of tuples by matching one variable subset at a time.

Tuples of one variable subset all conflict, so a class takes at most one of them: a subset is matched to
the classes. A class is a row of a table: its colour and the value, if any, it gives each variable. To
the tuples of a subset, classes differ in which of its variables they have already. Classes with all of
them come first, then those with fewer; among classes with the same variables a tuple fits those that
have its values there, and the n-th tuple of such values in rank order goes to the n-th class of them in
colour order. Tuples left over open classes of their own.

The colouring is valid and deterministic but not that of first fit. Its rounds are the variable subsets,
whatever the number of values, and each is a few equality joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lanes import HOT_ROWS
from ..plans.ranks import ranked
from ..plans.workspace import Workspace


def _numbered(ws, df: DataFrame, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """``df`` with ``pos``, from 1 within ``keys``; large tables are numbered over range partitions."""
    columns = [F.col(c) for c in order]
    if rows > HOT_ROWS:
        return ranked(ws, df, keys, columns, name, "pos")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)))


def match_classes(ws: Workspace, tuples: DataFrame, by: list[str], largest_first: bool) -> DataFrame:
    """``(by, id, color)`` of tuples ``(by, id, priority, items)``."""
    pair = F.transform("items", lambda x: F.struct(x["var"], x["value"]))
    tuples = ws.write(
        tuples.select(
            *by, "id", "priority", F.transform("items", lambda x: x["var"]).alias("vars"), F.map_from_entries(pair).alias("held")
        ),
        "tuples",
    )
    # One row for each subset of the variables, which are columns of a table.
    found = [(list(r["vars"]), r["n"]) for r in tuples.groupBy("vars").agg(F.count(F.lit(1)).alias("n")).collect()]
    found.sort(key=lambda s: (-s[1] if largest_first else 0, s[0]))
    name_of = {v: f"v{i}" for i, v in enumerate(sorted({v for vars_, _ in found for v in vars_}))}
    every = list(name_of.values())
    string = tuples.schema["held"].dataType.valueType
    classes, top, size, stages = None, 0, 0, []
    for number, (vars_, rows) in enumerate(found):
        own = [name_of[v] for v in vars_]
        mine = tuples.where(F.col("vars") == F.array(*[F.lit(v) for v in vars_])).select(
            *by, "id", "priority", *[F.col("held")[F.lit(v)].alias(name_of[v]) for v in vars_]
        )
        placed: list[DataFrame] = []

        def waiting() -> DataFrame:
            left = mine
            for p in placed:
                left = left.join(p.select(*by, "id"), [*by, "id"], "left_anti")
            return left

        shapes = []
        if classes is not None:
            has = [F.col(c).isNotNull().alias(c) for c in own]
            kinds = classes.select(*has).distinct().collect()
            shapes = sorted(([c for c in own if k[c]] for k in kinds), key=lambda p: (-len(p), p))
        for at, shape in enumerate(shapes):
            fits = F.lit(True)
            for c in own:
                fits &= F.col(c).isNotNull() if c in shape else F.col(c).isNull()
            key = [*by, *shape]
            a = _numbered(ws, waiting(), key, ["priority", "id"], rows, f"tuples{number}_{at}")
            b = _numbered(ws, classes.where(fits).select(*key, "color"), key, ["color"], size, f"open{number}_{at}")
            met = a.join(b, [*key, "pos"]).select(*by, "id", "color", *own)
            met, seen = ws.measured(met, f"met{number}_{at}")
            if seen["rows"]:
                placed.append(met)
                stages.append(f"met{number}_{at}")
        fresh = _numbered(ws, waiting(), by, ["priority", "id"], rows, f"left{number}")
        if by and classes is not None:
            tops = classes.groupBy(*by).agg(F.max("color").alias("top"))
            fresh = fresh.join(F.broadcast(tops) if size <= HOT_ROWS else tops, by, "left")
            before = F.coalesce("top", F.lit(0))
        else:
            before = F.lit(top)
        fresh = fresh.select(*by, "id", (before + F.col("pos")).cast("bigint").alias("color"), *own)
        fresh = ws.write(fresh, f"new{number}")
        stages.append(f"new{number}")
        filled = fresh.drop("id")
        for p in placed:
            filled = filled.union(p.drop("id"))
        if classes is None:
            none = [F.lit(None).cast(string).alias(c) for c in every if c not in own]
            grown = filled.select("*", *none)
        else:
            told = filled.withColumnsRenamed({c: f"new_{c}" for c in own})
            grown = classes.join(told, [*by, "color"], "full").withColumns(
                {c: F.coalesce(c, f"new_{c}") for c in own}
            )
        classes, seen = ws.measured(
            grown.select(*by, "color", *every), f"classes{number}", top=F.max("color")
        )
        top, size = seen["top"], seen["rows"]
        if number:
            ws.drop(f"classes{number - 1}")
    shape = tuples.select(*by, "id", F.lit(1).cast("bigint").alias("color")).schema
    if not stages:
        return ws.spark.createDataFrame([], shape)
    colors = ws.write(ws.read(shape, *stages).withColumn("color", F.col("color").cast("int")), "result")
    ws.finish("result")
    return colors
