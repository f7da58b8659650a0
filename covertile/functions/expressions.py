"""Native column expressions: no UDF, everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mex(used: Column) -> Column:
    """Smallest integer >= 1 that is not in the array ``used`` (array<int>, no nulls)."""
    return F.array_min(F.array_except(F.sequence(F.lit(1), F.size(used) + F.lit(1)), used))


def escape(text: Column) -> Column:
    """Backslash-escape the two separators of the canonical form and the backslash itself."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("|"), F.lit("\\|"))
    return F.replace(out, F.lit(":"), F.lit("\\:"))


def canonical(items: Column) -> Column:
    """``var:value|var:value`` for an array<struct<var, value>> already sorted by var."""
    return F.array_join(
        F.transform(items, lambda x: F.concat(escape(x["var"]), F.lit(":"), escape(x["value"]))),
        "|",
    )


def tuple_id(items: Column) -> Column:
    """Identity of a partial assignment: the whole md5, never a truncated hash."""
    return F.md5(canonical(items))


def hash_priority(id_: Column, *seed: Column | int | str | None) -> Column:
    """Reproducible random rank of an id. Compared together with the id it is a total order."""
    parts = [s if isinstance(s, Column) else F.lit(s) for s in seed if s is not None]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], id_.cast("string")))


def tie_distance(id_: Column, draw: int) -> Column:
    """Distance of the last digit of an id to a drawn number; smaller wins a tie."""
    return F.abs(F.lit(draw) - id_ % F.lit(10))


def precedes(pa: Column, a: Column, pb: Column, b: Column) -> Column:
    """(pa, a) < (pb, b): the total order every operator breaks ties with."""
    return (pa < pb) | ((pa == pb) & (a < b))
