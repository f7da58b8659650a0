"""t-way tuples of a table, their incidence with rows, coverage and what is missing.

A tuple is a partial assignment of t variables. Its items are sorted by variable name and its
identity is the md5 of the canonical text. A row with a null in a column assigns nothing to that
variable, so it contributes no tuple that contains it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tuple_id
from ..plans.ranks import ranked
from ..plans.workspace import Workspace
from .checks import check_strength
from .domains import PIECE, decoded, domains, indexed, mixed_radix, product


def column_subsets(cols: list[str], t: int, mode: str = "all") -> list[tuple[str, ...]]:
    """The variable subsets of strength t. Metadata only: C(n, t) names.

    ``sliding`` keeps a leading variable followed by t-1 adjacent ones, in the order given; it
    misses combinations for t >= 3 and equals ``all`` for t = 2.
    """
    check_strength(t, len(cols))
    if len(set(cols)) != len(cols):
        raise ValueError("the same column is named twice")
    if mode == "all":
        return [tuple(s) for s in combinations(sorted(cols), t)]
    if mode != "sliding":
        raise ValueError(f"mode must be 'all' or 'sliding', got {mode!r}")
    found = []
    for lead in range(len(cols)):
        for start in range(lead + 1, len(cols) - t + 2):
            found.append(tuple(sorted([cols[lead], *cols[start : start + t - 1]])))
    return found


def _items(cols: list[str]) -> Column:
    return F.array(
        *[F.struct(F.lit(c).alias("var"), F.col(c).cast("string").alias("value")) for c in cols]
    )


def _explode_subsets(df: DataFrame, cols: list[str], subsets: list[tuple[str, ...]]) -> DataFrame:
    """One row per row of ``df`` and subset, as ``items``; the subsets are one folded literal."""
    names = sorted(cols)
    place = {c: i for i, c in enumerate(names)}
    choice = F.array(*[F.array(*[F.lit(place[c]) for c in s]) for s in subsets])
    return (
        df.withColumn("_row", _items(names))
        .withColumn("_subset", F.explode(choice))
        .withColumn("items", F.transform("_subset", lambda i: F.get(F.col("_row"), i)))
        .where(~F.exists("items", lambda x: x["value"].isNull()))
        .drop("_row", "_subset")
    )


def tway_tuples(df: DataFrame, cols: list[str], t: int, mode: str = "all") -> DataFrame:
    """``(tuple_id, items, support)``: the t-tuples observed in the rows of ``df``.

    Equal rows are counted first, so the t-tuples are enumerated per distinct row and the only
    wide exchange carries partial counts. A value that fills a third of the table is therefore
    one row per task by the time anything is shuffled.
    """
    subsets = column_subsets(cols, t, mode)
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return (
        _explode_subsets(rows, cols, subsets)
        .groupBy("items")
        .agg(F.sum("_n").alias("support"))
        .select(tuple_id(F.col("items")).alias("tuple_id"), "items", "support")
    )


def all_tuples(domain: DataFrame, t: int, cols: list[str] | None = None) -> DataFrame:
    """``(tuple_id, items)``: every t-tuple over a domain, C(n, t) * v^t of them."""
    ws = Workspace(domain.sparkSession, "all_tuples")
    numbered, sizes = indexed(ws, domain)
    subsets = column_subsets(sorted(sizes) if cols is None else cols, t)
    return product(ws, numbered, sizes, subsets).select(
        tuple_id(F.col("items")).alias("tuple_id"), "items"
    )


def incidence(
    df: DataFrame, cols: list[str], t: int, row_id: str | None = None, by: str = "row"
) -> DataFrame:
    """``(set_id, elem_id)`` between rows and the t-tuples they contain.

    ``by='row'``: a set is a row, its elements are tuples. ``by='tuple'``: the same pairs with
    the roles swapped. Rows are the distinct rows of ``cols`` (id = md5 of the row) unless
    ``row_id`` names a key column of ``df``.
    """
    if by not in ("row", "tuple"):
        raise ValueError(f"by must be 'row' or 'tuple', got {by!r}")
    subsets = column_subsets(cols, t)
    if row_id is None:
        known = F.filter(_items(sorted(cols)), lambda x: x["value"].isNotNull())
        rows = df.select(*cols).distinct().withColumn("_id", tuple_id(known))
    else:
        rows = df.select(F.col(row_id).alias("_id"), *cols)
    pairs = _explode_subsets(rows, cols, subsets).select(
        F.col("_id").alias("set_id"), tuple_id(F.col("items")).alias("elem_id")
    )
    return pairs if by == "row" else swap(pairs)


def swap(pairs: DataFrame) -> DataFrame:
    """Exchange the roles of sets and elements."""
    return pairs.select(
        F.col("elem_id").alias("set_id"),
        F.col("set_id").alias("elem_id"),
        *[c for c in pairs.columns if c not in ("set_id", "elem_id")],
    )


def variables_of(items: Column) -> Column:
    """The variable subset of a tuple as text."""
    return F.array_join(F.transform(items, lambda x: x["var"]), ",")


def coverage(
    df: DataFrame, cols: list[str], t: int, domain: DataFrame | None = None
) -> DataFrame:
    """``(variables, covered, possible, ratio)`` per column subset.

    ``possible`` is the product of the domain sizes; the domain is what the table holds unless
    given. Observed values outside a given domain do not count.
    """
    subsets = column_subsets(cols, t)
    own = domain is None
    domain = domains(df, cols) if own else domain.select("var", "value").distinct()
    seen = tway_tuples(df, cols, t).withColumn("variables", variables_of(F.col("items")))
    if not own:
        known = (
            seen.select("tuple_id", F.inline("items"))
            .join(domain, ["var", "value"])
            .groupBy("tuple_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == t)
        )
        seen = seen.join(known, "tuple_id", "left_semi")
    covered = seen.groupBy("variables").agg(F.count(F.lit(1)).alias("covered"))
    sizes = domain.groupBy("var").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(",".join(s), v) for s in subsets for v in s], "variables string, var string"
    )
    possible = (
        listed.join(sizes, "var", "left")
        .groupBy("variables")
        .agg(F.collect_list(F.coalesce("n", F.lit(0))).alias("ns"))
        .select(
            "variables",
            F.aggregate("ns", F.lit(1).cast("bigint"), lambda a, n: a * n).alias("possible"),
        )
    )
    return (
        possible.join(covered, "variables", "left")
        .withColumn("covered", F.coalesce("covered", F.lit(0).cast("bigint")))
        .select(
            "variables",
            "covered",
            "possible",
            F.when(F.col("possible") > 0, F.col("covered") / F.col("possible")).alias("ratio"),
        )
    )


def missing_tuples(
    df: DataFrame, cols: list[str], t: int, domain: DataFrame | None = None
) -> DataFrame:
    """``(tuple_id, items)`` of the t-tuples of the domain that no row of ``df`` contains.

    Observed tuples are numbered as the combinations of their subset are, and only the gaps between
    neighbouring numbers are generated: the work grows with what is seen and what is missing, not with
    the combinations. Values outside a given domain take no part.
    """
    spark = df.sparkSession
    with Workspace(spark, "missing") as ws:
        numbered, sizes = indexed(ws, domains(df, cols) if domain is None else domain.select("var", "value").distinct())
        # A variable without values has no combinations.
        subsets = [s for s in column_subsets(cols, t) if all(v in sizes for v in s)]
        if not subsets:
            ws.finish()
            return spark.createDataFrame([], "tuple_id string, items array<struct<var:string,value:string>>")
        # One row for each column subset.
        table = F.broadcast(mixed_radix(spark, sizes, subsets))
        seen = _explode_subsets(df.select(*cols).distinct(), cols, subsets).select("items").distinct()
        seen = seen.withColumn("vars", F.transform("items", lambda x: x["var"])).join(table, "vars")
        for i in range(t):
            digit = numbered.select(
                F.col("var").alias(f"var{i}"), F.col("value").alias(f"value{i}"), F.col("pos").alias(f"pos{i}")
            )
            seen = (
                seen.withColumn(f"var{i}", F.col("vars")[i])
                .withColumn(f"value{i}", F.col("items")[i]["value"])
                .join(digit, [f"var{i}", f"value{i}"])
            )
        code = sum((F.col(f"pos{i}") * F.col("strides")[i] for i in range(t)), F.lit(0).cast("bigint"))
        ends = table.select("subset", F.explode(F.array(F.lit(-1).cast("bigint"), "total")).alias("code"))
        codes = seen.select("subset", code.alias("code")).union(ends)
        placed = ranked(ws, codes, ["subset"], [F.col("code")], "codes", "place")
        after = placed.select("subset", (F.col("place") - 1).alias("place"), F.col("code").alias("upto"))
        gaps = placed.join(after, ["subset", "place"]).where("upto - code > 1")
        pieces = gaps.select(
            "subset",
            "upto",
            F.explode(F.sequence(F.col("code") + 1, F.col("upto") - 1, F.lit(PIECE).cast("bigint"))).alias("begin"),
        ).repartition("subset", "begin")
        missing = pieces.select(
            "subset",
            F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + PIECE, F.col("upto")) - 1)).alias("code"),
        )
        found = decoded(missing.join(table, "subset"), numbered, t)
        ws.finish("domain", "codes")
        return found.select(tuple_id(F.col("items")).alias("tuple_id"), "items")
