"""Variables, their domains, and the complete rows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tuple_id
from ..plans.ranks import ranked
from ..plans.workspace import Workspace
from .checks import check_at_least

DOMAIN_SCHEMA = "var string, value string"

# Ids generated from one row of the piece table; keeps every exploded sequence short.
PIECE = 1 << 16


def domains(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(var, value)``: the distinct non-null values of each column, as strings."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        texts.unpivot([], list(cols), "var", "value").where(F.col("value").isNotNull()).distinct()
    )


def synthetic_domain(spark: SparkSession, n: int, v: int) -> DataFrame:
    """``n`` variables p01, p02, ... with the values 1..v."""
    check_at_least("n", n, 2)
    check_at_least("v", v, 2)
    width = max(2, len(str(n)))
    return spark.range(n * v).select(
        F.concat(
            F.lit("p"),
            F.lpad(F.floor(F.col("id") / v + 1).cast("string"), width, "0"),
        ).alias("var"),
        (F.col("id") % v + 1).cast("string").alias("value"),
    )


def indexed(ws: Workspace, domain: DataFrame, name: str = "domain") -> tuple[DataFrame, dict]:
    """The domain with a 0-based position per variable, and the size of each variable.

    Only one number per variable reaches the driver.
    """
    numbered = ws.write(
        ranked(ws, domain, ["var"], [F.col("value")], f"{name}_sorted", "pos").select(
            "var", "value", (F.col("pos") - 1).alias("pos")
        ),
        name,
    )
    sizes = {r["var"]: r["n"] for r in numbered.groupBy("var").agg(F.count("*").alias("n")).collect()}
    return numbered, sizes


def mixed_radix(spark: SparkSession, sizes: dict[str, int], subsets: list[tuple[str, ...]]) -> DataFrame:
    """``(subset, vars, strides, radix, total)``: how combinations of a subset are numbered.

    Combination number ``code`` of a subset is a mixed-radix number whose digits are positions in the
    domains.
    """
    plan = []
    for number, subset in enumerate(subsets):
        strides, total = [], 1
        for var in reversed(subset):
            strides.insert(0, total)
            total *= sizes[var]
        if total >= 1 << 63:
            raise ValueError(f"the combinations of {subset} do not fit a 64-bit number")
        plan.append((number, list(subset), strides, [sizes[v] for v in subset], total))
    return spark.createDataFrame(
        plan,
        "subset int, vars array<string>, strides array<bigint>, radix array<bigint>, total bigint",
    )


def product(
    ws: Workspace, numbered: DataFrame, sizes: dict[str, int], subsets: list[tuple[str, ...]]
) -> DataFrame:
    """``(subset, code, items)`` for every combination of values of every variable subset.

    The combinations come from a generated range and one equality join per digit. The range is cut
    into short pieces, hence one huge subset spreads evenly.
    """
    table = mixed_radix(ws.spark, sizes, subsets)
    pieces = table.withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(total - 1) div {PIECE}")))
    ).repartition("subset", "piece")
    codes = pieces.withColumn(
        "code",
        F.explode(
            F.sequence(
                F.col("piece") * PIECE,
                F.least(F.col("total"), (F.col("piece") + 1) * PIECE) - 1,
            )
        ),
    )
    return decoded(codes, numbered, len(subsets[0]))


def decoded(codes: DataFrame, numbered: DataFrame, width: int) -> DataFrame:
    """``(subset, code, items)`` of ``codes``, which hold the columns of :func:`mixed_radix`."""
    for i in range(width):
        digit = numbered.select(
            F.col("var").alias(f"var{i}"),
            F.col("pos").alias(f"pos{i}"),
            F.col("value").alias(f"value{i}"),
        )
        codes = (
            codes.withColumn(f"var{i}", F.col("vars")[i])
            .withColumn(f"pos{i}", F.expr(f"(code div strides[{i}]) % radix[{i}]"))
            .join(digit, [f"var{i}", f"pos{i}"])
        )
    items = F.array(
        *[
            F.struct(F.col(f"var{i}").alias("var"), F.col(f"value{i}").alias("value"))
            for i in range(width)
        ]
    )
    return codes.select("subset", "code", items.alias("items"))


def all_rows(domain: DataFrame) -> DataFrame:
    """Full factorial: ``row_id`` and one column per variable, v1 * v2 * ... * vn rows.

    Exponential by nature; meant for small domains. Prefer candidate rows from a real table.
    """
    ws = Workspace(domain.sparkSession, "all_rows")
    numbered, sizes = indexed(ws, domain)
    variables = sorted(sizes)
    rows = product(ws, numbered, sizes, [tuple(variables)])
    return rows.select(
        tuple_id(F.col("items")).alias("row_id"),
        *[F.col("items")[i]["value"].alias(v) for i, v in enumerate(variables)],
    )
