"""Hyperedge text: one set per line, members separated by spaces, ``#`` for comments.

With ``header`` the first line of every file holds the number of sets. Reader and writer have
the same default, so what is written is read back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace


def _is_set(line: Column) -> Column:
    return (F.trim(line) != "") & ~F.startswith(line, F.lit("#"))


def _members(line: Column) -> Column:
    return F.transform(F.array_distinct(F.split(F.trim(line), r"\s+")), lambda x: x.cast("bigint"))


def read_hyperedges(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``(path, set_id, elem_id)``; sets are numbered from 1 in the line order of each file.

    Files are split and read in parallel, of whatever size. A line number is the position in its
    split plus the lines of the earlier splits of the file, so only one row per split is ordered.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    sets = lines.where(_is_set(F.col("value"))).withColumn("at", F.monotonically_increasing_id())
    key = ["path", "block"]
    blocks = sets.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first_at"),
        F.min("line").alias("first_line"),
    )
    if header:
        # The header is the first line of the file, even if that line is a comment or empty.
        tops = (
            lines.groupBy(*key)
            .agg(F.min("line").alias("top"))
            .where(F.col("block") == 0)
        )
        blocks = blocks.join(tops, key, "left")
    else:
        blocks = blocks.withColumn("top", F.lit(None).cast("bigint"))
    blocks = blocks.withColumn(
        "own", F.col("n") - F.coalesce((F.col("first_line") == F.col("top")).cast("int"), F.lit(0))
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    skipped = F.col("n") - F.col("own")
    return (
        sets.join(blocks, key)
        .where(F.col("top").isNull() | (F.col("line") != F.col("top")))
        .select(
            "path",
            (F.col("before") + F.col("at") - F.col("first_at") + 1 - skipped).alias("set_id"),
            F.explode(_members(F.col("value"))).alias("elem_id"),
        )
    )


def parse_hyperedges(df: DataFrame, text: str = "text", header: bool = True) -> DataFrame:
    """The same grammar over a string column that holds a whole hypergraph per row.

    The other columns are kept; ``set_id`` counts from 1 within a row.
    """
    rest = [c for c in df.columns if c != text]
    kept = F.filter(
        F.split(F.col(text), r"\r?\n"),
        lambda line, i: _is_set(line) & ((i > 0) | F.lit(not header)),
    )
    sets = df.select(*rest, F.posexplode(kept).alias("at", "line"))
    return sets.select(
        *rest,
        (F.col("at") + 1).cast("bigint").alias("set_id"),
        F.explode(_members(F.col("line"))).alias("elem_id"),
    )


def write_hyperedges(
    pairs: DataFrame, path: str, header: bool = True, files: int | None = None
) -> None:
    """Write ``(set_id, elem_id)``, one line per set with its members in order.

    Sets are spread over ``files`` files by a hash of their id (default: the number of shuffle
    partitions). One set is one line by definition of the format, so a set must fit a row.
    """
    spark = pairs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = (
        pairs.groupBy("set_id")
        .agg(F.sort_array(F.collect_set("elem_id")).alias("members"))
        .select(
            F.pmod(F.xxhash64("set_id"), F.lit(files)).cast("int").alias("part"),
            F.lit(1).alias("kind"),
            "set_id",
            F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("value"),
        )
    )
    if header:
        ws = Workspace(spark, "hyperedges")
        lines = ws.write(lines, "lines")
        counts = (
            lines.groupBy("part")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                "part",
                F.lit(0).alias("kind"),
                F.lit(None).cast(lines.schema["set_id"].dataType).alias("set_id"),
                F.col("n").cast("string").alias("value"),
            )
        )
        lines = lines.select("part", "kind", "set_id", "value").unionByName(counts)
    (
        lines.repartition(files, "part")
        .sortWithinPartitions("part", "kind", "set_id")
        .select("part", "value")
        .write.partitionBy("part")
        .text(path)
    )
    if header:
        ws.drop("lines")
