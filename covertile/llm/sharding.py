"""Sharding by longest processing time: groups that stay together, sizes as equal as they can be.

Rows with equal texts are a group. Groups are scheduled as LPT does it: sorted by size, largest
first, each to the least-loaded shard, which a heap gives. A corpus has too many groups for one
heap, so only groups above ``1 / (shards * DETAIL)`` of all bytes are jobs of their own (there are
at most ``shards * DETAIL`` of them); all other groups are packed by the hash of their text into
``shards * PACKS`` packs, which are the remaining jobs. The driver thus sees a bounded number of
jobs however large the corpus is, and shards differ by no more than a pack, or by what a single
group exceeds the mean.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.plans.workspace import Workspace

SHARDS = 16
DETAIL = 64
PACKS = 1024


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null and empty texts are the same group."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def longest_first(jobs: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """(size, name) -> shard by LPT; equal sizes and loads go by name and shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_of_rows(
    docs: DataFrame, column: str = "shard", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """``docs`` with ``column``, 0 to ``shards - 1``; equal texts share a shard.

    The two tables joined to the rows have at most ``shards * DETAIL`` and ``shards * PACKS``
    rows, whatever the input, and are broadcast. Null texts are empty ones, of size 1.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    k1, k2, pack, big, size = (f"_{n}_{uuid.uuid4().hex}" for n in ("k1", "k2", "pack", "big", "size"))
    packs = shards * PACKS
    groups = (
        docs.select(*text_key(F.col(text)), size_of(F.col(text)).alias("size"))
        .groupBy("k1", "k2")
        .agg(F.sum("size").alias("size"))
    )
    groups, seen = ws.measured(groups, "groups", total=F.sum("size"))
    rows = groups.where(F.col("size") * F.lit(shards * DETAIL) > F.lit(seen["total"])).collect()
    large = [(r["size"], (0, r["k1"], r["k2"])) for r in rows]
    small = (
        groups.where(F.col("size") * F.lit(shards * DETAIL) <= F.lit(seen["total"]))
        .groupBy(F.pmod("k1", F.lit(packs)).alias("pack"))
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    placed = longest_first(large + [(r["size"], (1, r["pack"], 0)) for r in small], shards)
    own = spark.createDataFrame(
        [(n[1], n[2], s) for n, s in placed.items() if n[0] == 0], f"{k1} bigint, {k2} bigint, {big} int"
    )
    packed = spark.createDataFrame(
        [(n[1], s) for n, s in placed.items() if n[0] == 1], f"{pack} bigint, {size} int"
    )
    first, second = text_key(F.col(text))
    others = [f"`{c}`" for c in docs.columns if c != column]
    return (
        docs.withColumn(k1, first)
        .withColumn(k2, second)
        .withColumn(pack, F.pmod(F.col(k1), F.lit(packs)))
        .join(F.broadcast(own), [k1, k2], "left")
        .join(F.broadcast(packed), pack, "left")
        .select(*others, F.coalesce(big, size).alias(column))
    )


def slots(ws: Workspace, placed: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps in each ``shard``, along ``order`` (ties anyhow).

    Rows are range partitioned, so many tasks number a shard, and written, as a second evaluation
    may cut the ranges elsewhere. What the broadcast holds is a row for each task and shard in it:
    at most their sum, as the ranges are disjoint.
    """
    by = ["shard", *order]
    laid = ws.write(
        placed.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("range_", F.spark_partition_id())
        .withColumn("at_", F.monotonically_increasing_id()),
        "ordered",
    )
    earlier = Window.partitionBy("shard").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy("shard", "range_")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at_").alias("first_"))
        .withColumn("before_", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    return laid.join(F.broadcast(starts), ["shard", "range_"]).select(
        *placed.columns, (F.col("before_") + F.col("at_") - F.col("first_")).alias("slot")
    )


def shard_table(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """Per row ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the bytes law."""
    ws = Workspace(docs.sparkSession, "slots")
    small = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = shard_of_rows(small, shards=shards).select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
    )
    return slots(ws, placed, ["doc_id", "text_crc32"]).withColumn(
        "grown_shard", F.lit(None).cast("int")
    )


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, in place of columns of these names; rows by shard and id."""
    ws = Workspace(docs.sparkSession, "sharded")
    names = [f"`{c}`" for c in docs.columns if c not in ("shard", "slot")]
    placed = shard_of_rows(docs, "shard", text, shards)
    placed = placed.select("shard", F.col(doc_id).alias("id"), F.struct(*names).alias("row"))
    return slots(ws, placed, ["id"]).select("row.*", "shard", "slot")
