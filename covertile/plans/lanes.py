"""Explicit splitting of hot keys for many-to-one joins.

A key that holds more than ``limit`` rows is cut into lanes of about ``limit`` rows each: the
large side carries ``(key, lane)``, the small side is copied once per lane of its key, and the
join runs on both columns. Ordinary keys have the single lane 0. The list of hot keys has at
most ``rows / limit`` entries. Nothing is dropped: lanes only spread the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

HOT_ROWS = 1_000_000
# Above this many hot keys their table is joined by shuffle instead of broadcast.
BROADCAST_KEYS = 100_000


class Lanes:
    def __init__(
        self,
        ws: Workspace,
        name: str,
        df: DataFrame,
        key: list[str],
        spread: str,
        limit: int = HOT_ROWS,
        rows: int | None = None,
    ):
        """``rows`` is the size of ``df`` if known: a table within the limit has no hot key."""
        self.key, self.spread, self.lane = key, spread, f"{name}_lane"
        self.count = 0
        if rows is not None and rows <= limit:
            return
        found = (
            df.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > limit)
            .select(*key, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("lanes"))
        )
        hot, seen = ws.measured(found, f"{name}_hot")
        self.count = seen["rows"]
        self.hot = F.broadcast(hot) if self.count <= BROADCAST_KEYS else hot

    @property
    def on(self) -> list[str]:
        return [*self.key, self.lane] if self.count else list(self.key)

    def tag(self, large: DataFrame) -> DataFrame:
        """Add the lane column to the many side."""
        if not self.count:
            return large
        return (
            large.join(self.hot, self.key, "left")
            .withColumn(
                self.lane,
                F.coalesce(F.pmod(F.xxhash64(self.spread), F.col("lanes")), F.lit(0)).cast("int"),
            )
            .drop("lanes")
        )

    def copy(self, small: DataFrame) -> DataFrame:
        """One copy of each row of the one side per lane of its key."""
        if not self.count:
            return small
        return (
            small.join(self.hot, self.key, "left")
            .withColumn(
                self.lane,
                F.explode(F.sequence(F.lit(0), F.coalesce(F.col("lanes"), F.lit(1)) - F.lit(1))),
            )
            .drop("lanes")
        )
