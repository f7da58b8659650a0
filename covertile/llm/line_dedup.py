"""Line deduplication by overlapping windows of three lines, with native expressions only.

A window is three consecutive lines (cut at ``\\n``) of which one holds a word. It is known by 128 bits
of hash. Windows that occur more than once are found by one aggregation, combined before the exchange,
that keeps the first place of each: smallest id, then smallest position. Joining the windows to
those, every occurrence but the first covers its three lines; covered positions of a document are
merged, and the lines at the other positions stay. The first places are written before that join, so a
hot window is one row of a scan, and the side with its occurrences may be split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.plans.workspace import Workspace

from .rows import numbered

LINES = 3
WORD = r"[^\x20\x09-\x0D]"


def _windows(lines: Column) -> Column:
    """Array of (pos, h1, h2) of the windows that hold a word; lines are counted from 0."""
    # A conditional, as a sequence would count down for short texts.
    starts = F.when(F.size(lines) >= LINES, F.sequence(F.lit(0), F.size(lines) - LINES))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    worded = F.filter(starts, lambda i: F.array_join(F.slice(lines, i + 1, LINES), "").rlike(WORD))
    return F.transform(
        worded,
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(F.slice(lines, i + 1, LINES)).alias("h1"),
            F.xxhash64(F.lit("second"), F.slice(lines, i + 1, LINES)).alias("h2"),
        ),
    )


def drop_repeated_windows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n_lines: str = "n_lines",
    n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` without the lines of later occurrences of three-line windows, and two counts.

    The first occurrence is that of the smallest id (null before all), then the first row of that
    id, then the smallest position; a document's own repeats count. Windows are judged on the input.
    Texts of fewer than three lines stay as they are, null stays null with no lines. A document may
    end up empty; its row stays. Columns of the names of the counts are replaced.
    """
    ws = Workspace(docs.sparkSession, "lines")
    # The lines are written, not the text: a split inside a lambda would run for every line.
    cut = f"_lines_{uuid.uuid4().hex}"
    rows, place = numbered(ws, docs.withColumn(cut, F.split(F.col(text), "\n", -1)).drop(text))
    lines = F.col(cut)
    found = rows.select(
        F.col(place).alias("row"), F.col(doc_id).alias("id"), F.inline(_windows(lines))
    )
    firsts = (
        found.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "pos")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    firsts = ws.write(firsts, "firsts")
    covered = (
        found.join(firsts, ["h1", "h2"])
        .where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
        .groupBy(F.col("row").alias(place))
        .agg(F.sort_array(F.collect_set("pos")).alias("later"))
    )
    gone = f"{place}_gone"
    covered = covered.select(
        place,
        F.array_distinct(
            F.flatten(F.transform("later", lambda p: F.sequence(p, p + F.lit(LINES - 1))))
        ).alias(gone),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), lines).otherwise(F.transform(kept, lambda i: F.get(lines, i)))
    new = F.array_join(kept, "\n")
    columns = [
        new.alias(c) if c == text else F.col(f"`{c}`")
        for c in docs.columns
        if c not in (n_lines, n_removed)
    ]
    return rows.join(covered, place, "left").select(
        *columns,
        F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias(n_lines),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias(n_removed),
    )
