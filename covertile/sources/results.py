"""Experiment records as ``;``-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame

RESULT_COLUMNS = ["t", "n", "v", "algo", "seconds", "size"]


def write_results(df: DataFrame, path: str) -> None:
    """Append one ``t;n;v;algo;seconds;size`` line per row."""
    df.select(*RESULT_COLUMNS).write.mode("append").option("sep", ";").csv(path)
