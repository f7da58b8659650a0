"""Row identities for tables whose ids may be missing or repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.plans.workspace import Workspace


def identified(ws: Workspace, docs: DataFrame, scan: bool) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart however often it is evaluated, and its name.

    With ``scan``, ``docs`` is a plain scan of files, as ``spark.read`` gives it: a row is known by its
    file and its number in it, and nothing is written. Any other frame is written with row numbers.
    """
    if not scan:
        return numbered(ws, docs)
    place = f"_place_{uuid.uuid4().hex}"
    file = F.xxhash64("_metadata.file_path").alias("file")
    return docs.withColumn(place, F.struct(file, F.col("_metadata.row_index").alias("row"))), place


def numbered(ws: Workspace, docs: DataFrame, name: str = "numbered") -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and the name of that column.

    It has to be written: how a scan is split, and so what numbers its rows get, may change between
    two evaluations when executors come or go.
    """
    place = f"_place_{uuid.uuid4().hex}"
    return ws.write(docs.withColumn(place, F.monotonically_increasing_id()), name), place
