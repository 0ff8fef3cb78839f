"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.plans.materialise import materialise, shared_folder

#: Rows up to which a counted table is broadcast; beyond it an ordinary join is planned.
BROADCAST_ROWS = 20_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here and a lost executor costs nothing that was written."""
    return materialise(df, name)


def partitions(spark: SparkSession, rows: float, per_task: int) -> int:
    """At least the session's shuffle partitions, and so many that a task gets about ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // per_task) + 1)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with a table of ``rows`` counted rows: broadcast while that is small."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)
