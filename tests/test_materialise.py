"""Tables in the shared folder."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from pixelframe.plans.materialise import CLEANUP, materialise


def test_shuffle_files_go_with_the_write(spark):
    """No shuffle file of the written query is left, and the session's own setting is as it was."""
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p for p in blocks.rglob("shuffle_*.data")}
    before, setting = held(), spark.conf.get(CLEANUP)
    out = materialise(spark.range(100_000).withColumn("x", F.rand(1)).repartition(8, "id"), "t")
    assert spark.conf.get(CLEANUP) == setting
    for _ in range(50):  # removal is asynchronous
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert out.count() == 100_000
