"""Session helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed input bytes handled as one block of documents.
BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. A session on one machine may name none and gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty() and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="marlstone-ckpt-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = threading.Lock()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors.

    The shuffle files that lead to the checkpoint are of no more use once it is written, so Spark is told to remove
    them then, not when the driver happens to collect garbage. The setting belongs to the session, so threads that share
    one write their checkpoints in turn.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with _SETTING:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            # A new DataFrame takes the setting; the one that was given may be older.
            return df.select("*").checkpoint()
        finally:
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def input_bytes(df: DataFrame) -> int:
    """The planner's size estimate of a DataFrame, from file sizes; no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.sizeInBytes())


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the input is dealt into: in proportion to its bytes, at least one per shuffle partition."""
    spark = df.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A plan that does not start from files reports a huge default size; such inputs use the partition count.
    size = input_bytes(df)
    return max(floor, 1) if size > 1 << 50 else max(floor, math.ceil(size / block_bytes))


def doc_block(blocks: int, column: str = "doc_id"):
    """The block number of a document, from its id alone."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(blocks)).cast("int")
