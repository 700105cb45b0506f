"""Session-level helpers: table access, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; no filter, no cap."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the setting is unset and the session is a local one (tests, a laptop) a
    temporary folder is made and stored in the session, so that later calls use the same
    one. On a cluster a folder of one machine would not do, so the setting is required.
    """
    at = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_CONF} has to name a folder all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set(CHECKPOINT_CONF, at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in :func:`shared_dir`."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what finished phases of a long query held.

    Shuffle files and checkpoints are only dropped once the driver's garbage is
    collected, which a driver with room to spare may not do before a disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, for a table written and read again."""
    return f"{shared_dir(spark)}/{label}-{os.urandom(8).hex()}"


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_rows(df: DataFrame, max_rows: int) -> list:
    """Rows of a table that must be small by its nature; raises if it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows in a table that has to be small")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``F.broadcast`` behind a check of the row count; else the frame as it is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df
