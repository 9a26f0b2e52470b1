"""Session settings the page jobs rely on, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the page jobs expect and return the session.

    Pages are wide rows (kilobytes to megabytes), so Arrow batches towards the
    shredder are kept short; times are compared in UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def _checkpoint_folder(spark) -> str:
    """The shared folder of ``spark.checkpoint.dir``, set as the session's checkpoint folder.

    Only a local session may fall back to a temporary folder; a cluster without
    the setting is refused, because a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="pageloom-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, for what a job itself writes and reads."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder named by ``spark.checkpoint.dir``."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back: for loops of many rounds.

    A checkpoint keeps the size its plan was estimated to have, and a join's estimate is the product of its sides, so over the
    rounds of a loop the numbers alone grow beyond use. Files have the size they have.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
