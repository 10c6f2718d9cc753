"""Tables that a plan reads several times, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if the
    executors are threads of this machine, else an error."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/fieldtrust-checkpoints"
    return found.rstrip("/")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back: what follows reads only the
    columns it needs, and a lost executor costs no more than a file's rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
