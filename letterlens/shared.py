"""What sources, operators and queries share: tables in the folder that driver and executors share, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured bytes are no more than this.
BROADCAST_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='letterlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for tables that are written once and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_once(df: DataFrame, path: str) -> DataFrame:
    """df written and read again: it cuts lineage, survives the loss of executors, and what reads it reads it once made."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(*columns: str | Column) -> Column:
    """Bytes that a row takes with these texts, the fixed part of a row included."""
    total = F.lit(64)
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def is_small(df: DataFrame, *texts: str | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the bytes of df's rows, with these text columns, are within the limit."""
    return (df.agg(F.sum(text_bytes(*texts))).first()[0] or 0) <= limit


def sized_side(df: DataFrame, *texts: str | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, *texts, limit=limit) else df
