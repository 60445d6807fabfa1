"""Files read by many tasks whose parts depend on what comes before them.

Spark cuts a text file, or one in a splittable compression, into splits, and a task reads the lines of a split in order.
What a split needs to know of the ones before it (how many quotes, how many bytes) is summed up per split first; the
sums of a file's splits, in order, are a table with a row per split, and its prefix sums go to the tasks of a second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterlens.shared import BROADCAST_BYTES, is_small


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where it starts in the file) and value, the bytes of a line without its line feed; lines of a split in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def before_split(per_split: DataFrame, amount: str) -> DataFrame:
    """file, split, and `amount` summed over the splits of the file before it; per_split has a row per split."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("file", "split", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("long").alias("before"))


def with_before(lines: DataFrame, starts: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """lines, still in order within their split, with `before` of their split."""
    if is_small(starts, "file", limit=limit):
        return lines.join(F.broadcast(starts), ["file", "split"])  # a broadcast join leaves lines where and as they are
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    return numbered.join(starts.hint("shuffle_merge"), ["file", "split"]).sortWithinPartitions("file", "split", "line").drop("line")
