"""Result tables bucketed by case, so that what joins them on case_id moves no rows.

Each engine's results are saved as a table with the same number of buckets of case_id. Joins of such tables read bucket
by bucket; Spark plans no exchange for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINES = ("parsed", "rules", "ml", "ioc", "geo", "correlation")
BUCKETS = 64


def save_bucketed(results: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Saves results, replacing the table, in buckets of case_id, sorted within them."""
    results.repartition(buckets, "case_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "case_id").sortBy("case_id").saveAsTable(table)


def keep_bucketed(results: DataFrame, path: str, dealt: bool = True, table: str | None = None) -> DataFrame:
    """results saved at path and read again, in as many buckets of case_id as a shuffle has partitions.

    What is dealt by case_id already is written as it lies; nothing is shuffled for it. What the write itself shuffles
    is deleted when it ends, as nothing reads it again.
    """
    spark, table = results.sparkSession, table or f"letterlens_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not dealt:
        results = results.repartition(buckets, "case_id")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        results.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "case_id").sortBy("case_id").saveAsTable(table)
    finally:
        spark.conf.set(cleanup, before)
    return spark.table(table)


def drop_kept(spark: SparkSession, *paths: str) -> None:
    """Deletes the rows that keep_bucketed() saved at these paths, which nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def pending_of_tables(spark: SparkSession, cases: str, results: list[str], force: bool = False) -> DataFrame:
    """Cases that lack a row in some result table; all of them if forced. All are tables in the same buckets of case_id.

    Each result table is read once, by its case_id alone; the joins are by merging of buckets, without an exchange.
    """
    rows = spark.table(cases)
    if force:
        return rows
    done = None
    for name in results:
        own = spark.table(name).select("case_id").hint("merge")
        done = own.distinct() if done is None else done.join(own, "case_id", "left_semi")
    return rows.join(done.hint("merge"), "case_id", "left_anti")


def drop_tables(spark: SparkSession, *tables: str) -> None:
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def completeness(spark: SparkSession, cases: str, results: dict[str, str]) -> DataFrame:
    """Per case the engines that have no result for it, in order; results: table by engine."""
    out = spark.table(cases).select("case_id")
    for name, table in results.items():
        out = out.join(spark.table(table).select("case_id").distinct().withColumn(name, F.lit(True)).hint("merge"), "case_id", "left")
    return out.select("case_id", F.concat_ws(",", *[F.when(F.col(n).isNull(), n) for n in results]).alias("missing"))
