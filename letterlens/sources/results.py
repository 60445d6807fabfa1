"""Results replaced case by case, with a log of commits that readers follow.

A run writes its rows and the cases it is about into folders of its own, and then commits by one small file that appears
whole or not at all. Readers take committed runs only, and for each case the last of them. A batch of a stream names its
run after its id, so a batch that is replayed finds itself committed and changes nothing, and one that died half-way is
written over. After COMPACT_EVERY commits the latest rows become one run that replaces the others, so the number of files
does not grow with the number of reruns. One writer at a time is assumed, as a stream or a scheduled job is one.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

COMPACT_EVERY = 16
BUCKETS = 64
_COMMIT = "run string, seq long, batch long, replaces array<string>, schema string"


@dataclass
class Log:
    """The committed runs, in order, that no later run has replaced; and the last stream batch among all."""

    runs: list[str] = field(default_factory=list)
    seq: int = 0
    batch: int = -1
    schema: StructType | None = None


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read_log(spark: SparkSession, path: str) -> Log:
    at, fs = _folder(spark, f"{path}/commits")
    if not fs.exists(at):
        return Log()
    rows = sorted(spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").json(f"{path}/commits").collect(), key=lambda r: r.seq)  # COMPACT_EVERY or so
    gone = {x for r in rows for x in r.replaces or []}
    runs = [r.run for r in rows if r.run not in gone]
    return Log(runs, max((r.seq for r in rows), default=0), max((r.batch for r in rows), default=-1), StructType.fromJson(json.loads(rows[-1].schema)) if rows else None)


def _commit(spark: SparkSession, path: str, run: str, log: Log, batch: int, replaces: list[str], schema: StructType) -> None:
    row = spark.createDataFrame([(run, log.seq + 1, batch, replaces, schema.json())], _COMMIT)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/commits/{run}")


def _write(rows: DataFrame, cases: DataFrame, path: str, run: str, buckets: int) -> None:
    bucket = F.expr(f"pmod(xxhash64(case_id), {buckets})")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{run}")
    cases.select("case_id").distinct().coalesce(8).write.mode("overwrite").parquet(f"{path}/cases/{run}")


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS, cases: DataFrame | None = None, batch_id: int | None = None, compact_every: int = COMPACT_EVERY) -> bool:
    """Replaces the results of `cases` (of those in `results`, if not given), leaving other cases' as they are.

    batch_id: the id of a stream's batch, which is written once however often it is replayed. Gives whether anything was
    written. The columns of results are those of the runs before.
    """
    spark, log = results.sparkSession, read_log(results.sparkSession, path)
    if batch_id is not None and batch_id <= log.batch:
        return False
    run = f"batch-{batch_id:020d}" if batch_id is not None else f"run-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _write(results, results if cases is None else cases, path, run, buckets)
    _commit(spark, path, run, log, -1 if batch_id is None else batch_id, [], results.schema)
    if len(log.runs) + 1 > compact_every:
        compact(spark, path, buckets)
    return True


def _read(spark: SparkSession, path: str, log: Log) -> tuple[DataFrame, DataFrame]:
    """The rows of the log's runs and the last run of each case, runs by their place in the log."""
    schema = StructType([*log.schema.fields, StructField("bucket", IntegerType())])
    rows = cases = None
    for n, run in enumerate(log.runs):
        own = spark.read.schema(schema).parquet(f"{path}/rows/{run}").withColumn("_n", F.lit(n))
        ids = spark.read.schema("case_id string").parquet(f"{path}/cases/{run}").withColumn("_n", F.lit(n))
        rows, cases = (own, ids) if rows is None else (rows.unionByName(own), cases.unionByName(ids))
    return rows, cases.groupBy("case_id").agg(F.max("_n").alias("_n"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """For each case the rows of the last committed run that was about it, none if that run yielded none."""
    log = read_log(spark, path)
    if not log.runs:
        raise FileNotFoundError(f"no committed run in {path}")
    rows, last = _read(spark, path, log)
    return rows.join(last, ["case_id", "_n"]).select(*log.schema.names)


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Makes one run of the latest rows, commits it in place of the others, and then deletes those.

    Until the commit readers see the old runs, after it the new one; what a crash leaves undeleted nobody reads.
    """
    log = read_log(spark, path)
    if len(log.runs) < 2:
        return
    run = f"compact-{log.seq + 1:020d}"
    rows, last = _read(spark, path, log)
    _write(rows.join(last, ["case_id", "_n"]).select(*log.schema.names), last, path, run, buckets)
    _commit(spark, path, run, log, log.batch, log.runs, log.schema)
    for old in log.runs:
        for part in ("rows", "cases", "commits"):
            at, fs = _folder(spark, f"{path}/{part}/{old}")
            fs.delete(at, True)
