"""Indicator sources that are plugged in: a Python data source reads each in a partition of its own.

A source is any object with a name and a method indicators() that yields records. One that raises, or that has a record
breaking the feed's rules, is reported as failed, with its reason; the other sources' rows are as they would be without it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from letterlens.operators import indicators as I
from letterlens.sources import feeds as FE

SCHEMA = "source string, place int, type string, value string, status string, confidence string, reason string, feed_version string, feed_sha256 string, error string"
FIELDS = ("type", "value", "status", "confidence", "reason", "feed_version", "feed_sha256")


class IndicatorSource(Protocol):
    name: str

    def indicators(self) -> Iterator[dict]:
        """Records with type, value, status, confidence, reason, and feed_version and feed_sha256 if there are any."""


@dataclass(frozen=True)
class Records:
    """A source of given records."""

    name: str
    records: tuple[dict, ...]

    def indicators(self) -> Iterator[dict]:
        yield from self.records


@dataclass(frozen=True)
class JsonFeed:
    """A feed file as feeds.FEED has it, at a local path or a URI that Arrow's file systems open."""

    name: str
    uri: str

    def indicators(self) -> Iterator[dict]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(path) as f:
            content = f.read()
        root = json.loads(content)
        stamp = {"feed_version": root["feed_version"], "feed_sha256": hashlib.sha256(content).hexdigest()}
        for record in root["indicators"]:
            yield {k: record.get(k) for k in FIELDS} | stamp


class _Partition(InputPartition):
    def __init__(self, at: int):
        super().__init__(at)


class _Reader(DataSourceReader):
    def __init__(self, sources: Sequence[IndicatorSource]):
        self.sources = sources

    def partitions(self) -> list[InputPartition]:
        return [_Partition(i) for i in range(len(self.sources))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, rows = self.sources[partition.value], []
        try:
            for place, record in enumerate(source.indicators()):
                own = [record.get(k) for k in FIELDS]
                own[3] = None if own[3] is None or isinstance(own[3], bool) else str(own[3])
                rows.append((source.name, place, *own, None))
        except Exception as e:  # a failed source gives its reason, and none of the rows it had begun with
            yield (source.name, None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")
            return
        yield from rows


def read_sources(spark: SparkSession, sources: Sequence[IndicatorSource]) -> DataFrame:
    """A row per record of each source, and one with `error` for a source that failed; columns as in SCHEMA."""
    held = tuple(sources)

    class Indicators(DataSource):
        @classmethod
        def name(cls) -> str:
            return "letterlens_indicators"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(held)

    spark.dataSource.register(Indicators)
    return spark.read.format("letterlens_indicators").load()


def match_sources(indicators: DataFrame, sources: Sequence[IndicatorSource]) -> DataFrame:
    """Every indicator against every source; a failed source has status error for each, with its reason.

    What failed is settled per source before the lookup: a source that raised, one with a record that breaks the feed's
    rules (I12), and one without records. Names must differ.
    """
    from letterlens.shared import new_folder, write_once

    spark, names = indicators.sparkSession, [s.name for s in sources]
    if len(set(names)) != len(names):
        raise ValueError("two sources have the same name")
    rows = write_once(read_sources(spark, sources), new_folder(spark, "indicator-sources"))
    broken = FE.feed_violations(rows.where("error is null")).groupBy("source").agg(F.min_by("violation", "place").alias("violation"))
    raised = rows.where("error is not null").select("source", "error")
    failed = {r.source: r.error for r in raised.collect()} | {r.source: f"record breaks the feed's rules: {r.violation}" for r in broken.collect()}  # a row a source
    good = rows.where("error is null").drop("error").where(~F.col("source").isin(*failed)) if failed else rows.drop("error")
    matches = I.match_indicators(indicators, FE.valid_feed(good), names)
    reasons = F.create_map(*[F.lit(x) for n in names for x in (n, failed.get(n, "the source has no records"))])
    return matches.withColumn("reason", F.when(F.col("status") == "error", reasons[F.col("source")]).otherwise(F.col("reason")))
