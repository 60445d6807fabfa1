"""Mail in CSV files, read by ranges of bytes.

A quoted message has line feeds in it, so a line's place in a record is known only from the quotes before it: a line
begins a record if their number is even (a doubled quote counts twice). Quotes are counted per split, the counts summed
over the splits, and then each task puts the records of its split together. What a split holds of a record that began
in an earlier one, or that ends in a later one, is a fragment; a split has two at most, and they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterlens.shared import BROADCAST_BYTES, new_folder, write_once
from letterlens.sources.ordered import before_split, ordered_lines, with_before

WHOLE, HEAD, TAIL = 0, 1, 2
_RECORDS = "file string, split long, kind int, first boolean, value binary"


class _Records:
    """Records of one split, fed with its lines in order."""

    def __init__(self, file: str, split: int, quotes: int):
        self.file, self.split, self.odd, self.open, self.kind, self.seen = file, split, quotes % 2, [], HEAD if quotes % 2 else WHOLE, False
        self.out = []

    def _close(self) -> None:
        self.out.append((self.kind, self.split == 0 and not self.seen and self.kind != HEAD, b"\n".join(self.open)))
        self.seen, self.open, self.kind = True, [], WHOLE

    def add(self, lines: list[bytes], quotes: np.ndarray) -> list:
        """Takes lines with their numbers of quotes; gives the records that end in them."""
        ends = (self.odd + np.cumsum(quotes)) % 2 == 0
        at = 0
        for end in np.flatnonzero(ends).tolist():
            self.open += lines[at:end + 1]
            self._close()
            at = end + 1
        self.open += lines[at:]
        self.odd = 0 if len(ends) and ends[-1] else 1 if len(ends) else self.odd
        out, self.out = self.out, []
        return out

    def rest(self) -> list:
        """The record that is still open, a fragment."""
        if self.open:
            self.kind = HEAD if self.kind == HEAD else TAIL
            self._close()
        out, self.out = self.out, []
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None

    def rows(own: _Records, records: list) -> pa.RecordBatch:
        kind, first, value = zip(*records, strict=True)
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([own.file] * n), pa.array([own.split] * n, pa.int64()), pa.array(kind, pa.int32()), pa.array(first), pa.array(value, pa.binary())],
                                          ["file", "split", "kind", "first", "value"])

    for batch in batches:
        splits, files = batch.column("split").to_numpy(), batch.column("file")
        cuts = np.flatnonzero((splits[1:] != splits[:-1]) | np.array(pc.not_equal(files[1:], files[:-1]))) + 1 if len(batch) > 1 else []
        for begin, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            part = batch.slice(begin, end - begin)
            if not len(part):
                continue
            place = part.column("file")[0].as_py(), part.column("split")[0].as_py()
            if now is None or (now.file, now.split) != place:
                if now is not None and (left := now.rest()):
                    yield rows(now, left)
                now = _Records(*place, part.column("before")[0].as_py())
            lines = part.column("value")
            if records := now.add(lines.to_pylist(), pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)):
                yield rows(now, records)
    if now is not None and (left := now.rest()):
        yield rows(now, left)


def csv_records(spark: SparkSession, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """file, first (whether it is a file's first record) and value, the text of a record as it stands in the file.

    Quotes stand only around a field or doubled within one (RFC 4180); line feeds outside quotes end a record, with a
    carriage return before them or not; empty records are left out. A file that ends within quotes gives its last record as it is.
    """
    lines = ordered_lines(spark, path)
    text = F.decode("value", "ISO-8859-1")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    starts = before_split(lines.groupBy("file", "split").agg(F.sum(quotes.cast("long")).alias("quotes")), "quotes")
    starts = write_once(starts, new_folder(spark, "csv-splits"))
    cut = with_before(lines, starts, limit).select("file", "split", "before", "value").mapInArrow(_cut, _RECORDS)
    cut = write_once(cut, new_folder(spark, "csv-records"))
    record = Window.partitionBy("file").orderBy("split", "kind")
    fragments = cut.where(F.col("kind") != WHOLE).withColumn("n", F.sum((F.col("kind") == TAIL).cast("int")).over(record))
    joined = fragments.groupBy("file", "n").agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "kind", "value"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(None).cast("binary"), lambda acc, p: F.when(acc.isNull(), p.value).otherwise(F.concat(acc, F.encode(F.lit("\n"), "UTF-8"), p.value)))
    out = cut.where(F.col("kind") == WHOLE).select("file", "first", "value").unionByName(joined.select("file", "first", whole.alias("value")))
    value = F.regexp_replace(F.col("value").cast("string"), "\r$", "")
    return out.withColumn("value", value).where("value <> ''")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files that share a header, all columns strings, as spark.read.csv reads them with multiLine.

    A file is read by as many tasks as it has splits, where multiLine gives a file to one task.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, escape='"').columns  # of the first record alone
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    return csv_records(spark, path).where("not first").select(F.from_csv("value", F.lit(schema), options).alias("r")).select("r.*")


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mail in CSV, columns file and message: path, mailbox (what comes before the first slash) and content."""
    rows = read_quoted_csv(spark, path)
    return rows.select(F.col("file").alias("path"), F.regexp_extract("file", r"^([^/]*)", 1).alias("mailbox"), F.encode("message", "UTF-8").alias("content"))
