"""Token ids as Parquet files with list columns, laid out for selective reads.

Documents are encoded, range-sorted by doc_id and written as shards in that order. Ids are dictionary-encoded (a
vocabulary's ids in 16 bits), doc_id, start and n_tokens delta-encoded; row groups and pages are of chosen sizes and every
file has column and offset indexes. So the columns of metadata are read without the ids, and the ids of some documents,
or of a stretch of the corpus, without the pages of the others.

A shard's `start` counts from the shard's begin. The small table `shards` has each shard's first position in the corpus:
it is summed up after the shards are written, so no id is written twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side
from .token_counts import vocabulary_path
from .word_ids import word_ids

FILE = "word_bpe_49k.json"
END_ID = 2
#: Texts that a task holds at once.
TEXTS = 400
#: Ids of a shard, and the fewest for which another shard is worth while when there are fewer shards than cores.
SHARD_IDS, LEAST_IDS = 1 << 26, 1 << 18
#: Bytes of a row group before encoding and of a page; rows of a page, which bounds what a selective read decodes.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 500
_ROWS = "doc_id long, n_tokens long, width int, packed binary"


def encode(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens, width and packed for each row of docs (doc_id, text): packed has the ids, followed by end_id.

    An id takes `width` bytes, little-endian: two if the text's ids fit, else four; so what is shuffled is half as much.
    Ids are the library's for whole texts, without added special tokens; special strings in a text are handled as is its
    default. A null text counts as empty. Rows may repeat, doc_id may be null, other columns are ignored.
    """
    at, last = path or vocabulary_path(FILE), np.array([] if end_id is None else [end_id], np.uint32)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(at, "", True)
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                lists = [np.concatenate([x, last]) for x in own.ids([t or "" for t in part.column("text").to_pylist()])]
                width = [2 if x.max(initial=0) < 1 << 16 else 4 for x in lists]
                packed = [x.astype(f"<u{w}").tobytes() for x, w in zip(lists, width, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, lists)), pa.int64()), pa.array(width, pa.int32()), pa.array(packed, pa.binary())],
                                                 ["doc_id", "n_tokens", "width", "packed"])

    return docs.select("doc_id", "text").mapInArrow(ids, _ROWS)


def _with_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids as lists, and start: ids of the shard's rows before each row, as the rows of a shard go by in order."""
    past = 0
    for batch in batches:
        for part in (batch.slice(k, TEXTS) for k in range(0, len(batch), TEXTS)):
            ends = np.r_[0, np.cumsum(part.column("n_tokens").to_numpy())].astype(np.int64)
            ids = [np.frombuffer(p, f"<u{w}").astype(np.int32) for p, w in zip(part.column("packed").to_pylist(), part.column("width").to_pylist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("doc_id"), pa.array(past + ends[:-1]), part.column("n_tokens"), lists],
                                             ["shard", "doc_id", "start", "n_tokens", "ids"])
            past += int(ends[-1])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS,
                 group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes docs' ids to folder/ids in ascending doc_id order, and folder/shards; folder must be new.

    A null doc_id comes first; rows that share a doc_id are ordered by the digest of their ids, so reruns give the same
    files but for which of fully equal rows comes first. A document is never split. An empty table gives tables without rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = scratch.write(encode(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "encoded")
    n_ids = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, -(-n_ids // shard_ids), min(spark.sparkContext.defaultParallelism, n_ids // LEAST_IDS))
    by = ["doc_id", "tie", "row"]
    shards = (rows.withColumn("tie", F.xxhash64("packed")).repartitionByRange(n_shards, *by).sortWithinPartitions(*by)
              .select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "width", "packed")
              .mapInArrow(_with_start, "shard int, doc_id long, start long, n_tokens long, ids array<int>"))
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
               "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")}
    shards.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{folder}/ids")
    total = read_raw(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    total.coalesce(1).withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/shards")
    scratch.drop("encoded")


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, doc_id long, start long, n_tokens long, ids array<int>").parquet(f"{folder}/ids")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Columns and rows that a query leaves out are not read."""
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first")
    rows = read_raw(spark, folder).join(small_side(shards, shards.count(), 16), "shard")
    return rows.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_stretch(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """start and ids of what lies in positions begin to end (exclusive) of the corpus, documents cut at both ends.

    Shards outside are never opened; within a shard the filters on start and doc ends go to the page index.
    """
    out = None
    held = spark.read.parquet(f"{folder}/shards").where((F.col("first") < end) & (F.col("first") + F.col("n_ids") > begin)).select("shard", "first")
    bounds = held.agg(F.min("shard"), F.max("shard")).first()
    rows = read_raw(spark, folder).where(F.col("shard").between(*bounds)) if bounds[0] is not None else read_raw(spark, folder).where("false")
    start = F.col("first") + F.col("start")
    out = rows.join(small_side(held, held.count(), 16), "shard").where((start < end) & (start + F.col("n_tokens") > begin))
    skip = F.greatest(F.lit(0), F.lit(begin) - start)
    return out.select((start + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (F.least(F.lit(end), start + F.col("n_tokens")) - start - skip).cast("int")).alias("ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of rows as read_tokens() gives them."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4].tolist()
            out = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
