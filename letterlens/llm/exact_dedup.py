"""Exact dedup by an extendible-hash index on shared files.

The 64-bit hash of the normalised text is the key. A directory over its leading bits starts shallow; wherever a bucket
holds more keys than its capacity, its prefix takes one more bit and the directory doubles, until none is overfull.
Postings go to their bucket by the directory and are written to the shared folder clustered by bucket, so one owner task
has a bucket, a contiguous range of keys, whole. Owners resolve the keys: under one key hangs a chain of postings, and
neighbours of a chain are told apart by comparing the bytes of their texts.

A key that one row has needs no chain, so its posting carries no text. Postings of keys that rows share are aggregated
before they are shuffled and salted, so a text that a third of all rows share comes to its owner as SALTS postings.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, keep_decided, small_side, text_key

#: Keys a bucket may hold before its prefix takes another bit.
BUCKET_KEYS = 20_000
SALTS = 16


def _prefix(bits: int):
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(scratch: Scratch, keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int, int]:
    """The directory (slot, bucket), a row for each of its 2**bits slots; the bits; and the number of buckets.

    keys: h, distinct. Only the number of overfull buckets comes to the driver, once a doubling.
    """
    bits, settled, open_keys = max(0, ceil(log2(max(1, n_keys) / capacity))), [], keys
    while True:
        sizes = scratch.write(open_keys.groupBy(_prefix(bits).alias("prefix")).agg(F.count("*").alias("n")), f"level-{bits}")
        full = sizes.where(F.col("n") > capacity).select("prefix")
        settled.append((bits, sizes.where(F.col("n") <= capacity).select("prefix")))
        n_full = full.count() if bits < 63 else 0
        if not n_full:
            break
        open_keys = open_keys.withColumn("prefix", _prefix(bits)).join(small_side(full, n_full, 16), "prefix", "left_semi").drop("prefix")
        bits += 1
    slots = None
    for depth, level in settled:  # a bucket of fewer bits has several slots
        first = F.shiftleft("prefix", bits - depth)
        own = level.select(F.explode(F.sequence(first, first + (2 ** (bits - depth) - 1))).alias("slot"), F.concat_ws(":", F.lit(depth), F.col("prefix")).alias("bucket"))
        slots = own if slots is None else slots.unionByName(own)
    return scratch.write(slots, "directory"), bits, 2**bits


def exact_groups(docs: DataFrame, capacity: int = BUCKET_KEYS, salts: int = SALTS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, key (text_key).

    Texts are equal if identical after lower-casing A-Z only; null counts as empty, and empty texts are equal to each
    other. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and of rows
    that repeat the largest doc_id exactly one stays. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    texts = docs.select("doc_id", "text", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = scratch.write(texts.select(
        "doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), text_key(F.col("text")).alias("key"),
        F.monotonically_increasing_id().alias("row")), "rows")

    keys = scratch.write(rows.groupBy("h").agg(F.count("*").alias("n")), "keys")
    n_keys, n_shared = keys.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    directory, bits, n_slots = build_directory(scratch, keys.select("h"), n_keys, capacity)
    shared = small_side(keys.where("n > 1").select("h"), n_shared, 24)

    # Postings with texts only where a chain is to be resolved, partly aggregated.
    posted = (texts.withColumn("h", F.xxhash64("norm")).join(shared, "h")
              .groupBy("h", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
    single = keys.where("n = 1").select("h", F.lit(None).cast("string").alias("norm"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("top"))
    chain = Window.partitionBy("bucket", "h").orderBy("norm")
    # An owner walks the chains of its buckets: a posting whose bytes differ from its neighbour's begins a class.
    index = scratch.write(
        posted.drop("salt").unionByName(single).withColumn("slot", _prefix(bits)).join(small_side(directory, n_slots, 48), "slot").drop("slot")
        .repartition("bucket").sortWithinPartitions("bucket", "h", "norm")
        .withColumn("new", (~F.col("norm").eqNullSafe(F.lag("norm").over(chain))).cast("int"))
        .withColumn("class", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sha", F.when(F.col("new") == 1, F.unhex(F.sha2("norm", 256)))), "index")
    found = scratch.write(index.groupBy("bucket", "h", "class").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"), F.max("sha").alias("sha")), "found")

    chains = found.where("sha is not null").select("h", "sha", "group_size", "keep_id")
    by_key = small_side(chains, n_shared, 120)
    out = rows.join(by_key, ["h", "sha"], "left")
    # Of rows that repeat the id that stays, the first one stays; ids are rarely repeated, so only those are looked at.
    many = rows.join(small_side(chains.where("group_size > 1").select("h", "sha", "keep_id"), n_shared, 120), ["h", "sha"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = scratch.write(many.groupBy("h", "sha").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "sha", "first"), "again")
    out = out.join(small_side(again, again.count(), 80), ["h", "sha"], "left")
    single_row = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(single_row, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single_row | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("first").isNull() | (F.col("row") == F.col("first"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "key")


def keep_one_of_equal(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups() drops, columns as they are. Nulls and repeats count as there."""
    return keep_decided(docs, exact_groups(docs).select("doc_id", "key", "kept"))
