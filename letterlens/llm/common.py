"""What the operators of this subpackage share: tables in the shared folder, size-checked joins, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows take no more than this.
BROADCAST_BYTES = 24 << 20
#: A word, as every contract here counts words (a Java and an RE2 pattern).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='letterlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written once and read again: they cut lineage, and survive the loss of executors.

    They lie in the shared folder, each run in a folder of its own. drop() deletes a table that nothing reads any more;
    a table that a returned DataFrame still reads stays until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that to a text of ASCII alone, and fast."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, begin: Column, n: Column) -> Column:
    """The text of n words from word `begin` (from 0), each with the white space before it as it stands in the text."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), (begin + 1).cast("int"), n.cast("int")), "")


def text_key(text: Column) -> Column:
    """What tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose decision is to stay; decided has doc_id, key (text_key) and kept, a row for each row of docs.

    Decisions go by doc_id, null or not, and text. What goes is anti-joined, so texts are shuffled only if that is too
    much to broadcast. Of rows alike in both one stays if the decision has kept any.
    """
    by = decided.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_k")).agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n_rows"))
    odd = by.where("n_kept < n_rows or n_rows > 1")
    n_odd, n_both = odd.agg(F.count("*"), F.count_if(F.col("n_kept") > 0)).first()
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    out = docs.withColumn("_key", text_key(F.col("text"))).join(small_side(odd.where("n_kept = 0").select("_id", "_k"), n_odd, 48), on, "left_anti")
    if n_both:
        both = small_side(odd.where("n_kept > 0").select("_id", "_k"), n_both, 48)
        out = out.join(both, on, "left_anti").unionByName(out.join(both, on, "left_semi").dropDuplicates(["doc_id", "_key"]))
    return out.select(*docs.columns)
