"""Mixing sources to target weights.

Each document has a hash-random key. Within its source, documents are dealt into ranges of that key, the ranges' sums
of word counts are added up in key order (a distributed prefix sum), and the range in which the budget ends is sorted to
find the very word at which the source is cut. A source whose budget is over its size is repeated: whole epochs first,
then the cut. What leaves the sort is one row a source, so taking documents needs no shuffle of texts.

The key is made from doc_id and text, so only rows alike in both share one. Such rows are counted before they are
sorted, however many they are, and where a cut falls among them they are numbered part by part of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, first_words, small_side, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Mean documents in a range of keys.
RANGE_DOCS = 2_000


def _key(seed: str):
    """16 hexadecimal digits, random by doc_id and text; null ids and texts have keys too."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)), 1, 16)


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """per_source (source, source_size, n_docs), a row a source, with its target.

    Sources in order of code points, null last, take the weights in turn. Sources are filled in the order in which they
    reach max_epochs times their size; the level at which the rest share what is left by weight is found from prefix
    sums over that order, so nothing is iterated.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    fill = one.orderBy("fills_at", "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    out = (per_source
           .withColumn("sid", F.row_number().over(by_name))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
           .withColumn("ceiling", (F.col("source_size") * max_epochs).cast("double"))
           .withColumn("fills_at", F.col("ceiling") / F.col("weight"))
           .withColumn("left", F.lit(share) * F.sum("source_size").over(one) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("level", F.when(F.col("left") / F.col("w_left") <= F.col("fills_at"), F.struct("fills_at", "sid", "left", "w_left")))
           .withColumn("level", F.min("level").over(one)))
    return out.withColumn("target", F.when(
        F.col("level").isNull() | (F.struct("fills_at", "sid") < F.struct("level.fills_at", "level.sid")), F.col("ceiling"))
        .otherwise(F.least("ceiling", F.col("weight") * F.col("level.left") / F.col("level.w_left")))
    ).select("sid", "source", "source_size", "n_docs", "target")


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
             range_docs: int = RANGE_DOCS) -> tuple[DataFrame, DataFrame, int, bool]:
    """The sizes of docs (doc_id, text, source), the cut of each source, the number of sources, and whether a cut is shared.

    sized: doc_id, source, size, key. cuts: source, source_size, target, epochs (taken whole), and cut_key, the key at
    which the last epoch ends: cut_whole of the cut_rows rows with that key are taken, then cut_words of the next one.
    All are null if the budget ends between epochs. A cut is shared if several rows have its key.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key")), "sized")
    per_source = scratch.write(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
        weights, share, max_epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_ranges", F.ceil(F.col("n_docs") / range_docs).cast("long")), "sources")
    n_sources = per_source.count()
    sources = small_side(per_source, n_sources, 120)
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("n_ranges") / float(2**32)).cast("long")
    ranged = (sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
              .select("sid", "rest", part.alias("part"), "key", "size"))
    # Prefix sums over the ranges of each source, then over the distinct keys of the range in which the budget ends.
    upto = Window.partitionBy("sid").orderBy("part")
    last = (ranged.groupBy("sid", "rest", "part").agg(F.sum("size").alias("words"))
            .withColumn("past", F.sum("words").over(upto) - F.col("words"))
            .where("past < rest and rest <= past + words").select("sid", "part", "past"))
    within = Window.partitionBy("sid", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (ranged.join(small_side(last, n_sources, 60), ["sid", "part"])
            .groupBy("sid", "part", "past", "rest", "key", "size").agg(F.count("*").alias("n"))
            .withColumn("start", F.col("past") + F.sum(F.col("size") * F.col("n")).over(within) - F.col("size") * F.col("n"))
            .where("start < rest and rest <= start + size * n")
            .select("sid", F.col("key").alias("cut_key"), F.col("n").alias("cut_rows"), F.expr("(rest - start) div size").alias("cut_whole"), F.expr("(rest - start) % size").alias("cut_words")))
    cuts = scratch.write(per_source.join(cuts, "sid", "left").drop("n_ranges", "rest"), "cuts")
    return sized, cuts, n_sources, not cuts.where("cut_rows > 1").isEmpty()


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with _nth, from 0 within the rows of a source, for rows at a shared cut; counts of parts are added up first."""
    rows = scratch.write(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_row", 33)), "at-cuts")
    earlier = Window.partitionBy("_sid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_sid", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return rows.join(before, ["_sid", "_part"]).withColumn(
        "_nth", F.col("_before") + F.row_number().over(Window.partitionBy("_sid", "_part").orderBy("_row")) - 1).drop("_row", "_part", "_before")


def _taken(rows: DataFrame, cuts: DataFrame, n_sources: int, shared: bool) -> DataFrame:
    """rows with the columns of their source's cut, and _extra: null before the cut, after it 0, at it the words taken."""
    c = small_side(cuts.select(*[F.col(x).alias(f"_{x}") for x in cuts.columns]), n_sources, 200)
    rows = rows.join(c, F.col("source").eqNullSafe(F.col("_source")))
    at, key, cut = F.coalesce(F.col("_key") == F.col("_cut_key"), F.lit(False)), F.col("_key"), F.col("_cut_key")

    def extra(nth):
        own = F.when(nth < F.col("_cut_whole"), F.lit(None)).when(nth == F.col("_cut_whole"), F.col("_cut_words")).otherwise(0)
        return F.when(cut.isNull() | (key > cut), F.lit(0)).when(key == cut, own).cast("long")
    if not shared:
        return rows.withColumn("_extra", extra(F.lit(0)))
    many = at & (F.col("_cut_rows") > 1)
    numbered = _numbered(rows.where(many), Scratch(rows.sparkSession, "mix-cut"))
    return rows.where(~many).withColumn("_extra", extra(F.lit(0))).unionByName(numbered.withColumn("_extra", extra(F.col("_nth"))).drop("_nth"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size counts words; a null text has none. taken counts repeats: whole epochs, and in the last epoch every document
    before the cut; the document at the cut gives its first words only, so a source's taken words are its rounded
    target. Of rows alike in doc_id and text as many are taken as the cut says, no matter which. Empty texts take
    nothing; a null source is a source; an empty table gives an empty result. Reruns agree: the key depends on doc_id,
    text and the seed alone.
    """
    sized, cuts, n, shared = plan_mix(docs, **options)
    out = _taken(sized.withColumnRenamed("key", "_key"), cuts, n, shared)
    return out.select(
        "doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.col("_epochs") + F.coalesce("_extra", "size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; the document at a cut ends after its last word taken, white
    space before that as it is.

    Documents without words come along wherever their place in the order of keys is before the cut. Nulls and repeats
    count as in mix(); columns are as in docs.
    """
    _, cuts, n, shared = plan_mix(docs, **options)
    seed = options.get("seed", SEED)
    rows = _taken(docs.withColumn("_key", _key(seed)), cuts, n, shared)
    whole = F.col("_epochs") + F.when(F.col("_extra").isNull(), 1).otherwise(0)
    rows = rows.withColumn("_copies", F.concat(
        F.array_repeat(F.lit(None).cast("long"), whole.cast("int")),
        F.when(F.col("_extra") > 0, F.array("_extra")).otherwise(F.array().cast("array<long>"))))
    rows = rows.withColumn("_cut", F.explode("_copies"))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(first_words(F.col("text"), F.lit(0), F.col("_cut")))
    return rows.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
