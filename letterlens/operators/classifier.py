"""The text classifier: terms, vocabulary, TF-IDF, logistic regression, scoring, explanation and evaluation."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from letterlens.operators import logistic
from letterlens.shared import new_folder, write_once

VOCABULARY = 5_000
#: The candidates (C, vocabulary) in order.
GRID = ((0.5, 5_000), (1.0, 5_000), (5.0, 5_000), (10.0, 5_000), (5.0, 8_000), (10.0, 8_000))
# Accented letters with the plain letters they fold to, and the thresholds of predictions.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LEGITIMATE_BELOW, PHISHING_ABOVE = 0.30, 0.70
SURE, FAIRLY = 0.35, 0.15


def terms(text: Column) -> Column:
    """Words of two characters or more, folded to lower case without accents, and their neighbouring pairs."""
    words = tokens(text)
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def tokens(text: Column) -> Column:
    """The words of terms(), without pairs. Runs of two word characters or more, as found from the left, end at no other."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"(?U)\w{2,}"), 0)


def counts(samples: DataFrame) -> DataFrame:
    """(doc, term, tf); samples: doc, text."""
    return samples.select("doc", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The `size` most frequent terms (a top-k), ties by term: term, corpus_count, df."""
    return (tf.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("df")).orderBy(F.desc("corpus_count"), "term").limit(size))


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document of unit length.

    The vocabulary is bounded by its size, so it is broadcast.
    """
    raw = tf.join(F.broadcast(vocab.select("term", "df")), "term").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * (F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1)) + 1))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Texts whose terms a task counts at once.
TEXTS = 2_000


def _alone(samples: DataFrame) -> bool:
    """Whether every doc is one row, so that its terms can be counted where its text lies."""
    return samples.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _row_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of batches (doc, words): a slice, of each of its rows' distinct terms the row, the place among the slice's terms and the count, and those terms."""
    for whole in batches:
        for k in range(0, len(whole), TEXTS):
            b = whole.slice(k, TEXTS)
            lists = b.column("words")
            coded = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            m, next_ = len(coded.dictionary), np.flatnonzero(row[1:] == row[:-1])
            pairs, which = np.unique(code[next_] * m + code[next_ + 1], return_inverse=True)
            every = m + len(pairs)
            keys, tf = np.unique(np.concatenate([row * every + code, row[next_] * every + m + which]), return_counts=True)
            words = coded.dictionary.cast(pa.string())
            joined = pc.binary_join_element_wise(words.take(pa.array(pairs // max(m, 1))), words.take(pa.array(pairs % max(m, 1))), " ")
            yield b, keys // max(every, 1), keys % max(every, 1), tf, pa.concat_arrays([words, joined])


def frequencies(samples: DataFrame) -> DataFrame:
    """(term, corpus_count, df) over samples (doc, text). Terms are summed in tasks before anything is shuffled."""
    if not _alone(samples):
        return counts(samples).groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("df"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, tf, terms_ in _row_terms(batches):
            n = len(terms_)
            yield pa.RecordBatch.from_arrays([terms_, pa.array(np.bincount(at, tf, n).astype(np.int64)), pa.array(np.bincount(at, minlength=n))], ["term", "corpus_count", "df"])
    rows = samples.select("doc", tokens(F.col("text")).alias("words")).mapInArrow(summed, "term string, corpus_count long, df long")
    return rows.groupBy("term").agg(F.sum("corpus_count").alias("corpus_count"), F.sum("df").alias("df"))


def most_frequent(freq: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The `size` most frequent terms (a top-k), ties by term."""
    return freq.select("term", "corpus_count", "df").orderBy(F.desc("corpus_count"), "term").limit(size)


def known_terms(samples: DataFrame, known: list[str]) -> DataFrame:
    """(doc, at, tf): of each text the places in `known` of the terms that it has, ascending, and their counts, as arrays.

    known is bounded as a vocabulary is, and goes to the tasks. Nothing is shuffled, unless a doc is several rows.
    """
    spark, terms_ = samples.sparkSession, list(known)
    if not _alone(samples):
        table = spark.createDataFrame(list(enumerate(terms_)), "at int, term string")
        v = F.sort_array(F.collect_list(F.struct("at", "tf")))
        return counts(samples).join(F.broadcast(table), "term").groupBy("doc").agg(v.alias("v")).select("doc", F.col("v.at").alias("at"), F.col("v.tf").alias("tf"))
    own = samples.select("doc", tokens(F.col("text")).alias("words"))
    wanted = pa.array(terms_, pa.string())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, at, tf, all_ in _row_terms(batches):
            place = pc.fill_null(pc.index_in(all_, wanted), -1).to_numpy(zero_copy_only=False)[at] if len(all_) else np.zeros(0, np.int32)
            keep = np.flatnonzero(place >= 0)
            keep = keep[np.lexsort((place[keep], row[keep]))]
            ends = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=len(b)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place[keep].astype(np.int32), tf[keep].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *lists], ["doc", "at", "tf"])
    return own.mapInArrow(found, StructType([own.schema["doc"], StructField("at", ArrayType(IntegerType())), StructField("tf", ArrayType(LongType()))]))


def weights(samples: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """M16 from texts: (doc, term, weight) as tfidf(), without a shuffle. vocab: term, df, and what else goes along."""
    ranked = vocab.collect()  # as many rows as a vocabulary has
    spark, more = samples.sparkSession, [c for c in vocab.columns if c not in ("at", "df")]
    fields = [vocab.schema[c] for c in more]
    table = F.broadcast(spark.createDataFrame([(i, *[r[c] for c in more]) for i, r in enumerate(ranked)], StructType([StructField("at", IntegerType()), *fields])))
    rows = known_terms(samples, [r.term for r in ranked])
    idf = F.array(*[F.lit(float(_idf(r.df, n_docs))) for r in ranked]) if ranked else F.array().cast("array<double>")
    w = F.zip_with("at", "tf", lambda a, t: (1 + F.log(t.cast("double"))) * F.get(idf, a))
    rows = rows.withColumn("w", w).withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda t, x: t + x * x)))
    flat = rows.select("doc", "norm", F.inline(F.arrays_zip("at", "w")))
    return flat.join(table, "at").select("doc", *more, (F.col("w") / F.col("norm")).alias("weight"))


def _idf(df: int, n_docs: int) -> float:
    return math.log((n_docs + 1.0) / (df + 1)) + 1


@dataclass
class TextModel:
    """A fitted model: its terms with document counts and coefficients, which are as many as the vocabulary, and how it was fitted."""

    terms: DataFrame  # term, df, at, coefficient
    intercept: float
    n_docs: int
    c: float
    size: int
    passes: int
    seconds: float


def vectors(train: DataFrame, tf: DataFrame, vocab: DataFrame, sizes: list[int], n_docs: int) -> DataFrame:
    """Rows for `logistic`: doc, label, w, at, raw, norms. A text without known terms has empty arrays and norms of 1."""
    raw = (1 + F.log(F.col("tf").cast("double"))) * (F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1)) + 1)
    per = tf.join(F.broadcast(vocab.select("term", "df", "at")), "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", raw.alias("raw")))).alias("v"))
    v = F.coalesce("v", F.array().cast("array<struct<at:int,raw:double>>"))
    length = lambda size: F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + F.when(e["at"] < size, e["raw"] * e["raw"]).otherwise(0.0)))
    out = train.select("doc", "label", "w").join(per, "doc", "left").withColumn("v", v)
    norms = F.array(*[F.coalesce(F.nullif(length(s), F.lit(0.0)), F.lit(1.0)) for s in sizes])
    return out.select("doc", "label", "w", F.col("v.at").alias("at"), F.col("v.raw").alias("raw"), norms.alias("norms"))


def text_vectors(train: DataFrame, ranked: list[tuple[str, int]], sizes: list[int], n_docs: int) -> DataFrame:
    """The rows of vectors() from texts (doc, text, label, w); ranked: the vocabulary's terms with their df, in order."""
    idf = F.array(*[F.lit(_idf(df, n_docs)) for _, df in ranked]) if ranked else F.array().cast("array<double>")
    if not _alone(train):
        per = known_terms(train.select("doc", "text"), [t for t, _ in ranked])
        rows = train.select("doc", "label", "w").join(per, "doc", "left").withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "tf": F.coalesce("tf", F.array().cast("array<bigint>"))})
    else:
        own = F.struct("doc", "label", "w")
        rows = known_terms(train.select(own.alias("doc"), "text"), [t for t, _ in ranked]).select("doc.*", "at", "tf")
    rows = rows.withColumn("raw", F.zip_with("at", "tf", lambda a, t: (1 + F.log(t.cast("double"))) * F.get(idf, a)))
    length = lambda size: F.sqrt(F.aggregate(F.arrays_zip("at", "raw"), F.lit(0.0), lambda t, e: t + F.when(e["at"] < size, e["raw"] * e["raw"]).otherwise(0.0)))
    norms = F.array(*[F.coalesce(F.nullif(length(s), F.lit(0.0)), F.lit(1.0)) for s in sizes])
    return rows.select("doc", "label", "w", "at", "raw", norms.alias("norms"))


def fit_all(train: DataFrame, grid: tuple[tuple[float, int], ...], balanced: bool = True) -> list[TextModel]:
    """A regression per candidate (C, vocabulary), all fitted together. train: doc, text, label.

    Vectors are made once, without Python, and written to the shared folder; every step of the optimiser is one pass over
    them for all candidates. Classes weigh alike if balanced. Labels that are null count as 0.
    """
    spark, began = train.sparkSession, time.time()
    train = train.withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(0)))
    stats = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(stats.values())
    share = F.when(F.col("label") == 1, n / (2 * stats.get(1, n or 1))).otherwise(n / (2 * stats.get(0, n or 1))) if balanced else F.lit(1.0)
    widest = max(size for _, size in grid)
    ranked = sorted(most_frequent(frequencies(train.select("doc", "text")), widest).collect(), key=lambda r: (-r.corpus_count, r.term))  # at most `widest` rows
    sizes = [min(size, len(ranked)) for _, size in grid]
    rows = write_once(text_vectors(train.withColumn("w", share.cast("double")), [(r.term, r.df) for r in ranked], sorted(set(sizes)), n), new_folder(spark, "vectors"))
    weight = rows.agg(F.sum("w")).first()[0] or 0.0
    points, passes = logistic.fit_stacked(rows, [1 / (c * max(n, 1)) for c, _ in grid], sizes, len(ranked), weight)
    seconds = time.time() - began
    models = []
    for (c, asked), size, point in zip(grid, sizes, points, strict=True):
        own = [(r.term, r.df, i, float(point[i])) for i, r in enumerate(ranked[:size])]
        models.append(TextModel(spark.createDataFrame(own, "term string, df long, at int, coefficient double"), float(point[-1]), n, c, asked, passes, seconds))
    return models


def fit(train: DataFrame, c: float = 1.0, size: int = VOCABULARY, balanced: bool = True) -> TextModel:
    """Logistic regression with L2 penalty, classes weighted alike if balanced. train: doc, text, label."""
    return fit_all(train, ((c, size),), balanced)[0]


def contributions(samples: DataFrame, model: TextModel) -> DataFrame:
    """(doc, term, contribution): each term's weight in the text times its coefficient."""
    w = weights(samples, model.terms.select("term", "df", "coefficient"), model.n_docs)
    return w.select("doc", "term", (F.col("weight") * F.col("coefficient")).alias("contribution"))


def score(samples: DataFrame, model: TextModel) -> DataFrame:
    """(doc, probability): a sparse product with the coefficients, through the logistic function, rounded to 4."""
    s = contributions(samples, model).groupBy("doc").agg(F.sum("contribution").alias("s"))
    return samples.select("doc").join(s, "doc", "left").select("doc", F.round(1 / (1 + F.exp(-(F.coalesce("s", F.lit(0.0)) + model.intercept))), 4).alias("probability"))


def explain(parts: DataFrame, k: int = 5) -> DataFrame:
    """Per document the k terms that speak most for each side (a top-k), from contributions."""
    side = parts.where("contribution <> 0").withColumn("direction", F.when(F.col("contribution") > 0, "phishing").otherwise("legitimate"))
    by = Window.partitionBy("doc", "direction").orderBy(F.desc(F.abs("contribution")), "term")
    return side.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("doc", "direction", "rank", "term", F.round(F.abs("contribution"), 4).alias("weight"))


def predict(p: Column) -> Column:
    return F.when(p < LEGITIMATE_BELOW, "LEGITIMATE").when(p > PHISHING_ABOVE, "PHISHING").otherwise("UNCERTAIN")


def confidence(p: Column) -> Column:
    return F.when(F.abs(p - 0.5) >= SURE, "HIGH").when(F.abs(p - 0.5) >= FAIRLY, "MEDIUM").otherwise("LOW")


def with_fallbacks(scored: DataFrame, ready: Column, enough: Column) -> DataFrame:
    """Prediction, confidence and status; without a model or enough text the result is an uncertain 0.5."""
    status = F.when(~ready, "unavailable").when(~enough, "insufficient_text").when(F.col("probability").isNull(), "error").otherwise("ready")
    out = scored.withColumn("model_status", status).withColumn("probability", F.when(F.col("model_status") == "ready", F.col("probability")).otherwise(0.5))
    p = F.col("probability")
    return out.withColumn("prediction", predict(p)).withColumn("confidence", F.when(F.col("model_status") == "ready", confidence(p)).otherwise("LOW"))


def evaluate(scored: DataFrame, threshold: float = 0.5, *by: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 on a zero division); scored: label, probability."""
    hit, true = F.col("probability") >= threshold, F.col("label") == 1
    agg = scored.groupBy(*by).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    out = agg.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return (out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
            .withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
            .withColumn("false_positive_rate", ratio("fp", F.col("fp") + F.col("tn"))))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Rank-sum AUC. Rows are counted per score first; only distinct scores are ordered, in cells, then summed."""
    per = scored.groupBy("probability").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = F.floor(F.col("probability") * 1000)
    cells = per.groupBy(cell.alias("cell")).agg(F.sum("n").alias("cell_n")).withColumn("cells_before", F.coalesce(F.sum("cell_n").over(below), F.lit(0)))
    inside = Window.partitionBy("cell").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("cell", cell).join(F.broadcast(cells), "cell").withColumn("before", F.col("cells_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.agg(F.coalesce(F.try_divide(F.sum(F.col("p") * (F.col("before") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")), F.lit(0.0)).alias("roc_auc"))


def errors(scored: DataFrame, threshold: float = 0.5, k: int = 10) -> DataFrame:
    """The first k false positives and false negatives (a top-k), by doc."""
    hit = F.col("probability") >= threshold
    kind = F.when(hit & (F.col("label") == 0), "false_positive").when(~hit & (F.col("label") == 1), "false_negative")
    by = Window.partitionBy("kind").orderBy("doc")
    return scored.withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("kind", "rank", "doc", "probability")


def score_all(samples: DataFrame, models: list[TextModel]) -> DataFrame:
    """(doc, candidate, probability) of models that were fitted together; the samples are read and counted once for all."""
    widest = max(models, key=lambda m: m.size)
    table = widest.terms.select("term", "df", "at")
    for j, m in enumerate(models):  # as many rows as the vocabulary
        table = table.join(m.terms.select("term", F.col("coefficient").alias(f"b{j}")), "term", "left")
    raw = (1 + F.log(F.col("tf").cast("double"))) * (F.log((F.lit(widest.n_docs) + 1.0) / (F.col("df") + 1)) + 1)
    rows = counts(samples).join(F.broadcast(table), "term").withColumn("raw", raw)
    dots = [F.sum(F.col("raw") * F.col(f"b{j}")).alias(f"d{j}") for j in range(len(models))]
    norms = [F.sqrt(F.sum(F.when(F.col(f"b{j}").isNotNull(), F.col("raw") * F.col("raw")))).alias(f"n{j}") for j in range(len(models))]
    one = lambda j, m: F.round(1 / (1 + F.exp(-(F.coalesce(F.try_divide(f"d{j}", f"n{j}"), F.lit(0.0)) + m.intercept))), 4)
    per = samples.select("doc").join(rows.groupBy("doc").agg(*dots, *norms), "doc", "left")
    return per.select("doc", F.posexplode(F.array(*[one(j, m) for j, m in enumerate(models)])).alias("candidate", "probability"))


def grid_search(train: DataFrame, validation: DataFrame, grid=GRID) -> tuple[TextModel, list[dict]]:
    """The first of the candidates (C, vocabulary) with the best F1 on validation, refitted on both.

    All candidates are fitted in the same passes and scored in one.
    """
    models = fit_all(train, tuple(grid))
    scored = score_all(validation, models).join(validation.select("doc", "label"), "doc")
    f1 = {r.candidate: r.f1 for r in evaluate(scored, 0.5, "candidate").select("candidate", "f1").collect()}
    known = max(m.terms.count() for m in models)
    tried = [{"c": c, "size": size, "f1": f1.get(j, 0.0), "terms": min(size, known), "passes": models[j].passes} for j, (c, size) in enumerate(grid)]
    best = max(tried, key=lambda t: t["f1"])  # the first of equals
    return fit(train.unionByName(validation), best["c"], best["size"]), tried


def model_card(model: TextModel, parts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: samples per split, terms, parameters, seconds of training, metrics on the test split, and a digest of the model's numbers.

    parts: doc, text, label, split. The digest is of the terms, at most as many as the vocabulary, in order.
    """
    n = {r.split: r.n for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()}
    test = parts.where("split = 'test'")
    scored = score(test, model).join(test.select("doc", "label"), "doc")
    row = F.format_string("%s=%.6f", "term", "coefficient")
    digest = model.terms.agg(F.sha2(F.concat_ws("\n", F.lit(f"{model.intercept:.6f}"), F.array_sort(F.collect_list(row))), 256).alias("model_sha256"), F.count("*").alias("terms"))
    made = (F.lit(model.c).alias("c"), F.lit(model.size).alias("vocabulary_size"), F.lit("l2").alias("penalty"), F.lit(model.passes).alias("passes"), F.lit(threshold).alias("threshold"),
            F.lit(model.seconds).alias("training_seconds"))
    counts_ = digest.select("*", *made, *[F.lit(n.get(s, 0)).cast("long").alias(f"{s}_samples") for s in ("train", "validation", "test")])
    return counts_.crossJoin(evaluate(scored, threshold)).crossJoin(roc_auc(scored))  # one row each
