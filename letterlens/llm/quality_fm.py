"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last term is the sum of all pairwise interactions <v_i, v_j> x_i x_j, in time linear in the features of a text.
The model is fitted on a bounded sample of labelled rows and is of fixed size, so it is broadcast; every text is scored
whole, in batches of ragged arrays.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots that words are hashed to, and rank of the interactions.
WORD_SLOTS, RANK = 1 << 15, 8
#: Bound of the labelled sample that the model is fitted on: the rows whose doc_id hashes lowest.
TRAIN_ROWS = 6_000
EPOCHS, RATE, DECAY, SEED = 8, 0.05, 1e-4, 7
THRESHOLD = 0.7
_PRINT = list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))
#: Structure statistics and metadata of a text: shares of the ASCII signs, then those that _structure() names.
N_STATS = len(_PRINT) + 14


def _structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, n_words = len(text) or 1, len(words) or 1
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    signs = by_byte[_PRINT]
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    most = counts.most_common(1)[0][1] if counts else 0
    return [*np.sqrt(signs / n).tolist(),
            math.sqrt(upper / n), math.sqrt(lower / n), math.sqrt(int(by_byte[48:58].sum()) / n), int(by_byte[128:].sum()) / n,
            math.sqrt(int(signs.sum()) / n), int(by_byte[9:14].sum() + by_byte[32]) / n, upper / (upper + lower + 1),
            len(counts) / n_words, most / n_words, len(set(lines)) / len(lines),
            math.log1p(len(lines)) / 10, math.log1p(n_words) / 10, math.log1p(n) / 15, min(n / n_words, 40) / 40]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ragged word features (sizes, slots, values of unit length) and dense statistics of whole UTF-8 texts."""
    sizes, slots, values, stats, seen = [], [], [], [], {}
    for text in texts:
        words = text.split()
        counts = Counter(words)
        for w in counts:
            if w not in seen:
                seen[w] = zlib.crc32(w.lower()) % WORD_SLOTS
        slots += [seen[w] for w in counts]
        v = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        values.append(v / (np.sqrt((v * v).sum()) or 1))
        sizes.append(len(counts))
        stats.append(_structure(text, words, counts))
    return (np.array(sizes, np.int64), np.array(slots, np.int64),
            np.concatenate(values) if values else np.zeros(0), np.array(stats, np.float64).reshape(-1, N_STATS))


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # of word slots, then of statistics
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def margins(self, sizes, slots, values, stats):
        """The machine's sums for each text, and the parts that a gradient needs."""
        z = np.clip((stats - self.mean) / self.spread, -4, 4)
        ws, vs = self.w[WORD_SLOTS:], self.v[WORD_SLOTS:]
        linear, s, sq = self.w0 + z @ ws, z @ vs, (z * z) @ (vs * vs)
        if len(slots):
            full = np.flatnonzero(sizes)
            at = (np.cumsum(sizes) - sizes)[full]
            vx = self.v[slots] * values[:, None]
            linear[full] += np.add.reduceat(self.w[slots] * values, at)
            s[full] += np.add.reduceat(vx, at)
            sq[full] += np.add.reduceat(vx * vx, at)
        return linear + 0.5 * (s * s - sq).sum(1), s, z

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(texts))[0], -40, 40)))


def fit(sizes, slots, values, stats, y, epochs=EPOCHS, rate=RATE, decay=DECAY, seed=SEED) -> Machine:
    """Adagrad over mini-batches of the logistic loss. With one class or no rows it learns the base rate alone."""
    rng, n = np.random.default_rng(seed), len(y)
    spread = stats.std(0) if n else np.ones(N_STATS)
    m = Machine(math.log((y.sum() + 1) / (n - y.sum() + 1)), np.zeros(WORD_SLOTS + N_STATS),
                rng.normal(0, 0.02, (WORD_SLOTS + N_STATS, RANK)), stats.mean(0) if n else np.zeros(N_STATS), np.where(spread > 1e-9, spread, 1))
    if not 0 < y.sum() < n:
        m.v[:] = 0
        return m
    gw, gv, g0, start = np.full(len(m.w), 1e-2), np.full(m.v.shape, 1e-2), 1e-2, np.cumsum(sizes) - sizes
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 64)):
            c = sizes[rows]
            at = np.repeat(start[rows] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            sl, x, doc = slots[at], values[at], np.repeat(np.arange(len(rows)), c)
            margin, s, z = m.margins(c, sl, x, stats[rows])
            g = (1 / (1 + np.exp(-margin)) - y[rows]) / len(rows)
            # d margin / dw = x and d margin / dv = x (s - v x), for words (summed by slot) and for statistics
            order = np.argsort(sl, kind="stable")
            u, first = np.unique(sl[order], return_index=True)
            gx = (g[doc] * x)[order]
            dw = np.add.reduceat(gx, first) if len(u) else gx
            dv = np.add.reduceat(gx[:, None] * (s[doc[order]] - m.v[sl[order]] * x[order, None]), first) if len(u) else np.zeros((0, RANK))
            vs = m.v[WORD_SLOTS:]
            u = np.r_[u, np.arange(WORD_SLOTS, len(m.w))]
            dw = np.r_[dw, g @ z] + decay * m.w[u]
            dv = np.r_[dv, (g[:, None] * z).T @ s - vs * (g @ (z * z))[:, None]] + decay * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            g0 += g.sum() ** 2
            m.w0 -= rate * g.sum() / math.sqrt(g0)
    return m


def is_held_out():
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """The machine fitted on at most `rows` labelled rows that are not held out, those whose doc_id hashes lowest.

    Rows with a null label or doc_id teach nothing. Of labels that repeat for a doc_id the largest counts, of texts that
    do the one with the least digest, so that reruns and layouts agree.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").where(~is_held_out())
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 200):
                b = whole.slice(k, 200)
                sizes, slots, values, stats = features(_texts(b.column("text")))
                ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("quality"), pa.ListArray.from_arrays(ends, pa.array(slots.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32))), pa.array(list(stats), pa.list_(pa.float64()))],
                    ["doc_id", "quality", "slots", "vals", "stats"])

    # The sample is bounded by `rows`, so its ids can be broadcast and its features come to the driver.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    least = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("quality").cast("int").alias("quality"), "text")
    got = (known.groupBy("doc_id").agg(F.min(least).alias("m")).select("doc_id", "m.quality", "m.text")
           .mapInArrow(extract, "doc_id long, quality int, slots array<int>, vals array<float>, stats array<double>")
           .toArrow().combine_chunks().sort_by("doc_id"))
    sizes = got["slots"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c, t: got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(t)
    return fit(sizes, flat("slots", np.int64), flat("vals", np.float64), flat("stats", np.float64).reshape(-1, N_STATS),
               got["quality"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold).

    Whole texts are scored; null counts as empty, and empty texts have a score too. Rows may repeat; a null doc_id is
    not held out. Labels, lang, source and doc_id are no inputs. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 200):  # bounds what a batch of long texts holds
                part = b.slice(k, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.scores(_texts(part.column("text"))))], ["doc_id", "score"])

    return (docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
            .select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier scores at the threshold or above, scored in the same pass. Columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.slice(k, 200)
                yield part.filter(pa.array(model.value.scores(_texts(part.column("text"))) >= threshold))

    return docs.mapInArrow(good, docs.schema)
