"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are rotated to the principal axes of all rows, so that leading components carry most. Of each vector and each
resolution (1, 4, 16, 32, then 48 segments) we keep the segments' means and deviations. For segments of length L,
q.x = sum(L * mean_q * mean_x) + sum(dev_q . dev_x) and the last sum is at most sum(|dev_q| * |dev_x|), so the
statistics bound q.x from above, and the distance |q|^2 + |x|^2 - 2 q.x from below. Candidates are tested coarse to
fine against the k-th best exact score known; exact scores, of the vectors as they are, decide among the survivors.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one row for a task. Each block
of queries meets one block of rows first; the k-th best scores found there go along to all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 20
SCALE = 64
QUERY_EVERY = 20
SEGMENTS = (1, 4, 16, 32, 48)
QUERY_BLOCK, ROW_BLOCK, SUB_BLOCK = 2_048, 8_192, 128
#: Share of survivors up to which pairs are looked at one by one, over which a product of matrices is cheaper.
SPARSE = 1 / 32


def _stats(v: np.ndarray, segments: int) -> np.ndarray:
    """Per vector: sqrt(L) * mean and |deviation| of each segment, so that a dot product of two rows is the bound."""
    out = []
    for part in np.array_split(v, min(segments, v.shape[1]) or 1, axis=1):
        mean = part.mean(1, keepdims=True) if part.shape[1] else np.zeros((len(v), 1))
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(((part - mean) ** 2).sum(1, keepdims=True))]
    return np.hstack(out)


def _products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Products of rows of a and b where alive, -inf elsewhere."""
    i, j = np.nonzero(alive) if alive.sum() <= SPARSE * alive.size else (None, None)
    if i is None:
        return np.where(alive, a @ b.T, -np.inf)
    out = np.full(alive.shape, -np.inf)
    out[i, j] = (a[i] * b[j]).sum(1)
    return out


def block_topk(q_ids, q, x_ids, x, k: int = K, segments=SEGMENTS, axes=None, least=None, survivors: list | None = None):
    """(query place, candidate place, score) of each query's k best candidates with another id, ties to the smaller id.

    axes: an orthogonal matrix. least: a score that each query's k-th best is known to reach. survivors gets, for each
    resolution, the pairs that pass it, last those whose exact scores are computed.
    """
    big = max(abs(q).max(initial=0), 1) * max(abs(x).max(initial=0), 1) * max(1, q.shape[1]) >= 2**52
    exact_q, exact_x = (q, x) if big else (q.astype(np.float64), x.astype(np.float64))  # doubles hold these sums exactly
    by_id = np.argsort(x_ids, kind="stable")
    exact_x, x_ids = exact_x[by_id], x_ids[by_id]
    axes = np.eye(q.shape[1]) if axes is None else axes
    turned_q, turned_x = q.astype(np.float64) @ axes, x[by_id].astype(np.float64) @ axes
    levels = [(_stats(turned_q, s), _stats(turned_x, s)) for s in segments if s < max(2, q.shape[1])]
    norms = np.linalg.norm(turned_q, axis=1), np.linalg.norm(turned_x, axis=1).max(initial=0)
    slack = 1e-9 * (1 + norms[0])[:, None] * (1 + norms[1])
    known = np.full(len(q), -np.inf) if least is None else least
    found = []
    for a in range(0, len(q), SUB_BLOCK):
        rows = np.arange(a, min(a + SUB_BLOCK, len(q)))
        alive = q_ids[rows, None] != x_ids[None]
        floor, passed = known[rows], []
        for level, (of_q, of_x) in enumerate(levels):
            bound = _products(of_q[rows], of_x, alive) + slack[rows]
            if not level and len(x_ids) >= 4 * k:
                # The exact scores of the candidates with the best coarse bounds give the k-th best score known here.
                first = np.argpartition(-bound, 4 * k - 1, axis=1)[:, :4 * k]
                score = np.einsum("qd,qnd->qn", exact_q[rows], exact_x[first]).astype(np.float64)
                score[~np.take_along_axis(alive, first, 1)] = -np.inf
                floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
            alive &= bound >= floor[:, None]
            passed.append(int(alive.sum()))
        if survivors is not None:
            survivors.append(passed)
        score = _products(exact_q[rows], exact_x, alive)
        if score.shape[1] > k:  # the k best and what ties with the last of them; ids are in order, so ties come in order
            alive &= score >= np.partition(score, -k, axis=1)[:, -k, None]
        i, j = np.nonzero(alive)
        s = score[i, j] if not big else (exact_q[rows[i]] * exact_x[j]).sum(1)
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        start = np.searchsorted(i, np.arange(len(rows)))
        top = np.arange(len(i)) - start[i] < k if len(i) else np.zeros(0, bool)
        found.append((rows[i[top]], by_id[j[top]], s[top].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of all rows (v), strongest first. Sums are added up by row of the matrix, so the driver gets one matrix."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for k in range(0, len(batch), 4_096):
                v = np.hstack([_matrix(batch.column("v").slice(k, 4_096), dim).astype(np.float64), np.ones((min(4_096, len(batch) - k), 1))])
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"i": t["i"].slice(0, 1), "sums": pa.array([np.sum(t["sums"].to_pylist(), axis=0)], pa.list_(pa.float64()))})

    got = rows.select("v").mapInArrow(sums, "i long, sums array<double>").groupBy("i").applyInArrow(added, "i long, sums array<double>").toArrow().sort_by("i")
    if not len(got):
        return np.eye(dim)
    m = np.array(got["sums"].to_pylist())
    n, mean = max(m[-1, -1], 1), m[-1, :-1] / max(m[-1, -1], 1)
    return np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1]


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, filled with zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(v), dim), np.int64)
    out[np.repeat(np.arange(len(v)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
    return out


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, each component x turned into floor(scale * x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where("vec_id is not null and embedding is not null").where(~bad)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.max("v").alias("v")))


def _blocks(rows: DataFrame, n: int, prefix: str, dim: int) -> DataFrame:
    """One row per block: its number, ids and components as bytes."""
    def packed(t: pa.Table) -> pa.Table:
        v = _matrix(t["v"], dim)
        v = v.astype(np.int32) if abs(v).max(initial=0) < 2**31 else v
        return pa.table({f"{prefix}_block": t["block"].slice(0, 1), f"{prefix}_ids": [t["vec_id"].to_numpy().tobytes()],
                         f"{prefix}_v": [v.tobytes()], f"{prefix}_type": [v.dtype.str]})

    return rows.withColumn("block", F.expr(f"pmod(xxhash64(vec_id), {n})")).groupBy("block").applyInArrow(
        packed, f"{prefix}_block long, {prefix}_ids binary, {prefix}_v binary, {prefix}_type string")


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE,
          query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k candidates with the highest inner products for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows of vectors (vec_id, embedding) whose vec_id is divisible by query_every; candidates are all
    rows but the query's own. Ties go to the smaller vec_id; a query with fewer candidates gets them all. A vector that
    is null or holds a null or non-finite component takes no part, nor does one without a vec_id. Rows that repeat a
    vec_id count as one, with the largest of their vectors. Vectors of differing length count as filled with zeros.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.write(scaled(vectors, scale), "rows")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    n, n_q, dim = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_every == 0), F.max(F.size("v"))).first()
    n_blocks, dim = max(1, ceil(n / row_block)), max(dim or 0, 1)
    x = scratch.write(_blocks(rows, n_blocks, "x", dim), "blocks")
    axes = principal_axes(rows, dim)
    q = scratch.write(_blocks(queries, max(1, ceil(n_q / query_block)), "q", dim), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = {p: np.frombuffer(r[f"{p}_ids"], np.int64) for p in "qx"}
                v = {p: np.frombuffer(r[f"{p}_v"], r[f"{p}_type"]).reshape(-1, dim) for p in "qx"}
                least = np.frombuffer(r["least"], np.float64) if r["least"] else None
                i, j, s = block_topk(ids["q"], v["q"].astype(np.int64), ids["x"], v["x"].astype(np.int64), k, axes=axes, least=least)
                kth = np.full(len(ids["q"]), -np.inf)
                n_of = np.bincount(i, minlength=len(kth))
                kth[n_of == k] = s[(np.cumsum(n_of) - 1)[n_of == k]]
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([kth.tobytes()]), pa.array([ids["q"][i]], pa.list_(pa.int64())),
                                                  pa.array([ids["x"][j]], pa.list_(pa.int64())), pa.array([s], pa.list_(pa.int64()))],
                                                 ["q_block", "least", "query_ids", "vec_ids", "scores"])

    # Each block of queries meets every block of rows: the stated query set against all rows, in blocks.
    schema = "q_block long, least binary, query_ids array<long>, vec_ids array<long>, scores array<long>"
    home = F.pmod("q_block", F.lit(n_blocks))
    at_home = q.withColumn("x_block", home).withColumn("least", F.lit(None).cast("binary"))
    seeds = scratch.write(at_home.join(x, "x_block").repartition("q_block").mapInArrow(search, schema), "seeds")
    others = (q.join(seeds.select("q_block", "least"), "q_block", "left").withColumn("x_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
              .where(F.col("x_block") != home))
    found = seeds.unionByName(others.join(x, "x_block").repartition("q_block", "x_block").mapInArrow(search, schema))
    found = found.select(F.inline(F.arrays_zip(F.col("query_ids").alias("query_id"), F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
