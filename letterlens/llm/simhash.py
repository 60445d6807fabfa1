"""SimHash near-dedup with BK-trees.

Fingerprints of word shingles are linked if they differ in at most RADIUS bits. Distinct fingerprints are dealt into
shards: of m blocks of bits, two linked fingerprints agree in m - RADIUS at least, so every choice of that many blocks
gives one shard per value of those bits, and no link is lost. Each shard is a BK-tree: the children of a node are keyed
by their Hamming distance to it, and a search follows only the edges within the radius of the distance found. The trees
of a task are grown and searched level by level over numpy arrays, all of them at once.

Trees are as large as the corpus, so they go to the tasks that search them by Spark's shuffle and are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_decided, small_side, text_key

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Mean fingerprints in a shard, over which more and longer keys are taken.
SHARD_FPS = 512
#: A shard with more fingerprints is dealt again by its other bits.
TREE_FPS = 4096
#: Texts whose shingles a task holds at once.
BATCH_TEXTS = 200
_LANES = np.uint64(0x0001000100010001)


def shingle_hashes(text: bytes, shingle_words: int) -> list[int]:
    """The hash of every shingle of a UTF-8 text in order; a text with fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0d
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return [digest(joined, SEED)] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return [digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle_words - 1:], strict=False)]


def bit_majorities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of ragged hashes (n of each text, end to end in h) the bits that are set in over half of a text's, as uint64.

    Bit sums of all texts are taken at once: four bits at a time lie in the 16-bit lanes of a word.
    """
    out, full = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if not len(full):
        return out
    starts = (np.cumsum(n) - n)[full]
    # A lane counts to 65535: longer texts are summed in parts.
    parts = [(s + k, i) for i, (s, m) in enumerate(zip(starts.tolist(), n[full].tolist(), strict=True)) for k in range(0, m, 60_000)]
    at, owner = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    for bit in range(16):
        sums = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at).view(np.uint16).reshape(-1, 4).astype(np.int64)
        counts = np.zeros((len(full), 4), np.int64)
        np.add.at(counts, owner, sums)
        most = (counts * 2 > n[full, None]).astype(np.uint64)
        for lane in range(4):
            out[full] |= most[:, lane] << np.uint64(bit + 16 * lane)
    return out


def fingerprints(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of each UTF-8 text, as uint64; 0 for a text without words."""
    own = [shingle_hashes(t, shingle_words) for t in texts]
    return bit_majorities(np.array([h for hs in own for h in hs], np.uint64), np.array([len(hs) for hs in own], np.int64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, len(b), BATCH_TEXTS):
            part = b.slice(k, BATCH_TEXTS)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(fingerprints(texts).view(np.int64))], ["doc_id", "key", "fp"])


def block_masks(n: int, radius: int = RADIUS, per_shard: int = SHARD_FPS) -> list[int]:
    """The bit masks whose values are the shard keys of n fingerprints: the fewest whose shards are small on average."""
    m = radius + 1
    while n / 2 ** (64 * (m - radius) / m) > per_shard and m < 2 * radius + 2:
        m += 1
    return _masks(list(range(64)), m, radius)


def _masks(bits: list[int], m: int, radius: int) -> list[int]:
    blocks = [sum(1 << b for b in part) for part in (bits[len(bits) * i // m:len(bits) * (i + 1) // m] for i in range(m))]
    return [sum(c) for c in combinations(blocks, m - radius)]


class BKForest:
    """BK-trees over fps (uint64), one per value of tree; fps of a tree are distinct. Nodes are places in fps."""

    def __init__(self, tree: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        left, group, keys, nodes = np.arange(len(fps)), np.unique(tree, return_inverse=True)[1].astype(np.int64), [], []
        self.root = np.zeros(len(fps), np.int64)
        for level in range(len(fps) + 1):
            if not len(left):
                break
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[first, len(group)])
            node = np.repeat(left[first], size)
            if level:
                keys.append(group[first])
                nodes.append(left[first])
            else:
                self.root[left] = node
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, node = left[rest], node[rest]
            group = node * 65 + np.bitwise_count(fps[left] ^ fps[node])  # an edge: its parent and distance
        order = np.argsort(keys := np.concatenate(keys or [np.zeros(0, np.int64)]))
        self.edges, self.child = keys[order], np.concatenate(nodes or [np.zeros(0, np.int64)])[order]

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) of one tree at most the radius apart, the query itself left out."""
        q, node, found = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            hit = (d <= self.radius) & (q != node)
            found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - self.radius, 0), "left")
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + self.radius, 64), "right") - lo
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0], queries[:0])


def _links(tree: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint with a link in its tree: its place, and the first place of its component there."""
    label = np.arange(len(fps))
    forest = BKForest(tree, fps, radius)
    size = np.bincount(np.unique(tree, return_inverse=True)[1])[np.unique(tree, return_inverse=True)[1]]
    step = np.cumsum(size) // 2_000_000  # so that what a search holds stays small
    for s in np.unique(step[size > 1]):
        a, b = forest.within(np.flatnonzero((step == s) & (size > 1)))
        while len(a):
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def shard_links(tree: np.ndarray, fps: np.ndarray, radius: int = RADIUS, most: int = TREE_FPS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, fingerprint) that join the components within each tree; large trees are dealt by other bits first."""
    inverse, counts = np.unique(tree, return_inverse=True, return_counts=True)[1:]
    large = counts[inverse] > most
    a, b = _links(inverse[~large], fps[~large], radius)
    out = [(fps[~large][a], fps[~large][b])]
    if large.any():
        own, at = fps[large], inverse[large]
        varied = 0
        for t in np.unique(at):
            varied |= int(np.bitwise_or.reduce(own[at == t] ^ own[at == t][0]))
        bits = [i for i in range(64) if varied >> i & 1]
        for mask in _masks(bits, radius + 1, radius) if len(bits) > radius else [0]:
            key = own & np.uint64(mask)
            sub = np.unique(np.stack([at.astype(np.uint64), key], 1), axis=0, return_inverse=True)[1].ravel()
            a, b = _links(sub, own, radius)
            out.append((own[a], own[b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by shard; the last shard of each is held back until it is whole."""
    def linked(mask, key, fp):
        tree = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]) if len(mask) else mask
        a, b = shard_links(tree, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1 if len(held[0]) and (
            (held[0][0], held[1][0]) != (held[0][-1], held[1][-1])) else 0
        if cut >= 50_000:
            yield linked(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    yield linked(*held)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), by alternating large and small stars.

    A round links each node's neighbours to its smallest neighbour; rounds end when nothing changes. Minima are
    aggregated before they are shuffled; only a count and a checksum come to the driver.
    """
    def stars(df: DataFrame, both: bool) -> DataFrame:
        pairs = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else df
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = pairs.join(least, "a")
        new = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if both else (
            out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))))
        return new.where("a <> b").distinct()

    sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars-0")
    before, k = now.agg(*sums).first(), 0
    while before[0]:
        k += 1
        now = scratch.write(stars(stars(now, True), False), f"stars-{k}")
        after = now.agg(*sums).first()
        scratch.drop(f"stars-{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, kept, key (text_key).

    A-Z are lower-cased; words are runs of other than white space; shingles of SHINGLE_WORDS words, repeats included.
    A text with fewer words is one shingle; one without words, or null, has fingerprint zero, which links like any
    other. component_id is the smallest doc_id that links reach, the row's own included; null ids count as no id, and
    a component without any id has a null component_id. Of each component kept marks the rows with its smallest doc_id,
    of several texts with that id those with the smallest key, and if no row has an id, those with the smallest key.
    Rows may repeat. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(_fingerprint_batches, "doc_id long, key long, fp long"), "fps")
    distinct = scratch.write(fps.groupBy("fp").agg(F.min(first_of("doc_id", "key")).alias("least"), F.count("*").alias("n")), "distinct")
    n = distinct.count()
    masks = [m - 2**64 if m >= 2**63 else m for m in block_masks(n, radius)]
    shards = distinct.select("fp", F.posexplode(F.array(*map(F.lit, masks)))).select(
        F.col("pos").cast("long").alias("mask"), F.expr("fp & col").alias("key"), "fp")
    edges = (shards.repartition("mask", "key").sortWithinPartitions("mask", "key")
             .mapInArrow(lambda it: _link_batches(it, radius), "a long, b long").distinct())
    roots = components(scratch, edges)
    linked = distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    linked = scratch.write(linked.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n_docs")).where("n_docs > 1")
                           .join(linked.select("root", "fp"), "root").select("fp", "first"), "linked")
    return (fps.join(small_side(linked, linked.count(), 60), "fp", "left")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), *decided()))


def first_of(doc_id: str, key: str):
    """Orders rows by doc_id, nulls last, then by key."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("key"))


def decided():
    """component_id, kept and key of rows joined with the first row of their component, `first`, null if they are alone."""
    alone, f = F.col("first").isNull(), F.col("first")
    return (F.when(alone, F.col("doc_id")).otherwise(f["id"]).alias("component_id"),
            (alone | (F.col("doc_id").eqNullSafe(f["id"]) & (F.col("key") == f["key"]))).alias("kept"), F.col("key"))


def keep_one_of_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with its smallest doc_id. Columns as they are.

    Of rows that repeat that document one stays; of a component without ids one stays.
    """
    return keep_decided(docs, near_groups(docs).select("doc_id", "key", "kept"))
