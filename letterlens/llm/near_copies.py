"""SimHash near-dedup at a Jaccard similarity: the BK-trees of simhash.py over shards that hold every likely pair.

Two texts whose sets of shingles of SHINGLE_WORDS words have a similarity of 0.8 differ in about 10 bits of their
fingerprints, too many for shards by blocks of bits. Shards here are buckets of equal shingle minima: a pair at just 0.8
shares none of the BANDS bands of ROWS minima with a chance of (1 - 0.8^6)^32 = 6e-5, a pair above that with less.

Of each shard the text that meets the most others is looked for first, in BK-trees over blocks of the shard's fingerprints,
and the exact sets decide on what a tree gives within LEAD_RADIUS bits; this joins a large group at a cost in proportion to
it. Shards in which texts are still apart go whole to a task; one with more than BLOCK texts goes
in pairs of blocks, so that every pair meets. There BK-trees over the fingerprints find the pairs within RADIUS bits, and
the exact sets decide; pairs whose texts are joined by now are passed over, and only joining links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_decided, small_side, text_key
from .simhash import BATCH_TEXTS, SEED, BKForest, bit_majorities, components, decided, first_of, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Bits in which fingerprints of texts at SIMILARITY may differ: 10 on average, with a deviation of 3.
RADIUS = 24
#: Bits for the one search of a shard's lead: wide enough for sets of a few shingles, whose fingerprints differ by more.
LEAD_RADIUS = 32
#: Rows whose trees a task grows at once, whole blocks of a shard.
LEAD_ROWS = 50_000
#: Texts of a shard that a task compares with each other, or with as many of another block.
BLOCK = 512
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_sets(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each UTF-8 text; a text without words is one empty shingle."""
    none = [xxhash.xxh64_intdigest(b"", SEED)]
    return [np.unique(np.array(shingle_hashes(t, shingle_words) or none, np.uint64)) for t in texts]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys (uint64) per set: equal minima of a band give equal keys."""
    h, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], starts)) * _ODD[0]
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


_SETS = "doc_id long, key long, fp long, sim long, bands array<long>, shingles array<long>"


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp: a digest of the set, so texts of one fp are alike; sim: the SimHash of the set."""
    for b in batches:
        for k in range(0, len(b), BATCH_TEXTS):
            part = b.slice(k, BATCH_TEXTS)
            sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()])
            size, flat = np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            bands = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32), band_keys(sets).view(np.int64).ravel())
            own = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), flat.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(fp.view(np.int64)), pa.array(bit_majorities(flat, size).view(np.int64)), bands, own],
                ["doc_id", "key", "fp", "sim", "bands", "shingles"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; those whose sizes rule it out are left before sets are joined."""
    of = lambda x: sets.select(F.col("fp").alias(x), F.col("size").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}"))
    sized = pairs.join(of("a").drop("s_a"), "a").join(of("b").drop("s_b"), "b").where(
        F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= similarity)
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (sized.join(of("a").drop("n_a"), "a").join(of("b").drop("n_b"), "b")
            .where(both / (F.col("n_a") + F.col("n_b") - both) >= similarity).select("a", "b"))


def joining_links(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, root: np.ndarray, sim: np.ndarray, sets: list[np.ndarray],
                  similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (fp, fp) that join all texts of a shard that similar pairs connect, given what root joins already.

    side is 0 where all of a shard are compared, else 1 or 2: then only pairs of different sides are.
    """
    forest, size, out = BKForest(shard, sim, radius), np.array([len(s) for s in sets]), []
    counts = np.bincount(shard)[shard]
    step = np.cumsum(counts) // 1_000_000  # so that what a search holds stays small
    for s in np.unique(step):
        q, x = forest.within(np.flatnonzero(step == s))
        fits = np.minimum(size[q], size[x]) >= similarity * np.maximum(size[q], size[x])
        fits &= (root[q] != root[x]) & np.where(side[q] > 0, side[q] < side[x], fp[q] < fp[x])
        q, x = q[fits], x[fits]
        by = np.lexsort((np.bitwise_count(sim[q] ^ sim[x]), shard[q]))
        at, up = -1, {}

        def find(r):
            while up.get(r, r) != r:
                r = up[r]
            return r
        for i, j in zip(q[by].tolist(), x[by].tolist(), strict=True):
            if shard[i] != at:
                at, up = shard[i], {}
            a, b = find(root[i]), find(root[j])
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both):
                    up[a] = b
                    out.append((int(fp[i]), int(fp[j])))
    return out


def _shard_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by shard; the last shard of each is held back until it is whole."""
    def linked(t: pa.Table):
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        shard = np.cumsum(np.r_[0, np.any([np.diff(col(c)) != 0 for c in ("band", "i", "j")], axis=0)])
        ends = t.column("shingles").combine_chunks()
        flat, cut = ends.flatten().to_numpy(), np.cumsum(ends.value_lengths().to_numpy())[:-1]
        links = joining_links(shard, np.where(col("i") == col("j"), 0, np.where(col("block") == col("i"), 1, 2)), col("fp"), col("root"),
                              col("sim").view(np.uint64), np.split(flat, cut), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
        new = np.flatnonzero((np.diff(ids) != 0).any(0))
        if held and len(batch) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("band", "i", "j")):
            yield linked(pa.Table.from_batches(held))
            held = []
        if len(new):
            yield linked(pa.Table.from_batches([*held, batch.slice(0, new[-1] + 1)]))
            held, batch = [], batch.slice(new[-1] + 1)
        if len(batch):
            held.append(batch)
    if held:
        yield linked(pa.Table.from_batches(held))


def near_lead(tree: np.ndarray, sim: np.ndarray, lead_sim: np.ndarray, radius: int = LEAD_RADIUS) -> np.ndarray:
    """Which rows a search for the lead finds in the BK-tree of their block; tree counts blocks from 0, lead_sim is of each row's lead."""
    first = np.unique(tree, return_index=True)[1]
    at = np.stack([np.r_[tree, tree[first]].astype(np.uint64), np.r_[sim, lead_sim[first]]], 1)
    nodes, place = np.unique(at, axis=0, return_inverse=True)
    place = place.ravel()
    leads, hit = place[len(tree):], np.zeros(len(nodes), bool)
    hit[BKForest(nodes[:, 0], nodes[:, 1], radius).within(leads)[1]] = True
    hit[leads] = True
    return hit[place[:len(tree)]]


def _lead_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by shard and block; the last block of each is held back until it is whole."""
    names = ("band", "i", "fp", "sim", "lead", "lead_sim")

    def linked(band, i, fp, sim, lead, lead_sim):
        tree = np.cumsum(np.r_[0, (np.diff(band) != 0) | (np.diff(i) != 0)]) if len(band) else band
        found = near_lead(tree, sim.view(np.uint64), lead_sim.view(np.uint64)) & (fp != lead) if len(band) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(fp, lead)[found]), pa.array(np.maximum(fp, lead)[found])], ["a", "b"])

    held = [np.zeros(0, np.int64)] * len(names)
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) >= LEAD_ROWS else []
        if len(cut):
            yield linked(*(h[:cut[-1] + 1] for h in held))
            held = [h[cut[-1] + 1:] for h in held]
    yield linked(*held)


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, component_id, kept, key (text_key).

    component_id is the smallest doc_id that links reach. Texts without words, null among them, are alike. Null ids
    count as no id, and a component without any id has a null component_id. Of each component kept marks the rows with
    its smallest doc_id, of several texts with that id or of none with an id those with the smallest key. Rows may
    repeat. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = scratch.write(docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(_set_batches, _SETS), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min(first_of("doc_id", "key")).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sim").alias("sim")), "nodes")
    keyed = nodes.select("fp", "sim", F.explode("bands").alias("band"))
    met = keyed.groupBy("band").agg(F.count("*").alias("n_band")).where("n_band > 1")
    shards = scratch.write(keyed.join(met, "band"), "shards")
    found = scratch.write(shards.groupBy("fp").agg(F.sum("n_band").alias("meets")), "found")
    found_side = small_side(found, found.count(), 40)
    sets = scratch.write(rows.select("fp", "sim", "shingles").join(found_side.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("sim").alias("sim"), F.first("shingles").alias("shingles"))
                         .withColumn("size", F.size("shingles")), "sets")

    blocks = F.ceil(F.col("n_band") / block)
    lead = shards.join(found_side, "fp").groupBy("band").agg(F.max(F.struct("meets", "fp", "sim")).alias("lead")).select("band", F.col("lead.fp").alias("lead"), F.col("lead.sim").alias("lead_sim"))
    dealt = shards.join(lead, "band").select("band", F.pmod(F.xxhash64("fp", "band"), blocks).alias("i"), "fp", "sim", "lead", "lead_sim")
    first = dealt.repartition("band", "i").sortWithinPartitions("band", "i").mapInArrow(_lead_batches, "a long, b long").distinct()
    edges = scratch.write(_alike(first, sets, similarity), "edges")
    roots = components(Scratch(docs.sparkSession, "near-copies-first"), edges)

    labelled = scratch.write(shards.join(roots, shards.fp == roots.node, "left").select("band", "n_band", "fp", F.coalesce("root", "fp").alias("root")), "labelled")
    apart = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = (labelled.join(apart, "band", "left_semi").withColumn("block", F.pmod(F.xxhash64("fp", "band"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "root"))
    more = scratch.write(open_.join(sets.select("fp", "sim", "shingles"), "fp").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
                         .mapInArrow(lambda it: _shard_batches(it, similarity), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        roots = components(Scratch(docs.sparkSession, "near-copies-second"), edges.unionByName(more))

    linked = nodes.select("fp", "least", "n").join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    linked = scratch.write(linked.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n_docs")).where("n_docs > 1")
                           .join(linked.select("root", "fp"), "root").select("fp", "first"), "linked")
    out = scratch.write(rows.select("doc_id", "key", "fp").join(small_side(linked, linked.count(), 60), "fp", "left").select("doc_id", *decided()), "groups")
    scratch.drop("rows", "nodes", "shards", "found", "sets", "edges", "labelled", "more", "linked")
    return out


def keep_one_of_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies: the one with its smallest doc_id. Columns as they are.

    Of rows that repeat that document one stays; of a group without ids one stays.
    """
    return keep_decided(docs, copy_groups(docs).select("doc_id", "key", "kept"))
