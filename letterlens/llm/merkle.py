"""Merkle manifest of a data set: one digest for all rows, a proof for each row, and a check of changed rows.

A row's leaf is the digest of its fields. Leaves are numbered within their source by a range sort and the sums of its
ranges. Level by level, runs of ARITY nodes become the digest of their concatenation, until each source has one node;
those nodes, in order of their sources, become the root in the same way.

A parent hashes its children one after the other and keeps a copy of the hash state before each of them (the midstate).
To fold a changed child it goes on from the state before that slot with the replacement and the siblings right of it
only. A run of leaves is folded in one task: the children of its ancestors come to it by joins from the root downwards,
in which a node has ARITY partners at most, so the tasks are even however large a source is. Parents that neighbouring
runs share keep their states within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

ARITY = 16
#: Leaves in a range of the sort that numbers them.
RANGE_LEAVES = 100_000
#: Runs that a task unpacks, and passes on, at once.
RUNS = 200
#: Parents a task keeps the states of.
KEPT_PARENTS = 256
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Parent:
    """A node over children's digests (hex text), with the hash state before each child."""

    def __init__(self, children: str):
        self.children, self.before, state = [children[k:k + HEX] for k in range(0, len(children), HEX)], [], hashlib.sha256()
        for child in self.children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, digest: str) -> str:
        """The parent's digest with another child in a slot."""
        state = self.before[slot].copy()
        state.update((digest + "".join(self.children[slot + 1:])).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1:])


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of the fields, each `-` if null, else its bytes' count, `:` and its value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _numbered(nodes: DataFrame, order: list[str], n_nodes: int, range_leaves: int, scratch: Scratch, name: str) -> DataFrame:
    """nodes with idx, from 0 within their key in this order, and n, the nodes of their key; what ties is told apart by row."""
    ranges = max(1, -(-n_nodes // range_leaves))
    by = ["key", *order, "row"]
    rows = scratch.write(nodes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
                         .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("row"), f"{name}-sorted")
    # A key's rows are contiguous in a range, so a row's place is its distance from the first row of its key there.
    spans = rows.groupBy("part", "key").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    key = Window.partitionBy("key")
    spans = (spans.withColumn("n", F.sum("m").over(key)).withColumn("past", F.sum("m").over(key.orderBy("part")) - F.col("m")).drop("m"))
    return rows.join(spans, ["part", "key"]).withColumn("idx", F.col("past") + F.col("at") - F.col("first")).drop("part", "at", "past", "first")


def _grown(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels over nodes (key, idx, n, digest) and the last node of each key (key, digest).

    A level has a row per run: key, run, n (runs of the key) and kids, the children's digests in order. A key that has
    one node is done. Each level is built from a sixteenth of the rows of the one before.
    """
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("key", "digest"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            break
        runs = nodes.groupBy("key", F.expr(f"idx div {ARITY}").alias("run"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x.digest), "").alias("kids"))

        def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests = [Parent(kids).digest for kids in batch.column("kids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "digest"])

        level = scratch.write(runs.mapInArrow(parents, "key string, run long, n long, kids string, digest string"), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.select("key", F.col("run").alias("idx"), "n", "digest")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, out


def _paths(levels: list[DataFrame], above: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """For each run of the lowest level its ancestors' kids: key, run, path (its own parents upwards), and above's columns.

    above: a row per key. A level's rows get what lies above them from the level over it; a run has ARITY partners at most.
    Each level is written before the next one down reads it, so no plan holds more than two joins.
    """
    path, carried = None, [c for c in above.columns if c != "key"] if above is not None else []
    for k, level in reversed(list(enumerate(levels))):
        ends = level.where("n = 1")
        ends = (ends if above is None else ends.join(above.hint("shuffle_merge"), "key")).withColumn("path", F.array("kids")).select("key", "run", "path", *carried)
        if path is not None:
            inner = level.where("n > 1").withColumn("up", F.expr(f"run div {ARITY}")).join(path.withColumnRenamed("run", "up").hint("shuffle_merge"), ["key", "up"])
            ends = ends.unionByName(inner.withColumn("path", F.concat(F.array("kids"), "path")).select("key", "run", "path", *carried))
        path = scratch.write(ends, f"{name}-{k}")
    return path


_OUT = ("doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof, folded_root, verified.

    docs has doc_id, source, lang, n_chars and text; other columns are ignored. Where `tampered` holds, the row's text is
    taken to be `changed`: its leaf is made anew and folded with the other rows' digests as they were, and verified says
    whether the root comes out again. All else is about the rows as they are. proof: the siblings' digests by level from
    the leaf to the root, concatenated per level ('' for a level at which the node is alone in its run).

    A null field is told apart from an empty one. A null source is a source, before all others. Within a source a null
    doc_id comes first; rows that share a doc_id are ordered by their leaves, and rows alike in all fields have places
    next to each other. A null `tampered` counts as false. A single row is its own root. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    own = {c: F.col(c) for c in FIELDS}
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(own | {"text": changed})) if tampered is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    leaves = scratch.write(docs.select("doc_id", key.alias("key"), leaf_of(own).alias("digest"), other.alias("other")), "leaves")
    leaves = scratch.write(_numbered(leaves, ["doc_id", "digest"], leaves.count(), range_leaves, scratch, "leaves"), "numbered")
    levels, tops = _grown(leaves, scratch, "level")
    tops = scratch.write(tops.withColumn("source_key", F.substring("key", 1, 1 << 30)).withColumn("key", F.lit("root")), "tops")
    tops = scratch.write(_numbered(tops, ["source_key"], tops.count(), range_leaves, scratch, "tops"), "tops-numbered")
    top_levels, _ = _grown(tops, scratch, "top")

    # What lies above each source, then above each run of leaves.
    sources = tops.select("source_key", "idx", F.col("digest").alias("subroot"))
    if top_levels:
        above = _paths(top_levels, None, scratch, "top-paths").select(F.col("run").alias("up"), F.col("path").alias("top_path"))
        sources = sources.withColumn("up", F.expr(f"idx div {ARITY}")).join(above, "up").drop("up")
    else:
        sources = sources.withColumn("top_path", F.array().cast("array<string>"))
    sources = scratch.write(sources.select(F.col("source_key").alias("key"), F.col("idx").alias("top_idx"), "subroot", "top_path"), "sources")
    lone = leaves.where("n = 1").join(sources, "key").select("key", F.lit(0).cast("long").alias("run"), "top_idx", "subroot", F.array().cast("array<string>").alias("path"), "top_path", "doc_id", "idx", "digest", "other")
    item = F.struct("idx", "doc_id", "digest", "other")
    runs = lone.select("run", "top_idx", "subroot", "path", "top_path", F.array(item).alias("items"))
    if levels:
        path = _paths(levels, sources, scratch, "paths").select("key", "run", "top_idx", "subroot", "path", "top_path")
        gathered = leaves.where("n > 1").groupBy("key", F.expr(f"idx div {ARITY}").alias("run")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        runs = gathered.join(path.hint("shuffle_merge"), ["key", "run"]).sortWithinPartitions("key", "run").select("run", "top_idx", "subroot", "path", "top_path", "items").unionByName(runs)
    return runs.mapInArrow(_fold, _OUT)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Parent] = {}

    def parent(kids: str) -> Parent:
        if kids not in kept:
            if len(kept) >= KEPT_PARENTS:
                kept.clear()
            kept[kids] = Parent(kids)
        return kept[kids]

    names = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())
    for runs in (b.slice(k, RUNS) for b in batches for k in range(0, len(b), RUNS)):
        out = {name: [] for name in names}
        for run in runs.to_pylist():
            # The run's own parent serves its leaves alone; those above it serve its neighbours too.
            chain = [Parent(kids) if k == 0 and run["path"] else parent(kids) for k, kids in enumerate([*run["path"], *run["top_path"]])]
            slots, at = [], run["run"]
            for _ in run["path"][1:]:
                slots.append(at % ARITY)
                at //= ARITY
            at = run["top_idx"]
            for _ in run["top_path"]:
                slots.append(at % ARITY)
                at //= ARITY
            root = chain[-1].digest if chain else run["subroot"]
            for item in run["items"]:
                own = [item["idx"] % ARITY, *slots] if run["path"] else slots
                folded = item["other"] or item["digest"]
                for p, slot in zip(chain, own, strict=True):
                    folded = p.fold(slot, folded)
                for name, value in zip(names, (item["doc_id"], item["digest"], run["subroot"], root, [p.siblings(s) for p, s in zip(chain, own, strict=True)], folded, folded == root), strict=True):
                    out[name].append(value)
        # Proofs are six kilobytes a leaf, many times what a run brings: a batch of Spark's would become a GB.
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], list(names))


def lower_cased_fifth() -> tuple[Column, Column]:
    """The tampering of the registered query: where 5 divides the crc32 of doc_id's digits, A-Z of the text is lower-cased."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))
