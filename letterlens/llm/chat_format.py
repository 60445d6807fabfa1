"""Chat formatting of reply trees.

Nodes point at the node they reply to. Iterative self-joins double the distance that each node's pointer spans, so the
root, depth and score of every node's path are known after a logarithm of the greatest depth of rounds, and walking the
doubled pointers down again lists the nodes of the chosen root-to-leaf paths. Branches are ranked by score; every chosen
path is formatted as one conversation. Only ids and scores are joined in the rounds, texts once at the end.

Template of a turn: "### " role ":\\n" text "\\n</turn>\\n". In roles and texts the characters "\\", "#" and "<" are
escaped, so no control string can appear in them; parse() undoes it. Texts of assistants are under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

HEAD, MIDDLE, END = "### ", ":\n", "\n</turn>\n"
#: What stands for the characters that control strings are made of.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {v: k for k, v in ESCAPES.items()}
LOSS_ROLE = "assistant"
PATHS = "conv_id long, leaf long, formatted string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """Of roles, where a colon is a control character too."""
    return re.sub(r"[\\#<:]", lambda m: ESCAPES[m[0]], text)


def escape_text(text: str) -> str:
    return text.replace("\\", ESCAPES["\\"]).replace("#", ESCAPES["#"]).replace("<", ESCAPES["<"])


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of code points under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role) + MIDDLE, escape_text(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns of a formatted conversation, and all text under the loss mask."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(HEAD):].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def chosen_paths(nodes: DataFrame, best: int | None = 1, scratch: Scratch | None = None) -> DataFrame:
    """The nodes on the `best` paths of each tree (all, if None): conv_id, leaf, node, depth, path_rank.

    nodes: conv_id, node (unique in its conv_id), parent (null, or unknown in the conv_id, at a root), score (null: 0).
    A path's score is the mean of its nodes' scores; ties go to the smaller leaf. A conv_id with several roots has
    several trees. Nodes whose parents run in a circle have no root, so no path holds them.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "paths")
    ids = nodes.select("conv_id", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = ids.select(F.col("conv_id").alias("_c"), F.col("node").alias("up"))
    jump = scratch.write(
        ids.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("up")) & (F.col("parent") != F.col("node")), "left")
        .select("conv_id", "node", "up", "score", F.coalesce("up", "node").alias("root"),
                F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth")), "jump-0")
    leaves = jump.select("conv_id", "node").join(
        jump.select(F.col("conv_id").alias("_c"), F.col("up").alias("_up")).where("_up is not null").distinct(),
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_up")), "left_anti")
    # A round joins only nodes whose pointers have not yet passed their root; those that have are done.
    jumps, rounds = [jump], max(1, jump.count()).bit_length() + 1
    done = jump.where("up is null")
    while len(jumps) <= rounds and not jumps[-1].where("up is not null").isEmpty():
        a, b = jumps[-1].where("up is not null").alias("a"), done.unionByName(jumps[-1].where("up is not null")).alias("b")
        jumps.append(scratch.write(
            a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.up") == F.col("b.node"))).select(
                F.col("a.conv_id").alias("conv_id"), F.col("a.node").alias("node"), F.col("b.up").alias("up"),
                (F.col("a.score") + F.col("b.score")).alias("score"), F.col("b.root").alias("root"),
                (F.col("a.depth") + F.col("b.depth")).alias("depth")), f"jump-{len(jumps)}"))
        done = done.unionByName(jumps[-1].where("up is null"))
    paths = done.join(leaves.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n")),
                      F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")), "left_semi")
    rank = Window.partitionBy("conv_id", "root").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), "node")
    paths = paths.withColumn("path_rank", F.row_number().over(rank))
    on = (paths if best is None else paths.where(F.col("path_rank") <= best)).select(
        "conv_id", F.col("node").alias("leaf"), "node", "depth", "path_rank")
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].where("up is not null").select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "up")
        more = on.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))).select(
            "conv_id", "leaf", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"), "path_rank")
        on = scratch.write(on.unionByName(more), f"on-{k}")
    return on


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """Each chosen path as one conversation: conv_id, leaf, formatted, loss (spans of code points under the mask).

    nodes: conv_id, node, parent, score, role, text (see chosen_paths). Null roles and texts count as empty. An empty
    table gives an empty result.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    on = chosen_paths(nodes, best, scratch)
    texts = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "role", "text")
    turns = (on.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
             .groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct(
                 "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                text, spans = render([(t["role"], t["text"]) for t in r["turns"]])
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "leaf": r["leaf"], "formatted": text,
                                                   "loss": [{"start": s, "end": e} for s, e in spans]}],
                                                 schema=pa.schema([("conv_id", pa.int64()), ("leaf", pa.int64()), ("formatted", pa.string()),
                                                                   ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return turns.mapInArrow(formatted, PATHS)


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn replies to the one before it.

    Ties of turn are taken in order of role and text, null first; a row that repeats another is a turn of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what parse() gets from formatted conversations (conv_id, formatted, loss)."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns, loss = parse(r["formatted"], [(s["start"], s["end"]) for s in r["loss"]])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((r["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
