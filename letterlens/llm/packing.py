"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt at random into groups of bounded size, and each group is packed on its own, so packing is spread over
tasks and wastes at most a few bins a group. Within a group pieces come in order of falling length; a piece goes to the
open bin it fills best. If none has room, a bin is opened at the permitted length with the least cost per word, which
depends on how well the pieces still to come can fill it: each permitted length is filled in thought with pieces that no
open bin is expected to get, largest first. Those of the length that is opened are set aside for it, so that the lengths of
all bins are chosen jointly. At last every bin is cut down to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, first_words, word_count

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: What a bin costs besides its length.
BIN_COST = 16
GROUP_PIECES = 20_000
_OUT = "row long, doc_id long, piece long, length long, bin_id long, capacity long, bin_offset long"


class _Pieces:
    """How many pieces of each length are still to come, and how many of them no open bin is expected to get."""

    def __init__(self, lengths: np.ndarray, largest: int):
        self.free = np.bincount(lengths, minlength=largest + 1).tolist()
        self.promised = [0] * (largest + 1)
        self.some = sum(1 << s for s in set(lengths.tolist()))  # bit s is set if a piece of length s is free

    def _less(self, size: int, n: int = 1) -> None:
        self.free[size] -= n
        if not self.free[size]:
            self.some &= ~(1 << size)

    def placed(self, size: int) -> None:
        if self.promised[size]:
            self.promised[size] -= 1
        else:
            self._less(size)

    def filling(self, room: int) -> list[tuple[int, int]]:
        """Lengths and numbers of free pieces that fill the room, largest first."""
        out, below = [], room
        while fits := self.some & ((1 << (below + 1)) - 1):
            size = fits.bit_length() - 1
            n = min(self.free[size], room // size)
            out.append((size, n))
            room -= size * n
            below = min(room, size - 1)
        return out

    def promise(self, filling: list[tuple[int, int]]) -> None:
        for size, n in filling:
            self._less(size, n)
            self.promised[size] += n


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin, and final capacity of the bin, for each length (1 to the largest capacity)."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # open bins by the room they have
    some = 0  # bit r is set if a bin has room r
    used, left = [], _Pieces(lengths, caps[-1])
    sizes = lengths.tolist()
    for i in order.tolist():
        size = sizes[i]
        left.placed(size)
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            best = None
            for c in caps[bisect_left(caps, size):]:
                filling = left.filling(c - size)
                words = size + sum(s * n for s, n in filling)
                price = (caps[bisect_left(caps, words)] + bin_cost) / words
                if best is None or price < best[0]:
                    best = price, c, filling
            _, r, filling = best
            left.promise(filling)
            b = len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        if r > size:
            room[r - size].append(b)
            some |= 1 << (r - size)
    final = np.array(caps)[np.searchsorted(caps, used)] if used else np.zeros(0, np.int64)
    return bin_of, offset, final[bin_of]


def pack(docs: DataFrame, capacities=CAPACITIES, bin_cost: int = BIN_COST, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, length, bin_id, capacity, bin_offset.

    Lengths count words. A document longer than the largest capacity is split: all but its last piece fill a bin each,
    and nothing is dropped. A document without words, or null, has one piece of length 0 and no bin (null). Rows that
    repeat are packed each. doc_id may be null. An empty table gives an empty result. Reruns over the same files agree.
    """
    sizes = docs.select("doc_id", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    return _packed(Scratch(docs.sparkSession, "pack").write(sizes, "sizes"), capacities, bin_cost, group_pieces).drop("row")


def packed_texts(docs: DataFrame, capacities=CAPACITIES, bin_cost: int = BIN_COST, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """What pack() gives, with row, which tells apart rows of docs that share an id, and text, the piece's own text.

    A piece's text is its words with the white space before each as it was; a row's pieces in order give its text back,
    but for white space behind its last word. Texts are shuffled once, by row.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = scratch.write(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    sizes = scratch.write(rows.select("doc_id", word_count(F.col("text")).alias("size"), "row"), "sizes")
    places = scratch.write(_packed(sizes, capacities, bin_cost, group_pieces), "places")
    begin = F.col("piece") * max(capacities)
    whole = (F.col("piece") == 0) & (F.col("length") < max(capacities))  # the only piece of its row
    text = F.when(F.col("length") == 0, F.lit("")).when(whole, F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")).otherwise(first_words(F.col("text"), begin, F.col("length")))
    return places.join(rows.select("row", "text"), "row").withColumn("text", text)


def _packed(sizes: DataFrame, capacities, bin_cost: int, group_pieces: int) -> DataFrame:
    """Pieces and bins of sizes (doc_id, size, row)."""
    largest = max(capacities)
    n_groups = max(1, ceil(sizes.count() / group_pieces))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        size, first = rows["size"].to_numpy(), rows["group"][0].as_py() << 40
        whole, rest = size // largest, size % largest
        full, some, none = np.repeat(np.arange(len(size)), whole), np.flatnonzero(rest), np.flatnonzero(size == 0)
        bin_of, offset, capacity = best_fit(rest[some], capacities, bin_cost)
        own = first + int(bin_of.max(initial=-1)) + 1 + np.arange(len(full))
        zero = np.zeros(len(none), np.int64)
        return pa.table({
            "row": rows["row"].take(pa.array(np.r_[some, full, none])),
            "doc_id": rows["doc_id"].take(pa.array(np.r_[some, full, none])),
            "piece": np.r_[whole[some], np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole), zero],
            "length": np.r_[rest[some], np.full(len(full), largest), zero],
            "bin_id": np.r_[first + bin_of, own, zero],
            "capacity": np.r_[capacity, np.full(len(full), largest), zero],
            "bin_offset": np.r_[offset, np.zeros(len(full), np.int64), zero]})

    out = (sizes.withColumn("group", F.expr(f"pmod(xxhash64(row), {n_groups})"))
           .groupBy("group").applyInArrow(packed, _OUT))
    return out.withColumn("bin_id", F.when(F.col("length") > 0, F.col("bin_id")))
