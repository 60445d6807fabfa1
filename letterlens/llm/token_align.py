"""Alignment of two tokenizers over the same bytes.

Both id lists of a text cover the same bytes, so a token is placed by where it ends. The hash-set intersection of the
cumulative ends of both lists, sorted, are the offsets at which both have a boundary; an array addressed by end gives a
token's index. They slice both lists into groups, and in each slice the tokens that end with it are linked. Texts of a
batch lie end to end, as no group goes beyond its text. How often two ids are linked over all texts is counted by a
shuffle of pre-aggregated pairs.

Of two ids that are linked, the bytes of one end with the bytes of the other. So the two vocabularies alone bound the
number of linked pairs, and the counts are handed to all tasks if that bound is small; else they are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch
from .token_counts import vocabulary_path
from .word_ids import word_ids

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: An id pair is one number: A id * PAIR + B id.
PAIR = 1 << 24
#: Bytes of a pair in the table of counts: pair, count, and whether it is its B id's highest.
PAIR_BYTES = 17
#: Texts that a task holds at once.
TEXTS = 100
#: Parts over which a pair's rows are spread where counts are joined by a shuffle.
SALTS = 16
_PLAIN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ID_LISTS, _PAIRS = ("a_ids", "b_ids", "a_last", "b_last"), "pairs array<long>, times array<long>"


def _byte_of_char() -> dict[str, int]:
    """Bytes that print stand for themselves in a byte-level file, the others for the code points from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


def a_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = _byte_of_char()
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]))
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
    return out


def b_bytes(library) -> list[bytes]:
    """The bytes of each id of a sentencepiece model with byte fallback; control and unknown pieces have their own text."""
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class _Strings:
    """Byte strings by number, laid end to end."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array(list(map(len, strings)), np.int64)
        self.begin, self.all = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of these numbers joined, and where each ends."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.all[np.repeat(self.begin[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = word_ids(a_path, " ", False), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_bytes(a_path), b_bytes(self.b)
        self.a_strings, self.b_strings = _Strings(self.a_bytes), _Strings(self.b_bytes)
        # Ids as they stand in the text of groups, by what follows them: A , A | B , B ;
        n = len(self.a_bytes)
        self.written = _Strings([b"%d%s" % (i, s) for s in (b",", b"|") for i in range(n)] + [b"%d%s" % (i, s) for s in (b",", b";") for i in range(len(self.b_bytes))])
        self.base_b = 2 * n

    def most_pairs(self) -> int:
        """How many pairs can be linked at most: those of which one's bytes end with the other's."""
        of_a, of_b = Counter(x for x in self.a_bytes if x), Counter(x for x in self.b_bytes if x)
        ends = sum(m * of_b.get(x[k:], 0) for x, m in of_a.items() for k in range(len(x)))
        return ends + sum(m * of_a.get(x[k:], 0) for x, m in of_b.items() for k in range(1, len(x)))

    @staticmethod
    def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last A token and of the last B token of each group. A token without bytes goes before those that have some."""
        both = np.array(sorted(set(a_ends.tolist()).intersection(b_ends.tolist())), np.int64)
        last = []
        for ends in (a_ends, b_ends):
            at = np.zeros(1 + (ends[-1] if len(ends) else 0), np.int64)
            at[ends] = np.arange(len(ends))
            last.append(at[both])
        return tuple(last)

    def codes_of_groups(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
        """Numbers in `written` of groups as a1,a2|b1;a3|b2,b3;"""
        code = np.empty(len(a) + len(b), np.int64)
        # A token's place is its index and all tokens of the other list that come before its group, or within it for B.
        before = np.r_[0, b_last + 1]
        a_group = np.repeat(np.arange(len(a_last)), np.diff(np.r_[-1, a_last]))
        b_group = np.repeat(np.arange(len(b_last)), np.diff(np.r_[-1, b_last]))
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[a_last] = ends_b[b_last] = 1
        code[np.arange(len(a)) + before[a_group]] = a + ends_a * len(self.a_bytes)
        code[np.arange(len(b)) + a_last[b_group] + 1] = self.base_b + b + ends_b * len(self.b_bytes)
        return code

    def gives_back(self, whole: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the bytes of both lists are these."""
        if not len(a) or not len(whole) == self.a_strings.size[a].sum() == self.b_strings.size[b].sum():
            return False
        return self.a_strings.joined(a)[0].tobytes() == whole == self.b_strings.joined(b)[0].tobytes()

    def rows(self, texts: list[str | None]) -> list:
        """For each text links, digest, a, b, a_last, b_last, pairs and times; None for a text without tokens."""
        some = [i for i, t in enumerate(texts) if t]
        out, own = [None] * len(texts), [texts[i] for i in some]
        of_b = self.b.encode(own, num_threads=1) if own else []
        held = []
        for i, a, b in zip(some, self.a.ids(own), of_b, strict=True):
            a, b = a.astype(np.int64), np.array(b, np.int64)
            if self.gives_back(b" " + texts[i].encode(), a, b):
                held.append((i, a, b))
        if not held:
            return out
        a, b = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        a_last, b_last = self.cuts(np.cumsum(self.a_strings.size[a]), np.cumsum(self.b_strings.size[b]))
        written, ends = self.written.joined(self.codes_of_groups(a, b, a_last, b_last))
        written = memoryview(written)
        a_to, b_to = (np.cumsum([len(h[k]) for h in held]) for k in (1, 2))
        groups = np.searchsorted(a_last, a_to)
        text_no = np.repeat(np.arange(len(held)), np.diff(np.r_[0, groups]))
        # Within a slice the tokens that end with it are linked; no token is empty, so these are its last ones.
        keys, times = np.unique(text_no * PAIR * PAIR + a[a_last] * PAIR + b[b_last], return_counts=True)
        some_pairs = np.searchsorted(keys, np.arange(1, len(held) + 1) * PAIR * PAIR)
        keys %= PAIR * PAIR
        spans = zip(held, *[zip([0, *to], to, strict=False) for to in (groups.tolist(), some_pairs.tolist(), [0, *ends[a_to + b_to - 1].tolist()][1:])], [0, *a_to.tolist()], [0, *b_to.tolist()], strict=False)
        for (i, own_a, own_b), (g0, g1), (p0, p1), (w0, w1), a0, b0 in spans:
            out[i] = g1 - g0, hashlib.sha256(written[w0:w1 - 1]).hexdigest(), own_a, own_b, a_last[g0:g1] - a0, b_last[g0:g1] - b0, keys[p0:p1], times[p0:p1]
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


_NONE = (0, "", *[np.zeros(0, np.int64)] * 6)


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, ids: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): both id lists, the groups that common ends cut them into, and the links.

    doc_id, n_a, n_b, n_groups, n_links, groups_sha256; a_ids and b_ids; a_last and b_last, the index of each group's last
    token in its list; pairs and times, the distinct linked pairs (A id * PAIR + B id) and how often the text links them.
    A encodes a space and the text, B the text, special strings as plain text. A text that is null or empty, or whose
    bytes either list does not give back, has no tokens: zeros, empty lists and an empty digest. Rows may repeat, doc_id
    may be null, other columns are ignored, an empty table gives an empty result. The files must lie on every executor.
    Without `ids` the four lists of ids and last tokens are left out.
    """
    at = a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*at)
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                rows = [r or _NONE for r in own.rows(part.column("text").to_pylist())]
                links, digest, a, b, a_last, b_last, pairs, times = zip(*rows, strict=True)
                count = [pa.array(list(map(len, x)), pa.int64()) for x in (a, b, a_last)]
                lists = [_lists(x, pa.int32()) for x in (a, b, a_last, b_last)] if ids else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *count, pa.array(links, pa.int64()), pa.array(digest, pa.string()), *lists, _lists(pairs, pa.int64()), _lists(times, pa.int64())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(_ID_LISTS if ids else []), "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(align, ", ".join([_PLAIN, *[f"{c} array<int>" for c in (_ID_LISTS if ids else [])], _PAIRS]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """A row per linked pair of ids: pair, n (links over all rows), best (no pair with the same B id has more)."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % PAIR))).alias("best"))


def with_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs; see align_tokens().

    n_best: links whose pair no other pair with the same B id exceeds in links over all rows. count_sum: the sum, over the
    row's links, of their pairs' links over all rows.
    """
    scratch, at = Scratch(docs.sparkSession, "align"), (a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE))
    rows = scratch.write(align_tokens(docs, *at, ids=False), "aligned")
    counts = scratch.write(pair_counts(rows), "counts")
    if aligner(*at).most_pairs() * PAIR_BYTES <= broadcast_bytes:
        return _looked_up(rows, counts)
    return _joined(rows, counts, scratch)


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    known = counts.toArrow().sort_by("pair")
    held = rows.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy().astype(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (times * best[at], times * n[at])]
            out = batch.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, sums)], [*out.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(look_up, f"{_PLAIN}, n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs joined to their counts; a pair's rows are spread over SALTS parts."""
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("m"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    sums = links.join(salted, ["pair", "salt"]).groupBy("row").agg(F.sum(F.col("m") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
