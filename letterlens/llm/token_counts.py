"""Token counts by rank-synchronous merging of ragged arrays.

A byte-level BPE vocabulary merges, in each pre-token, the adjacent pair of lowest rank until none is left. Here many
pre-tokens lie end to end in one array; each round finds every sequence's own lowest rank and applies that pair
everywhere in it at once. What is left of a sequence when it has no pair to merge is counted, and the sequence goes.

Short sequences are done after a few rounds over the whole array. Long ones are then linked, symbol to symbol, and their
pairs wait in order of rank, so that a round looks only at the pairs it merges and their neighbours: a symbol's pairs
have higher ranks than the merge that made it, so in each sequence ranks rise, and one order serves all sequences.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern that splits texts before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries a task's cache may hold; a full cache is emptied, so it bounds memory and changes no count.
CACHE = 300_000
#: Rounds over the whole array, after which what is left goes on in order of rank.
WHOLE_ROUNDS = 24
_NONE = np.iinfo(np.int64).max
_BOTH_SPACE = re.compile(r"\s \s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RankMerger:
    """Counts what the merges of a byte-level BPE file (tokenizer JSON) leave of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Bytes that print stand for themselves in the file, the others for the code points from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.of_byte = np.array([vocab[chr(b if b in prints else next(rest))] for b in range(256)], np.int64)
        self.n = max(vocab.values()) + 1
        pairs = np.array([(vocab[a] * self.n + vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.pairs, self.merged, self.ranks = pairs[order, 0], pairs[order, 1], order

    def counts(self, parts: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in parts], np.int64)
        out, ids = size.copy(), self.of_byte[np.frombuffer(b"".join(parts), np.uint8)]
        seq = np.repeat(np.arange(len(parts)), size)
        for _ in range(WHOLE_ROUNDS):
            if len(ids) < 2:
                return out
            key = ids[:-1] * self.n + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], _NONE)
            least = np.full(len(parts), _NONE)
            np.minimum.at(least, seq[:-1], rank)
            hit = np.flatnonzero((rank == least[seq[:-1]]) & (rank != _NONE))
            if not len(hit):
                return out
            # In a run of overlapping hits every second one is applied, from the left.
            run = np.r_[True, np.diff(hit) > 1]
            start = np.flatnonzero(run)
            hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.r_[start, len(hit)]))) % 2 == 0]
            ids[hit] = self.merged[at[hit]]
            np.subtract.at(out, seq[hit], 1)
            stay = least[seq] != _NONE
            stay[hit + 1] = False
            ids, seq = ids[stay], seq[stay]
        if len(ids) > 1:
            out -= np.bincount(self._merged_by_rank(ids, seq), minlength=len(out))
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank _NONE where none is."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE), self.merged[at]

    def _merged_by_rank(self, ids: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """The sequence of each merge that is applied; ids and seq are the symbols that are left."""
        n = len(ids)
        ids, ahead, back = ids.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(np.r_[seq[1:] != seq[:-1], True])
        ahead[last] = n  # n stands for no neighbour
        back[np.r_[0, last[:-1] + 1]] = n
        pair_rank = np.full(n + 1, _NONE)  # of the pair that a symbol begins
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []
        done = []

        def wait(at: np.ndarray) -> None:
            at = at[ahead[at] < n]
            rank, _ = self._rank(ids[at], ids[ahead[at]])
            pair_rank[at] = rank
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for part, r in zip(np.split(at, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        wait(np.arange(n))
        while order:
            rank = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[pair_rank[at] == rank]
            if not len(at):
                continue
            # In a run of overlapping pairs every second one is merged, from the left.
            new = np.r_[True, ahead[at[:-1]] != at[1:]]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = ahead[at]
            ids[at] = self._rank(ids[at[:1]], ids[gone[:1]])[1]
            pair_rank[at] = pair_rank[gone] = _NONE
            after = ahead[gone]
            ahead[at] = after
            inner = after < n
            back[after[inner]] = at[inner]
            done.append(seq[at])
            before = back[at]
            before = before[before < n]
            pair_rank[before] = _NONE
            wait(np.unique(np.concatenate([at, before])))
        return np.concatenate(done) if done else seq[:0]


class TokenCounter:
    """Counts tokens of whole texts. Pieces of a text that have been counted before are looked up."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.split = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        self.pre, self.first, self.later = {}, {}, {}  # by pre-token, by piece that begins a text, by piece after a space

    def _fill(self, cache: dict, pieces: set[str], lead: str) -> None:
        parts = {p: self.split(lead + p) for p in pieces}
        new = list({t for own in parts.values() for t in own}.difference(self.pre))
        if len(self.pre) + len(new) > CACHE:
            self.pre.clear()
            new = list({t for own in parts.values() for t in own})
        self.pre.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist(), strict=True))
        cache.update((p, sum(map(self.pre.__getitem__, own))) for p, own in parts.items())

    def counts(self, texts: list[str]) -> list[int]:
        """A text is cut at spaces: a pre-token holds a space only at its start, or between white space on both sides.

        Texts with the latter go to the pattern as a whole. A special string counts as one token and splits its text.
        """
        if len(self.first) + len(self.later) > CACHE:
            self.first.clear()
            self.later.clear()
        out, first, later, plain, odd = [0] * len(texts), set(), set(), [], []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                segments = self.special.split(text)
                out[i] = len(segments) - 1
            else:
                segments = [text]
            for s in segments:
                if _BOTH_SPACE.search(s):
                    odd.append((i, s))
                elif s:
                    head, *tail = s.split(" ")
                    plain.append((i, head, tail))
                    first.add(head)
                    later.update(tail)
        self._fill(self.first, first.difference(self.first), "")
        self._fill(self.later, later.difference(self.later), " ")
        for i, head, tail in plain:
            out[i] += self.first[head] + sum(map(self.later.__getitem__, tail))
        for i, s in odd:
            own = self.split(s)
            new = list(set(own).difference(self.pre))
            self.pre.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist(), strict=True))
            out[i] += sum(map(self.pre.__getitem__, own))
        return out


@lru_cache(maxsize=4)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the vocabulary's own library without begin, end or added tokens; special strings in a text
    count as their one token, as is its default. Texts are counted whole; null counts as empty, which has no tokens.
    Rows may repeat, doc_id may be null, other columns are ignored, an empty table gives an empty result. The file at
    `path` must lie on every executor.
    """
    at = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(at)
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = pa.array(counter.counts(texts), pa.int64())
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", out.n_tokens > limit)
