"""Removal of repeated 100-byte strings with a sparse suffix array, sorted deep-shallow.

A window is a string of WINDOW bytes in one document. Of the GRAM-byte strings in a window, the one with the least hash
is its anchor; equal windows have equal anchors at equal offsets, so only suffixes that begin at anchors (about 1 in 35)
are compared. An anchor's context is all bytes that windows around it can hold.

1. Anchors are grouped by hash. Occurrences with equal contexts (by a second hash) form a class; all but the first of a
   class repeat it whole. Classes are pre-aggregated before the shuffle.
2. Where an anchor has several classes, the first occurrences' contexts are sorted as suffixes (to the right of the
   anchor) and as reversed prefixes (to its left). Both orders come from a deep-shallow sort: multikey refinement by
   8-byte keys to a shallow depth, then a blind trie for each group that still shares a long prefix. With the lengths of
   common prefixes between neighbours, equality of windows at an offset is equality of two ranks. An anchor with very
   many classes, as at the edge of a passage that many documents share, is split: each of its windows is a context of its
   own, dealt by its bytes, and a task passes on only the earliest of equal ones that it meets.
3. Each document's repeated spans are joined to it, merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch

WINDOW, GRAM = 100, 32
LEFT = WINDOW - GRAM
#: Bytes that the shallow sort looks at; longer common prefixes go to blind tries.
SHALLOW = 48
#: Text that a task looks at at once, and the text whose anchors one owner task gets.
CHUNK_BYTES, OWNER_BYTES = 2 << 20, 16 << 20
#: Classes of one anchor (11 MB of contexts) that a task sorts. Beyond them its windows are dealt one by one: up to 69 rows
#: a class, but no task has more than a few of equal windows.
HOT_CLASSES = 1 << 16
#: Windows of such anchors that a task remembers at once.
_REMEMBERED = 100_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 2**64)
_OF_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_FIRST_ID = -(2**63)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            top = np.uint64(pow(_BASE, k, 2**64)), np.uint64(pow(_INVERSE, k, 2**64))
            self.up, self.down = np.r_[self.up, self.up * top[0]], np.r_[self.down, self.down * top[1]]
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a = f(a[:-done], a[done:])
        done *= 2
    return f(a[:len(a) - (width - done)], a[width - done:]) if done < width else a


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Anchors of documents that lie end to end in data: (document number, place, left, right, hash, context hash)."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    w = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    h = np.zeros(n - GRAM + 1, np.uint64)
    for k, at in enumerate(range(0, GRAM, 8)):
        h += w[at:at + len(h)]
        h *= _MIX[k % 3]
        h ^= h >> np.uint64(31 - k)
    h |= np.uint64(1)  # never 0, which stands for a window that no document holds
    least = _slide(h, LEFT + 1, np.minimum)
    whole = np.zeros(n + 1, np.int32)
    long_ = ends - starts >= WINDOW
    np.add.at(whole, starts[long_], 1)
    np.add.at(whole, ends[long_] - WINDOW + 1, -1)
    least[np.cumsum(whole)[:len(least)] == 0] = 0
    pad = np.zeros(LEFT, np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum)[:len(h)] == h)
    doc = np.searchsorted(starts, place, "right") - 1
    left, right = np.minimum(place - starts[doc], LEFT), np.minimum(ends[doc] - place, WINDOW)
    up, down = _powers.upto(n + 1)
    sums = np.concatenate([pad[:1], np.cumsum(_OF_BYTE[data] * down[:n])])
    context = (sums[place + right] - sums[place - left]) * up[place - left]
    context = (context ^ (left * 128 + right).astype(np.uint64)) * _MIX[1]
    return doc, place - starts[doc], left, right, h[place], context ^ (context >> np.uint64(29))


def _firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by keys, then by order; and whether each row, so ordered, is the first of its keys."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    return by, new


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, int)
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1]] if len(new) else reach


_ANCHOR = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("dup", pa.int64()), ("at", pa.int64())])
#: at: place << 16 | left << 8 | right.


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the anchors, those that repeat an earlier one of the batch with c = 0 and h scattered."""
    for batch in batches:
        out: list[list[np.ndarray]] = []
        texts, ids, dups = batch.column("text"), batch.column("d").to_numpy(), batch.column("dup").to_numpy()
        size = pa.compute.binary_length(texts.cast(pa.binary())).fill_null(0).to_numpy()
        chunk = np.cumsum(size) // CHUNK_BYTES
        for c in np.unique(chunk):
            rows = np.flatnonzero((chunk == c) & (size >= WINDOW))
            ends = np.cumsum(size[rows])
            data = np.frombuffer(b"".join(t.as_buffer() for t in texts.cast(pa.binary()).take(pa.array(rows))), np.uint8)
            doc, place, left, right, h, context = anchors(data, ends - size[rows], ends)
            out.append([h.view(np.int64), context.view(np.int64), ids[rows][doc], dups[rows][doc], place << 16 | left << 8 | right])
        if not out:
            continue
        h, c, d, dup, at = (np.concatenate(x) for x in zip(*out, strict=True))
        by, first = _firsts([h, c], [d, dup, at])
        repeat = by[~first]
        c[by[first & (c[by] == 0)]] = 1
        c[repeat] = 0  # known to repeat: of no use to an owner, so any owner may pass it on
        h[repeat] ^= (d[repeat] * 0x5851F42D4C957F2D) ^ at[repeat]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, d, dup, at)], schema=_ANCHOR)


_MARK = "h long, d long, dup long, at long, open int"
_REPEAT, _FIRST, _HOT = 0, 1, 2


def _owner_rows(batches: Iterator[pa.RecordBatch], hot_classes: int = HOT_CLASSES) -> Iterator[pa.RecordBatch]:
    """Occurrences that repeat their class, and the first of each class of an anchor with several, or with very many."""
    names = ["h", "d", "dup", "at", "open"]
    held = [b for b in batches if len(b)]
    if not held:
        return
    h, c, d, dup, at = (pa.Table.from_batches(held).column(i).to_numpy() for i in range(5))
    known = c == 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[known], d[known], dup[known], at[known], np.full(known.sum(), _REPEAT, np.int32))], names)
    rest = np.flatnonzero(~known)
    rest = rest[np.argsort(h[rest], kind="stable")]
    same = h[rest][1:] == h[rest][:-1]
    rest = rest[np.r_[same, False] | np.r_[False, same]] if len(rest) else rest  # hashes that occur once are done
    h, c, d, dup, at = (x[rest] for x in (h, c, d, dup, at))
    by, first = _firsts([h, c], [d, dup, at])
    h, d, dup, at = (x[by] for x in (h, d, dup, at))
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, int)
    classes = np.bincount(group, weights=first) if len(h) else np.zeros(0)
    take = ~first | (classes[group] > 1)
    open_ = np.where(first, np.where(classes[group] > hot_classes, _HOT, _FIRST), _REPEAT).astype(np.int32)
    for k in range(0, len(h), 50_000):
        p = np.arange(k, min(k + 50_000, len(h)))[take[k:k + 50_000]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[p], d[p], dup[p], at[p], open_[p])], names)


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Places of the distinct strings, all of one length, in sorted order.

    Inner nodes hold only the depth at which they branch. A string is led down by the bytes at those depths alone; one
    comparison with the leaf it meets gives its common prefix, and so the place where it branches off.
    """
    length, root = len(strings[0]), 0  # a leaf is its number, an inner node (depth, {byte: node})
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[node]
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = length - (differ.bit_length() + 7) // 8
        above, byte, node = None, None, root
        while not isinstance(node, int) and node[0] < depth:
            above, byte, node = node, s[node[0]], node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            continue
        new = (depth, {other[depth]: node, s[depth]: i})
        if above is None:
            root = new
        else:
            above[1][byte] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows (equal lengths, uint8) within their groups, which are numbers in rising order."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    words = padded.view(">u8")
    label, open_ = group.astype(np.int64) * (len(rows) + 1), np.arange(len(rows))
    for k in range(min(shallow // 8, words.shape[1])):  # multikey refinement: only rows that are still tied
        key = words[open_, k]
        by = np.lexsort((key, label[open_]))
        rows_by, old, key = open_[by], label[open_][by], key[by]
        new = np.r_[True, (old[1:] != old[:-1]) | (key[1:] != key[:-1])] if len(by) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(by)])
        begin = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(by)), 0)) if len(by) else first
        label[rows_by] = old + np.repeat(first - begin[first], size)  # a label is the number of rows before it in its group
        open_ = rows_by[np.repeat(size > 1, size)]
    deep = np.zeros(len(rows), np.int64)
    by = open_[np.argsort(label[open_], kind="stable")]
    cuts = np.flatnonzero(np.diff(label[by])) + 1
    for tied in np.split(by, cuts) if len(by) else []:
        places: dict[bytes, list[int]] = {}
        for p in tied.tolist():
            places.setdefault(padded[p].tobytes(), []).append(p)
        distinct = list(places)
        for rank, i in enumerate(blind_trie_order(distinct) if len(distinct) > 1 else [0]):
            deep[places[distinct[i]]] = rank
    return np.lexsort((deep, label))


def _prefix_ranks(group: np.ndarray, rows: np.ndarray):
    """A function of a length n: numbers that are equal for rows of one group with equal first n bytes."""
    order = deep_shallow_order(group, rows)
    a, differ = rows[order], None
    common = np.full(len(rows), -1)
    for k in range(1, len(rows), 20_000):
        p = np.arange(k, min(k + 20_000, len(rows)))
        differ = a[p] != a[p - 1]
        common[p] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[np.r_[True, group[order][1:] != group[order][:-1]]] = -1

    def ranks(n: int) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        out[order] = np.cumsum(common < n)
        return out
    return ranks


def repeated_windows(group, left, right, left_n, right_n) -> np.ndarray:
    """For rows in order of group and occurrence: at which offsets (row x offset) the window equals an earlier row's.

    left holds the bytes before the anchor in reverse, right those from it on, both filled with zeros.
    """
    l_rank, r_rank = _prefix_ranks(group, left), _prefix_ranks(group, right)
    out = np.zeros((len(group), LEFT + 1), bool)
    for o in range(LEFT + 1):
        rows = np.flatnonzero((left_n >= o) & (right_n >= WINDOW - o))
        key = l_rank(o)[rows] * (len(group) + 1) + r_rank(WINDOW - o)[rows]
        by = np.argsort(key, kind="stable")
        key = key[by]
        out[rows[by[1:]], o] = key[1:] == key[:-1]
    return out


_CONTEXT = "h long, d long, dup long, at long, context binary"
_SPAN = "d long, dup long, start long, end long"


def _windows(text: bytes, h: int, at: int) -> Iterator[tuple[int, int, bytes]]:
    """Of an anchor's context each window: a hash of the anchor, the window's offset and its bytes; its place; its bytes."""
    p, left, right = at >> 16, at >> 8 & 255, at & 255
    for o in range(max(0, WINDOW - right), min(left, LEFT) + 1):
        w = text[p - o:p - o + WINDOW]
        key = xxhash.xxh3_64_intdigest(w, (h + o * 0x9E3779B97F4A7C15) & (2**64 - 1))
        yield key - (key >> 63 << 64), p << 16 | o << 8 | WINDOW - o, w


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts; of anchors with very many classes the windows, those known to repeat without bytes and with h scattered."""
    names, types = ["h", "d", "dup", "at", "context"], (pa.int64(),) * 4 + (pa.binary(),)
    earliest: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for batch in batches:
        for k in range(0, len(batch), 200):
            out: list[tuple] = []
            for r in batch.slice(k, 200).to_pylist():
                text, d, dup = (r["text"] or "").encode(), r["d"], r["dup"]
                for o in r["open"]:
                    h, at = o["h"], o["at"]
                    if o["open"] != _HOT:
                        p = at >> 16
                        out.append((h, d, dup, at, text[p - (at >> 8 & 255):p + (at & 255)]))
                        continue
                    for key, own, w in _windows(text, h, at):
                        met = earliest.get((key, w))
                        if met is None or (d, dup, own) < met:
                            earliest[key, w] = (d, dup, own)
                            out.append((key, d, dup, own, w))
                        else:
                            spread = (key ^ d * 0x5851F42D4C957F2D ^ own) & (2**63 - 1)
                            out.append((spread, d, dup, own, b""))
                if len(earliest) > _REMEMBERED:
                    earliest.clear()
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held)
    known = pa.compute.equal(pa.compute.binary_length(t.column(4)), 0)
    d, dup, at = (t.filter(known).column(i).to_numpy() for i in (1, 2, 3))
    place = at >> 16
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, dup, place - (at >> 8 & 255), place + (at & 255))], ["d", "dup", "start", "end"])
    t = t.filter(pa.compute.invert(known))
    h, d, dup, at = (t.column(i).to_numpy() for i in range(4))
    by, _ = _firsts([h], [d, dup, at])
    h, d, dup, at, contexts = h[by], d[by], dup[by], at[by], t.column(4).take(pa.array(by)).to_pylist()
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    place, left_n, right_n = at >> 16, at >> 8 & 255, at & 255
    # Whole groups, some thousands of rows at a time.
    for part in np.unique(ends := np.searchsorted(group, group, "left") // 20_000):
        p = np.flatnonzero(ends == part)
        left, right = np.zeros((len(p), LEFT), np.uint8), np.zeros((len(p), WINDOW), np.uint8)
        for i, j in enumerate(p.tolist()):
            c = np.frombuffer(contexts[j], np.uint8)
            left[i, :left_n[j]] = c[:left_n[j]][::-1]
            right[i, :right_n[j]] = c[left_n[j]:]
        found = repeated_windows(group[p] - group[p[0]], left, right, left_n[p], right_n[p])
        # Runs of neighbouring offsets are one span.
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), high = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
        j = p[row]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[j], dup[j], place[j] - high, place[j] - low + WINDOW)], ["d", "dup", "start", "end"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for k in range(0, len(batch), 200):
            out = []
            for r in batch.slice(k, 200).to_pylist():
                text = (r["text"] or "").encode()
                start, end = np.frombuffer(r["spans"] or b"", np.int64).reshape(2, -1)
                kept, at = [], 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                out.append((r["doc_id"], len(text), len(text) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for starts, ends in zip(b.column("starts"), b.column("ends"), strict=True):
            out.append(np.stack(merged(starts.values.to_numpy(), ends.values.to_numpy())).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("dup"), pa.array(out, pa.binary())], ["d", "dup", "spans"])


def cut_repeats(docs: DataFrame, owner_bytes: int = OWNER_BYTES, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A byte is removed if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or in the same
    document before. Matches never cross documents; null counts as empty. A null doc_id comes before all others; rows
    that repeat a doc_id count as documents of their own, in order of a hash of their texts. kept_text is the remaining
    text, with U+FFFD where a character was cut. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    n, n_ids, size = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.sum(F.octet_length("text"))).first()
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST_ID)).cast("long").alias("d"), F.lit(0).cast("long").alias("dup"), "text")
    if n_ids < n:
        from pyspark.sql import Window

        rows = scratch.write(rows.withColumn("dup", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("text"), F.col("text"))).cast("long")), "rows")
    owners = max(1, ceil((size or 0) / owner_bytes))
    marks = scratch.write(rows.select("d", "dup", "text").mapInArrow(_anchor_rows, "h long, c long, d long, dup long, at long")
                          .repartition(owners, "h").mapInArrow(partial(_owner_rows, hot_classes=hot_classes), _MARK), "marks")

    opened = marks.where(F.col("open") != _REPEAT).groupBy("d", "dup").agg(F.collect_list(F.struct("h", "at", "open")).alias("open"))
    spans = (rows.select("d", "dup", "text").join(opened, ["d", "dup"]).select("d", "dup", "text", "open")
             .mapInArrow(_context_rows, _CONTEXT).repartition(owners, "h").mapInArrow(_suffix_rows, _SPAN))
    place = F.shiftright("at", 16)
    whole = marks.where(F.col("open") == _REPEAT).select("d", "dup", (place - F.shiftright("at", 8).bitwiseAND(255)).alias("start"), (place + F.col("at").bitwiseAND(255)).alias("end"))
    spans = scratch.write(spans.unionByName(whole).groupBy("d", "dup").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
                          .mapInArrow(_merge_rows, "d long, dup long, spans binary"), "spans")
    span_bytes = spans.agg(F.sum(F.length("spans") + 40)).first()[0] or 0
    spans = F.broadcast(spans) if span_bytes <= BROADCAST_BYTES else spans
    return rows.join(spans, ["d", "dup"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
