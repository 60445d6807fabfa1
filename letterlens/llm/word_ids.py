"""Ids of whole texts by a tokenizers file, with a cache of words, for operators that need the library's own ids."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Texts that a cache of a task knows. A full one is emptied before the next texts, so memory is bounded; no id changes by it.
CACHE = 400_000
#: Ids that it holds for them.
CACHE_IDS = 8 * CACHE
#: A longer word is encoded each time it comes.
LONG_WORD = 64
#: New words that the library gets in one string.
AT_ONCE = 200
#: What the patterns of the files cut a text of plain characters into: with a lead of a space, and without one (lower-cased).
_WITH_LEAD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WITHOUT = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")


class _Numbers(dict):
    """Numbers texts as they are asked for; `new` has those that were not known."""

    def __init__(self):
        self.count, self.new = 0, []

    def __missing__(self, text: str) -> int:
        self[text] = number = self.count
        self.count += 1
        self.new.append(text)
        return number


class _Cache:
    """Ids by text. encode gives new texts' ids end to end, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.ids, self.begin, self.size, self.full = _Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def look_up(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists end to end, and how many each list has."""
        if self.full:
            self._empty()
        number, n = self.numbers.__getitem__, list(map(len, lists))
        at = np.fromiter(map(number, chain.from_iterable(lists)), np.int64, sum(n))
        if self.numbers.new:
            ids, size = self.encode(self.numbers.new)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            for text in self.numbers.new:
                if len(text) > LONG_WORD:
                    del self.numbers[text]
            self.numbers.new = []
            self.full = self.numbers.count > CACHE or len(self.ids) > CACHE_IDS
        size = self.size[at]
        ends = np.cumsum(size)
        total = np.r_[0, ends]
        return self.ids[np.repeat(self.begin[at] - ends + size, size) + np.arange(total[-1])], np.diff(total[np.r_[0, np.cumsum(n, dtype=np.int64)]])


class WordIds:
    """Ids by cutting texts where the tokenizer's own pattern cuts them, so that each pre-token is encoded once.

    Two kinds of files, by `lead`: byte-level ones, whose pre-tokens carry the space before them (a lead of one space), and
    lower-casing ones that drop white space and mark the ends of pre-tokens (none). `special` says whether special strings
    in a text count as special, as is the library's default. A text with such a string, or with characters that the
    patterns here may class otherwise than the library's do, is encoded whole.

    New pre-tokens go to the library many in a string. Where each ends is seen from the ids: with a lead it is the ids from
    one that begins with a space to the next such one, without one the ids up to one that ends with the mark.
    """

    def __init__(self, path: str, lead: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.lead = Tokenizer.from_file(path), lead
        self.library.encode_special_tokens = not special
        vocabulary = self.library.get_vocab()
        strings = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile("|".join(map(re.escape, strings)) or r"(?!)").search
        self.edge = np.zeros(1 + max(vocabulary.values()), bool)  # ids that begin with a space, or that end a pre-token
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if lead else token.endswith("</w>")
        self.known, self.plain = _Cache(self._encode), set()

    def _alone(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the pattern cuts at both ends, many in one string; one by one where it does not cut as expected."""
        groups = [parts[k:k + AT_ONCE] for k in range(0, len(parts), AT_ONCE)]
        joined = list(map(("" if self.lead else " ").join, groups))
        ids, size = [], []
        for group, raw in zip(groups, self._alone(joined), strict=True):
            own = np.frombuffer(raw, np.uint32)
            cuts = np.flatnonzero(self.edge[own])
            bounds = np.r_[cuts, len(own)] if self.lead else np.r_[0, cuts + 1]
            if len(cuts) != len(group) or bounds[0] or bounds[-1] != len(own):
                each = self._alone(group)
                own, n = np.frombuffer(b"".join(each), np.uint32), np.array(list(map(len, each)), np.int64)
            else:
                n = np.diff(bounds)
            ids.append(own)
            size.append(n)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *size])

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {p for p in parts if len(p) > LONG_WORD or self.lead and not (p[0] == " " and p[1:] and not p[1].isspace())}
        ids, size = self._together([p for p in parts if p not in odd])
        if not odd:
            return ids, size
        own = dict(zip(odd, self._alone(list(odd)), strict=True))
        plain = iter(np.split(ids, np.cumsum(size)))
        each = [np.frombuffer(own[p], np.uint32) if p in odd else next(plain) for p in parts]
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def _is_plain(self, c: str) -> bool:
        """Whether a character is a letter, decimal digit of ASCII, white space or sign here and in the library, which may compose and lower-case."""
        if unicodedata.category(c)[0] == "M" or unicodedata.normalize("NFC", c) != c:
            return False
        if c.isalpha():
            return self.lead == " " or c.lower().isalpha()
        return c in "0123456789" or not (c.isnumeric() or "\x1c" <= c <= "\x1f")

    def _parts(self, text: str) -> list[str] | None:
        """A text's pre-tokens, None if it has to be encoded whole."""
        new = set(text).difference(self.plain)
        if new:
            odd = {c for c in new if not self._is_plain(c)}
            self.plain |= new - odd
            if odd:
                return None
        if self.lead:
            return _WITH_LEAD.findall(self.lead + text)
        low = text.lower() if text.isascii() else text.encode().lower().decode()
        return None if "<" in low and (self.special(low) or self.special(text)) else _WITHOUT.findall(low)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text; with a lead, of lead + text."""
        parts = list(map(self._parts, texts))
        ids, size = self.known.look_up([own or [] for own in parts])
        out = np.split(ids, np.cumsum(size)[:-1]) if texts else []
        whole = [i for i, own in enumerate(parts) if own is None]
        for i, own in zip(whole, self._alone([self.lead + texts[i] for i in whole]), strict=True):
            out[i] = np.frombuffer(own, np.uint32)
        return out


@lru_cache(maxsize=4)
def word_ids(path: str, lead: str, special: bool) -> WordIds:
    return WordIds(path, lead, special)
