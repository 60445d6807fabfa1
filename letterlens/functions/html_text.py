"""Visible text of HTML by a tokeniser: every named entity, tags with `>` in attributes, elements that are never closed.

`text.visible_text` is the plain path, of patterns alone, and stays within the JVM; this one reads whole pages in Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from letterlens.functions.text import clean_space

#: Elements whose content is not seen (the last three hold no text of the page proper), and elements without content.
UNSEEN = frozenset(("script", "style", "head", "title", "meta", "template", "rt", "rp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))


class _Reader(HTMLParser):
    """Keeps the open elements: an end tag closes the last open one of its name and all within; without one it does nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.unseen, self.parts, self.run = 0, [], []

    def _flush(self) -> None:
        if self.run:
            self.parts.append("".join(self.run))
            self.run = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        while self.count.get(tag):
            last = self.open.pop()
            self.count[last] -= 1
            self.unseen -= last in UNSEEN
            if last == tag:
                break

    def handle_data(self, data):
        if not self.unseen:
            self.run.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA[") and not self.unseen:
            self.parts.append(data[6:])


def text_of(html: str | None) -> str:
    """Texts between tags, joined by blanks; markup that the tokeniser rejects loses its tags by a pattern."""
    if not html or not html.strip():
        return ""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:
        return re.sub(r"<[^>]+>", " ", html)
    reader._flush()
    return " ".join(reader.parts)


def exact_visible_text(html: Column) -> Column:
    """P9, exact: the text a reader sees, white space made single. Null and blank HTML give an empty text.

    Text is taken whole, however long; an element left open hides or shows all that follows it, as a parser has it.
    """
    read = F.pandas_udf(lambda pages: pd.Series([text_of(h) for h in pages], dtype=object), "string")
    return clean_space(read(html))
