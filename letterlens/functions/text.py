"""Text of messages: visible text of HTML, white space, links, and what the classifier reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is not seen, and named entities.
HIDDEN = ("script", "style", "head", "title", "meta")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Elements whose text holds no links for a reader of the whole text.
CODE = ("script", "style", "template")
HTTP = r"https?://[^\s<>\"']+"


def clean_space(text: Column) -> Column:
    """P10: runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def visible_text(html: Column) -> Column:
    """The text of HTML without hidden elements and tags, parts joined by blanks."""
    return clean_space(unescaped(_without_tags(html, HIDDEN[:-1])))


def _without_tags(html: Column, hidden: tuple[str, ...]) -> Column:
    t = F.coalesce(html, F.lit(""))
    for tag in hidden:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")


def unescaped(text: Column) -> Column:
    """Entities as their characters: numeric ones by code point (what is no character stays), then the named ones."""
    def char(digits: Column) -> Column:
        n = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).try_cast("bigint")
        good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), 1))
    decoded = F.aggregate(numbers, text, lambda t, d: F.replace(t, F.concat(F.lit("&#"), d, F.lit(";")), F.coalesce(char(d), F.concat(F.lit("&#"), d, F.lit(";")))))
    t = F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)
    for name, plain in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(plain))
    return t


def extract_urls(text: Column, html: Column) -> Column:
    """Links in the text, in href attributes and in the text of the HTML, without trailing marks, first seen first.

    Entities are decoded in attributes and text alike.
    """
    found = lambda c, p, g: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), g)
    hrefs = found(html, r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    every = F.concat(found(text, f"(?i){HTTP}", 0), F.transform(hrefs, unescaped), found(unescaped(_without_tags(html, CODE)), f"(?i){HTTP}", 0))
    bare = F.transform(every, lambda u: F.regexp_replace(u, r"[.,;:)\]>'\"]+$", ""))
    return F.array_distinct(F.filter(bare, lambda u: u.rlike("(?i)^https?://.")))


def composite(subject: Column, body_text: Column, body_html: Column) -> tuple[Column, Column]:
    """M1, M2: the text that the classifier reads, and whether subject and body together have ten characters."""
    title, plain = clean_space(subject), clean_space(body_text)
    body = F.when(plain != "", plain).otherwise(visible_text(body_html))
    return F.concat(F.lit("SUBJECT:\n"), title, F.lit("\n\nBODY:\n"), body), F.length(title) + F.length(body) >= 10


def content_hash(subject: Column, body_text: Column, body_html: Column) -> Column:
    """M3: SHA-256 of the lower-cased subject and body."""
    plain = clean_space(body_text)
    body = F.when(plain != "", plain).otherwise(visible_text(body_html))
    return F.sha2(F.concat_ws(" ", F.lower(clean_space(subject)), body), 256)
