"""HTML to text by native string functions, within what Java's and RE2's patterns share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BLOCKS = ("script", "style", "noscript", "head")
COMMENT, TAG, SPACE = "<!--(?s:.*?)-->", "<[^>]*>", r"[ \t\n\r]+"


def block(name: str) -> str:
    return f"(?is:<{name}[ >].*?</{name}>)"


def html_to_text(html: Column) -> Column:
    """Text of a page: comments and blocks dropped, tags as spaces, entities decoded, white space collapsed."""
    out = F.regexp_replace(html, COMMENT, " ")
    for name in BLOCKS:
        out = F.regexp_replace(out, block(name), " ")
    out = F.regexp_replace(out, TAG, " ")
    for entity, text in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(out, SPACE, " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is:<title[^>]*>(.*?)</title>)", 1))


def links(html: Column) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), 1)
