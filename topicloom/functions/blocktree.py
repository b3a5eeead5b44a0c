"""Block elements of a page as a tree: every element knows its whole inner text.

A depth stack runs over the tags of one row (an Arrow-batched pandas function; a stack
has no Column form). Each block element (``BLOCK_TAGS``) gives its inner text with all
nested elements, in the order the elements open, as an HTML parser's ``find_all`` over
those tags gives ``element.text``: ``<li>a<p>b</p>middle<p>d</p>tail</li>`` gives
``abmiddledtail``, then ``b``, then ``d``. Omitted end tags close as HTML closes them:
a block start tag closes an open ``p``, an ``li`` start tag closes an open ``li``, an end
tag closes everything opened after its element, and the end of the page closes all. An end tag without an open element is ignored. Texts are stripped of
tags, decoded like :func:`.html.plain_text` and trimmed; empty ones are left out. A null
page has no elements.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import ANY_TAG
from .wordlists import BLOCK_TAGS, ENTITIES

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^>]*)?\s*/?>")
_ANY = re.compile(ANY_TAG)
_BLOCK = frozenset(BLOCK_TAGS)


def _plain(html: str) -> str:
    text = _ANY.sub("", html)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text.strip()


def element_texts(page: str | None) -> list[str]:
    """Whole inner texts of the block elements of one page, in opening order."""
    if page is None:
        return []
    stack: list[tuple[str, int, int]] = []  # (name, order, where its content starts)
    found: list[tuple[int, str]] = []

    def close(at: int) -> None:
        name, order, start = stack.pop()
        found.append((order, page[start:at]))
    opened = 0
    for m in _TAG.finditer(page):
        name = m.group(2).lower()
        if name not in _BLOCK:
            continue
        if m.group(1):
            if any(n == name for n, _, _ in stack):
                while stack[-1][0] != name:
                    close(m.start())
                close(m.start())
            continue
        if stack and stack[-1][0] == "p":
            close(m.start())
        if name == "li" and stack and stack[-1][0] == "li":
            close(m.start())
        stack.append((name, opened, m.end()))
        opened += 1
    while stack:
        close(len(page))
    texts = (_plain(inner) for _, inner in sorted(found))
    return [t for t in texts if t]


def _texts_of(pages: pd.Series) -> pd.Series:
    return pd.Series([element_texts(p) for p in pages])


def block_texts(html: Column) -> Column:
    """Array of the whole inner texts of the block elements (see the module)."""
    return F.pandas_udf(_texts_of, "array<string>")(html)
