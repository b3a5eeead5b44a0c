"""HTML cleaning as chained Column expressions (narrow, JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import BLOCK_TAGS, ENTITIES

_BLOCKS = "|".join(BLOCK_TAGS)
_OPEN, _CLOSE = "\u0001", "\u0002"  # block markers; removed from the input first

#: Parts of a page that never carry content.
BOILERPLATE = (
    r"(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<nav\b.*?</nav>"
    r"|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<!--.*?-->"
)
OPEN_BLOCK = rf"(?i)<(?:{_BLOCKS})(?:\s[^>]*)?>"
CLOSE_BLOCK = rf"(?i)</(?:{_BLOCKS})\s*>"
ANY_TAG = r"<[A-Za-z/!?][^>]*>"  # other "<" are prose
ANCHOR = r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"


def h1_title(title: Column) -> Column:
    """Wrap a title in ``<h1>``."""
    return F.concat(F.lit("<h1>"), title, F.lit("</h1>"))


def strip_code(html: Column) -> Column:
    """Code blocks become ``<p>CodE</p>``, inline code becomes ``CodE``.

    A block match may start at a plain ``<pre>`` and run to a later
    ``</code></pre>``; this is the wanted behaviour, so logs go second.
    """
    blocks = F.regexp_replace(html, r"(?s)<pre.*?</code></pre>", "<p>CodE</p>")
    return F.regexp_replace(blocks, r"(?s)<code>.*?</code>", "CodE")


def strip_links(html: Column, strict: bool = False) -> Column:
    """Links become ``LinK``.

    The default pattern starts at any tag whose name begins with ``a``, so it
    also swallows ``<article>...</a>``; ``strict=True`` matches ``<a>`` only.
    """
    return F.regexp_replace(html, r"(?s)<a\b.*?</a>" if strict else r"(?s)<a.*?</a>", "LinK")


def strip_logs(html: Column) -> Column:
    """Bare ``<pre>`` blocks become ``<p>LoG</p>``."""
    return F.regexp_replace(html, r"(?s)<pre>.*?</pre>", "<p>LoG</p>")


def clean_post(title: Column, body: Column, strict: bool = False) -> Column:
    """Title as heading, then the body without code, links and logs."""
    return F.concat_ws("\n", h1_title(title), strip_logs(strip_links(strip_code(body), strict)))


def plain_text(html: Column) -> Column:
    """Drop every tag and decode the common entities."""
    text = F.regexp_replace(html, ANY_TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def raw_blocks(html: Column) -> Column:
    """Block contents with their inline tags, in page order, each text once.

    Every opening block tag starts a paragraph and the next block tag ends it:
    unclosed ``<p>`` are handled and nested blocks are not emitted twice. Text between
    two closing tags is the rest of the outer block and a paragraph of its own.
    """
    marked = F.translate(html, _OPEN + _CLOSE, "")
    marked = F.regexp_replace(marked, OPEN_BLOCK, _OPEN)
    marked = F.regexp_replace(marked, CLOSE_BLOCK, _CLOSE)
    for _ in range(2):  # matches of one pass do not overlap
        marked = F.regexp_replace(marked, r"\x02([^\x01\x02]+)\x02", _CLOSE + _OPEN + "$1" + _CLOSE)
    return F.regexp_extract_all(marked, F.lit(r"\x01([^\x01\x02]*)"), F.lit(1))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(html: Column) -> Column:
    """Non-empty paragraph texts of a page as an array."""
    texts = F.transform(raw_blocks(html), lambda block: trim_space(plain_text(block)))
    return F.filter(texts, lambda text: text != "")


def main_content(html: Column, min_chars: int = 25, max_link_share: float = 0.5) -> Column:
    """Blocks that look like prose, as HTML; null when none does.

    A block is kept when its text has ``min_chars`` characters and less than
    ``max_link_share`` of them stand inside links.
    """

    def is_prose(block: Column) -> Column:
        length = F.length(plain_text(block))
        linked = F.length(plain_text(F.array_join(F.regexp_extract_all(block, F.lit(ANCHOR), F.lit(1)), "")))
        return (length >= min_chars) & (linked < length * F.lit(max_link_share))

    kept = F.filter(raw_blocks(F.regexp_replace(html, BOILERPLATE, "")), is_prose)
    joined = F.array_join(
        F.transform(kept, lambda block: F.concat(F.lit("<p>"), trim_space(block), F.lit("</p>"))), "\n"
    )
    return F.when(F.size(kept) > 0, joined)
