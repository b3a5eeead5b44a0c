"""Sentence, token, tag, lemma and stem rules as Column expressions.

Each rule takes a Column and works on a long token column (whole-stage codegen)
as well as inside ``F.transform`` over an array column (no shuffle).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import trim_space
from .wordlists import (
    ASCII_PUNCTUATION,
    DETACHMENT,
    LEMMA_EXCEPTIONS,
    NOT_PLURAL,
    SENTENCE_END,
    STOP_WORDS,
    TAG_LEXICON,
    TAG_SUFFIXES,
    TOKEN_PATTERN,
)


def words(text: Column) -> Column:
    """Word tokens as an array, punctuation runs included."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences as an array."""
    marked = F.regexp_replace(F.translate(text, "\x03", ""), SENTENCE_END, "$1\x03$2")
    found = F.transform(F.split(marked, "\x03"), trim_space)
    return F.filter(found, lambda sentence: sentence != "")


def _ascii_letter(char: Column) -> Column:
    return char.between("a", "z") | char.between("A", "Z")


def is_punct(token: Column) -> Column:
    """All characters are Unicode punctuation; symbols such as ``+`` are not."""
    # the first test only spares most tokens the regular expression
    return ~_ascii_letter(F.substring(token, 1, 1)) & token.rlike(r"^\p{P}*$")


def is_stopword(token: Column, stop_words: Iterable[str] = STOP_WORDS, low: Column | None = None) -> Column:
    """Stop word in any case; ``low`` is the token in lower case, if at hand."""
    return (F.lower(token) if low is None else low).isin(*stop_words)


def is_short(token: Column) -> Column:
    return F.length(token) == 1


def keep_token(token: Column, stop_words: Iterable[str] = STOP_WORDS, low: Column | None = None) -> Column:
    """Not punctuation, not a stop word, more than one character."""
    return ~is_short(token) & ~is_stopword(token, stop_words, low) & ~is_punct(token)


def _ends(token: Column, suffixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [token.endswith(suffix) for suffix in suffixes])


def _closed_class(low: Column) -> Column:
    rule = None
    for tag, listed in TAG_LEXICON.items():
        rule = (F if rule is None else rule).when(low.isin(*listed), tag)
    return rule


def pos_tag(token: Column, low: Column | None = None) -> Column:
    """Penn tag from the closed-class lexicon, else suffix rules, else noun."""
    low = F.lower(token) if low is None else low
    first = F.substring(token, 1, 1)
    closed = [word for listed in TAG_LEXICON.values() for word in listed]
    mark = (F.when(first.isin(".", "!", "?"), ".")
            .when(first == ",", ",")
            .when(first.isin(":", ";", "-"), ":")
            .otherwise("SYM"))
    rule = F.when(low.isin(*closed), _closed_class(low))
    rule = rule.when(~_ascii_letter(first) & first.rlike(r"[^\p{L}\p{N}_]"), mark)
    rule = rule.when(~_ascii_letter(first) & first.rlike(r"\p{N}"), "CD")
    # most tokens end in no suffix at all: one look at the last letter skips the list
    last = sorted({suffix[-1] for suffixes, _ in TAG_SUFFIXES for suffix in suffixes})
    by_suffix = F.when(~F.substring(low, -1, 1).isin(*last), None)
    for suffixes, tag in TAG_SUFFIXES:
        by_suffix = by_suffix.when(_ends(low, suffixes), tag)
    rule = rule.otherwise(by_suffix)
    return F.coalesce(rule, F.when(first != F.lower(first), "NNP").otherwise("NN"))


def word_class(tag: Column) -> Column:
    """Lemma class from the first letter of the tag; anything else is a noun."""
    head = F.substring(tag, 1, 1)
    return F.when(head == "V", "v").when(head == "R", "r").when(head == "J", "a").otherwise("n")


def _detach(token: Column, word_class_: str) -> Column:
    listed, rules = LEMMA_EXCEPTIONS[word_class_], DETACHMENT[word_class_]
    table = F.create_map(*[F.lit(part) for pair in listed.items() for part in pair])
    rule = F.when(token.isin(*listed), table[token])
    if not rules:
        return rule.otherwise(token)
    last = sorted({suffix[-1] for suffix, _ in rules})
    rule = rule.when(~F.substring(token, -1, 1).isin(*last), token)
    if word_class_ in "nv":
        rule = rule.when(_ends(token, NOT_PLURAL), token)
    for suffix, ending in rules:
        size = len(suffix)
        stem = F.substring(token, F.lit(1), F.length(token) - size)
        rule = rule.when(token.endswith(suffix) & (F.length(token) > size + 1), F.concat(stem, F.lit(ending)))
    return rule.otherwise(token)


def _lemma_of_lower(token: Column, cls: Column) -> Column:
    return (
        F.when(cls == "n", _detach(token, "n"))
        .when(cls == "v", _detach(token, "v"))
        .when(cls == "a", _detach(token, "a"))
        .otherwise(_detach(token, "r"))
    )


def _bind(value: Column, rule: Callable[[Column], Column]) -> Column:
    # a lambda variable: the value is computed once however often it is used
    return F.transform(F.array(value), rule)[0]


def lemma(token: Column, tag: Column) -> Column:
    """Lemma under a Penn tag: irregular form, else rule of the word class.

    Tokens with capitals are left as they are, as a lower-case lexicon lookup
    would leave them.
    """
    cls = _bind(tag, word_class)
    return F.when(token != F.lower(token), token).otherwise(_bind(cls, lambda c: _lemma_of_lower(token, c)))


def is_ascii_punct(token: Column) -> Column:
    """The token is a piece of the ASCII punctuation string."""
    return F.lit(ASCII_PUNCTUATION).contains(token)


def s_stem(token: Column) -> Column:
    """S-stemmer (Harman 1991): ies -> y, es -> e, s -> nothing, with exceptions."""
    size = F.length(token)
    return (
        F.when(token.endswith("ies") & ~_ends(token, ("eies", "aies")),
               F.concat(F.substring(token, F.lit(1), size - 3), F.lit("y")))
        .when(token.endswith("es") & ~_ends(token, ("aes", "ees", "oes")),
              F.substring(token, F.lit(1), size - 1))
        .when(token.endswith("s") & ~_ends(token, ("us", "ss")),
              F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )


def normalise_array(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Filter, lemmatise and lower a token array in place (no shuffle).

    Every step binds its result to a lambda variable. As flat column
    expressions the rules would be inlined into each other many times over and
    outgrow what the JVM compiles.
    """
    paired = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lower(t).alias("low")))
    kept = F.filter(paired, lambda x: keep_token(x["token"], stop_words, x["low"]))
    return _normalise(F.transform(kept, lambda x: F.struct(
        x["token"].alias("token"), x["low"].alias("low"), pos_tag(x["token"], x["low"]).alias("tag"))))


def normalise_tagged(tagged: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """The same for an array of (token, tag)."""
    paired = F.transform(tagged, lambda x: F.struct(
        x["token"].alias("token"), F.lower(x["token"]).alias("low"), x["tag"].alias("tag")))
    return _normalise(F.filter(paired, lambda x: keep_token(x["token"], stop_words, x["low"])))


def _normalise(kept: Column) -> Column:
    classed = F.transform(kept, lambda x: F.struct(
        x["low"].alias("low"), F.when(x["token"] != x["low"], "").otherwise(word_class(x["tag"])).alias("cls")))
    lemmas = F.transform(classed, lambda x: F.when(x["cls"] == "", x["low"]).otherwise(
        F.lower(_lemma_of_lower(x["low"], x["cls"]))))
    return F.filter(lemmas, lambda token: F.length(token) > 1)


# --- the same normaliser, word by word -----------------------------------

#: TOKEN_PATTERN; white space is ASCII there.
_TOKEN = re.compile(r"\w+|[^\w \t\n\x0b\f\r]+")
_CLOSED = {word: tag for tag, listed in reversed(TAG_LEXICON.items()) for word in listed}
#: Distinct tokens a task remembers before it starts anew.
REMEMBERED = 500_000


def _general(char: str) -> str:
    return unicodedata.category(char)[0]


def _is_letter(char: str) -> bool:
    return char.isascii() and char.isalpha()


def _word_tag(token: str, low: str) -> str:
    """:func:`pos_tag` of one token."""
    first = token[0]
    if low in _CLOSED:
        return _CLOSED[low]
    if not _is_letter(first):
        if first != "_" and _general(first) not in "LN":
            return "." if first in ".!?" else "," if first == "," else ":" if first in ":;-" else "SYM"
        if _general(first) == "N":
            return "CD"
    for suffixes, tag in TAG_SUFFIXES:
        if low.endswith(suffixes):
            return tag
    return "NNP" if first != first.lower() else "NN"


def _word_lemma(token: str, tag: str) -> str:
    cls = {"V": "v", "R": "r", "J": "a"}.get(tag[0], "n")
    listed = LEMMA_EXCEPTIONS[cls]
    if token in listed:
        return listed[token]
    if cls in "nv" and token.endswith(NOT_PLURAL):
        return token
    for suffix, ending in DETACHMENT[cls]:
        if token.endswith(suffix) and len(token) > len(suffix) + 1:
            return token[:-len(suffix)] + ending
    return token


def normal_word(token: str, stop_words: frozenset[str]) -> str | None:
    """What :func:`normalise_array` makes of one token; None if it is dropped."""
    low = token.lower()
    if len(token) == 1 or low in stop_words:
        return None
    # a line separator at the end is let through, as the pattern's $ does
    body = token[:-1] if token[-1] in "\x85\u2028\u2029" else token
    if not _is_letter(token[0]) and all(_general(char) == "P" for char in body):
        return None
    word = low if token != low else _word_lemma(low, _word_tag(token, low)).lower()
    return word if len(word) > 1 else None


def normal_words(texts: pa.Array, stop_words: frozenset[str], known: dict[str, str | None]) -> pa.Array:
    """Token arrays of whole texts; ``known`` holds the words already looked at."""
    ends, found = [0], []
    for text in texts.to_pylist():
        if text is not None:
            for token in _TOKEN.findall(text):
                try:
                    word = known[token]
                except KeyError:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    word = known[token] = normal_word(token, stop_words)
                if word is not None:
                    found.append(word)
        ends.append(len(found))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()), mask=texts.is_null())
    return lists
