"""Joins between raw and cleaned posts, and the tagged-document forms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import html as H
from ..functions import text as T
from ..functions.wordlists import STOP_WORDS
from .scale import bounded

#: Documents a task turns into arrays at a time.
SLICE = 512
TAGGED_TYPE = "array<array<array<struct<token:string,tag:string>>>>"


def unroll(df: DataFrame, array: Column, pos: str, value: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Position and value of each array element; nulls and empty arrays vanish.

    The outer form with a filter behind it: for the inner form the optimizer
    adds a size filter, which evaluates a computed array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(value).isNotNull())


def coded(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words) of a batch of token arrays: one entry per token, in order."""
    flat, row = pc.list_flatten(tokens), pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    if flat.null_count:
        kept = pc.is_valid(flat)
        flat, row = flat.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
    words = flat.dictionary_encode()
    return row.astype(np.int64), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


# --- joins ---------------------------------------------------------------

def docs_of(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents whose id stands in the (filtered) raw posts."""
    return docs.join(raw.select("id"), "id", "left_semi")


def clean_with_raw(clean: DataFrame, raw: DataFrame) -> DataFrame:
    return clean.join(raw, "id", "inner")


def with_dates(doc_topics: DataFrame, raw: DataFrame) -> DataFrame:
    """Dates onto the document table; documents without a post keep null."""
    return doc_topics.join(raw.select("id", "creation_date"), "id", "left")


def existing(total: DataFrame, faulty: DataFrame) -> DataFrame:
    """Ids that are not faulty; by key, never by position."""
    return total.join(faulty.select("id"), "id", "left_anti")


def union_of(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other)
    return first


def first_per_year(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """At most n posts of each year.

    ``row_number() <= n`` is pruned before the shuffle (window group limit), so
    a year that holds most rows sends n rows per task, not its whole content.
    """
    dated = df.withColumn("year", F.year("creation_date"))
    ranked = dated.withColumn("_rank", F.row_number().over(Window.partitionBy("year").orderBy(order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


# --- paragraphs, sentences, tokens ---------------------------------------

def paragraphs(pages: DataFrame, html: str = "body") -> DataFrame:
    """(id, para, text) of the paragraph-like blocks."""
    return unroll(pages, H.paragraphs(F.col(html)), "para", "text")


def sentences(paras: DataFrame) -> DataFrame:
    """(id, para, sent, text)."""
    return unroll(paras, T.sentences(F.col("text")), "sent", "text", ("id", "para"))


def sentence_tokens(sents: DataFrame) -> DataFrame:
    """(id, para, sent, pos, token)."""
    return unroll(sents, T.words(F.col("text")), "pos", "token", ("id", "para", "sent"))


def tokens(docs: DataFrame, text: str = "body") -> DataFrame:
    """(id, pos, token) of plain texts."""
    return unroll(docs, T.words(F.col(text)), "pos", "token")


def tag_tokens(toks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Add the Penn tag; a ``lexicon(token, tag)`` goes before the rules.

    The lexicon is matched in lower case and broadcast only if it is small.
    """
    if lexicon is None:
        return toks.withColumn("tag", T.pos_tag(F.col("token")))
    known = lexicon.groupBy(F.lower("token").alias("_low")).agg(F.min("tag").alias("_tag"))
    joined = toks.withColumn("_low", F.lower("token")).join(bounded(known), "_low", "left")
    return joined.withColumn("tag", F.coalesce("_tag", T.pos_tag(F.col("token")))).drop("_low", "_tag")


# --- tagged documents ----------------------------------------------------

def tagged_docs(pages: DataFrame, html: str = "body") -> DataFrame:
    """(id, doc): paragraphs of sentences of (token, tag), built inside the row."""
    def tagged(text):
        return F.transform(T.words(text), lambda t: F.struct(t.alias("token"), T.pos_tag(t).alias("tag")))

    doc = F.transform(H.paragraphs(F.col(html)), lambda p: F.transform(T.sentences(p), tagged))
    return pages.select("id", doc.alias("doc"))


def to_json(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.to_json("doc").alias("json"))


def parse_json(raw: DataFrame, text: str = "json") -> DataFrame:
    """(id, raw, doc, parse_ok): malformed input keeps its text, has no doc."""
    doc = F.from_json(F.col(text), TAGGED_TYPE, {"mode": "PERMISSIVE"})
    return raw.select("id", F.col(text).alias("raw"), doc.alias("doc")).withColumn("parse_ok", F.col("doc").isNotNull())


def parsed(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.filter("parse_ok").select("id", "doc")


def quarantine(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.filter(~F.col("parse_ok")).select("id", "raw")


def flatten(docs: DataFrame) -> DataFrame:
    """(id, para, sent, pos, token, tag) of tagged documents."""
    paras = unroll(docs, F.col("doc"), "para", "p")
    sents = unroll(paras, F.col("p"), "sent", "s", ("id", "para"))
    words = unroll(sents, F.col("s"), "pos", "w", ("id", "para", "sent"))
    return words.select("id", "para", "sent", "pos", "w.token", "w.tag")


def assemble(flat: DataFrame) -> DataFrame:
    """Rebuild tagged documents from the long form.

    Groups are bounded by one document, which is one row of the source.
    """
    def collect(df, keys, position, value, name):
        ordered = F.array_sort(F.collect_list(F.struct(position, value)))
        return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias(name))

    words = flat.withColumn("w", F.struct("token", "tag")).repartition("id")
    sents = collect(words, ["id", "para", "sent"], "pos", "w", "s")
    paras = collect(sents, ["id", "para"], "sent", "s", "p")
    return collect(paras, ["id"], "para", "p", "doc")


# --- normalised forms ----------------------------------------------------

def drop_punct(toks: DataFrame) -> DataFrame:
    return toks.filter(~T.is_punct(F.col("token")))


def drop_stopwords(toks: DataFrame, stop_words: Iterable[str] | DataFrame = STOP_WORDS) -> DataFrame:
    """A word list becomes a hash-set filter; a table becomes an anti join."""
    if isinstance(stop_words, DataFrame):
        listed = stop_words.select(F.lower("token").alias("_low")).distinct()
        return (toks.withColumn("_low", F.lower("token"))
                .join(bounded(listed), "_low", "left_anti").drop("_low"))
    return toks.filter(~T.is_stopword(F.col("token"), stop_words))


def drop_short(toks: DataFrame) -> DataFrame:
    return toks.filter(~T.is_short(F.col("token")))


def lemmas(tagged: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Add the lemma; ``table(token, class, lemma)`` goes before the rules."""
    rule = T.lemma(F.col("token"), F.col("tag"))
    if table is None:
        return tagged.withColumn("lemma", rule)
    known = table.groupBy("token", F.col("class").alias("_class")).agg(F.min("lemma").alias("_lemma"))
    joined = (tagged.withColumn("_class", T.word_class(F.col("tag")))
              .join(bounded(known), ["token", "_class"], "left"))
    return joined.withColumn("lemma", F.coalesce("_lemma", rule)).drop("_class", "_lemma")


def normalise(docs: DataFrame) -> DataFrame:
    """(id, tokens) of tagged documents: the full normaliser, inside the row."""
    return docs.select("id", T.normalise_tagged(F.flatten(F.flatten("doc"))).alias("tokens"))


def normalised_docs(docs: DataFrame, text: str = "body") -> DataFrame:
    """(id, tokens) of plain texts: tokenise, tag and normalise, no shuffle.

    The rules of ``T.normalise_array(T.words(text))``. A word's result hangs on the word
    alone, so a task works each distinct word out once instead of each occurrence.
    """
    stop_words = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                tokens = T.normal_words(part.column(1), stop_words, known)
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], ["id", "tokens"])

    return docs.select("id", text).mapInArrow(run, StructType([docs.schema["id"]]).add("tokens", ArrayType(StringType())))


def token_rows(docs: DataFrame) -> DataFrame:
    """(id, pos, token): the long form of (id, tokens)."""
    return unroll(docs, F.col("tokens"), "pos", "token")


def stem_tokens(docs: DataFrame, text: str = "body") -> DataFrame:
    """(id, pos, token, stem): lower, tokenise, drop punctuation, stem."""
    low = unroll(docs, T.words(F.lower(text)), "pos", "token")
    return low.filter(~T.is_ascii_punct(F.col("token"))).withColumn("stem", T.s_stem(F.col("token")))
