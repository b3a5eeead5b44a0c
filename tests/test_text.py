"""Micro-tables for the text rules that the synthetic data does not exercise."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import html as H
from topicloom.functions import text as T
from topicloom.operators import corpus as D


def apply(spark, rule, value):
    return spark.createDataFrame([(value,)], "x string").select(rule(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize("rule, given, want", [
    (H.h1_title, "How to log in", "<h1>How to log in</h1>"),
    (H.strip_code, 'x<pre class="l"><code>a\nb</code></pre>y<code>z</code>', "x<p>CodE</p>yCodE"),
    (H.strip_code, "<pre>log</pre> t <pre><code>c</code></pre>", "<p>CodE</p>"),
    (H.strip_links, 'see <a href="u">here</a>!', "see LinK!"),
    (H.strip_links, '<article>k<a href="q">y</a>', "LinK"),
    (lambda c: H.strip_links(c, strict=True), '<article>k<a href="q">y</a>', "<article>kLinK"),
    (H.strip_logs, "a<pre>log</pre>b", "a<p>LoG</p>b"),
    (H.strip_logs, 'a<pre class="q">log</pre>b', 'a<pre class="q">log</pre>b'),
    (H.plain_text, "<p>a &lt;b&gt; &amp;amp; c</p>", "a <b> &amp; c"),
    (H.paragraphs, "<h1>T</h1><p><b>A<br><p>B</p><ul><li><p>C</p></li></ul>", ["T", "A", "B", "C"]),
    (T.words, "can't use foo_bar, v2.0!", "can ' t use foo_bar , v2 . 0 !".split()),
    (T.words, "déjà vu", ["déjà", "vu"]),
    (T.sentences, "One. Two!  Three", ["One.", "Two!", "Three"]),
    (T.sentences, ".NET core v2.0 is out", [".NET core v2.0 is out"]),
    (T.sentences, "?!", ["?!"]),
    (H.plain_text, "1 < 2 and 3 > 2<br/>", "1 < 2 and 3 > 2"),
    (H.paragraphs, "<li>a<p>b</p>c tail</li>", ["a", "b", "c tail"]),
    (T.s_stem, "queries", "query"), (T.s_stem, "does", "doe"), (T.s_stem, "pages", "page"),
    (T.s_stem, "status", "status"), (T.s_stem, "cats", "cat"),
])
def test_rules(spark, rule, given, want):
    assert apply(spark, rule, given) == want


def test_code_goes_before_logs(spark):
    row = spark.createDataFrame([("T", "<pre>x</pre><p>y</p>")], "t string, b string")
    assert row.select(H.clean_post(F.col("t"), F.col("b")).alias("c")).head().c == "<h1>T</h1>\n<p>LoG</p><p>y</p>"


def test_main_content_drops_navigation_and_scripts(spark):
    page = ('<nav><ul><li><a href="/">home page of this whole site</a></li></ul></nav><script>var t="</p>";</script>'
            '<p>This paragraph is long enough to be kept.</p><p><a href="q">only a link text that is long too</a></p>')
    assert apply(spark, H.main_content, page) == "<p>This paragraph is long enough to be kept.</p>"
    assert apply(spark, H.main_content, "<p>short</p>") is None


@pytest.mark.parametrize("token, kept", [
    ("...", False), ("The", False), ("x", False), ("C++", True), ("$$", True), ("login", True), ("—", False)])
def test_keep_token(spark, token, kept):
    assert apply(spark, T.keep_token, token) is kept


@pytest.mark.parametrize("token, tag, lemma", [
    ("rocks", "NNS", "rock"), ("corpora", "NNS", "corpus"), ("better", "JJR", "good"), ("better", "RBR", "well"),
    ("queries", "NNS", "query"), ("status", "NN", "status"), ("walked", "VBD", "walk"), ("Rocks", "NNS", "Rocks"),
    ("matches", "NNS", "match"), ("is", "VBZ", "be")])
def test_lemma(spark, token, tag, lemma):
    df = spark.createDataFrame([(1, token, tag)], "id long, token string, tag string")
    assert D.lemmas(df).head().lemma == lemma


def test_given_lexicons_win(spark):
    toks = spark.createDataFrame([(1, 0, "Cache"), (1, 1, "mongooses")], "id long, pos int, token string")
    tags = D.tag_tokens(toks, spark.createDataFrame([("cache", "NN"), ("mongooses", "NNS")], "token string, tag string"))
    assert {r.token: r.tag for r in tags.collect()} == {"Cache": "NN", "mongooses": "NNS"}
    table = spark.createDataFrame([("mongooses", "n", "mongoose")], "token string, class string, lemma string")
    assert {r.token: r.lemma for r in D.lemmas(tags, table).collect()}["mongooses"] == "mongoose"
    stops = spark.createDataFrame([("CACHE",)], "token string")
    assert [r.token for r in D.drop_stopwords(toks, stops).collect()] == ["mongooses"]


def test_normalised_array_equals_the_long_form(spark):
    docs = spark.createDataFrame([(1, "The Rocks were Rolling, better queries; C++ x ... 42 corpora!"), (2, ""), (3, "a")],
                                 "id long, body string")
    array = {r.id: r.tokens for r in D.normalised_docs(docs).collect()}
    rows = D.lemmas(D.tag_tokens(D.drop_short(D.drop_stopwords(D.drop_punct(D.tokens(docs))))))
    long = {}
    for r in rows.orderBy("id", "pos").collect():
        if len(r.lemma) > 1:
            long.setdefault(r.id, []).append(r.lemma.lower())
    assert array == {1: long[1], 2: [], 3: []}


def test_tagged_document_round_trip(spark):
    pairs = "Every/DT old/JJ lamp/NN in/IN the/DT blue/JJ harbour/NN still/RB glows/VBZ".split()
    doc = [[[tuple(p.split("/")) for p in pairs]]]
    docs = spark.createDataFrame([(1, doc)], f"id long, doc {D.TAGGED_TYPE}")
    stored = D.to_json(docs)
    bad = stored.unionByName(spark.createDataFrame([(2, "[[[{'token")], "id long, json string"))
    parsed = D.parse_json(bad)
    assert [r.id for r in D.quarantine(parsed).collect()] == [2]
    flat = D.flatten(D.parsed(parsed))
    assert flat.count() == 9
    assert D.assemble(flat).head().doc == docs.head().doc


def test_lemmas_are_checked_against_the_dictionary(spark):
    from topicloom.operators import lemmas as LM

    words = ("using use use us caches cache databases database houses house stopped stop stop bigger big "
             "Running running run").split()
    tags = ["VBG", "VB", "NN", "PRP", "NNS", "NN", "NNS", "NN", "NNS", "NN", "VBD", "VB", "NN", "JJR", "JJ",
            "VBG", "VBG", "VB"]
    rows = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "pos int, token string, tag string")
    got = {r.token: r.lemma for r in LM.dictionary_lemmas(rows).collect()}
    assert got["using"] == "use" and got["caches"] == "cache" and got["databases"] == "database"
    assert got["houses"] == "house" and got["stopped"] == "stop" and got["bigger"] == "big"
    assert got["Running"] == "Running" and got["running"] == "run"
    alone = spark.createDataFrame([(0, "quizzes", "NNS")], "pos int, token string, tag string")
    assert LM.dictionary_lemmas(alone).first().lemma == "quizzes"  # no entry to confirm a candidate


def _parser_texts(page):
    """Element texts by the standard library's HTML parser, for comparison."""
    from html.parser import HTMLParser

    from topicloom.functions.blocktree import _plain
    from topicloom.functions.wordlists import BLOCK_TAGS

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.stack, self.done, self.n = [], [], 0

        def _close(self, at):
            name, order, start = self.stack.pop()
            self.done.append((order, page[start:at]))

        def _at(self):
            line, col = self.getpos()
            return sum(len(x) for x in page.splitlines(keepends=True)[:line - 1]) + col

        def handle_starttag(self, tag, attrs):
            if tag not in BLOCK_TAGS:
                return
            at = self._at()
            if self.stack and self.stack[-1][0] == "p":
                self._close(at)
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self._close(at)
            self.stack.append((tag, self.n, at + len(self.get_starttag_text())))
            self.n += 1

        def handle_endtag(self, tag):
            if tag in BLOCK_TAGS and any(n == tag for n, _, _ in self.stack):
                at = self._at()
                while self.stack[-1][0] != tag:
                    self._close(at)
                self._close(at)
    walk = Walk()
    walk.feed(page)
    walk.close()
    while walk.stack:
        walk._close(len(page))
    return [t for t in (_plain(x) for _, x in sorted(walk.done)) if t]


def test_block_tree_keeps_nested_text(spark):
    from topicloom.functions.blocktree import block_texts, element_texts

    pages = ["<li>a<p>b</p>middle<p>d</p>tail</li>", "<p>one<p>two<h2>head</h2></p> loose </p>",
             "<ul><li>x<li>y &amp; z</ul>", "<P class='a'>Up</P><p></p>", "", "no tags", "<p>open to the end",
             "<div><h1>T</h1><p>a <a href='u'>link</a> b</p></div>\n<li>last</li>"]
    want = [["abmiddledtail", "b", "d"], ["one", "two", "head"], ["x", "y & z"], ["Up"], [], [], ["open to the end"],
            ["T", "a link b", "last"]]
    assert [element_texts(p) for p in pages] == want
    assert [_parser_texts(p) for p in pages] == want
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages + [None])], "id int, body string") \
        .select("id", block_texts(F.col("body")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == want + [[]]


def test_normalised_docs_work_each_distinct_word_out_once(spark, monkeypatch):
    import pyarrow as pa

    seen, rule = [], T.normal_word
    monkeypatch.setattr(T, "normal_word", lambda token, stop: seen.append(token) or rule(token, stop))
    known = {}
    got = T.normal_words(pa.array(["Cats boxes, cats", None, "", "cats boxes"]), frozenset(), known)
    assert got.to_pylist() == [["cats", "box", "cat"], None, [], ["cat", "box"]]
    assert sorted(seen) == [",", "Cats", "boxes", "cats"]


def test_normalised_docs_follow_the_column_rule(spark):
    odd = ["The boxes were RUNNING; dashes, wolves & men!", "C++ $$ -- ...x can't foo_bar v2.0 d\u00e9j\u00e0 vu",
           "42nd 3 _ab __ analyses better best ladies is's bus", "a\u00a0b\u00a0\u00a0c \u2026\u2026 ..\u2028 \u0130stanbul \u039f\u0394\u039f\u03a3",
           "\u4e00\u4e8c \u00bd\u00bd \u20ac\u20ac x\u0301y ing ed es ss us ches s", "", None]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(None, "no id here")], "id long, body string")
    want = docs.select("id", T.normalise_array(T.words(F.col("body"))).alias("tokens")).collect()
    got = D.normalised_docs(docs).collect()
    assert {r.id: r.tokens for r in got} == {r.id: r.tokens for r in want} and len(got) == len(odd) + 1
