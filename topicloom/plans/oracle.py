"""The same queries as DuckDB SQL over the whole tables.

Each query names the common table expressions it builds on; ``sql`` puts the
needed ones in front, in order. Word lists come from the shared fixed values.
"""

from __future__ import annotations

from ..functions import html as H
from ..functions.wordlists import (
    ASCII_PUNCTUATION,
    BLOCK_TAGS,
    DETACHMENT,
    ENTITIES,
    KEYWORDS,
    LEMMA_EXCEPTIONS,
    NOT_PLURAL,
    SENTENCE_END,
    STOP_WORDS,
    TAG_LEXICON,
    TAG_SUFFIXES,
    TOKEN_PATTERN,
)
from ..operators.analysis import RELABEL
from ..operators.lemmas import CONSONANTS, DOUBLED, MORPHY
from .catalog import COUNT, DECAY, EPS, MIN_CORES, MIN_SAMPLES, SPLIT_YEAR, WIDE_EPS, WIDE_SAMPLES
from .corpora import CLUSTERS, MODELS, TOPICS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def ends(column: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {q(s)})" for s in suffixes) + ")"


# --- scalar rules --------------------------------------------------------

def tag(t: str) -> str:
    first = f"substring({t}, 1, 1)"
    cases = [f"WHEN lower({t}) IN {listed(words)} THEN {q(name)}" for name, words in TAG_LEXICON.items()]
    cases.append(
        f"WHEN regexp_matches({first}, '[^\\p{{L}}\\p{{N}}_]') THEN CASE WHEN {first} IN ('.', '!', '?') THEN '.' "
        f"WHEN {first} = ',' THEN ',' WHEN {first} IN (':', ';', '-') THEN ':' ELSE 'SYM' END")
    cases.append(f"WHEN regexp_matches({first}, '\\p{{N}}') THEN 'CD'")
    cases += [f"WHEN {ends(f'lower({t})', suffixes)} THEN {q(name)}" for suffixes, name in TAG_SUFFIXES]
    cases.append(f"WHEN {first} <> lower({first}) THEN 'NNP'")
    return "CASE " + " ".join(cases) + " ELSE 'NN' END"


def lemma(t: str, g: str) -> str:
    def detach(cls: str) -> str:
        cases = [f"WHEN {t} = {q(a)} THEN {q(b)}" for a, b in LEMMA_EXCEPTIONS[cls].items()]
        if cls in "nv":
            cases.append(f"WHEN {ends(t, NOT_PLURAL)} THEN {t}")
        for suffix, ending in DETACHMENT[cls]:
            size = len(suffix)
            cases.append(f"WHEN ends_with({t}, {q(suffix)}) AND length({t}) > {size + 1} "
                         f"THEN substring({t}, 1, length({t}) - {size}) || {q(ending)}")
        return "CASE " + " ".join(cases) + f" ELSE {t} END"

    head = f"substring({g}, 1, 1)"
    return (f"CASE WHEN {t} <> lower({t}) THEN {t} WHEN {head} = 'V' THEN {detach('v')} "
            f"WHEN {head} = 'J' THEN {detach('a')} WHEN {head} = 'R' THEN {detach('r')} ELSE {detach('n')} END")


def morphy(low: str, cls: str) -> str:
    """The candidates of :mod:`..operators.lemmas` as a DuckDB list."""
    made = []
    for c, rules in MORPHY.items():
        for suffix, ending in rules:
            made.append(f"CASE WHEN {cls} = {q(c)} AND ends_with({low}, {q(suffix)}) AND length({low}) > {len(suffix)} "
                        f"THEN substring({low}, 1, length({low}) - {len(suffix)}) || {q(ending)} END")
    for c, suffixes in DOUBLED.items():
        for suffix in suffixes:
            stem = f"substring({low}, 1, length({low}) - {len(suffix)})"
            made.append(f"CASE WHEN {cls} = {q(c)} AND ends_with({low}, {q(suffix)}) AND length({stem}) >= 3 "
                        f"AND substring({stem}, -1, 1) = substring({stem}, -2, 1) AND contains({q(CONSONANTS)}, substring({stem}, -1, 1)) "
                        f"THEN substring({stem}, 1, length({stem}) - 1) END")
    return "[" + ", ".join(made) + "]"


def irregular(low: str, cls: str) -> str:
    parts = [f"WHEN {cls} = {q(c)} THEN CASE {low} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in table.items()) + " END"
             for c, table in LEMMA_EXCEPTIONS.items() if table]
    return "CASE " + " ".join(parts) + " END"


def plain(c: str) -> str:
    out = f"regexp_replace({c}, {q(H.ANY_TAG)}, '', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def code(c: str) -> str:
    return (f"regexp_replace(regexp_replace({c}, '(?s)<pre.*?</code></pre>', '<p>CodE</p>', 'g'), "
            "'(?s)<code>.*?</code>', 'CodE', 'g')")


def links(c: str, strict: bool = False) -> str:
    pattern = r"(?s)<a\b.*?</a>" if strict else "(?s)<a.*?</a>"
    return f"regexp_replace({c}, {q(pattern)}, 'LinK', 'g')"


def logs(c: str) -> str:
    return f"regexp_replace({c}, '(?s)<pre>.*?</pre>', '<p>LoG</p>', 'g')"


def clean(title: str, body: str) -> str:
    return f"'<h1>' || {title} || '</h1>' || chr(10) || {logs(links(code(body)))}"


def blocks(c: str) -> str:
    names = "|".join(BLOCK_TAGS)
    marked = f"replace(replace({c}, chr(1), ''), chr(2), '')"
    marked = rf"regexp_replace({marked}, '(?i)<(?:{names})(?:\s[^>]*)?>', chr(1), 'g')"
    marked = rf"regexp_replace({marked}, '(?i)</(?:{names})\s*>', chr(2), 'g')"
    for _ in range(2):  # text between two closing tags is still in the outer block
        marked = rf"regexp_replace({marked}, '\x02([^\x01\x02]+)\x02', chr(2) || chr(1) || '\1' || chr(2), 'g')"
    return rf"regexp_extract_all({marked}, '\x01([^\x01\x02]*)', 1)"


def year_range(a: int, b: int) -> str:
    return f"creation_date >= DATE '{a}-01-01' AND creation_date < DATE '{b + 1}-01-01'"


KEEP = (r"length(token) <> 1 AND NOT regexp_matches(token, '^\p{P}*$') "
        f"AND lower(token) NOT IN {listed(STOP_WORDS)}")

# --- common table expressions: name -> SQL, in dependency order ----------

CTE: dict[str, str] = {}

CTE["posts"] = """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, lang, source,
    DATE '2012-01-01' + CAST((doc_id * 37) % 3653 AS INTEGER) AS creation_date FROM documents"""
CTE["html_posts"] = """SELECT page_id AS id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    html AS body, DATE '2012-01-01' + CAST((page_id * 37) % 3653 AS INTEGER) AS creation_date FROM pages"""
CTE["en"] = "SELECT * FROM posts"  # the corpus: all posts


def words_of(source: str, text: str = "body") -> str:
    return (f"SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM "
            f"(SELECT id, regexp_extract_all({text}, {q(TOKEN_PATTERN)}) AS l FROM {source})")


CTE["all_tokens"] = words_of("posts")
CTE["en_tokens"] = words_of("en")


def tagged(source: str, made: str) -> None:
    """Paragraphs, sentences and tagged tokens of the pages of ``source``."""
    CTE[f"{made}paras"] = f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS para, text FROM (
    SELECT id, k, {trim(plain('block'))} AS text FROM (
    SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS block FROM (SELECT id, {blocks('body')} AS l FROM {source})))
    WHERE text <> ''"""
    CTE[f"{made}sents"] = rf"""SELECT id, para, row_number() OVER (PARTITION BY id, para ORDER BY k) - 1 AS sent, text FROM (
    SELECT id, para, k, {trim('s')} AS text FROM (
    SELECT id, para, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM
    (SELECT id, para, string_split(regexp_replace(replace(text, chr(3), ''), {q(SENTENCE_END)}, '\1' || chr(3) || '\2', 'g'), chr(3)) AS l FROM {made}paras))) WHERE text <> ''"""
    CTE[f"{made}flat"] = f"""SELECT id, para, sent, pos, token, {tag('token')} AS tag FROM (
    SELECT id, para, sent, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM
    (SELECT id, para, sent, regexp_extract_all(text, {q(TOKEN_PATTERN)}) AS l FROM {made}sents))"""


def main_of(source: str) -> str:
    """(id, content): main content of the pages of ``source``, null if none."""
    return f"""SELECT h.id, k.content FROM {source} h LEFT JOIN (
        SELECT id, string_agg('<p>' || {trim('block')} || '</p>', chr(10) ORDER BY k) AS content FROM (
        SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS block FROM
        (SELECT id, {blocks(f"regexp_replace(body, {q(H.BOILERPLATE)}, '', 'g')")} AS l FROM {source}))
        WHERE length({plain('block')}) >= 25 AND length({plain(f"array_to_string(regexp_extract_all(block, {q(H.ANCHOR)}, 1), '')")})
        < length({plain('block')}) * 0.5 GROUP BY id) k USING (id)"""


tagged("html_posts", "")
CTE["web_cleaned"] = f"SELECT id, {clean('title', 'body')} AS body FROM html_posts"
CTE["web_main"] = f"SELECT id, coalesce(content, '') AS body FROM ({main_of('web_cleaned')})"
tagged("web_main", "web_")
CTE["web_norm"] = f"""SELECT id, para, sent, pos, lower({lemma('token', 'tag')}) AS token FROM
    (SELECT id, para, sent, pos, token, tag FROM web_flat WHERE {KEEP})"""
CTE["kept"] = f"SELECT id, pos, token, {tag('token')} AS tag FROM en_tokens WHERE {KEEP}"
CTE["norm"] = f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, token FROM
    (SELECT id, pos, lower({lemma('token', 'tag')}) AS token FROM kept) WHERE length(token) > 1"""
CTE["dict"] = "SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM norm GROUP BY token"
CTE["terms"] = """SELECT row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id, token, df, cf FROM
    (SELECT * FROM dict WHERE df >= 20 AND df <= 0.5 * (SELECT count(*) FROM en) ORDER BY df DESC, token LIMIT 100000)"""
CTE["bow"] = "SELECT id, term_id, count(*) AS n FROM norm JOIN terms USING (token) GROUP BY id, term_id"
CTE["raw_tfidf"] = """SELECT id, term_id, n * log2((SELECT count(*) FROM en)::DOUBLE / df) AS r
    FROM bow JOIN terms USING (term_id)"""
CTE["tfidf"] = "SELECT id, term_id, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw_tfidf WHERE r > 1e-12"
CTE["len"] = "SELECT id, sum(n)::BIGINT AS n FROM bow GROUP BY id"
CTE["theta"] = f"""SELECT id, t.topic_id, (1 + coalesce(sum(CASE WHEN term_id % {TOPICS} = t.topic_id THEN n END), 0))::DOUBLE
    / ({TOPICS} + sum(n)) AS p FROM bow, (SELECT unnest(range({TOPICS})) AS topic_id) t GROUP BY id, t.topic_id"""
CTE["tt"] = f"""SELECT topic_id, term_id, n / sum(n) OVER (PARTITION BY topic_id) AS w FROM
    (SELECT id % {TOPICS} AS topic_id, term_id, sum(n)::DOUBLE AS n FROM bow GROUP BY ALL)"""
CTE["ett"] = f"""SELECT topic, term_id, n / sum(n) OVER (PARTITION BY topic) AS w FROM
    (SELECT (id // {TOPICS}) % {MODELS} * {TOPICS} + id % {TOPICS} AS topic, term_id, sum(n)::DOUBLE AS n FROM bow GROUP BY ALL)"""
CTE["clusters"] = f"SELECT id, id % {CLUSTERS} AS cluster FROM en"
CTE["csize"] = "SELECT cluster, count(*) AS size FROM clusters GROUP BY cluster"
CTE["cent"] = """SELECT cluster, term_id, sum(w) / any_value(size) AS w FROM tfidf JOIN clusters USING (id)
    JOIN csize USING (cluster) GROUP BY cluster, term_id"""


def top(n: int) -> str:
    return (f"SELECT topic_id, rank, term_id, token, w FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY topic_id ORDER BY round(w, 12) DESC, term_id) AS rank FROM tt) JOIN terms USING (term_id) WHERE rank <= {n}")


CTE["top10"] = top(10)
CTE["top25"] = top(25)
CTE["dominant"] = """SELECT en.id, d.topic_id, round(d.p, 4) AS share FROM en LEFT JOIN (SELECT id, topic_id, p FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, topic_id) AS k FROM theta) WHERE k = 1) d
    ON en.id = d.id"""
CTE["keywords"] = "SELECT topic_id, string_agg(token, ', ' ORDER BY rank) AS keywords FROM top10 GROUP BY topic_id"
CTE["status"] = "SELECT id, year(creation_date) AS year, id % 50 <> 0 AS parse_ok FROM posts"
CTE["share"] = """SELECT topic_id, m / sum(m) OVER () AS share FROM
    (SELECT topic_id, sum(p * n) AS m FROM theta JOIN len USING (id) GROUP BY topic_id)"""

# phrases: counts, scores and greedy merge of a token stream


def merging(source: str, made: str) -> None:
    x = made
    CTE[f"{x}_pairs"] = f"SELECT id, pos, token AS a, lead(token) OVER (PARTITION BY id ORDER BY pos) AS b FROM {source}"
    CTE[f"{x}_one"] = f"SELECT token, count(*) AS n FROM {source} GROUP BY token"
    CTE[f"{x}_two"] = f"SELECT a, b, count(*) AS n FROM {x}_pairs WHERE b IS NOT NULL GROUP BY a, b"
    CTE[f"{x}_scored"] = f"""SELECT t.a, t.b, t.n AS n_ab, u.n AS n_a, v.n AS n_b, (t.n - 20)::DOUBLE *
        ((SELECT count(*) FROM {x}_one) + (SELECT count(*) FROM {x}_two)) / u.n / v.n AS score
        FROM {x}_two t JOIN {x}_one u ON t.a = u.token JOIN {x}_one v ON t.b = v.token"""
    CTE[f"{x}_phrases"] = f"SELECT * FROM {x}_scored WHERE score > 1"
    CTE[f"{x}_hits"] = f"""SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run
        FROM {x}_pairs SEMI JOIN {x}_phrases USING (a, b)"""
    CTE[f"{x}_starts"] = f"""SELECT id, pos FROM (SELECT id, pos, row_number() OVER (PARTITION BY id, run ORDER BY pos) AS k
        FROM {x}_hits) WHERE k % 2 = 1"""
    CTE[x] = f"""SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY p.pos) - 1 AS pos,
        CASE WHEN s.pos IS NULL THEN p.a ELSE p.a || '_' || p.b END AS token FROM {x}_pairs p
        LEFT JOIN {x}_starts s ON p.id = s.id AND p.pos = s.pos
        LEFT JOIN {x}_starts r ON p.id = r.id AND p.pos = r.pos + 1 WHERE r.pos IS NULL"""


merging("norm", "bi")
merging("bi", "tri")

# ensemble

CTE["cum"] = """SELECT *, sum(w) OVER (PARTITION BY topic ORDER BY w DESC, term_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ett"""
CTE["masked"] = """SELECT topic, term_id, w FROM (SELECT *, coalesce(min(w) FILTER (c < 0.95) OVER (PARTITION BY topic),
    max(w) OVER (PARTITION BY topic)) AS least FROM cum) WHERE w >= least"""
CTE["dist"] = f"""SELECT g.a, g.b, CASE WHEN g.a = g.b THEN 0 WHEN coalesce(s.mass, 0) <= 0.05 THEN 1
    ELSE 1 - s.dot / sqrt(s.aa * s.bb) END AS dist FROM
    (SELECT x.r AS a, y.r AS b FROM range({COUNT}) x(r), range({COUNT}) y(r)) g LEFT JOIN
    (SELECT m.topic AS a, e.topic AS b, sum(m.w * e.w) AS dot, sum(e.w * e.w) AS bb, sum(e.w) AS mass, any_value(q.aa) AS aa
     FROM masked m JOIN ett e USING (term_id) JOIN (SELECT topic, sum(w * w) AS aa FROM masked GROUP BY topic) q
     ON q.topic = m.topic GROUP BY m.topic, e.topic) s ON g.a = s.a AND g.b = s.b"""


def clustering(x: str, eps: float, samples: int) -> None:
    CTE[f"{x}_near"] = f"SELECT a, b FROM dist WHERE a <> b AND dist < {eps}"
    CTE[f"{x}_cores"] = f"""SELECT a AS topic, count(*) FILTER (a <> b AND dist < {eps}) AS n_neighbours,
        count(*) FILTER (a <> b AND dist < {eps}) >= {samples} AS is_core FROM dist GROUP BY a"""
    CTE[f"{x}_edges"] = f"""SELECT p.a AS parent, p.b AS child, count(c.b) AS close FROM {x}_near p
        JOIN {x}_cores k ON k.topic = p.a AND k.is_core JOIN {x}_cores l ON l.topic = p.b AND l.is_core
        JOIN (SELECT a, b AS x FROM {x}_near UNION SELECT DISTINCT topic, topic FROM {x}_cores) h ON h.a = p.a
        LEFT JOIN {x}_near c ON c.a = p.b AND c.b = h.x GROUP BY p.a, p.b, k.n_neighbours
        HAVING count(c.b)::DOUBLE / (k.n_neighbours + 1) >= 0.25"""
    CTE[f"{x}_reach"] = f"""SELECT topic AS x, topic AS y FROM {x}_cores WHERE is_core UNION
        SELECT r.x, e.y FROM {x}_reach r JOIN (SELECT parent AS x, child AS y FROM {x}_edges UNION
        SELECT child, parent FROM {x}_edges) e ON r.y = e.x"""
    CTE[f"{x}_named"] = f"SELECT x AS topic, min(y) AS label FROM {x}_reach GROUP BY x"
    CTE[f"{x}_clusters"] = f"""SELECT c.topic, c.is_core, coalesce(n.label, l.label, -1) AS label FROM {x}_cores c
        LEFT JOIN {x}_named n USING (topic) LEFT JOIN (SELECT b AS topic, label FROM (SELECT d.b, n.label, row_number()
        OVER (PARTITION BY d.b ORDER BY d.dist, d.a, n.label) AS k FROM dist d JOIN {x}_named n ON d.a = n.topic
        WHERE d.a <> d.b AND d.dist < {eps}) WHERE k = 1) l USING (topic)"""


clustering("one", EPS, MIN_SAMPLES)
clustering("wide", WIDE_EPS, WIDE_SAMPLES)

CTE["labelled"] = f"""SELECT c.topic, c.is_core, c.topic % {TOPICS} AS label, coalesce(l.labels, []) AS labels FROM one_cores c
    LEFT JOIN (SELECT n.b AS topic, list_sort(list_distinct(list(n.a % {TOPICS}))) AS labels FROM one_near n
    JOIN one_cores k ON k.topic = n.a AND k.is_core GROUP BY n.b) l USING (topic)"""
CTE["summary"] = """SELECT label, count(*) AS num_cores, max(len(labels)) AS max_labels FROM labelled WHERE is_core GROUP BY label"""
CTE["v0"] = f"""SELECT label, num_cores, row_number() OVER (ORDER BY max_labels, num_cores, label) AS k,
    num_cores < {MIN_CORES} AS gone FROM summary"""
for step in range(1, TOPICS + 1):  # one cluster per step, in visiting order
    before = f"v{step - 1}"
    CTE[f"lone{step}"] = f"""SELECT t.label, count(*) AS lone FROM labelled t, (SELECT coalesce(list(label), []) AS g FROM {before}
        WHERE gone) WHERE t.is_core AND list_filter(t.labels, lambda x: NOT list_contains(g, x)) = [t.label] GROUP BY t.label"""
    CTE[f"v{step}"] = f"""SELECT v.label, v.num_cores, v.k, v.gone OR (v.k = {step} AND coalesce(l.lone, 0) < {MIN_CORES}) AS gone
        FROM {before} v LEFT JOIN lone{step} l USING (label)"""
CTE["gone_list"] = f"SELECT coalesce(list(label), []) AS g FROM v{TOPICS} WHERE gone"
CTE["vcores"] = """SELECT topic, label FROM labelled, gone_list WHERE is_core
    AND list_filter(labels, lambda x: NOT list_contains(g, x)) = [label]"""

# merge tree over the fixed clusters

CTE["leaf"] = "SELECT cluster, term_id, sum(w) AS s FROM tfidf JOIN clusters USING (id) GROUP BY cluster, term_id"
CTE["n0"] = "SELECT cluster AS c, count(DISTINCT id)::BIGINT AS n FROM tfidf JOIN clusters USING (id) GROUP BY cluster"
CTE["g0"] = "SELECT x.cluster AS a, y.cluster AS b, sum(x.s * y.s) AS v FROM leaf x JOIN leaf y USING (term_id) GROUP BY ALL"
for step in range(1, CLUSTERS):
    i, fresh = step - 1, CLUSTERS + step - 1
    CTE[f"m{step}"] = f"""SELECT g.a, g.b, round(1 - g.v / (x.n * y.n), 12) AS distance, x.n + y.n AS size FROM g{i} g
        JOIN n{i} x ON g.a = x.c JOIN n{i} y ON g.b = y.c WHERE g.a < g.b ORDER BY 3, 1, 2 LIMIT 1"""

    def renamed(c: str, step=step, fresh=fresh) -> str:
        return f"CASE WHEN {c} IN (SELECT a FROM m{step} UNION ALL SELECT b FROM m{step}) THEN {fresh} ELSE {c} END"

    CTE[f"g{step}"] = f"SELECT a, b, sum(v) AS v FROM (SELECT {renamed('a')} AS a, {renamed('b')} AS b, v FROM g{i}) GROUP BY a, b"
    CTE[f"n{step}"] = f"SELECT c, sum(n)::BIGINT AS n FROM (SELECT {renamed('c')} AS c, n FROM n{i}) GROUP BY c"

# expectation-maximisation with fixed topics, unrolled

CTE["t0"] = f"SELECT DISTINCT id, t.topic_id, 1.0 / {TOPICS} AS p FROM bow, (SELECT unnest(range({TOPICS})) AS topic_id) t"
for step in (1, 2):
    CTE[f"q{step}"] = f"""SELECT b.id, b.term_id, b.n, sum(t.p * tt.w) AS mixed FROM bow b JOIN tt USING (term_id)
        JOIN t{step - 1} t ON t.id = b.id AND t.topic_id = tt.topic_id GROUP BY ALL"""
    CTE[f"t{step}"] = f"""SELECT t.id, t.topic_id, coalesce(sum(c.n * t.p * tt.w / c.mixed), 0) / any_value(l.n) AS p FROM t{step - 1} t
        JOIN len l ON l.id = t.id LEFT JOIN tt ON tt.topic_id = t.topic_id
        LEFT JOIN q{step} c ON c.id = t.id AND c.term_id = tt.term_id GROUP BY t.id, t.topic_id"""

# windows of 110 tokens for the coherence measure

CTE["win"] = """SELECT DISTINCT n.id, n.token, unnest(range(greatest(n.pos - 109, 0), least(n.pos, l.starts - 1) + 1)) AS spot
    FROM norm n JOIN (SELECT id, greatest(count(*) - 110, 0) + 1 AS starts FROM norm GROUP BY id) l USING (id)
    WHERE n.token IN (SELECT token FROM top10)"""
CTE["wpair"] = "SELECT x.token AS a, y.token AS b, count(*) AS n FROM win x JOIN win y USING (id, spot) GROUP BY ALL"
CTE["wtotal"] = """SELECT sum(s)::DOUBLE + (SELECT count(*) FROM en WHERE id NOT IN (SELECT id FROM norm)) AS t FROM
    (SELECT greatest(count(*) - 110, 0) + 1 AS s FROM norm GROUP BY id)"""
CTE["npmi"] = """SELECT x.topic_id, x.token AS a, y.token AS b,
    ln((coalesce(p.n, 0) / t + 1e-12) / ((pa.n / t) * (pb.n / t))) / -ln(coalesce(p.n, 0) / t + 1e-12) AS v
    FROM top10 x JOIN top10 y USING (topic_id) JOIN wpair pa ON pa.a = x.token AND pa.b = x.token
    JOIN wpair pb ON pb.a = y.token AND pb.b = y.token LEFT JOIN wpair p ON p.a = x.token AND p.b = y.token, wtotal"""
CTE["npmi_sum"] = "SELECT topic_id, b, sum(v) AS s FROM npmi GROUP BY topic_id, b"

_RECURSIVE = {"one_reach", "wide_reach"}
_ONCE = {"norm", "terms", "bow", "tfidf", "dist", "win", "leaf"} | {f"m{i}" for i in range(1, CLUSTERS)}


def _uses(body: str) -> set[str]:
    import re

    return set(re.findall(r"[a-z_0-9]+", body)) & CTE.keys()


def sql(body: str) -> str:
    """``body`` behind the table expressions it needs."""
    needed, open_ = set(), _uses(body)
    while open_:
        name = open_.pop()
        needed.add(name)
        open_ |= (_uses(CTE[name]) & _DEPENDS[name]) - needed
    parts = [f"{name} AS {'MATERIALIZED ' if name in _ONCE else ''}({CTE[name]})" for name in CTE if name in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


# a name in a body is a table only if it was defined before
_DEPENDS: dict[str, set[str]] = {}
for _position, _name in enumerate(CTE):
    _DEPENDS[_name] = set(list(CTE)[:_position])


def halves(keep: str) -> str:
    return f"""SELECT x.term_id AS i, y.term_id AS j, x.w * y.w AS v, year(p.creation_date) <= {SPLIT_YEAR} AS old
    FROM tfidf x JOIN tfidf y ON x.id = y.id AND x.term_id <= y.term_id JOIN posts p ON p.id = x.id{keep}"""


COSTS = """SELECT t.id, t.cluster, sum(t.w * c.w) AS dot, sqrt(sum(t.w * t.w)) AS dn FROM
    (SELECT * FROM tfidf JOIN clusters USING (id)) t JOIN cent c ON c.cluster = t.cluster AND c.term_id = t.term_id GROUP BY ALL"""

def _lloyd(step: int) -> str:
    """Assignment to centroids c{step} (most similar, ties to the lower number) and the centroids that follow."""
    return f"""a{step} AS (SELECT id, cluster, sim FROM (SELECT i.id, k.cluster, round(coalesce(d.dot, 0), 12) AS sim,
    row_number() OVER (PARTITION BY i.id ORDER BY round(coalesce(d.dot, 0), 12) DESC, k.cluster) AS r
    FROM (SELECT DISTINCT id FROM u) i CROSS JOIN (SELECT DISTINCT cluster FROM c{step}) k LEFT JOIN
    (SELECT u.id, c.cluster, sum(u.x * c.c) AS dot FROM u JOIN c{step} c USING (term_id) GROUP BY ALL) d
    ON d.id = i.id AND d.cluster = k.cluster) WHERE r = 1),
s{step} AS (SELECT a.cluster, u.term_id, sum(u.x) AS s FROM a{step} a JOIN u USING (id) GROUP BY ALL),
c{step + 1} AS (SELECT cluster, term_id, s / sqrt(sum(s * s) OVER (PARTITION BY cluster)) AS c FROM s{step}
    UNION ALL SELECT * FROM c{step} WHERE cluster NOT IN (SELECT cluster FROM s{step}))"""


LLOYD = f"""SELECT * FROM (WITH u AS (SELECT id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM tfidf WHERE w <> 0),
c0 AS (SELECT s.cluster, u.term_id, u.x AS c FROM u JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS cluster
    FROM (SELECT DISTINCT id FROM u ORDER BY id LIMIT {CLUSTERS})) s USING (id)),
{", ".join(_lloyd(i) for i in range(4))}
SELECT id, cluster::INT AS cluster, round(sim, 6) AS similarity FROM a3)"""

BODIES: dict[str, str] = {
    "scan_posts": "SELECT id, title, lang, source, creation_date::VARCHAR AS creation_date, length(body) AS n_chars FROM posts",
    "scan_answers": "SELECT conv_id AS id, turn, text AS body FROM conversations WHERE role = 'assistant'",
    "newest_posts": """SELECT id, title, creation_date::VARCHAR AS creation_date FROM
        (SELECT * FROM posts ORDER BY creation_date DESC, id LIMIT 100)""",
    "incremental_ingest": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "append_table": "SELECT id, title, body FROM posts UNION ALL SELECT id, title, body FROM html_posts",
    "normalise_dates": "SELECT id, creation_date::VARCHAR AS creation_date FROM posts",
    "add_column": "SELECT id, lang, NULL::VARCHAR AS preprocessed_html FROM posts",
    "update_column": """SELECT p.id, p.lang, CASE WHEN l.doc_id IS NULL THEN p.title WHEN l.quality = 1 THEN 'good' END AS title
        FROM posts p LEFT JOIN labels l ON p.id = l.doc_id""",
    "read_like_page": """SELECT id, title FROM (SELECT id, title FROM posts WHERE title ILIKE '%THE%'
        ORDER BY id DESC LIMIT 50 OFFSET 20)""",
    "row_count": "SELECT count(*) AS n FROM posts",
    "batch_numbers": "SELECT id, r AS row_no, r // 50 AS batch FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM posts)",
    "roundtrip_csv": "SELECT id, title, source FROM posts",
    "keyword_filter": rf"""SELECT id, title FROM posts WHERE
        regexp_matches(body, '(?i)(^|[^\p{{L}}\p{{N}}_])({"|".join(KEYWORDS)})([^\p{{L}}\p{{N}}_]|$)')""",
    "year_filter": f"SELECT id, creation_date::VARCHAR AS creation_date FROM posts WHERE {year_range(2014, 2016)}",
    "h1_title": "SELECT id, '<h1>' || title || '</h1>' AS title FROM html_posts",
    "strip_code": f"SELECT id, {code('body')} AS body FROM html_posts",
    "strip_links": f"SELECT id, {links('body')} AS body FROM html_posts",
    "strip_links_strict": f"SELECT id, {links('body', True)} AS body FROM html_posts",
    "strip_logs": f"SELECT id, {logs('body')} AS body FROM html_posts",
    "clean_posts": f"SELECT id, {clean('title', 'body')} AS content FROM html_posts",
    "main_content": main_of("html_posts"),
    "paragraphs": "SELECT id, para, text FROM paras",
    "plain_text": f"SELECT id, {plain('body')} AS body FROM html_posts",
    "sentences": "SELECT id, para, sent, text FROM sents",
    "tokens": "SELECT id, pos, token FROM all_tokens",
    "pos_tags": f"SELECT id, pos, token, {tag('token')} AS tag FROM all_tokens",
    "nested_docs": """SELECT h.id, coalesce(n_paras, 0) AS n_paras, coalesce(n_sents, 0) AS n_sents, coalesce(n_tokens, 0) AS n_tokens
        FROM html_posts h LEFT JOIN (SELECT id, count(DISTINCT para) AS n_paras, count(DISTINCT (para, sent)) AS n_sents,
        count(*) AS n_tokens FROM flat GROUP BY id) USING (id)""",
    "assembled_docs": "SELECT id, string_agg(token || '/' || tag, ' ' ORDER BY para, sent, pos) AS text FROM flat GROUP BY id",
    "parse_quarantine": """SELECT h.id, h.id % 10 <> 0 AS parse_ok, CASE WHEN h.id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_tokens
        FROM html_posts h LEFT JOIN (SELECT id, count(*) AS n FROM flat GROUP BY id) USING (id)""",
    "html_tokens": """SELECT h.id, coalesce(t.tokens, '') AS tokens FROM html_posts h LEFT JOIN (SELECT id,
        string_agg(token, ' ' ORDER BY para, sent, pos) AS tokens FROM web_norm WHERE length(token) > 1 GROUP BY id) t USING (id)""",
    "flatten_docs": "SELECT id, para, sent, pos, token, tag FROM flat",
    "docs_semi_join": f"""SELECT id, length({clean('title', 'body')}) AS n_chars FROM posts
        WHERE id IN (SELECT id FROM posts WHERE {year_range(2015, 2015)})""",
    "clean_raw_join": f"""SELECT c.id, length({clean('c.title', 'c.body')}) AS n_chars, r.creation_date::VARCHAR AS creation_date
        FROM posts c JOIN posts r USING (id) WHERE r.{year_range(2012, 2013).replace('AND creation', 'AND r.creation')}""",
    "topic_dates": """SELECT d.id, d.topic_id, p.creation_date::VARCHAR AS creation_date FROM dominant d LEFT JOIN posts p USING (id)""",
    "existing_ids": "SELECT id, year FROM status WHERE id NOT IN (SELECT id FROM status WHERE NOT parse_ok)",
    "multi_year": f"""SELECT id, title, creation_date::VARCHAR AS creation_date FROM (SELECT id, title, creation_date FROM posts
        UNION ALL SELECT id, title, creation_date FROM html_posts) WHERE {year_range(2012, 2014)}""",
    "per_year_limit": """SELECT id, year FROM (SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY id) AS k
        FROM status) WHERE k <= 5""",
    "drop_punct": r"SELECT id, pos, token FROM all_tokens WHERE NOT regexp_matches(token, '^\p{P}*$')",
    "drop_stopwords": f"SELECT id, pos, token FROM all_tokens WHERE lower(token) NOT IN {listed(STOP_WORDS)}",
    "drop_short": "SELECT id, pos, token FROM all_tokens WHERE length(token) <> 1",
    "lemmas": f"""SELECT * FROM (WITH c AS (SELECT *, lower(token) AS low, CASE substring(tag, 1, 1) WHEN 'V' THEN 'v'
        WHEN 'R' THEN 'r' WHEN 'J' THEN 'a' ELSE 'n' END AS cls FROM (SELECT id, pos, token, {tag('token')} AS tag FROM all_tokens)),
        w AS (SELECT low, cls, count(*) AS n, count(*) FILTER (WHERE substring(tag, 1, 1) IN ('N', 'V', 'J', 'R')) AS n_open
            FROM c GROUP BY ALL),
        k AS (SELECT low, cls, unnest(list_distinct(list_filter({morphy('low', 'cls')}, lambda x: x IS NOT NULL))) AS cand FROM w),
        b AS (SELECT low, cls, cand FROM (SELECT k.low, k.cls, k.cand, row_number() OVER (PARTITION BY k.low, k.cls
            ORDER BY (e.cls = k.cls) DESC, e.n_open DESC, length(k.cand), k.cand) AS r FROM k JOIN w e ON e.low = k.cand
            WHERE e.n_open > 0) WHERE r = 1),
        t AS (SELECT w.low, w.cls, coalesce({irregular('w.low', 'w.cls')}, b.cand, w.low) AS lemma FROM w LEFT JOIN b USING (low, cls))
        SELECT c.id, c.pos, c.token, c.tag, CASE WHEN c.token <> c.low THEN c.token ELSE t.lemma END AS lemma
        FROM c JOIN t USING (low, cls))""",
    "normalise_docs": """SELECT en.id, coalesce(t.tokens, '') AS tokens FROM en LEFT JOIN
        (SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM norm GROUP BY id) t USING (id)""",
    "stem_tokens": f"""SELECT id, pos, token, CASE WHEN ends_with(token, 'ies') AND NOT {ends('token', ('eies', 'aies'))}
        THEN substring(token, 1, length(token) - 3) || 'y'
        WHEN ends_with(token, 'es') AND NOT {ends('token', ('aes', 'ees', 'oes'))} THEN substring(token, 1, length(token) - 1)
        WHEN ends_with(token, 's') AND NOT {ends('token', ('us', 'ss'))} THEN substring(token, 1, length(token) - 1)
        ELSE token END AS stem FROM ({words_of('en', 'lower(body)')})
        WHERE NOT contains({q(ASCII_PUNCTUATION)}, token)""",
    "frequent_terms": """SELECT year, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, token) AS rank
        FROM (SELECT year(creation_date) AS year, token, count(*) AS n FROM norm JOIN en USING (id) GROUP BY ALL)) WHERE rank <= 20""",
    "bigram_counts": "SELECT token AS a, '' AS b, n FROM bi_one UNION ALL SELECT a, b, n FROM bi_two",
    "phrase_scores": "SELECT a, b, n_ab, n_a, n_b, round(score, 6) AS score FROM bi_phrases",
    "apply_bigrams": """SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, token FROM bi
        WHERE contains(token, '_')""",
    "apply_trigrams": """SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, token FROM tri
        WHERE contains(token, '_')""",
    "ngram_docs": """SELECT en.id, coalesce(t.tokens, '') AS tokens FROM en LEFT JOIN (SELECT id, string_agg(token, ' ' ORDER BY part, pos)
        AS tokens FROM (SELECT id, 0 AS part, pos, token FROM norm UNION ALL SELECT id, 1, pos, token FROM bi
        WHERE contains(token, '_')) GROUP BY id) t USING (id)""",
    "dictionary": "SELECT token, df, cf FROM dict",
    "dictionary_pruned": "SELECT term_id, token, df, cf FROM terms",
    "dictionary_numbered": "SELECT row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id, token, df, cf FROM dict",
    "dictionary_update": "SELECT term_id, token, df, cf FROM terms",
    "bow": "SELECT id, term_id, n FROM bow",
    "bow_unbounded": "SELECT id, term_id, n FROM bow",
    "one_hot": "SELECT id, term_id, 1.0::DOUBLE AS w FROM bow",
    "tfidf": "SELECT id, term_id, round(w, 6) AS w FROM tfidf",
    "assign_nearest": f"""SELECT id, cluster, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
        distance, cluster) AS k FROM (SELECT t.id, c.cluster, round(1 - coalesce(s.dot, 0), 12) AS distance FROM
        (SELECT DISTINCT id FROM tfidf) t CROSS JOIN (SELECT id AS cid, row_number() OVER (ORDER BY id) - 1 AS cluster FROM
        (SELECT DISTINCT id FROM tfidf ORDER BY id LIMIT {CLUSTERS})) c LEFT JOIN (SELECT x.id, y.id AS cid, sum(x.w * y.w) AS dot
        FROM tfidf x JOIN tfidf y USING (term_id) WHERE y.id IN (SELECT DISTINCT id FROM tfidf ORDER BY id LIMIT {CLUSTERS})
        GROUP BY x.id, y.id) s ON s.id = t.id AND s.cid = c.cid)) WHERE k = 1""",
    "kmeans_lloyd_steps": LLOYD,
    "centroids": "SELECT cluster, term_id, round(w, 6) AS w FROM cent",
    "cluster_merges": " UNION ALL ".join(
        f"SELECT {s} AS step, a AS \"left\", b AS \"right\", round(distance, 6) AS distance, size FROM m{s}" for s in range(1, CLUSTERS)),
    "elbow_cost": f"""SELECT count(DISTINCT cluster) AS k, round(sum(1 - dot / (dn * cn)) / 2, 6) AS sse FROM ({COSTS})
        JOIN (SELECT cluster, sqrt(sum(w * w)) AS cn FROM cent GROUP BY cluster) USING (cluster)""",
    "cluster_words": """SELECT cluster, rank, token, round(weight, 6) AS weight FROM (SELECT cluster, token, w * 100 AS weight,
        row_number() OVER (PARTITION BY cluster ORDER BY round(w * 100, 9) DESC, token) AS rank FROM cent JOIN terms USING (term_id))
        WHERE rank <= 50""",
    "coherence_umass": """SELECT topic_id, round(avg(ln((coalesce(n, 0) + 1)::DOUBLE / df)), 6) AS coherence FROM
        (SELECT x.topic_id, x.term_id AS i, y.term_id AS j, t.df FROM top10 x JOIN top10 y USING (topic_id)
        JOIN terms t ON t.term_id = y.term_id WHERE x.rank <= 3 AND y.rank < x.rank) p LEFT JOIN
        (SELECT a.term_id AS i, b.term_id AS j, count(*) AS n FROM bow a JOIN bow b USING (id)
        WHERE a.term_id IN (SELECT term_id FROM top10 WHERE rank <= 3) AND b.term_id IN (SELECT term_id FROM top10 WHERE rank <= 3)
        GROUP BY ALL) c USING (i, j) GROUP BY topic_id""",
    "coherence_cv": """SELECT topic_id, round(avg(m), 6) AS coherence FROM (SELECT topic_id, a,
        sum(v * s) / sqrt(sum(v * v)) / sqrt(sum(s * s)) AS m FROM npmi JOIN npmi_sum USING (topic_id, b) GROUP BY topic_id, a)
        GROUP BY topic_id""",
    "lsa_gram_update": f"""SELECT i AS term_i, j AS term_j, round(sum(CASE WHEN old THEN v * {DECAY * DECAY} ELSE v END), 6) AS v
        FROM ({halves('')}) GROUP BY i, j""",
    "topic_terms": "SELECT topic_id, rank, token, round(w, 6) AS w FROM top25",
    "topic_relevance": """SELECT topic_id, rank, token, round(relevance, 6) AS relevance FROM (SELECT topic_id, term_id, relevance,
        row_number() OVER (PARTITION BY topic_id ORDER BY round(relevance, 9) DESC, term_id) AS rank FROM
        (SELECT topic_id, term_id, 0.6 * ln(w) + 0.4 * ln(w / sum(w * share) OVER (PARTITION BY term_id)) AS relevance
        FROM tt JOIN share USING (topic_id) WHERE w > 0)) JOIN terms USING (term_id) WHERE rank <= 30""",
    "topic_share": "SELECT topic_id, round(share, 6) AS share FROM share",
    "topic_js": """SELECT a, b, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM
        (SELECT x.k AS a, y.k AS b, t.term_id, coalesce(f.w, 0) AS p, coalesce(g.w, 0) AS q FROM
        (SELECT DISTINCT topic_id AS k FROM tt) x JOIN (SELECT DISTINCT topic_id AS k FROM tt) y ON x.k < y.k CROSS JOIN
        (SELECT DISTINCT term_id FROM tt) t LEFT JOIN tt f ON f.topic_id = x.k AND f.term_id = t.term_id
        LEFT JOIN tt g ON g.topic_id = y.k AND g.term_id = t.term_id) GROUP BY a, b""",
    "term_topic_share": """SELECT term_id, topic_id, round(w / sum(w) OVER (PARTITION BY term_id), 6) AS share FROM tt WHERE w > 0""",
    "mass_mask": "SELECT topic, term_id, round(w, 6) AS w FROM masked",
    "mask_summary": """SELECT count(*) AS topics, round(avg(n) * 100 / (SELECT count(*) FROM terms), 6) AS percent FROM
        (SELECT topic, count(*) AS n FROM masked GROUP BY topic)""",
    "rank_mask": """SELECT topic, term_id, round(w, 6) AS w FROM (SELECT *, coalesce(max(CASE WHEN k = floor((SELECT count(*) FROM terms)
        * 0.11) + 1 THEN w END) OVER (PARTITION BY topic), 0) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY topic
        ORDER BY w DESC, term_id) AS k FROM ett)) WHERE w > edge""",
    "topic_distance": "SELECT a, b, round(dist, 6) AS dist FROM dist",
    "distance_summary": "SELECT round(min(dist), 6) AS least, round(avg(dist), 6) AS mean, round(max(dist), 6) AS most FROM dist WHERE a <> b",
    "topic_cores": "SELECT topic, n_neighbours, is_core FROM one_cores",
    "topic_edges": "SELECT parent, child, close FROM one_edges",
    "topic_clusters": "SELECT topic, is_core, label FROM one_clusters",
    "cluster_summary": "SELECT label, num_cores, max_labels FROM summary",
    "valid_clusters": f"SELECT label, num_cores, NOT gone AS is_valid FROM v{TOPICS}",
    "stable_topics": """SELECT label, term_id, round(sum(w) / any_value(n), 6) AS w FROM ett JOIN vcores USING (topic)
        JOIN (SELECT label, count(*) AS n FROM vcores GROUP BY label) USING (label) GROUP BY label, term_id""",
    "recluster": "SELECT topic, is_core, label FROM wide_clusters",
    "add_models": "SELECT topic, term_id, round(w, 6) AS w FROM ett",
    "foldin_topics": "SELECT id, topic_id, round(p, 6) AS p FROM t2",
    "foldin_perplexity": """SELECT round(exp(-sum(n * ln(mixed)) / sum(n)), 6) AS perplexity FROM (SELECT b.id, b.term_id, b.n,
        sum(t.p * tt.w) AS mixed FROM bow b JOIN tt USING (term_id) JOIN t2 t ON t.id = b.id AND t.topic_id = tt.topic_id GROUP BY ALL)""",
    "dominant_topic": "SELECT id, topic_id, share FROM dominant",
    "topic_keywords": "SELECT topic_id, keywords FROM keywords",
    "document_topics": f"""SELECT d.id AS "Document_No", d.topic_id AS "Dominant_Topic", d.share AS "Topic_Perc_Contrib",
        k.keywords AS "Keywords", {plain('(' + clean('p.title', 'p.body') + ')')} AS "Text"
        FROM dominant d JOIN posts p USING (id) LEFT JOIN keywords k ON k.topic_id = d.topic_id""",
    "year_index": """SELECT year, count(*) AS total, count(*) FILTER (NOT parse_ok) AS faulty, count(*) FILTER (parse_ok) AS existing
        FROM status GROUP BY year""",
    "reconcile": """SELECT year, count(*) AS total, count(*) FILTER (NOT parse_ok) AS faulty, count(*) FILTER (parse_ok) AS existing,
        true AS agrees FROM status GROUP BY year""",
    "parse_errors": f"""SELECT year, docs, errors, words, round(errors / docs, 6) AS ratio, CASE WHEN upto > 0 THEN
        round(errors / upto, 4) END AS compat FROM (SELECT *, sum(words) OVER (ORDER BY year) AS upto FROM
        (SELECT year, count(*) AS docs, count(*) FILTER (NOT parse_ok) AS errors, coalesce(sum(CASE WHEN parse_ok THEN
        len(regexp_extract_all(body, {q(TOKEN_PATTERN)})) END), 0)::BIGINT AS words FROM status JOIN posts USING (id) GROUP BY year))""",
    "relabel_map": "SELECT id, coalesce(r.t, topic_id) AS topic_id FROM dominant LEFT JOIN (VALUES "
        + ", ".join(f"({a}, {b})" for a, b in RELABEL.items()) + ") r(f, t) ON topic_id = r.f",
    "relabel_freq": "SELECT topic_id, row_number() OVER (ORDER BY round(share, 12) DESC, topic_id) AS label FROM share",
    "post_calendar": """SELECT id, year(creation_date) AS year, month(creation_date) AS month,
        date_trunc('month', creation_date)::DATE::VARCHAR AS month_start FROM posts""",
    "post_trend": "SELECT date_trunc('month', creation_date)::DATE::VARCHAR AS period, count(*) AS n FROM posts GROUP BY ALL",
    "topic_trend": """SELECT period, topic_id, n, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM
        (SELECT date_trunc('year', creation_date)::DATE::VARCHAR AS period, topic_id, count(*)::DOUBLE AS n
        FROM dominant JOIN posts USING (id) WHERE topic_id IS NOT NULL GROUP BY ALL)""",
}


def oracles() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
