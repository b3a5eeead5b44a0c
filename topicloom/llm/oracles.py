"""SQL equivalents of the operators' queries, where SQL can express them."""

from . import decontaminate as D
from . import filter_audit as A
from . import host_rules as H
from . import vector_codes as V
from . import warc_writer as W

_SPACE = r"\x20\x09-\x0D"

RULES = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^{_SPACE}]+') AS l FROM d),
g AS (SELECT doc_id, i, list_slice(l, i, i + {H.WINDOW - 1}) AS win FROM
    (SELECT doc_id, l, unnest(range(1, len(l) - {H.WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range({H.WINDOW})) AS k) GROUP BY doc_id),
dl AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM
    (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{_SPACE}]')
    GROUP BY doc_id, line) GROUP BY doc_id),
b AS (SELECT d.doc_id, host, len(l) AS n_words, length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rw.n, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, n_words < {H.MIN_WORDS} OR 100 * n_repeat_words > {H.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT host, count(*) AS host_docs, sum(base_failed::INT)::BIGINT AS host_failed FROM f GROUP BY host),
a AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed) / sum(host_docs)::DOUBLE AS p, count(*) AS hosts,
    sum(host_failed * host_failed / host_docs::DOUBLE) AS q FROM h),
v AS (SELECT p, q / n - p * p - p * (1 - p) * hosts / n AS spread FROM a),
s AS (SELECT p, CASE WHEN spread > 0 THEN least(greatest(p * (1 - p) / spread - 1, {H.MIN_STRENGTH}), {H.MAX_STRENGTH})
    ELSE {H.MAX_STRENGTH} END AS s FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (host_failed + p * s) / (host_docs + s) <= {H.MAX_HOST_RATE} AS kept, host_docs, host_failed
FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host, s"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS l FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS l FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, size, list_slice(l, k, k + size - 1) AS win FROM
    (SELECT item, l, least({D.ITEM_WINDOW}, len(l)) AS size, unnest(range(1, len(l) - least({D.ITEM_WINDOW}, len(l)) + 2)) AS k
    FROM i WHERE len(l) > 0)),
dw AS (SELECT doc_id, size, k, list_slice(l, k, k + size - 1) AS win FROM
    (SELECT doc_id, l, size, unnest(range(1, len(l) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw))),
m AS (SELECT doc_id, item, k, dw.size FROM dw JOIN iw USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {D.SHARE} * n_hit >= len(l), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS size,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages)
SELECT page_id, size AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN size >= {W.REVISIT_BYTES} AND latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= {W.REVISIT_BYTES} AND latest <> page_id THEN latest END AS refers_to FROM p"""

ORACLES: dict[str, str] = {"op2_host_rules": RULES, "op4_decontamination": CONTAMINATION, "op6_warc": ARCHIVES}


def _codes_round(step: int) -> str:
    """Assignment to codebook ``step`` (cc{step}) and, from it, codebook step + 1."""
    return f"""
d{step} AS (SELECT rid, p, j, sum((pc.v - cc.v) * (pc.v - cc.v)) AS d FROM pc JOIN cc{step} cc USING (p, i) GROUP BY rid, p, j),
a{step} AS (SELECT rid, p, j, d FROM (SELECT *, row_number() OVER (PARTITION BY rid, p ORDER BY d, j) AS r FROM d{step}) WHERE r = 1),
s{step} AS (SELECT a.p, a.j, pc.i, sum(pc.v) AS s, count(*) AS n FROM a{step} a JOIN pc USING (rid, p) GROUP BY a.p, a.j, pc.i),
cc{step + 1} AS (SELECT cc.p, cc.j, cc.i, coalesce(floor(s.s::DOUBLE / s.n)::BIGINT, cc.v) AS v
    FROM cc{step} cc LEFT JOIN s{step} s USING (p, j, i)),"""


CODES = f"""
WITH raw AS (SELECT vec_id, label, embedding AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {V.PARTS} = 0
    AND list_bool_and(list_transform(embedding, lambda y: y IS NOT NULL AND isfinite(y) AND abs(y) < {V.LIMIT}))),
ints AS (SELECT vec_id, label, list_transform(x, lambda y: floor(y::DOUBLE * {V.SCALE})::BIGINT) AS e FROM raw),
dim AS (SELECT len(e) AS d FROM ints ORDER BY vec_id NULLS LAST, e LIMIT 1),
v AS (SELECT row_number() OVER () AS rid, vec_id, label, e FROM ints, dim WHERE len(e) = dim.d),
parts AS (SELECT rid, p, list_slice(e, p * (len(e) // {V.PARTS}) + 1, (p + 1) * (len(e) // {V.PARTS})) AS x
    FROM v, range({V.PARTS}) t(p)),
pc AS (SELECT rid, p, i, x[i] AS v FROM (SELECT rid, p, x, unnest(range(1, len(x) + 1)) AS i FROM parts)),
seed AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS j, e FROM v) WHERE j < {V.ENTRIES}),
cc0 AS (SELECT p, j, i, c[i] AS v FROM (SELECT p, j, c, unnest(range(1, len(c) + 1)) AS i FROM
    (SELECT p, j, list_slice(e, p * (len(e) // {V.PARTS}) + 1, (p + 1) * (len(e) // {V.PARTS})) AS c
     FROM seed, range({V.PARTS}) t(p)))),{"".join(_codes_round(k) for k in range(V.ROUNDS))}
df AS (SELECT rid, p, j, sum((pc.v - cc.v) * (pc.v - cc.v)) AS d FROM pc JOIN cc{V.ROUNDS} cc USING (p, i) GROUP BY rid, p, j),
af AS (SELECT rid, p, j, d FROM (SELECT *, row_number() OVER (PARTITION BY rid, p ORDER BY d, j) AS r FROM df) WHERE r = 1),
r AS (SELECT rid, string_agg(lpad(lower(hex(j)), 2, '0'), '' ORDER BY p) AS code, sum(d) AS error FROM af GROUP BY rid),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, j, i)) AS codebooks_sha256 FROM cc{V.ROUNDS})
SELECT v.vec_id, r.code, r.error::BIGINT AS error, (sum(r.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
    h.codebooks_sha256 FROM v JOIN r USING (rid), h"""

ORACLES["op13_vector_codes"] = CODES

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^{_SPACE}]+') AS l FROM d),
lb AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, (len(l) < {A.MIN_WORDS})::INT AS fa, (100 * len(list_distinct(l)) < {A.DISTINCT_PERCENT} * len(l))::INT AS fb,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {A.UPPER_PERCENT} * length(t))::INT AS fc,
    regexp_matches(t, '{A.SYMBOLS}')::INT AS fd,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS fe,
    coalesce(lb.good, false)::INT AS good, coalesce(lb.toxic, false)::INT AS toxic FROM w LEFT JOIN lb USING (doc_id)),
mc AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM f GROUP BY ALL),
lt AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (SELECT p1.c || p2.c || p3.c || p4.c || p5.c AS filter_order FROM lt p1, lt p2, lt p3, lt p4, lt p5
    WHERE p1.b + p2.b + p3.b + p4.b + p5.b = 31),
st AS (SELECT filter_order, step, (SELECT b FROM lt WHERE c = substr(filter_order, step, 1)) AS bit,
    (SELECT coalesce(sum(b), 0) FROM lt WHERE contains(substr(filter_order, 1, step - 1), c))::INT AS prior
    FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & prior <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & prior = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM mc, st GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

ORACLES["op11_filter_audit"] = AUDIT
