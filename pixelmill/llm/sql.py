"""Check SQL (DuckDB) of the operators that SQL can express: no candidate search, and no hash shorter than md5."""

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Statistics word by word; lines per host are counted over distinct texts.
LINE_FREQUENCY = rf"""
WITH d AS MATERIALIZED (
  SELECT *, coalesce('=' || doc_id, rid::VARCHAR) AS document FROM (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host FROM documents)
), w AS (SELECT rid, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM d),
g AS (
  SELECT rid, i, word,
         word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), r AS (SELECT rid, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS again FROM g),
c AS (SELECT rid, word, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cov FROM r),
s AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (cov) AS n_repeat_words
  FROM c GROUP BY rid
), raw AS (SELECT rid, document, host, unnest(string_split(t, chr(10))) AS t FROM d),
l AS (
  SELECT rid, document, host, t AS line, {_WORDS} AS ws,
         array_to_string(list_transform({_WORDS}, lambda x: {_lower('x')}), ' ') AS norm
  FROM raw WHERE len({_WORDS}) > 0
), dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
host_size AS (SELECT host, count(DISTINCT document) AS n_of FROM d GROUP BY host),
f AS (
  SELECT l.host, norm
  FROM l JOIN host_size h ON l.host = h.host
  GROUP BY l.host, norm, n_of
  HAVING count(DISTINCT document) > 10 AND (count(DISTINCT document) > 100 OR count(DISTINCT document) > 0.1 * n_of)
), lost AS (
  SELECT rid, sum(len(ws)) AS lost, count(*) AS n_lines
  FROM l JOIN f ON l.host = f.host AND l.norm = f.norm GROUP BY rid
), a AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines_removed,
         (coalesce(n_words, 0) - coalesce(lost, 0))::BIGINT AS n_words_left
  FROM d LEFT JOIN s USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_left >= n_words AS kept
FROM a
"""


def _numbered(table: str, key: str) -> str:
    """(rid, id, t) of all rows; to be materialised, so that a row keeps its number."""
    return f"SELECT row_number() OVER () AS rid, {key} AS id, {_lower("coalesce(text, '')")} AS t FROM {table}"


def _shingles(rows: str) -> str:
    """(rid, id, shingle) of distinct 5-word shingles; shorter texts are one."""
    return f"""
  SELECT DISTINCT rid, id, unnest(CASE WHEN len(ws) >= 5
           THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM (SELECT rid, id, {_WORDS} AS ws FROM {rows})"""


#: Pairs through common shingles of distinct sets, then labels passed along the links.
JACCARD_JOIN = f"""
WITH RECURSIVE d AS MATERIALIZED ({_numbered('documents', 'doc_id')}),
sh AS MATERIALIZED ({_shingles('d')}),
sets AS MATERIALIZED (
  SELECT rid, id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS s FROM sh GROUP BY rid, id
), one AS (SELECT s, min(rid) AS rid, min(n) AS n, min(id) AS first_id FROM sets GROUP BY s),
tok AS MATERIALIZED (SELECT s, shingle FROM one JOIN sh USING (rid)),
linked AS MATERIALIZED (
  SELECT p.s AS a, p.b FROM (
    SELECT x.s, y.s AS b, count(*) AS k FROM tok x JOIN tok y ON x.shingle = y.shingle AND x.s <> y.s GROUP BY x.s, y.s
  ) p JOIN one u ON u.s = p.s JOIN one v ON v.s = p.b WHERE 100 * k >= 75 * (u.n + v.n - k)
), reach AS (
  SELECT s AS a, s AS b FROM one
  UNION
  SELECT reach.a, linked.b FROM reach JOIN linked ON linked.a = reach.b
), comp AS (SELECT reach.a AS s, min(first_id) AS component_id FROM reach JOIN one ON one.s = reach.b GROUP BY reach.a),
of_row AS (SELECT rid, n, component_id FROM sets JOIN comp USING (s))
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN id ELSE component_id END AS component_id
FROM d LEFT JOIN of_row USING (rid)
"""

#: Every window of 35 words counted as it is.
REPEATED_PASSAGES = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM d),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS i,
         unnest(list_transform(range(1, len(ws) - 33), lambda k: sha256(array_to_string(ws[k:k + 34], ' ')))) AS h
  FROM (SELECT rid, {_WORDS} AS ws FROM d)
), twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (
  SELECT w.rid, w.i, word, max(CASE WHEN twice.i IS NULL THEN 0 ELSE 1 END) OVER (
           PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN twice ON twice.rid = w.rid AND twice.i = w.i
), s AS (
  SELECT rid, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
  FROM c GROUP BY rid
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
"""

#: Every pair of an item and a document that have a shingle in common; no signatures.
CONTAINMENT = f"""
WITH d AS MATERIALIZED ({_numbered('documents', 'doc_id')}), b AS MATERIALIZED ({_numbered('benchmark', 'item_id')}),
doc AS ({_shingles('d')}),
item AS MATERIALIZED ({_shingles('b')}),
size AS (SELECT rid, count(*) AS n FROM item GROUP BY rid),
pair AS (
  SELECT doc.rid, doc.id AS doc_id, item.rid AS item_row, item.id AS item_id, count(*) AS n_shared
  FROM doc JOIN item USING (shingle) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n::BIGINT AS n_item, n_shared::DOUBLE / n AS containment
FROM pair JOIN size ON size.rid = item_row WHERE 100 * n_shared >= 75 * n
"""

#: Every phrase counted as it is, and every candidate compared with every longer one.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS k)
  ) GROUP BY lang, phrase, k HAVING count(*) >= 100
), c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n, x.f AS l, y.f AS r, j, (1000 * c.a * n) // (x.f * y.f) AS score
  FROM c JOIN total USING (lang), (SELECT unnest(range(1, 5)) AS j), g x, g y
  WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:c.k], ' ')
), low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
apart AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = low.lang AND len(c.phrase) > len(low.phrase) AND 100 * c.a >= 100 * low.a
      AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM apart QUALIFY rank <= 2000
"""

_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""

#: Every prefix of every rebuilt conversation, and every node compared with all nodes below it.
PREFIX_TRIE = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS c, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
conv AS MATERIALIZED (
  SELECT size.c, size.c - size.c % 5 AS root, h, least(h, coalesce(base.n, 0)) AS shared
  FROM (SELECT c, n, xor({_CRC}, 4294967295::UBIGINT)::BIGINT % 9 AS h FROM size) size
  LEFT JOIN size base ON base.c = size.c - size.c % 5
), r AS (
  SELECT conv.c, t.p, role, text FROM conv JOIN t ON t.c = conv.root WHERE t.p <= h
  UNION ALL
  SELECT t.c, t.p - h + shared, role, text FROM conv JOIN t ON t.c = conv.c WHERE t.p > h
), seq AS (
  SELECT c, list(sha256(strlen(role)::VARCHAR || ':' || role || text) ORDER BY p) AS s, list(strlen(text) ORDER BY p) AS b FROM r GROUP BY c
), whole AS (SELECT conv.c, coalesce(s, []) AS s, coalesce(b, []) AS b FROM conv LEFT JOIN seq USING (c)),
path AS (
  SELECT c, d, len(s) = d AS is_end, array_to_string(s[1:d], '') AS k, array_to_string(s[1:d - 1], '') AS above, coalesce(b[d], 0) AS bytes
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM whole)
), node AS MATERIALIZED (
  SELECT k, d, min(above) AS above, min(c) AS c, count(*) AS n, min(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends
  FROM path GROUP BY k, d
), kids AS (SELECT above AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k, d)),
below AS (
  SELECT v.k, v.d, sum((u.n - 1) * u.bytes) AS saved, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM full_node v JOIN full_node u ON u.d >= v.d AND u.k[1:64 * v.d] = v.k GROUP BY v.k, v.d
)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, up.c AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_node x JOIN below USING (k, d) LEFT JOIN node up ON x.d > 0 AND up.k = x.above AND up.d = x.d - 1
"""
