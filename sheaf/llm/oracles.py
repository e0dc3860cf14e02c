"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

from sheaf.llm.url_filter import PATTERN_RULES, SITE_RULES, UrlRule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


_BLANKLESS = rf"regexp_extract_all({_lowered('text')}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANKLESS} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) END AS s FROM w),
  c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
  e AS (SELECT id, n, unnest(s) AS x FROM c),
  p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
  l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
  u AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
  r(id, root) AS (SELECT DISTINCT x, x FROM u UNION SELECT u.y, r.root FROM r JOIN u ON r.id = u.x WHERE r.root < u.y),
  m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(m.root, c.id, d.doc_id) AS component_id,
  coalesce(m.root, c.id, d.doc_id) = d.doc_id AS kept, coalesce(c.id, d.doc_id) AS class_id
FROM s d LEFT JOIN c ON d.s = c.s LEFT JOIN m ON c.id = m.id"""

SUFFIX_ARRAY = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  o AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1122) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS o FROM b)),
  w AS (SELECT doc_id, o + i AS i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT *, unnest(range(1, least(512, length(h) // 2 - 49) + 1)) AS i FROM o)),
  m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
  g AS (SELECT w.doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id),
  k AS (SELECT doc_id, i, i - lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS new FROM g),
  n AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM k),
  r AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM n GROUP BY doc_id, span),
  t AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
  x AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM t JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM b LEFT JOIN x USING (doc_id)"""

_BENCH = rf"regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_BENCH} AS w FROM documents),
  i AS (SELECT item_id, {_BENCH} AS w FROM benchmark),
  z AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
  iw AS (SELECT DISTINCT item_id, size, w[s:s+size-1] AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM z)),
  p AS (SELECT doc_id, size, pos, w[pos:pos+size-1] AS win FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM z))),
  h AS (SELECT p.doc_id, p.pos, p.size, iw.item_id FROM p JOIN iw ON p.size = iw.size AND p.win = iw.win),
  c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY doc_id),
  f AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""

_PROBE = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"replace(replace({c}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
  t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
  g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length('<|im_start|><|im_end|>') + 2 + length({_ESCAPED.format(c='role')}) + length({_ESCAPED.format(c='text')}))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _case(rules: tuple[UrlRule, ...], column: str) -> str:
    """The first rule in order of length and name whose pattern matches."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    value = {"rule": lambda r: r.name, "verdict": lambda r: r.verdict}[column]
    return "CASE " + " ".join(f"WHEN regexp_matches(site, '{r.pattern}') THEN '{value(r)}'" for r in ordered) + " END"


URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS place FROM pages),
  h AS (SELECT page_id, translate(split_part(place, '/', 1), '{_UPPER}', '{_LOWER}') AS host, substr(place, length(split_part(place, '/', 1)) + 1) AS path FROM u),
  s AS (SELECT *, host || path AS site FROM h),
  r AS (SELECT page_id, host, path, {_case(SITE_RULES, "rule")} AS rule, {_case(SITE_RULES, "verdict")} AS own,
      {_case(PATTERN_RULES, "rule")} AS pattern, {_case(PATTERN_RULES, "verdict")} AS other FROM s)
SELECT page_id, host, path, rule, coalesce(own, other, 'allow') AS verdict, coalesce(rule, pattern) AS matched_rule FROM r"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
  d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h,
      row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST, url) AS place, first(page_id) OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS lead FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN lead END AS refers_to
FROM d"""

_TERMS = rf"regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
  n AS (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
  c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
  v AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
  f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM v, c GROUP BY t, n_docs),
  m AS (SELECT r, doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM n, c),
  s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN v USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10"""

# the checksum bit by bit: a byte is put in, then eight steps shift it through
_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT))"""

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k, b) AS c FROM t GROUP BY conv_id),
  g AS (SELECT conv_id, c, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM o),
  r AS (SELECT g.conv_id, list_concat(coalesce(o.c[1:h], []), g.c[h+1:]) AS c FROM g LEFT JOIN o ON o.conv_id = g.base),
  p AS (SELECT conv_id, c, unnest(range(0, len(c) + 1)) AS depth FROM r),
  x AS (SELECT conv_id, depth, depth = len(c) AS ends, CASE WHEN depth > 0 THEN c[depth].b ELSE 0 END AS b,
      md5(array_to_string(list_transform(c[1:depth], lambda e: e.k || ':' || e.b), ',')) AS node,
      CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(c[1:depth-1], lambda e: e.k || ':' || e.b), ',')) END AS parent FROM p),
  n AS (SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY node, parent, depth),
  k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
  l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
  a AS (SELECT DISTINCT x.node AS top, y.node FROM x JOIN x y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
  s AS (SELECT a.top AS node, sum((l.n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum((l.n_convs - 1) * l.b)::BIGINT AS saved_tokens FROM a JOIN l USING (node) GROUP BY a.top)
SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
FROM l JOIN s USING (node) LEFT JOIN l u ON u.node = l.parent"""
