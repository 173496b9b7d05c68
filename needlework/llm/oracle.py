"""The queries that SQL can express, stated from scratch for an independent engine."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of code points up to U+00FF (the bits of every byte in turn)."""
    code = f"""flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
  WHEN unicode(ch) < 192 THEN [194, unicode(ch)] ELSE [195, unicode(ch) - 64] END))"""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: {bits}), 4294967295)"


PREFIX_TRIE = f"""WITH RECURSIVE turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
borrowed AS (SELECT *, ({crc32("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM turns),
rebuilt AS (SELECT a.conv_id, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] AS turns
  FROM borrowed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 5),
paths AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM paths GROUP BY ALL),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.node[1:n.depth] = n.node) AS n_children FROM nodes n),
own AS (SELECT *, (n_children = 0)::BIGINT AS leaf,
  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[depth].text) END AS saved FROM counted)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, sum(d.leaf)::BIGINT AS n_leaves,
  sum(d.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM own n JOIN own d ON d.depth >= n.depth AND d.node[1:n.depth] = n.node
LEFT JOIN own p ON p.depth = n.depth - 1 AND n.node[1:p.depth] = p.node
GROUP BY n.node, n.conv_id, n.depth, p.conv_id, n.n_convs, n.n_children, n.ends_sha256"""

SPELLING = f"""WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM distinct_runs),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
  ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
without AS (SELECT word, n, place, left(word, (place - 1)::INTEGER) || substr(word, place::INTEGER + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
  CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chains(word, root) AS (SELECT word, word FROM formed UNION SELECT c.word, f.form FROM chains c JOIN formed f ON c.root = f.word
  WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c USING (word)
JOIN formed l ON l.word = c.root WHERE l.form IS NULL"""

NGRAM_JOIN = f"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(
  regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
  list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM split),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n, b.n AS m, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (n + m - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON a = doc_id GROUP BY ALL"""

#: The rules of op3, by action, host and path.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx"]
_BAD = f"list_filter(range(1, len(l) + 1), lambda i: list_has_any(string_split(l[i], '-'), {WORDS}))"
URL_FILTER = f"""WITH rules(action, h, p) AS (VALUES {", ".join(map(str, RULES))}),
cut AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, arg_max(action, length(h || p)) AS action, arg_max(h || p, length(h || p)) AS rule
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
bad AS (SELECT DISTINCT array_to_string(l[list_min({_BAD}):], '.') AS key
  FROM (SELECT DISTINCT string_split(host, '.') AS l FROM parts) WHERE len({_BAD}) > 0),
shares AS (SELECT host || ' ' || path AS key, sum(length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')))::DOUBLE
  / greatest(sum(length(coalesce(html, ''))), 1)::DOUBLE AS share FROM parts WHERE contains(url, '://') GROUP BY 1),
thin AS (SELECT key FROM shares QUALIFY row_number() OVER (ORDER BY share, key) <= least(4096, floor(0.05::DOUBLE * count(*) OVER ())))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host || ' ' || path IN (SELECT key FROM thin)
  OR EXISTS (SELECT 1 FROM bad WHERE host = key OR ends_with(host, '.' || key)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)"""

ORACLE = {"op3_url_filter": URL_FILTER, "op11_prefix_trie": PREFIX_TRIE, "op12_spelling": SPELLING, "op13_ngram_join": NGRAM_JOIN}
