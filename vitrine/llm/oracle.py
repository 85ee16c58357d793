"""DuckDB SQL for the queries of this package that SQL can express.

Left out, and tested against brute-force versions instead: op2 (learnt
formats), op6 (a trained classifier), op7 and op8 (a tokenizer), op9 (byte
strings at every position).
"""

from __future__ import annotations

from vitrine.llm import quality

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
ranked AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
escaped AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length('### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': '
                || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10)) AS chars FROM ranked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY n)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), chr(32))) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, b.b FROM reach r JOIN edges b ON r.other = b.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP4 = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + 4), chr(32)) AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 'i')
SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n) AS n_item, count(*) AS n_shared
FROM shingles d JOIN items i ON i.s = d.s WHERE d.side = 'd' GROUP BY d.id, i.id HAVING count(*) >= 0.75 * any_value(i.n)
"""


def _either(phrases) -> str:
    return "|".join(p.replace("'", "''") for p in phrases)


OP10 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, {WORDS.format("t")} AS w FROM docs),
windows AS (
  SELECT r, i, md5(array_to_string(list_slice(w, i, i + 7), chr(32))) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS c
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs)),
judged AS (
  SELECT *, c > 0 AS real, c > 0 AND (
      NOT regexp_matches(l, '{quality.SENTENCE.replace("'", "''")}')
      OR len(regexp_extract_all(l, '{quality.SEPARATORS}')) >= {quality.MIN_SEPARATORS}
      OR (len(regexp_extract_all(l, '{quality.MARKS}')) >= {quality.MIN_MARKS}
          AND len(regexp_extract_all(l, '{quality.MARKS}')) > c * {quality.MAX_MARK_SHARE})
      OR regexp_matches(lower(l), '\b({_either(quality.BOILERPLATE)})\b')) AS fails
  FROM lines),
by_doc AS (
  SELECT r, CAST(sum(c) AS BIGINT) AS word_chars, count(*) FILTER (real) - count(DISTINCT l) FILTER (real) AS n_dup_lines,
         CAST(coalesce(sum(c) FILTER (NOT fails), 0) AS BIGINT) AS clean_chars FROM judged GROUP BY r),
measured AS (
  SELECT d.doc_id, len(w.w) AS n_words, b.word_chars, len(regexp_extract_all(d.t, '{quality.SYMBOLS}')) AS n_symbols, b.n_dup_lines,
         coalesce(p.n, 0) AS n_repeat_words, b.clean_chars
  FROM docs d JOIN words w USING (r) JOIN by_doc b USING (r) LEFT JOIN repeated p USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
       AND word_chars - clean_chars <= word_chars * {quality.MAX_LOST_SHARE} AS kept
FROM measured
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM docs),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
  FROM bits a JOIN bits b ON b.f <> a.f JOIN bits c ON c.f NOT IN (a.f, b.f) JOIN bits d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN bits e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bs[step] AS bit, coalesce(list_sum(list_slice(bs, 1, step - 1)), 0)::INTEGER AS before
  FROM (SELECT filter_order, bs, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
counted AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

OP12 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
                                   lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations)),
pieces AS (
  SELECT ids.conv_id, 0 AS own, i, role, text FROM ids JOIN turns ON turns.conv_id = ids.source AND i <= h
  UNION ALL SELECT conv_id, 1, i, role, text FROM turns JOIN ids USING (conv_id) WHERE i > h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM pieces),
paths AS (
  SELECT conv_id, depth, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, strlen(text) AS b FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
nodes AS (
  SELECT depth, k, any_value(b) AS b, count(*) AS n_convs, min(conv_id) AS conv_id, left(k, greatest(length(k) - 64, 0)) AS up FROM paths GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
subtrees AS (
  SELECT DISTINCT a.depth AS depth, a.k AS k, d.depth AS below, d.k AS other FROM paths a JOIN paths d ON a.conv_id = d.conv_id AND a.depth <= d.depth),
sums AS (
  SELECT s.depth, s.k, CAST(sum((n.n_convs - 1) * n.b) AS BIGINT) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
  FROM subtrees s JOIN nodes n ON n.depth = s.below AND n.k = s.other LEFT JOIN children c ON c.depth = s.below AND c.k = s.other GROUP BY s.depth, s.k),
ends AS (
  SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM paths
  WHERE (conv_id, depth) IN (SELECT (conv_id, max(depth)) FROM paths GROUP BY conv_id) GROUP BY depth, k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (depth, k) LEFT JOIN children c USING (depth, k) LEFT JOIN ends e USING (depth, k)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.depth > 0 AND p.k = n.up
"""

OP13 = "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (" + OP3.replace("75 *", "85 *") + ")"

ORACLE: dict[str, str] = {
    "op1_chat_formatting": OP1,
    "op3_jaccard_join": OP3,
    "op4_decontamination": OP4,
    "op10_quality_rules": OP10,
    "op11_filter_audit": OP11,
    "op12_prefix_trie": OP12,
    "op13_near_dedup": OP13,
}
