"""DuckDB SQL of the queries that SQL can express. The others are compared with brute force in tests/llm."""

from __future__ import annotations

from . import chat, decontam, quality, substring

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def _n(x: str, outside: str) -> str:
    return f"length(regexp_replace({x}, '{outside}', '', 'g'))"


_SOLID = f"regexp_replace(l, '{BLANK}', '', 'g')"
_PHRASES = f"length({_SOLID}) - length(regexp_replace(regexp_replace(l, '{quality.BOILERPLATE}', '', 'g'), '{BLANK}', '', 'g'))"
_SENTENCE, _END_MARK = (x.replace("'", "''") for x in (quality.SENTENCE, quality.END_MARK))
_WORDS = f"len(regexp_extract_all(l, '{WORD}'))"
_FAILS = f"""(NOT regexp_matches(l, '{_SENTENCE}') OR len(regexp_extract_all(l, '{quality.SEPARATOR}')) >= {quality.MIN_SEPARATORS}
 OR {_WORDS} >= {quality.NAV_WORDS} AND NOT regexp_matches(l, '{_END_MARK}') AND len(regexp_extract_all(l, '{quality.CAPITALISED}')) * 100 >= {_WORDS} * {quality.NAV_CAPITALISED}
 OR {_n(_SOLID, '[^#*$%&|<>~^=•»›]+')} * 100 > length({_SOLID}) * {quality.MAX_SYMBOLS}
 OR {_n(_SOLID, '[^!]+')} * 100 > length({_SOLID}) * {quality.MAX_EXCLAMATIONS} AND {_n(_SOLID, '[^!]+')} > 2
 OR length({_SOLID}) >= {quality.SHOUT_CHARS} AND {_n(_SOLID, chr(92) + 'P{Lu}+')} * 100 > length({_SOLID}) * {quality.MAX_UPPER}
 OR NOT regexp_matches({_SOLID}, '\\p{{L}}') OR regexp_matches(l, '{quality.BOILERPLATE}') AND ({_PHRASES}) * 100 > length({_SOLID}) * {quality.MAX_BOILERPLATE})"""

OP2 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE (doc_id, s) IN (SELECT (doc_id, s) FROM g GROUP BY doc_id, s HAVING count(*) > 1)) GROUP BY 1),
l AS (SELECT doc_id, l, ({_FAILS})::INT AS bad, length({_SOLID}) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{WORD}')),
x AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(n * bad) AS lost, sum(n) AS chars FROM l GROUP BY 1),
y AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, {_n('t', '[^#*$%&|<>]+')}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= {quality.MAX_LOST} * word_chars AS kept FROM y"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""WITH b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark), g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {decontam.SIZE - 1}], ' ') AS s, least(len(ws), {decontam.SIZE}) AS k FROM b, unnest(range(1, greatest(len(ws) - {decontam.SIZE - 2}, 2))) u(i) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), k AS (SELECT DISTINCT k FROM g),
v AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM d, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) u(i)),
h AS (SELECT DISTINCT doc_id, i, k, item_id FROM v JOIN g USING (s, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {1 + 5 * k}, 5))::BIGINT >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP7 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages), s AS (SELECT *, sha1(h) AS sha FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM s"""

_HEAD = f"'{chat.START}' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10)"
OP9 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations), p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> '{chat.SYSTEM}'),
r AS (SELECT conv_id, perspective, turn, name, text, CASE WHEN name = '{chat.SYSTEM}' THEN '{chat.SYSTEM}' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role FROM t JOIN p USING (conv_id)),
s AS (SELECT *, {_HEAD} || text || '<|im_end|>' || chr(10) AS segment, length({_HEAD}) AS head FROM r),
o AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, name, segment ROWS UNBOUNDED PRECEDING) - length(segment))::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, role, name, segment, start, CASE WHEN role = 'assistant' THEN start + head ELSE start END::BIGINT AS mask_start, CASE WHEN role = 'assistant' THEN start + length(segment) ELSE start END::BIGINT AS mask_end FROM o"""

OP10 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {substring.SIZE - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - {substring.SIZE - 2}, 1))) u(i)),
f AS (SELECT s, min((doc_id, i)) AS first FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.SIZE})) AS p FROM g JOIN f USING (s) WHERE (doc_id, i) <> first),
x AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) u(i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.p = x.i) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

#: Pairs meet by a shingle in common that is not in more than half of the documents' classes; classes of equal sets stand for their members.
OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS sh FROM w WHERE len(ws) > 0),
c AS (SELECT min(doc_id) AS c, sh, len(sh) AS n FROM s GROUP BY sh), e AS (SELECT c, n, unnest(sh) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, q.b FROM r JOIN q ON r.b = q.a),
m AS (SELECT a AS c, min(b) AS root FROM r GROUP BY a)
SELECT w.doc_id, coalesce(len(s.sh), 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, w.doc_id = coalesce(m.root, w.doc_id) AS kept FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.c = c.c"""

ORACLES = {"op2_quality_rules": OP2, "op5_minhash": OP5, "op6_decontamination": OP6, "op7_warc": OP7, "op9_chat": OP9, "op10_substring": OP10}
