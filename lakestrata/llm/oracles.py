"""SQL twins (DuckDB) of those queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES
from .quality import BASE, RULES, V2
from .secret_scan import ASSIGN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

op2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_LETTERS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, {_LETTERS}) AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS l, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bw),
lens AS (SELECT DISTINCT l FROM windows),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hits AS (SELECT dw.doc_id, dw.i, dw.l, windows.item FROM dw JOIN windows ON dw.l = windows.l AND dw.g = windows.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

op8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_PLAIN}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a),
comp AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp ON d.doc_id = comp.node
"""

_mask = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, fails in enumerate(RULES.values()))
_any = lambda policy: " OR ".join(f"({RULES[r]})" for r in policy.rule_names)

op9 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
        len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_alpha_words, coalesce(list_max([length(x) for x in w]), 0) AS max_word_chars, len([x for x in w if NOT regexp_matches(x, '[^\x00-\x7F]')]) AS n_ascii_words, coalesce(list_sum([length(x) for x in w if NOT regexp_matches(x, '[^\x00-\x7F]')]), 0) AS ascii_chars,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_shouted, len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) AS n_stuttered
      FROM t LEFT JOIN cover ON t.doc_id = cover.doc_id LEFT JOIN lines ON t.doc_id = lines.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_any(BASE)}) AS base_failed, NOT ({_any(V2)}) AS kept, CAST({_mask} AS BIGINT) AS fail_mask FROM m
"""

op10 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

_bits = lambda rule: 1 << list(RULES).index(rule)

quality_ablations = op9.replace("SELECT doc_id, n_words, word_chars", ", masks AS (SELECT doc_id, n_words, word_chars").rstrip() + f"), policy AS (SELECT fail_mask & {V2.mask} AS m FROM masks)\n" + "\nUNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE m & {_bits(rule)} <> 0) AS n_failed, count(*) FILTER (WHERE m = {_bits(rule)}) AS n_only, count(*) FILTER (WHERE m = 0) AS n_kept, '{V2.version}' AS policy FROM policy" for rule in V2.rule_names
)

_phrases = ", ".join(f"({[*phrase.split()]}, '{label}')" for phrase, label in BASE_PHRASES.items())

license_base = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_LETTERS}) AS w FROM documents),
p(words, label) AS (VALUES {_phrases}),
hits AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, words, w, unnest(range(0, len(w) - len(words) + 1)) AS i FROM d, p WHERE len(w) >= len(words)) WHERE w[i + 1:i + len(words)] = words)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id GROUP BY d.doc_id
"""

_quoted = lambda pattern: pattern.replace("'", "''")

secret_base = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_quoted(ASSIGN.pattern)}', 2), lambda x: length(x) >= 6)) AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM documents
"""

#: CRC-32 byte by byte over a table made from the reflected polynomial 0xEDB88320.
shard_facts = """
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))
SELECT doc_id, strlen(text) + 8 AS size, true AS gapless, true AS even,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
FROM (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents), t
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": op2, "op8_near_duplicates": op8, "op9_quality_rules": op9, "op10_substring_dedup": op10,
    "quality_ablations": quality_ablations, "license_base": license_base, "secret_base": secret_base, "shard_facts": shard_facts,
}
