"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

import re

from spinecat.llm import chat, divergence, mixing, spelling

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def _windows(words: str, size: int) -> str:
    """First places (from 1) of the windows of a word list."""
    return f"unnest(range(1, len({words}) - {size - 2}))"


OP3 = f"""
WITH rates AS (
  SELECT coalesce('s' || source, '') AS source_key,
         (SELECT count(*) FROM documents)
         * (1.0 / (SELECT count(DISTINCT coalesce('s' || source, '')) FROM documents))::DOUBLE / count(*) AS rate
  FROM documents GROUP BY 1),
means AS (SELECT source_key, greatest(ceil(rate / {mixing.SPLIT}), 1)::INT AS parts, rate FROM rates),
terms AS (
  SELECT source_key, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS term
  FROM means, unnest(range(0, 128)) AS t(k)),
sums AS (SELECT source_key, k, sum(term) OVER (PARTITION BY source_key ORDER BY k) AS total FROM terms),
numbered AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS same,
         row_number() OVER (PARTITION BY doc_id ORDER BY doc_id, encode(text) NULLS FIRST, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) AS numero
  FROM documents),
docs AS (
  SELECT * EXCLUDE (same, numero), coalesce('s' || source, '') AS source_key,
         CASE WHEN doc_id IS NULL OR same > 1 THEN coalesce('i' || doc_id, '') || '#' || numero ELSE doc_id::VARCHAR END AS ident
  FROM numbered),
ids AS (SELECT DISTINCT ident, source_key FROM docs),
draws AS (
  SELECT ident, source_key, j,
         (('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', ident, j::VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM ids JOIN means USING (source_key), unnest(range(0, parts)) AS t(j)),
counts AS (
  SELECT ident, source_key, count(*) FILTER (WHERE total < u) AS n
  FROM draws JOIN sums USING (source_key) GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       md5(concat_ws(':', '{mixing.SEED}', 'order', ident, copy::VARCHAR)) AS shuffle_key
FROM docs JOIN counts USING (ident, source_key), unnest(range(0, n)) AS t(copy)
"""

OP4 = f"""
WITH w AS (SELECT doc_id, {SPACE_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, {_windows('ws', 13)} AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM places),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k), unnest(range(0, 13)) AS t(j) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {ALNUM_WORDS} AS ws FROM benchmark),
item_places AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0),
item_win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS k FROM item_places),
w AS (SELECT doc_id, {ALNUM_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM item_win),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes),
hits AS (
  SELECT doc_id, item, i, n FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM places) p
  JOIN item_win USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP8 = f"""
WITH w AS (SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text, {SPACE_WORDS} AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
places AS (SELECT doc_id, ws, {_windows('ws', 5)} AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM places),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
again AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM win JOIN twice USING (doc_id, k), unnest(range(0, 5)) AS t(j) GROUP BY doc_id),
base AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS bad FROM failed GROUP BY host),
moments AS (
  SELECT sum(n) AS n, count(*) AS hosts, sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) AS squares FROM hosts),
spread AS (
  SELECT m, greatest(squares - m * m - m * (1 - m) * hosts / n, m * (1 - m) / 10000, 1e-9) AS v FROM moments),
prior AS (SELECT m, greatest(m * (1 - m) / v - 1, 1.0) AS s FROM spread),
rates AS (SELECT host, (bad + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM failed JOIN rates USING (host)
"""

_CONTROL = "|".join(re.sub(r"([\[\]|])", r"\\\1", x) for x in (*chat.MARKS, *chat.FOREIGN))
_LENGTH = (
    "(length({x}) + length({x}) - length(replace({x}, '" + chat.ESCAPE + "', '')) "
    "+ 2 * len(regexp_extract_all(replace({x}, '" + chat.ESCAPE + "', '" + chat.ESCAPE + "0'), '" + _CONTROL + "')))"
)

OP10 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({sum(map(len, chat.MARKS))} + {_LENGTH.format(x='role')} + {_LENGTH.format(x='text')}) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM texts
"""



def _nibble_crc(i: int) -> int:
    """CRC-32 of four bits, by the reflected polynomial."""
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


_CRC = "[" + ", ".join(f"{_nibble_crc(i)}::BIGINT" for i in range(16)) + "]"

OP12 = f"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
hexed AS (
  SELECT run, hex(encode(head || run)) AS h, count(*) AS times FROM found
  WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY head, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h)),
      lambda k: (strpos('0123456789ABCDEF', substr(h, CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END, 1)) - 1)::BIGINT)),
    lambda s, x: xor(s >> 4, {_CRC}[(xor(s, x) & 15) + 1]))) AS crc
  FROM hexed),
slipped AS (
  SELECT CASE WHEN crc % {spelling.SLIP} = 0
              THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, times
  FROM hashed),
counted AS (
  SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= {spelling.MIN_LENGTH}
  GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}),
cuts AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counted)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM counted)
  UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM counted)),
best AS (
  SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, counted.n AS other_n,
         row_number() OVER (PARTITION BY near.word ORDER BY counted.n DESC, encode(other)) AS place
  FROM near JOIN counted ON counted.word = other),
formed AS (
  SELECT counted.word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= {spelling.LEAD} * n THEN other END AS form,
         CASE WHEN other_n >= {spelling.LEAD} * n THEN other_n END AS form_n
  FROM counted LEFT JOIN best ON best.word = counted.word AND place = 1),
walk AS (
  SELECT word, word AS root FROM formed
  UNION SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root AND formed.form IS NOT NULL),
roots AS (SELECT walk.word, root FROM walk JOIN formed ON formed.word = root AND formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN n USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM dense JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

STATEMENTS: dict[str, str] = {
    "op3_mixing": OP3,
    "op4_substrings": OP4,
    "op5_decontaminate": OP5,
    "op8_host_rules": OP8,
    "op10_chat": OP10,
    "op12_spelling": OP12,
    "op13_divergence": OP13,
}
