"""SQL for DuckDB of the queries on conversations, mixing and phrases."""

from __future__ import annotations

ASCII_LOWER = ("translate(coalesce(text, ''), "
               "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

# A shortest path row by row from the end: the least (cost, audit, rows) of each state of
# "(s?(ua)+)?", numbered 0 to 3. Up to two rows are inserted before a row.
REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) AS t(i))),
filled AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')))
           AS digits
  FROM conversations),
kinds AS (
  SELECT conv, turn, role, text, xor(list_reduce(
    list_transform(range(len(digits) // 2),
                   lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20
    AS kind
  FROM filled, crc_table),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS p
  FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY p) AS earlier,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '.' END
           AS fault
  FROM placed),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) AS n,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au'))
           AS illegal
  FROM faulty GROUP BY conv),
conversation_ids AS (
  SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations),
inserts(s, letters, here, written) AS (VALUES
  (0, '', 0, []::VARCHAR[]), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']),
  (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']),
  (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
edits AS (
  SELECT conv, p, here, 'D' AS letter, here AS next, 3 AS cost, []::VARCHAR[] AS written
  FROM faulty, range(4) AS t(here)
  UNION ALL
  SELECT conv, p, here, 'R', CASE WHEN here = 2 THEN 3 ELSE 2 END, 2 + (fault = 't')::INT,
         [CASE WHEN here = 2 THEN 'assistant:' ELSE 'user:' END || text]
  FROM faulty, range(4) AS t(here) WHERE fault IN ('t', '.')
  UNION ALL
  SELECT conv, p, here, 'K', next, (fault = 't')::INT, [role || ':' || text]
  FROM faulty JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3))
    AS t(here, initial, next) USING (initial)
  WHERE fault IN ('t', '.')),
steps AS (
  SELECT conv, p, s, e.next, 2 * len(letters) + e.cost AS cost, letters || letter AS audit,
         list_concat(i.written, e.written) AS written
  FROM inserts AS i JOIN edits AS e USING (here)),
best AS (
  SELECT conv, coalesce(n, 0) AS p, s,
         min({'c': 2 * len(letters), 'a': letters, 'w': written}) AS path
  FROM conversation_ids LEFT JOIN counts USING (conv), inserts
  WHERE here IN (0, 3) GROUP BY ALL
  UNION ALL
  SELECT b.conv, b.p - 1, t.s, min({'c': t.cost + b.path.c, 'a': t.audit || b.path.a,
                                   'w': list_concat(t.written, b.path.w)})
  FROM best AS b JOIN steps AS t ON t.conv = b.conv AND t.p = b.p AND t.next = b.s
  GROUP BY b.conv, b.p, t.s)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, path.c::BIGINT AS cost, path.a AS audit,
       sha256(array_to_string(path.w, chr(10))) AS repaired_sha256
FROM conversation_ids LEFT JOIN counts USING (conv) JOIN best USING (conv)
WHERE best.p = 0 AND best.s = 0
"""

# Sources fill up in the order of size by weight: one is held at its cap if its share of what
# is left after those before it would be more.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))),
                       13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, sum(source_size) OVER () AS words,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM sources),
held AS (
  SELECT *, 3 * source_size * weights < weight * (words - 3 * before) AS at_cap FROM filling),
shared AS (
  SELECT (max(words) - 3 * coalesce(sum(source_size) FILTER (at_cap), 0))::DOUBLE AS rest,
         sum(weight) FILTER (NOT at_cap)::DOUBLE AS rest_weight
  FROM held),
targets AS (
  SELECT source, source_size,
         least(source_size * 3.0::DOUBLE, rest * weight::DOUBLE / rest_weight) AS target
  FROM held, shared),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
  FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""

PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i
        FROM words, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)),
often AS (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head,
         array_to_string(w[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a,
         min({{'s': (2000000::HUGEINT * a // (h.f + t.f))::BIGINT, 'c': c, 'l': h.f, 'r': t.f}})
           AS cut
  FROM cuts JOIN often AS h ON h.lang = cuts.lang AND h.phrase = head
       JOIN often AS t ON t.lang = cuts.lang AND t.phrase = tail
  GROUP BY ALL),
covered AS (
  SELECT lang, array_to_string(w[i + 1:i + m], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(k - m + 1)) AS i
        FROM candidates, (VALUES (2), (3)) AS t(m) WHERE m < k)
  GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.s DESC, a DESC, phrase) AS rank,
         phrase, a, cut.l AS l, cut.r AS r, cut.s AS score
  FROM scored LEFT JOIN covered USING (lang, phrase)
  WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= 2000
"""
