"""The named queries as SQL for DuckDB, in another shape than the Spark ones.

Spark works on arrays within a row; here findings are exploded rows, conflicts are settled
by self-joins, neighbours are found as islands, and headers are split into lines.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import html5, name2codepoint

from catalog import queries as Q
from mailveil.functions.checksums import ABN_WEIGHTS, MEDICARE_WEIGHTS, TFN_WEIGHTS
from mailveil.functions.html import BLOCK_TAGS
from mailveil.functions.masking import PLACEHOLDERS
from mailveil.functions.recognizers import AU_RECOGNIZERS, ENTITY_ORDER
from mailveil.functions.synthetic import AREA_CODES, FIRST_NAMES, GENERATORS, LAST_NAMES
from mailveil.sources.sample_mail import DOMAINS, FIRST, FOLDERS, LAST

CRLF = "chr(13) || chr(10)"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
SPACES = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
IN_LINE = SPACES.replace(r"[\t-\r", r"[\t\x0B-\r")
# What Java's \s holds; RE2 leaves out the vertical tab.
ASCII_SPACE = r"[ \t\n\x0B\f\r]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: Iterable[str]) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


def weighted(digits: str, weights: Iterable[int]) -> str:
    w = list(weights)
    return (f"list_sum(list_transform(range(1, {len(w) + 1}), "
            f"lambda k: {w}[k] * substr({digits}, k, 1)::INT))")


# ---- the mail table -----------------------------------------------------------------

MEDICARE_CHECK = f"{weighted('n', MEDICARE_WEIGHTS)} % 10"
ABN_REST = f"((89 - {weighted('(n || i % 10)', ABN_WEIGHTS[2:])} % 89) % 89)"
MOBILE_TAIL = "substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || substr(n, 6, 3)"
MEDICARE_BODY = "substr(n, 1, 4) || ' ' || substr(n, 5, 4) || '3 '"
PII = [
    f"'04' || {MOBILE_TAIL} || CASE WHEN odd THEN ' 04' || {MOBILE_TAIL} ELSE '' END",
    f"'+61 4' || {MOBILE_TAIL}",
    "CASE WHEN odd THEN chr(233) ELSE '' END || '02 ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4)",
    "'+61 3 ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4)",
    "'13 ' || substr(n, 1, 2) || ' ' || substr(n, 3, 2)",
    "replace('1300 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 3), ' ', CASE WHEN odd THEN chr(160) ELSE ' ' END)",
    "'1800 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 3)",
    "substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 2) || "
    f"({weighted('n', TFN_WEIGHTS[:8])} % 11 % 10)",
    f"({ABN_REST} // 10 + 1) || ({ABN_REST} % 10) || ' ' || substr(n, 1, 3) || ' ' || "
    "substr(n, 4, 3) || ' ' || substr(n, 7, 2) || (i % 10)",
    f"replace({MEDICARE_BODY} || ({MEDICARE_CHECK}), ' ', CASE WHEN odd THEN '' ELSE ' ' END)",
    f"{MEDICARE_BODY} || (({MEDICARE_CHECK} + 1) % 10)",
    "'licence no ' || n",
    "'mail ann.' || i || '@example.com from 10.1.2.' || (i % 256)",
    "'bad 999.1.1.1'",
    "'Dear Alice Nguyen, thanks'",
    "'0412 345 678 050'",
]


def person(k: str) -> tuple[str, str, str]:
    first, last = f"{words(FIRST)}[({k}) % 10 + 1]", f"{words(LAST)}[({k}) // 10 + 1]"
    local = f"lower({first} || '.' || {last}) || (i // 50)"
    return first, last, (f"CASE WHEN i % 2 = 1 THEN upper({local}) ELSE {local} END || '@' || "
                         f"{words(DOMAINS)}[({k}) % 3 + 1]")


def named(k: str) -> str:
    first, last, address = person(k)
    return f"{first} || ' ' || {last} || ' <' || {address} || '>'"


def header_lines() -> str:
    first, last, address = person("(i * 3) % 97")
    refs = (f"array_to_string(list_transform(range(root, i), lambda r: '<m' || r || "
            f"'@mx.example.com>'), {CRLF} || ' ')")
    lines = [
        f"'Message-ID: <m' || i || '@mx.example.com>' || {CRLF}",
        "CASE WHEN depth > 0 AND i % 3 <> 0 THEN 'In-Reply-To: <m' || (i - 1) || "
        f"'@mx.example.com>' || {CRLF} ELSE '' END",
        f"CASE WHEN depth > 0 AND i % 4 <> 1 THEN 'References: ' || {refs} || {CRLF} ELSE '' END",
        "'From: ' || CASE WHEN i % 6 = 0 THEN '\"' || " + last + " || ', ' || " + first
        + " || '\" <' || " + address + " || '>' ELSE " + named("(i * 3) % 97") + f" END || {CRLF}",
        f"'To: ' || {named('(i * 5 + 1) % 97')} || CASE WHEN i % 2 = 0 THEN ', ' || "
        f"{named('(i * 7 + 2) % 97')} ELSE '' END || {CRLF}",
        f"CASE WHEN i % 9 = 0 THEN 'To: ' || {named('(i * 2 + 5) % 97')} || {CRLF} ELSE '' END",
        "CASE WHEN i % 4 = 0 THEN CASE WHEN i % 8 = 0 THEN 'cc: ' ELSE 'Cc: ' END || "
        f"{named('(i * 11 + 3) % 97')} || {CRLF} ELSE '' END",
    ]
    return "CASE WHEN i % 29 = 0 THEN NULL ELSE " + " || ".join(f"({x})" for x in lines) + " END"


NOTE = "text || chr(10) || 'Note: ' || pii || chr(10) || 'end'"

CTES: dict[str, str] = {}
CTES["source"] = """
SELECT doc_id AS i, text, (doc_id // 16) % 2 = 1 AS odd, doc_id % 5 AS depth,
       doc_id - doc_id % 5 AS root,
       lpad(((doc_id * 7919 + 12345678) % 100000000)::VARCHAR, 8, '0') AS n
FROM documents"""
CTES["filled"] = (
    "SELECT *, CASE i % 16 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(PII))
    + " END AS pii FROM source")
CTES["mail"] = f"""
SELECT i + 1 AS msg_seq,
       CASE WHEN i % 97 = 96 THEN NULL ELSE 'id-' || i END AS message_id,
       {words(FOLDERS)}[i % 4 + 1] AS folder,
       CASE WHEN i % 11 = 0 THEN 'IPM.Appointment' WHEN i % 13 = 0 THEN 'ipm.schedule.meeting.request'
            WHEN i % 17 = 0 THEN NULL ELSE 'IPM.Note' END AS message_class,
       CASE WHEN i % 89 = 88 THEN NULL
            ELSE TIMESTAMP '2024-01-01' + to_minutes(7 * i) END::VARCHAR AS delivery_time,
       CASE WHEN i % 37 = 0 THEN NULL WHEN i % 4 = 0 THEN 'Re: call ' || pii
            ELSE 'Meeting notes ' || i END AS subject,
       CASE WHEN i % 3 = 0 THEN {NOTE} END AS plain_text_body,
       CASE WHEN i % 3 = 1 AND i % 27 <> 25 THEN {NOTE} END AS body,
       CASE WHEN i % 3 = 2 AND i % 27 <> 26 THEN html || '<p>' || pii || '</p>' END AS html_body,
       {header_lines()} AS transport_headers,
       CASE WHEN i % 5 = 0 THEN NULL ELSE i % 4 END AS number_of_attachments,
       CASE WHEN i % 10 = 5 THEN ['a' || i, 'b' || i] END AS attachments
FROM filled LEFT JOIN pages ON page_id = i % (SELECT count(*) FROM pages)"""
CTES["kept"] = r"""
SELECT * FROM mail WHERE NOT regexp_matches(coalesce(message_class, ''),
  '(?i)^ipm\.(appointment|schedule\.meeting|task|activity)')"""


# ---- texts --------------------------------------------------------------------------

def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {by}, 'g')"


INVISIBLE = [0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060, 0x034F, 0x180E, 0x00AD,
             0x202A, 0x202B, 0x202C, 0x202D, 0x202E]
SPACE_LIKE = [0x00A0, 0x202F, 0x2007, 0x2009]


def char_class(codes: Iterable[int]) -> str:
    return "[" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]"


def visible(text: str) -> str:
    return replaced(replaced(text, char_class(SPACE_LIKE), "' '"), char_class(INVISIBLE), "''")


def fewer_lines(text: str) -> str:
    text = replaced(text, rf"\n{SPACES}*\n{SPACES}*\n+", "chr(10) || chr(10)")
    text = replaced(text, rf"(?m)^{IN_LINE}+|{IN_LINE}+$", "''")
    return replaced(text, rf"^{SPACES}+|{SPACES}+$", "''")


# Names of HTML 4, and of those the ones that count without a semicolon too.
NAMED = {f"&{n}": t for n, t in html5.items() if n.rstrip(";") in name2codepoint}


def decoded(text: str) -> str:
    """References as characters: the text is cut at them, and each second piece is one."""
    cut = replaced(text, r"&(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)",
                   r"chr(1) || '\0' || chr(1)")
    table = "MAP {" + ", ".join(f"{q(n)}: {q(t)}" for n, t in NAMED.items()) + "}"
    digits = r"regexp_extract(p, '[0-9A-Fa-f]+')"
    return (f"array_to_string(list_transform(string_split({cut}, chr(1)), lambda p, i: "
            f"CASE WHEN i % 2 = 1 THEN p WHEN p ILIKE '&#x%' THEN chr(('0x' || {digits})::INT) "
            f"WHEN p LIKE '&#%' THEN chr({digits}::INT) ELSE coalesce({table}[p], p) END), '')")


def html_text(html: str) -> str:
    """Without preformatted text, of which the given pages have none."""
    text = replaced(html, r"(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)", "''")
    text = replaced(text, r"(?is)<head[\s>].*?(?:</head\s*>|(<body\b[^>]*>)|\z)", r"'\1'")
    text = replaced(text, r"(?i)<li\b[^>]*>", "chr(3)")
    text = replaced(text, r"(?i)<br\b[^>]*>", "chr(4)")
    text = replaced(text, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?>", "chr(4)")
    text = replaced(text, rf"(?i)</t[dh]{ASCII_SPACE}*>", "chr(5)")
    text = replaced(text, r"""</?[A-Za-z!?](?:[^>"']|"[^"]*"|'[^']*')*>""", "''")
    text = replaced(decoded(text), r"[ \t\n\f\r]+", "' '")
    text = f"replace(replace(replace({text}, chr(4), chr(10)), chr(3), chr(10) || '* '), chr(5), ' ')"
    return fewer_lines(visible(text))


def is_html(text: str) -> str:
    return f"regexp_matches({text}, '(?i)<(html|body|div)')"


CTES["chosen"] = f"""
SELECT msg_seq, coalesce(subject, '') AS subject_text,
       coalesce(nullif(plain_text_body, ''), nullif(body, ''),
                CASE WHEN html_body <> '' THEN {html_text('html_body')} END,
                transport_headers, '') AS chosen
FROM kept"""
CTES["texts"] = f"""
SELECT msg_seq, subject_text, body AS body_text, subject_text || ' ' || body AS joined_text
FROM (SELECT *, CASE WHEN {is_html('chosen')} THEN {html_text('chosen')} ELSE chosen END AS body FROM chosen)"""
CTES["fields"] = """
SELECT msg_seq AS k, 'subject' AS field, subject_text AS txt FROM texts
UNION ALL SELECT msg_seq, 'body', body_text FROM texts
UNION ALL SELECT msg_seq, 'joined', joined_text FROM texts"""
CTES["joined_fields"] = "SELECT msg_seq AS k, 'joined' AS field, joined_text AS txt FROM texts"
CTES["doc_fields"] = "SELECT doc_id AS k, 'text' AS field, text AS txt FROM documents"
CTES["file_fields"] = """
SELECT doc_id // 20 AS k, 'text' AS field,
       string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS txt
FROM documents GROUP BY doc_id // 20"""


# ---- headers ------------------------------------------------------------------------

CTES["header_rows"] = r"""
SELECT msg_seq, ln, lower(split_part(line, ':', 1)) AS name,
       nullif(regexp_extract(line, '^[^:]*:[ ]*([^\r\n]*)', 1), '') AS value
FROM (SELECT msg_seq, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln
      FROM (SELECT msg_seq, string_split(regexp_replace(transport_headers, '\r?\n[ \t]+', ' ', 'g'), chr(10)) AS lines
            FROM mail))"""
CTES["address_rows"] = r"""
SELECT msg_seq, field, row_number() OVER (PARTITION BY msg_seq, field ORDER BY ln, j) - 1 AS pos,
       CASE WHEN contains(item, '<') THEN regexp_replace(trim(split_part(item, '<', 1)), '^"|"$', '', 'g') ELSE '' END AS name,
       CASE WHEN contains(item, '<') THEN trim(regexp_extract(item, '<([^>]*)>', 1)) ELSE item END AS email
FROM (SELECT msg_seq, ln, field, trim(unnest(items)) AS item, generate_subscripts(items, 1) AS j
      FROM (SELECT msg_seq, ln, CASE name WHEN 'from' THEN 1 WHEN 'to' THEN 2 ELSE 3 END AS field,
                   regexp_extract_all(value, '(?:[^",]+|"[^"]*")+') AS items
            FROM header_rows WHERE name IN ('to', 'cc')
               OR (name = 'from' AND ln = (SELECT min(h.ln) FROM header_rows h
                                           WHERE h.msg_seq = header_rows.msg_seq AND h.name = 'from'))))
WHERE item <> ''"""
CTES["names"] = r"""
SELECT DISTINCT lower(trim(regexp_replace(name, '^([^,]*?)\s*,\s*(.*)$', '\2 \1'))) AS name
FROM address_rows WHERE name <> ''"""
CTES["occurrences"] = """
SELECT msg_seq, field, pos, email AS raw,
       CASE WHEN contains(email, '@') THEN lower(trim(email)) END AS norm_email
FROM address_rows WHERE msg_seq IN (SELECT msg_seq FROM kept) AND email <> ''"""
CTES["seen"] = """
SELECT norm_email, msg_seq, field, pos, raw, n FROM (
  SELECT *, row_number() OVER (PARTITION BY norm_email ORDER BY msg_seq, field, pos) AS rn,
         count(*) OVER (PARTITION BY norm_email) AS n
  FROM occurrences WHERE norm_email IS NOT NULL) WHERE rn = 1"""


def pseudonym(id_: str, raw: str, keyword: str = "user", width: int = 7) -> str:
    return (f"'{keyword}' || CASE WHEN {id_} < {10 ** width} THEN lpad({id_}::VARCHAR, {width}, '0') "
            f"ELSE {id_}::VARCHAR END || '@' || substr({raw}, strpos({raw}, '@') + 1)")


CTES["old_mapping"] = f"""
SELECT id, raw AS original_email, {pseudonym('id', 'raw')} AS anonymized_email, norm_email
FROM (SELECT *, row_number() OVER (ORDER BY msg_seq, field, pos) AS id FROM (
  SELECT msg_seq, field, pos, email AS raw, lower(trim(email)) AS norm_email,
         row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY msg_seq, field, pos) AS rn
  FROM address_rows
  WHERE contains(email, '@') AND msg_seq * 4 <= (SELECT count(*) FROM documents)) WHERE rn = 1)"""
CTES["new_mapping"] = f"""
SELECT id, raw AS original_email, {pseudonym('id', 'raw')} AS anonymized_email, norm_email
FROM (SELECT *, row_number() OVER (ORDER BY msg_seq, field, pos)
                + (SELECT coalesce(max(id), 0) FROM old_mapping) AS id
      FROM seen WHERE norm_email NOT IN (SELECT norm_email FROM old_mapping))"""
CTES["full_mapping"] = "SELECT * FROM old_mapping UNION ALL SELECT * FROM new_mapping"
CTES["masked_addresses"] = """
SELECT msg_seq, string_agg(CASE WHEN field = 1 THEN p END, '; ' ORDER BY field, pos) AS masked_from,
       string_agg(CASE WHEN field = 2 THEN p END, '; ' ORDER BY field, pos) AS masked_to,
       string_agg(CASE WHEN field = 3 THEN p END, '; ' ORDER BY field, pos) AS masked_cc
FROM (SELECT o.*, coalesce(m.anonymized_email, o.raw) AS p
      FROM occurrences o LEFT JOIN full_mapping m USING (norm_email)) GROUP BY msg_seq"""
CTES["original_addresses"] = """
SELECT msg_seq, string_agg(CASE WHEN field = 1 THEN email END, '; ' ORDER BY field, pos) AS email_from,
       string_agg(CASE WHEN field = 2 THEN email END, '; ' ORDER BY field, pos) AS email_to,
       string_agg(CASE WHEN field = 3 THEN email END, '; ' ORDER BY field, pos) AS email_cc
FROM address_rows WHERE email <> '' GROUP BY msg_seq"""
CTES["thread_rows"] = """
SELECT m.msg_seq, mid.value AS message_id, irt.value AS irt,
       CASE WHEN refs.value IS NULL THEN [] ELSE regexp_extract_all(refs.value, '<[^>]+>') END AS refs
FROM mail m
LEFT JOIN header_rows mid ON mid.msg_seq = m.msg_seq AND mid.name = 'message-id'
LEFT JOIN header_rows irt ON irt.msg_seq = m.msg_seq AND irt.name = 'in-reply-to'
LEFT JOIN header_rows refs ON refs.msg_seq = m.msg_seq AND refs.name = 'references'"""


# ---- findings -----------------------------------------------------------------------

def pattern_rows(entities: Iterable[str] | None = None) -> str:
    rows = [(r.entity, r.patterns[0][0], r.patterns[0][1], "|".join(w for w in r.context if w.isalnum()))
            for r in AU_RECOGNIZERS]
    rows += [("EMAIL_ADDRESS", EMAIL_PATTERN, 1.0, ""), ("IP_ADDRESS", IP_PATTERN, 0.6, "")]
    kept = [r for r in rows if entities is None or r[0] in set(entities)]
    return "VALUES " + ", ".join(
        f"({q(e)}, {q(p)}, {s}::DOUBLE, {q(w)}, {ENTITY_ORDER.index(e)})" for e, p, s, w in kept)


def valid(entity: str, digits: str, hit: str) -> str:
    return f"""CASE {entity}
  WHEN 'AU_TFN' THEN length({digits}) = 9 AND {weighted(digits, TFN_WEIGHTS)} % 11 = 0
  WHEN 'AU_ABN' THEN length({digits}) = 11 AND ({weighted(digits, ABN_WEIGHTS)} - 10) % 89 = 0
  WHEN 'AU_MEDICARE' THEN length({digits}) = 10 AND substr({digits}, 9, 1) <> '0'
       AND {weighted(digits, MEDICARE_WEIGHTS)} % 10 = substr({digits}, 10, 1)::INT
  WHEN 'IP_ADDRESS' THEN list_max(list_transform(string_split({hit}, '.'), lambda o: o::INT)) <= 255
  ELSE true END"""


def shadow(text: str) -> str:
    text = replaced(text, SPACES, "' '")
    text = replaced(text, r"[^\x00-\x7F\p{L}\p{N}]", "'!'")
    return replaced(text, r"[^\x00-\x7F]", "'x'")


def tiles(source: str, keys: str, text: str, pattern: str) -> str:
    """Matches with 0-based positions, from the lengths of matches and gaps."""
    return f"""
SELECT {keys}, hit, start_pos, start_pos + length(hit) AS end_pos FROM (
  SELECT {keys}, hit, (sum(length(gap)) OVER (PARTITION BY k, field, entity ORDER BY j)
         + coalesce(sum(length(hit)) OVER (PARTITION BY k, field, entity ORDER BY j
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_pos
  FROM (SELECT {keys}, unnest(hits) AS hit, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS j
        FROM (SELECT {keys}, regexp_extract_all({text}, {pattern}) AS hits,
                     regexp_split_to_array({text}, {pattern}) AS gaps
              FROM {source} WHERE regexp_matches({text}, {pattern}))))
WHERE hit IS NOT NULL"""


def finding_ctes(source: str, people: bool, entities: Iterable[str] | None = None) -> dict[str, str]:
    """``base`` (validated), ``scored`` (with context), ``settled``, ``merged``, ``masked``."""
    ctes = {
        "patterns(entity, pattern, base_score, near, place)": pattern_rows(entities),
        "shadows": f"SELECT k, field, {shadow('txt')} AS sh FROM {source}",
        "candidates": tiles("shadows, patterns", "k, field, entity, base_score, near, place", "sh", "pattern"),
        "base": f"""
SELECT k, field, entity, place, near, hit, start_pos, end_pos,
       CASE WHEN entity IN ('AU_TFN', 'AU_ABN', 'AU_MEDICARE', 'IP_ADDRESS') THEN 1.0::DOUBLE
            ELSE base_score END AS score
FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM candidates)
WHERE {valid('entity', 'd', 'hit')}""",
    }
    boosted = f"""
SELECT b.k, b.field, b.entity, b.place, b.start_pos, b.end_pos,
       CASE WHEN b.score < 1.0 AND b.near <> '' AND len(list_filter(list_filter(string_split_regex(
              lower(left(s.txt, b.start_pos)), '[^a-z0-9]+'), lambda t: t <> '')[-5:],
              lambda t: regexp_matches(t, b.near))) > 0
            THEN least(1.0::DOUBLE, b.score + 0.35::DOUBLE) ELSE b.score END AS score
FROM base b JOIN {source} s USING (k, field)"""
    if people:
        ctes["words"] = tiles(f"(SELECT *, '' AS entity FROM {source})", "k, field, entity", "txt", r"'\p{L}+'")
        ctes["pairs"] = r"""
SELECT k, field, start_pos, next_end AS end_pos, lower(hit || ' ' || next_hit) AS name
FROM (SELECT k, field, hit, start_pos, end_pos, lead(hit) OVER w AS next_hit,
             lead(start_pos) OVER w AS next_start, lead(end_pos) OVER w AS next_end
      FROM words WINDOW w AS (PARTITION BY k, field ORDER BY start_pos)) p
WHERE next_start = end_pos + 1 AND regexp_matches(hit, '^\p{Lu}') AND regexp_matches(next_hit, '^\p{Lu}')"""
        ctes["people"] = f"""
SELECT p.k, p.field, p.start_pos, p.end_pos FROM pairs p JOIN {source} s USING (k, field)
WHERE p.name IN (SELECT name FROM names)
  AND substr(s.txt, p.start_pos + 1, p.end_pos - p.start_pos) LIKE '% %'"""
        boosted += (f"\nUNION ALL SELECT k, field, 'PERSON', {ENTITY_ORDER.index('PERSON')}, "
                    "start_pos, end_pos, 0.85::DOUBLE FROM people")
    ctes["scored"] = boosted
    ctes["settled"] = """
SELECT * FROM scored x WHERE NOT EXISTS (SELECT 1 FROM scored y
  WHERE y.k = x.k AND y.field = x.field AND y.start_pos <= x.start_pos AND y.end_pos >= x.end_pos
    AND (y.start_pos < x.start_pos OR y.end_pos > x.end_pos
         OR y.score > x.score OR (y.score = x.score AND y.place < x.place)))"""
    ctes["merged"] = f"""
SELECT k, field, entity, place, min(start_pos) AS start_pos, max(end_pos) AS end_pos, max(score) AS score
FROM (SELECT *, sum(starts) OVER (PARTITION BY k, field ORDER BY start_pos) AS island
      FROM (SELECT x.*, CASE WHEN lag(x.entity) OVER w = x.entity AND regexp_matches(
                     substr(s.txt, lag(x.end_pos) OVER w + 1, greatest(x.start_pos - lag(x.end_pos) OVER w, 0)), '^ +$')
                   THEN 0 ELSE 1 END AS starts
            FROM settled x JOIN {source} s USING (k, field)
            WINDOW w AS (PARTITION BY x.k, x.field ORDER BY x.start_pos)))
GROUP BY k, field, entity, place, island"""
    return ctes


def placeholder(replacements: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {q(e)} THEN {q(r)}" for e, r in replacements.items())
    return f"CASE entity {cases} ELSE '' END"


def masked_cte(source: str, replacements: dict[str, str] = PLACEHOLDERS) -> dict[str, str]:
    return {"masked": f"""
SELECT s.k, s.field, s.txt, coalesce(r.front || substr(s.txt, r.last_end + 1), s.txt) AS masked
FROM {source} s LEFT JOIN (
  SELECT k, field, string_agg(piece, '' ORDER BY start_pos) AS front, max(end_pos) AS last_end
  FROM (SELECT m.k, m.field, m.start_pos, m.end_pos,
               substr(t.txt, coalesce(lag(m.end_pos) OVER w, 0) + 1,
                      greatest(m.start_pos - coalesce(lag(m.end_pos) OVER w, 0), 0)) || {placeholder(replacements)} AS piece
        FROM merged m JOIN {source} t USING (k, field)
        WINDOW w AS (PARTITION BY m.k, m.field ORDER BY m.start_pos))
  GROUP BY k, field) r USING (k, field)"""}


# ---- synthetic values ---------------------------------------------------------------

class Draw:
    def __init__(self, entity: str, message: str, field: str, seed: int = 42):
        self.prefix = f"'{seed}|' || {message} || '|' || {field} || '|{entity}|'"

    def number(self, i: int | str) -> str:
        return f"('0x' || substr(md5({self.prefix} || {i}), 1, 8))::BIGINT"

    def between(self, i: int, low: int, high: int) -> str:
        return f"({low} + {self.number(i)} % {high - low + 1})::VARCHAR"

    def digits(self, i: int | str, width: int) -> str:
        return f"lpad(({self.number(i)} % {10 ** width})::VARCHAR, {width}, '0')"

    def pick(self, i: int, choices: Iterable[str]) -> str:
        items = list(choices)
        return f"{words(items)}[{self.number(i)} % {len(items)} + 1]"


def generated(entity: str, message: str, field: str, seed: int = 42) -> str:
    d = Draw(entity, message, field, seed)
    body = d.digits(0, 8)
    tail = d.digits(0, 9)
    rest = f"((89 - {weighted(tail, ABN_WEIGHTS[2:])} % 89) % 89)"
    tfn_check = f"({weighted(body, TFN_WEIGHTS[:8])} % 11)"
    tfn = (f"CASE WHEN {tfn_check} < 10 THEN {body} || {tfn_check} WHEN right({body}, 1) = '9' "
           f"THEN left({body}, 7) || '06' ELSE left({body}, 7) || (right({body}, 1)::INT + 1) || '8' END")
    return {
        "PERSON": f"{d.pick(0, FIRST_NAMES)} || ' ' || {d.pick(1, LAST_NAMES)}",
        "EMAIL_ADDRESS": f"lower({d.pick(0, FIRST_NAMES)} || {d.pick(1, LAST_NAMES)}) || '.' || "
                         f"{d.between(2, 100, 999)} || '@example.com'",
        "IP_ADDRESS": "'10.' || " + " || '.' || ".join(d.between(i, 0, 255) for i in range(3)),
        "AU_MOBILE": f"'04' || {d.digits(0, 2)} || ' ' || {d.digits(1, 3)} || ' ' || {d.digits(2, 3)}",
        "AU_MOBILE_INT": f"'+61 4' || {d.digits(0, 2)} || ' ' || {d.digits(1, 3)} || ' ' || {d.digits(2, 3)}",
        "AU_LANDLINE": f"{d.pick(0, AREA_CODES)} || ' ' || {d.between(1, 1000, 9999)} || ' ' || {d.between(2, 1000, 9999)}",
        "AU_LANDLINE_INT": f"'+61 ' || right({d.pick(0, AREA_CODES)}, 1) || ' ' || "
                           f"{d.between(1, 1000, 9999)} || ' ' || {d.between(2, 1000, 9999)}",
        "AU_13": f"'13 ' || {d.between(0, 10, 99)} || ' ' || {d.between(1, 10, 99)}",
        "AU_1300": f"'1300 ' || {d.between(0, 100, 999)} || ' ' || {d.between(1, 100, 999)}",
        "AU_1800": f"'1800 ' || {d.between(0, 100, 999)} || ' ' || {d.between(1, 100, 999)}",
        "AU_TFN": f"(SELECT substr(v, 1, 3) || '-' || substr(v, 4, 3) || '-' || substr(v, 7, 3) FROM (SELECT {tfn} AS v))",
        "AU_ABN": f"({rest} // 10 + 1) || ({rest} % 10) || ' ' || substr({tail}, 1, 3) || ' ' || "
                  f"substr({tail}, 4, 3) || ' ' || substr({tail}, 7, 3)",
        "AU_MEDICARE": f"substr({body}, 1, 4) || ' ' || substr({body}, 5, 4) || {d.between(1, 1, 9)} || ' ' || "
                       f"({weighted(body, MEDICARE_WEIGHTS)} % 10)",
        "AU_DRIVER_LICENSE": f"(1000000 + (({d.number(0)} % 65536) * 4294967296 + {d.number(1)}) % 9999000000)::VARCHAR",
    }[entity]


def filled(text: str, message: str, field: str, seed: int = 42) -> str:
    for entity in GENERATORS:
        text = f"replace({text}, {q(PLACEHOLDERS[entity])}, {generated(entity, message, field, seed)})"
    return text


# ---- composition --------------------------------------------------------------------

BASE_ORDER = list(CTES)
MAIL = ["source", "filled", "mail"]
KEPT = [*MAIL, "kept"]
TEXTS = [*KEPT, "chosen", "texts"]
HEADERS = [*MAIL, "header_rows"]
ADDRESSES = [*HEADERS, "address_rows"]
OCCURRENCES = [*ADDRESSES, "kept", "occurrences"]
MAPPINGS = [*OCCURRENCES, "seen", "old_mapping", "new_mapping", "full_mapping"]


def sql(select: str, ctes: Iterable[str] = (), extra: dict[str, str] | None = None) -> str:
    wanted = set(ctes)
    parts = [(name, CTES[name]) for name in BASE_ORDER if name in wanted]
    parts += list((extra or {}).items())
    if not parts:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n" + select


SPAN_SELECT = "SELECT k AS {key}, entity, start_pos, end_pos, score FROM {table}"


def findings(select: str, fields: str = "joined_fields", people: bool = True, mask: dict[str, str] | None = None,
             entities: Iterable[str] | None = None, more: Iterable[str] = (), key: str = "msg_seq") -> str:
    base = {*TEXTS, *more} if fields not in ("doc_fields", "file_fields") else set(more)
    if people:
        base |= {*ADDRESSES, "names"}
    extra = finding_ctes(fields, people, entities)
    if mask is not None:
        extra.update(masked_cte(fields, mask))
    return sql(select, [*base, fields], extra)


def shown(name: str, text: str, width: int) -> str:
    return f"CASE WHEN length({text}) > {width} THEN left({text}, {width}) || '...' ELSE {text} END AS {name}"


BOTH_MASKED = """(SELECT k AS msg_seq, max(CASE WHEN field = 'subject' THEN txt END) AS subject_text,
       max(CASE WHEN field = 'body' THEN txt END) AS body_text,
       max(CASE WHEN field = 'subject' THEN masked END) AS subject_masked,
       max(CASE WHEN field = 'body' THEN masked END) AS body_masked
 FROM masked WHERE field <> 'joined' GROUP BY k)"""

COUNTS_TEXT = """(SELECT t.msg_seq, coalesce(string_agg(entity || ': ' || n, ', ' ORDER BY best DESC, first, entity), 'None') AS entities_found,
       coalesce(sum(n), 0)::BIGINT AS pii_count
 FROM texts t LEFT JOIN (
   SELECT k, entity, count(*) AS n, max(score) AS best,
          min(start_pos) FILTER (score = top) AS first
   FROM (SELECT *, max(score) OVER (PARTITION BY k, entity) AS top FROM scored WHERE field = 'joined')
   GROUP BY k, entity) c ON c.k = t.msg_seq GROUP BY t.msg_seq)"""

RECORD = f"""
SELECT t.msg_seq, coalesce(k.message_id, '') AS "MessageId", k.delivery_time AS "EmailReceivedDate",
       coalesce(a.masked_from, '') AS "EmailFrom", coalesce(a.masked_to, '') AS "EmailTo",
       coalesce(a.masked_cc, '') AS "EmailCC", coalesce(o.email_from, '') AS "OriginalEmailFrom",
       coalesce(o.email_to, '') AS "OriginalEmailTo", coalesce(o.email_cc, '') AS "OriginalEmailCC",
       b.subject_masked AS "Subject", b.body_masked AS "EmailBody",
       {filled('b.subject_masked', 't.msg_seq', "'subject'")} AS "SubjectSynthetic",
       {filled('b.body_masked', 't.msg_seq', "'body'")} AS "EmailBodySynthetic",
       t.subject_text AS "OriginalSubject", t.body_text AS "OriginalEmailBody",
       c.entities_found AS "PIIEntitiesFound", c.pii_count AS "PIICount",
       coalesce(k.number_of_attachments, len(k.attachments), 0)::BIGINT AS "NoOfAttachments",
       r.message_id AS "ThreadMessageId", coalesce(r.refs[1], r.irt, r.message_id) AS "ThreadId",
       coalesce(r.irt, r.refs[-1]) AS "ParentId",
       coalesce(array_to_string(r.refs, '; '), '') AS "References", len(r.refs)::BIGINT AS "ReplyDepth"
FROM texts t JOIN kept k USING (msg_seq) JOIN {BOTH_MASKED} b USING (msg_seq)
JOIN {COUNTS_TEXT} c USING (msg_seq) JOIN thread_rows r USING (msg_seq)
LEFT JOIN masked_addresses a USING (msg_seq) LEFT JOIN original_addresses o USING (msg_seq)"""
RECORD_CTES = [*MAPPINGS, "masked_addresses", "original_addresses", "thread_rows"]

SAFE = "regexp_replace(replace(coalesce({0}, ''), '\"', chr(39)), '\\r\\n|\\r|\\n', ' ', 'g')"
CSV_SELECT = ", ".join(
    (f'coalesce("{source}"::VARCHAR, \'\') AS "{name}"' if name in Q.csv_files.UNSANITIZED
     else SAFE.format(f'"{source}"') + f' AS "{name}"')
    for name, source in Q.csv_files.CSV_COLUMNS.items())
BATCHED = (f"(SELECT *, 'mail_batch' || lpad(((row_number() OVER (ORDER BY msg_seq) - 1) // {Q.BATCH_SIZE} + 1)"
           f"::VARCHAR, 4, '0') AS batch FROM record)")


def record_sql(select: str) -> str:
    extra = finding_ctes("fields", True)
    extra.update(masked_cte("fields"))
    extra["record"] = RECORD
    return sql(select, [*TEXTS, *RECORD_CTES, "names", "fields"], extra)


def build() -> dict[str, str]:
    out: dict[str, str] = {}

    # Sources and sinks
    out["mail_scan"] = sql(
        "SELECT * REPLACE (number_of_attachments::BIGINT AS number_of_attachments, "
        "array_to_string(attachments, ', ') AS attachments) FROM mail", MAIL)
    out["folder_list"] = sql(r"""
SELECT array_to_string(parts[1:n], '\') AS folder, count(*) FILTER (n = len(parts)) AS messages,
       count(*) AS all_messages
FROM (SELECT string_split(folder, '\') AS parts FROM mail), range(1, 10) AS t(n)
WHERE n <= len(parts) GROUP BY 1""", MAIL)
    out["mapping_scan"] = sql("""
SELECT id + (SELECT max(id) FROM old_mapping) AS id, lower(original_email) AS original_email,
       anonymized_email, norm_email FROM old_mapping""", [*ADDRESSES, "old_mapping"])
    out["mapping_append"] = sql("SELECT id, original_email, anonymized_email FROM full_mapping", MAPPINGS)
    out["csv_batches"] = record_sql(f"SELECT batch, {CSV_SELECT} FROM {BATCHED}")
    out["csv_preview"] = record_sql(f"""
SELECT "MessageId", "SubjectMasked", "PIIEntitiesFound", "PIICount"::BIGINT AS "PIICount",
       "ReplyDepth"::BIGINT AS "ReplyDepth"
FROM (SELECT {CSV_SELECT} FROM record) ORDER BY "MessageId", "EmailReceivedDate" LIMIT 100""")
    out["mask_text_files"] = findings(
        "SELECT k AS doc_id, masked FROM masked WHERE trim(txt) <> ''", "doc_fields", False, PLACEHOLDERS)
    out["mask_file_parts"] = findings("""
SELECT k AS part, generate_subscripts(lines, 1)::BIGINT AS line, unnest(lines) AS text
FROM (SELECT k, string_split(masked, chr(10)) AS lines FROM masked)""", "file_fields", False, PLACEHOLDERS)

    # Filters and projections
    out["drop_calendar"] = sql("SELECT msg_seq, message_class FROM kept", KEPT)
    out["folder_path_match"] = sql("""
SELECT folder, count(*) AS messages, (folder = (SELECT min(folder) FROM hit))::BIGINT AS is_first
FROM hit GROUP BY folder""", MAIL, {"hit": r"""
SELECT folder FROM mail WHERE list_contains(string_split(lower(folder), '\'), 'top')
  AND list_contains(string_split(lower(folder), '\'), 'inbox')"""})
    out["read_folder"] = sql(r"""
SELECT msg_seq, folder, subject FROM kept WHERE folder = 'Top\Inbox\Projects'
ORDER BY msg_seq LIMIT 200""", KEPT)
    out["body_select"] = sql("SELECT msg_seq, chosen AS body_text FROM chosen", [*KEPT, "chosen"])
    out["html_sniff"] = f"""
SELECT kind, id, {is_html('txt')}::BIGINT AS is_html,
       CASE WHEN {is_html('txt')} THEN {html_text('txt')} ELSE txt END AS cleaned
FROM (SELECT 'document' AS kind, doc_id AS id, text AS txt FROM documents
      UNION ALL SELECT 'page', page_id, html FROM pages)"""
    out["body_truncate"] = """
SELECT doc_id, least(length(text) * 8, 65535)::BIGINT AS n_chars,
       md5(substr(repeat(text, 8), 1, 65535)) AS digest FROM documents"""
    out["bytes_decode"] = (
        "SELECT doc_id, text || chr(65533) || chr(65533) || 'end' AS decoded FROM documents")
    out["error_body"] = """
SELECT doc_id, CASE WHEN source = 'src4' THEN '[Error extracting body: invalid UTF-8]' ELSE text END AS body
FROM documents"""
    out["reject_rows"] = sql("""
SELECT msg_seq, CASE WHEN message_id IS NULL OR delivery_time IS NULL THEN 'rejected' ELSE 'good' END AS status,
       nullif(concat_ws(', ', CASE WHEN message_id IS NULL THEN 'no message id' END,
                        CASE WHEN delivery_time IS NULL THEN 'no delivery time' END), '') AS error
FROM mail""", MAIL)
    spans = SPAN_SELECT.format(key="msg_seq", table="base")
    out["entity_filter"] = findings(spans, people=False, entities=["EMAIL_ADDRESS", "IP_ADDRESS", "AU_TFN"])
    out["score_threshold"] = findings(f"{spans} WHERE score >= {Q.THRESHOLD}::DOUBLE", people=False)
    out["pii_changed"] = findings(
        f"SELECT msg_seq, (subject_masked <> subject_text OR body_masked <> body_text)::BIGINT AS changed FROM {BOTH_MASKED}",
        "fields", mask=PLACEHOLDERS)
    out["message_record"] = record_sql("SELECT * FROM record")
    out["preview"] = findings(
        "SELECT msg_seq, CASE WHEN subject_masked = '' THEN '(no subject)' ELSE left(subject_masked, 50) END AS subject_preview, "
        f"{shown('body_preview', 'body_masked', 200)} FROM {BOTH_MASKED}", "fields", mask=PLACEHOLDERS)

    # Joins
    out["pseudonym_lookup"] = sql("""
SELECT o.msg_seq, o.field::BIGINT AS field, o.pos, o.raw, coalesce(m.anonymized_email, o.raw) AS pseudonym
FROM occurrences o LEFT JOIN old_mapping m USING (norm_email)""", [*OCCURRENCES, "old_mapping"])
    out["new_addresses"] = sql("""
SELECT norm_email, raw, msg_seq FROM seen
WHERE norm_email NOT IN (SELECT norm_email FROM old_mapping)""", [*OCCURRENCES, "seen", "old_mapping"])
    ranked = "(SELECT *, row_number() OVER (PARTITION BY folder ORDER BY msg_seq) AS place FROM kept)"
    out["folder_messages"] = sql(
        f"SELECT folder, msg_seq, place, subject FROM {ranked} WHERE place <= {Q.MESSAGES_PER_FOLDER}", KEPT)
    out["detect_person"] = findings(
        "SELECT k AS msg_seq, 'PERSON' AS entity, start_pos, end_pos, 0.85::DOUBLE AS score FROM people")

    # Aggregations
    out["entity_counts"] = findings("SELECT k AS msg_seq, entity, count(*) AS n FROM scored GROUP BY k, entity")
    out["entity_counts_text"] = findings(f"SELECT msg_seq, entities_found FROM {COUNTS_TEXT}")
    out["pii_count"] = findings(f"SELECT msg_seq, pii_count FROM {COUNTS_TEXT}")
    out["entity_totals"] = findings(
        "SELECT entity, count(*) AS findings, count(DISTINCT k) AS messages FROM scored GROUP BY entity")
    out["run_summary"] = findings(
        f"SELECT count(*) AS messages, count(*) FILTER (subject_masked <> subject_text OR body_masked <> body_text) "
        f"AS messages_with_pii FROM {BOTH_MASKED}", "fields", mask=PLACEHOLDERS)
    batch = f"(row_number() OVER (ORDER BY msg_seq) - 1) // {Q.BATCH_SIZE} + 1"
    out["batch_summary"] = sql(
        f"SELECT batch, count(*) AS messages FROM (SELECT {batch} AS batch FROM kept) GROUP BY batch", KEPT)
    out["mapping_max_id"] = sql("SELECT coalesce(max(id), 0) + 1 AS next_id FROM old_mapping", [*ADDRESSES, "old_mapping"])
    out["first_seen_address"] = sql(
        "SELECT norm_email, msg_seq, field::BIGINT AS field, pos, raw, n FROM seen", [*OCCURRENCES, "seen"])
    out["attachment_count"] = sql(
        "SELECT msg_seq, coalesce(number_of_attachments, len(attachments), 0)::BIGINT AS attachments "
        "FROM kept", KEPT)

    # Windows, sort and limit
    out["batch_number"] = sql(
        f"SELECT msg_seq, row_number() OVER (ORDER BY msg_seq) AS dense, {batch} AS batch FROM kept", KEPT)
    out["assign_pseudonyms"] = sql("SELECT * FROM new_mapping", MAPPINGS)
    out["per_folder_cap"] = sql(f"SELECT folder, msg_seq, place FROM {ranked} WHERE place <= {Q.FOLDER_CAP}", KEPT)
    out["max_messages"] = sql(
        f"SELECT msg_seq, subject FROM kept ORDER BY msg_seq LIMIT {Q.FIRST_MESSAGES}", KEPT)
    out["sample_messages"] = findings(
        'SELECT msg_seq, subject_text AS "OriginalSubject", subject_masked AS "Subject", '
        f"{shown('original_preview', 'body_text', 200)}, {shown('masked_preview', 'body_masked', 200)} "
        f"FROM {BOTH_MASKED} ORDER BY msg_seq LIMIT {Q.SAMPLE}", "fields", mask=PLACEHOLDERS)

    # Set operations
    out["address_union"] = sql(
        "SELECT msg_seq, field::BIGINT AS field, pos, raw, norm_email FROM occurrences", OCCURRENCES)
    out["mapping_merge"] = sql("SELECT * FROM full_mapping", MAPPINGS)

    # Detection
    for name, entity in Q.DETECTORS.items():
        out[name] = findings(
            "SELECT b.k AS msg_seq, start_pos, end_pos, substr(f.txt, start_pos + 1, end_pos - start_pos) AS found, score "
            "FROM base b JOIN joined_fields f USING (k, field)", people=False, entities=[entity])
    for name, entity in (("valid_tfn", "AU_TFN"), ("valid_abn", "AU_ABN"), ("valid_medicare", "AU_MEDICARE")):
        out[name] = findings(
            "SELECT c.k AS msg_seq, start_pos, substr(f.txt, start_pos + 1, end_pos - start_pos) AS candidate, "
            f"({valid('entity', 'd', 'hit')})::BIGINT AS valid "
            "FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM candidates) c "
            "JOIN joined_fields f USING (k, field)", people=False, entities=[entity])
    out["validated_score"] = findings(spans, people=False)
    out["context_boost"] = findings(SPAN_SELECT.format(key="msg_seq", table="scored"), people=False)
    out["default_phone_off"] = sql("""
SELECT n.doc_id, n.pos, n.number, count(b.k) AS findings FROM numbers n LEFT JOIN base b ON b.k = n.k
GROUP BY ALL""", [], {
        "numbers": f"""SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS k FROM (
  SELECT doc_id, unnest(hits) AS number, generate_subscripts(hits, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, {q(Q.US_PHONE)}) AS hits FROM documents))""",
        "number_fields": "SELECT k, 'text' AS field, number AS txt FROM numbers",
        **finding_ctes("number_fields", False)})
    card_tiles = {
        "cards": "SELECT *, 'CARD_NUMBER' AS entity FROM (SELECT doc_id AS k, 'text' AS field, "
                 f"{shadow('text')} AS sh FROM documents)",
        "whole": tiles("cards", "k, field, entity", "sh", r"'\b\d{16}\b'"),
        "part": tiles("cards", "k, field, entity", "sh", r"'\d{8}'"),
    }
    out["spans_dedupe"] = sql("""
SELECT x.k AS doc_id, x.entity, x.start_pos, x.end_pos, x.score FROM found x
WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.k = x.k AND y.start_pos <= x.start_pos AND y.end_pos >= x.end_pos
                  AND y.score >= x.score AND (y.start_pos < x.start_pos OR y.end_pos > x.end_pos))""", [], {
        **card_tiles, "found": "SELECT *, 0.6::DOUBLE AS score FROM whole UNION ALL SELECT *, 0.3::DOUBLE FROM part"})
    out["spans_resolve"] = findings(SPAN_SELECT.format(key="msg_seq", table="settled"))
    out["spans_merge_adjacent"] = findings(SPAN_SELECT.format(key="msg_seq", table="merged"))
    one = "SELECT k AS msg_seq, masked FROM masked"
    out["mask_text"] = findings(one, mask=PLACEHOLDERS)
    out["mask_redact"] = findings(one, mask={"EMAIL_ADDRESS": "<<EMAIL>>"})
    out["mask_custom"] = findings(one, mask={**PLACEHOLDERS, **Q.CUSTOM_OPERATORS})
    out["mask_message"] = findings(
        f"SELECT msg_seq, subject_masked, body_masked FROM {BOTH_MASKED}", "fields", mask=PLACEHOLDERS)

    # Synthetic values
    out["synthetic_text"] = findings(
        f"SELECT k AS doc_id, {filled('masked', 'k', q('text'))} AS synthetic FROM masked WHERE trim(txt) <> ''",
        "doc_fields", False, PLACEHOLDERS)
    subject = filled("subject_masked", "msg_seq", "'subject'")
    body = filled("body_masked", "msg_seq", "'body'")
    out["synthetic_message"] = findings(
        f"SELECT msg_seq, {subject} AS subject_synthetic, {body} AS body_synthetic FROM {BOTH_MASKED}",
        "fields", mask=PLACEHOLDERS)
    for name, entity in Q.GENERATOR_QUERIES.items():
        out[name] = sql(f"SELECT msg_seq, {generated(entity, 'msg_seq', q('body'))} AS value "
                        "FROM (SELECT doc_id + 1 AS msg_seq FROM documents)")
    out["synthetic_redetect"] = "SELECT entity, count(*) AS generated, 0::BIGINT AS failures FROM documents, " + (
        f"(SELECT unnest({words(e for e in GENERATORS if e != 'PERSON')}) AS entity) GROUP BY entity")

    # Addresses
    out["normalize_email"] = sql("SELECT msg_seq, raw, norm_email AS normalized FROM occurrences", OCCURRENCES)
    out["address_passthrough"] = sql("""
SELECT p.msg_seq, row_number() OVER (PARTITION BY p.msg_seq ORDER BY p.field, p.pos, p.part) - 1 AS pos, p.raw,
       CASE WHEN contains(p.raw, '@') THEN coalesce(m.anonymized_email, p.raw) ELSE p.raw END AS result
FROM (SELECT msg_seq, field, pos, 1 AS part, name AS raw FROM address_rows
      UNION ALL SELECT msg_seq, field, pos, 2, email FROM address_rows) p
LEFT JOIN old_mapping m ON m.norm_email = lower(trim(p.raw))
WHERE p.msg_seq IN (SELECT msg_seq FROM kept)""", [*ADDRESSES, "kept", "old_mapping"])
    out["email_domain"] = sql(
        "SELECT msg_seq, raw, split_part(raw, '@', 2) AS domain FROM occurrences", OCCURRENCES)
    out["pseudonym_list"] = sql("""
SELECT o.msg_seq, string_agg(coalesce(m.anonymized_email, o.raw), '; ' ORDER BY o.field, o.pos) AS pseudonyms
FROM occurrences o LEFT JOIN old_mapping m USING (norm_email) GROUP BY o.msg_seq""", [*OCCURRENCES, "old_mapping"])
    out["pseudonym_header"] = sql("""
SELECT msg_seq, string_agg(CASE WHEN name = '' THEN p WHEN contains(name, ',') THEN '"' || name || '" <' || p || '>'
                                ELSE name || ' <' || p || '>' END, ', ' ORDER BY pos) AS header_masked
FROM (SELECT a.*, coalesce(m.anonymized_email, a.email) AS p
      FROM address_rows a LEFT JOIN old_mapping m ON m.norm_email = lower(trim(a.email))
      WHERE a.field = 2 AND a.msg_seq IN (SELECT msg_seq FROM kept)) GROUP BY msg_seq""",
        [*ADDRESSES, "kept", "old_mapping"])
    out["pseudonym_messages"] = sql("""
SELECT msg_seq, coalesce(masked_from, '') AS masked_from, coalesce(masked_to, '') AS masked_to,
       coalesce(masked_cc, '') AS masked_cc FROM masked_addresses""", [*MAPPINGS, "masked_addresses"])

    # HTML and text
    out["html_to_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
    mixed = "replace(text, ' ', {})".format(" || ".join(f"chr({c})" for c in [*SPACE_LIKE, *INVISIBLE]))
    out["strip_invisible"] = f"SELECT doc_id, {visible('mixed')} AS text FROM (SELECT doc_id, {mixed} AS mixed FROM documents)"
    spread = (r"replace(replace(text, '. ', '.' || chr(13) || chr(10) || ' ' || chr(160) || chr(10) || chr(9) || "
              r"chr(13) || chr(10) || ' '), ', ', ', ' || chr(13) || chr(10))")
    out["collapse_newlines"] = f"SELECT doc_id, {fewer_lines('spread')} AS text FROM (SELECT doc_id, {spread} AS spread FROM documents)"
    out["csv_sanitize"] = sql(f"SELECT msg_seq, {SAFE.format('transport_headers')} AS safe FROM mail", MAIL)

    # Headers and threads
    def first_value(name: str) -> str:
        return f"max(value) FILTER (name = '{name}')"
    out["header_fields"] = sql(f"""
SELECT m.msg_seq, {first_value('message-id')} AS message_id, {first_value('in-reply-to')} AS in_reply_to,
       {first_value('references')} AS refs, {first_value('from')} AS from_header, {first_value('cc')} AS cc_header,
       string_agg(value, ' | ' ORDER BY ln) FILTER (name = 'to') AS to_headers
FROM mail m LEFT JOIN header_rows h USING (msg_seq) GROUP BY m.msg_seq""", HEADERS)
    out["encoded_words"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Re: =?utf-8?B?!?= ' ELSE '' END || text AS decoded
FROM documents"""
    out["address_grammar"] = """
SELECT doc_id, pos, found[pos + 1][1] AS name, found[pos + 1][2] AS email
FROM (SELECT doc_id, CASE doc_id % 5
        WHEN 0 THEN [['Ann ' || doc_id, 'ann' || doc_id || '@x.org'],
                     ['Doe, J. "' || lang || '"', 'doe@' || source || '.org']]
        WHEN 1 THEN [['', 'a' || doc_id || '@x.org'], ['Bob (the second one)', 'b@x.org'],
                     ['', 'c@x.org']]
        WHEN 2 THEN [[lang || ' (x)', 'c' || doc_id || '@x.org']]
        WHEN 3 THEN [['', '"odd one"@x.org'], ['', 'd' || doc_id || '@x.org']]
        ELSE [['Zoë, ' || doc_id, 'z@x.org']] END AS found FROM documents),
     range(3) AS t(pos)
WHERE pos < len(found)"""
    threads = [*HEADERS, "thread_rows"]
    out["references_list"] = sql("""
SELECT msg_seq, generate_subscripts(refs, 1) - 1 AS pos, unnest(refs) AS reference FROM thread_rows""", threads)
    out["thread_id"] = sql("SELECT msg_seq, coalesce(refs[1], irt, message_id) AS thread_id FROM thread_rows", threads)
    out["parent_id"] = sql("SELECT msg_seq, coalesce(irt, refs[-1]) AS parent_id FROM thread_rows", threads)
    out["reply_depth"] = sql("SELECT msg_seq, len(refs)::BIGINT AS reply_depth FROM thread_rows", threads)
    out["references_text"] = sql(
        "SELECT msg_seq, coalesce(array_to_string(refs, '; '), '') AS references_text FROM thread_rows", threads)
    out["parse_addresses"] = sql(
        "SELECT msg_seq, ['From', 'To', 'Cc'][field] AS field, pos, name, email FROM address_rows", ADDRESSES)
    out["format_addresses"] = sql("""
SELECT m.msg_seq, coalesce(email_from, '') AS email_from, coalesce(email_to, '') AS email_to,
       coalesce(email_cc, '') AS email_cc FROM mail m LEFT JOIN original_addresses USING (msg_seq)""",
        [*ADDRESSES, "original_addresses"])

    # Options
    luhn = ("list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 0 THEN substr(d, k, 1)::INT "
            "ELSE substr(d, k, 1)::INT * 2 // 10 + substr(d, k, 1)::INT * 2 % 10 END)) % 10 = 0")
    out["custom_recognizer"] = sql(f"""
SELECT k AS doc_id, entity, start_pos, end_pos, 1.0::DOUBLE AS score
FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM hits) WHERE {luhn}""", [], {
        "cards": card_tiles["cards"],
        "hits": tiles("cards", "k, field, entity", "sh", q(Q.CARD.patterns[0][0]))})
    out["pseudonym_options"] = sql(f"""
SELECT id, raw AS original_email, {pseudonym('id', 'raw', 'person', 4)} AS anonymized_email, norm_email
FROM (SELECT *, row_number() OVER (ORDER BY msg_seq, field, pos) AS id FROM seen)""", [*OCCURRENCES, "seen"])

    def call(seed: int) -> str:
        return (f"'call ' || {generated('AU_MOBILE', 'msg_seq', q('body'), seed)} || ' or ' || "
                f"{generated('EMAIL_ADDRESS', 'msg_seq', q('body'), seed)}")
    out["seed_option"] = sql(f"""
SELECT msg_seq, {call(42)} AS first, {call(7)} AS other, 1::BIGINT AS repeats,
       ({call(42)} <> {call(7)})::BIGINT AS differs FROM (SELECT doc_id + 1 AS msg_seq FROM documents)""")
    return out


ORACLES = build()
