"""The SQL each query of this package is checked against, where SQL can express it."""

from __future__ import annotations

from flowweir.llm.licences import LONGER, RULES, SENTENCES

LOWERED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = f"""
WITH folded AS (SELECT doc_id, {LOWERED} AS folded FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(folded) AS text_sha256
FROM folded
WINDOW same AS (PARTITION BY folded)
"""

SQL["op5_quality_rules"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
windows AS (
  SELECT doc_id, i, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS gram
  FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 1)) AS i FROM parts)
),
repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id
),
ruled AS (
  SELECT doc_id, text, tokens, lines,
         list_filter(lines, lambda x:
           regexp_matches(x, '[.!?…。！？｡؟۔।॥።፧։។။།]["''”’»)」』）\]]*([\x20\x09-\x0D]|$)')
           AND 10 * len(regexp_extract_all(x, '[#*$%&|<>!]')) <= length(x)
           AND len(regexp_extract_all(x, '[|»›•·→]')) < 2
           AND NOT (
             regexp_matches(lower(x), 'all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept cookies|enable javascript|lorem ipsum|sign up for our newsletter|click here|read more|share on (facebook|twitter)|skip to content')
             AND len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) < 12
           )) AS good
  FROM parts
),
counted AS (
  SELECT r.doc_id,
         len(tokens)::BIGINT AS n_words,
         length(array_to_string(tokens, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(good)::BIGINT AS n_good_lines,
         length(array_to_string(lines, ''))::BIGINT AS line_chars,
         length(array_to_string(good, ''))::BIGINT AS good_chars
  FROM ruled r LEFT JOIN covered c ON r.doc_id = c.doc_id
),
verdicts AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND NOT 100 * (line_chars - good_chars) > 50 * line_chars AS kept
FROM verdicts
"""


# Score without and with a word nearby that names the kind, in hundredths.
_NAMED = {
    "email": (80, "mail|contact|write to|reach"),
    "ip": (60, "ip|address|server|host|client|login"),
    "card": (70, "card|credit|debit|visa|master|payment|account"),
    "phone": (60, "phone|call|tel|mobile|fax|reach|contact"),
    "iban": (80, "iban|bank|account|transfer"),
    "ssn": (40, "ssn|social security|taxpayer"),
}


def _places(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Confirmed matches of one kind with places and scores, from the pieces between them."""
    points, named = _NAMED[kind]
    return f"""
  SELECT doc_id, text, '{kind}' AS kind, {rank} AS rank, start, start + length(m) AS "end",
         {points} + CASE WHEN regexp_matches(
           lower(substr(text, greatest(start - 48, 0) + 1, start - greatest(start - 48, 0))
                 || ' ' || substr(text, start + length(m) + 1, 24)),
           '(^|[^a-z])({named})') THEN 20 ELSE 0 END AS points
  FROM (
    SELECT doc_id, text, matches[i] AS m,
           length(array_to_string(pieces[1:i], '')) + length(array_to_string(matches[1:i - 1], ''))
             AS start
    FROM (
      SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS matches,
               string_split_regex(text, '{pattern}') AS pieces
        FROM texts
      )
    )
  )
  WHERE {valid}
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
# Alternate digits from the right are doubled, and 9 is taken off where that passes 9.
_LUHN = f"""
length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(
  range(1, length({_DIGITS}) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT
                 WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4
                 THEN 2 * substr(reverse({_DIGITS}), i, 1)::INT - 9
                 ELSE 2 * substr(reverse({_DIGITS}), i, 1)::INT END)) % 10 = 0
"""
# 97 divides the number when its remainder is 0, and the check wants remainder 1.
_IBAN_CODE = "replace(m, ' ', '')"
_MOD97 = f"""
length({_IBAN_CODE}) BETWEEN 15 AND 34 AND list_reduce(
  list_prepend(0, list_transform(
    string_split(substr({_IBAN_CODE}, 5) || substr({_IBAN_CODE}, 1, 4), ''),
    lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)::INT - 1)),
  lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 "
        "OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    ),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
)
_EXTRA = (
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", _MOD97),
    (
        "ssn",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "NOT regexp_matches(substr(text, start, 1), '[0-9-]') "
        "AND NOT regexp_matches(substr(text, start + length(m) + 1, 1), '[0-9-]') "
        "AND regexp_matches(lower(substr(text, greatest(start - 48, 0) + 1, "
        "start - greatest(start - 48, 0)) || ' ' || substr(text, start + length(m) + 1, 24)), "
        "'(^|[^a-z])(ssn|social security|taxpayer)')",
    ),
)

SQL["op7_personal_data"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
{" UNION ALL ".join(_places(k, i, p, v) for i, (k, p, v) in enumerate(_KINDS + _EXTRA))}
)
SELECT t.doc_id,
       count(*) FILTER (kind = 'email') AS n_email,
       count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card,
       count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank)
                       FILTER (rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank), '')
         AS spans,
       coalesce(string_agg(points::VARCHAR, ',' ORDER BY start, rank), '') AS scores
FROM (SELECT doc_id FROM documents) t LEFT JOIN spans USING (doc_id)
GROUP BY t.doc_id
"""

# Every turn costs three control strings of eight characters; escaping adds one per place.
SQL["op10_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(24 + length(role) + length(text)
           + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT
         AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _licence_sql() -> str:
    known = ", ".join(f"('{s}', '{n}')" for n, forms in SENTENCES.items() for s in forms)
    holds: dict[str, str] = {}
    for licence, rule in RULES:
        found = f"contains(line, ',{','.join(rule)},')"
        holds[licence] = f"{holds[licence]} OR {found}" if licence in holds else found
    for short, longer in LONGER.items():
        holds[short] = f"({holds[short]}) AND NOT ({holds[longer]})"
    listed = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in holds.items())
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
sentences AS (
  SELECT doc_id, i, trim(regexp_replace(lower(parts[i]), '[^a-z0-9]+', ' ', 'g')) AS sentence
  FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id,
             string_split_regex(coalesce(text, ''), '[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n+') AS parts
      FROM documents
    )
  )
),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY i) AS names
  FROM sentences JOIN known USING (sentence) GROUP BY doc_id
),
lines AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(names, '') AS names,
         ',' || coalesce(names, '') || ',' AS line
  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
)
SELECT doc_id, n AS n_sentences, names AS sentence_ids,
       array_to_string(list_sort(list_filter([{listed}], lambda x: x IS NOT NULL)), ',') AS licences
FROM lines
"""


SQL["op3_licences"] = _licence_sql()


# The longest match at a place is found by growing the runs of window places that lie on
# one diagonal of document and item; a shorter item matches as a whole.
SQL["op11_decontamination"] = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
items AS (
  SELECT item_id, row_number() OVER () AS item, words, least(10, len(words)) AS need
  FROM (SELECT item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark)
  WHERE len(words) > 0
),
windows AS (
  SELECT item, item_id, need, i, array_to_string(words[i:i + need - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - need + 2)) AS i FROM items)
),
places AS (
  SELECT row, need, p, array_to_string(words[p:p + need - 1], ' ') AS gram
  FROM (SELECT row, words, need, unnest(range(1, len(words) - need + 2)) AS p
        FROM texts, (SELECT DISTINCT need FROM items))
),
found AS (
  SELECT row, p, need, item, item_id, i
  FROM places JOIN windows USING (need, gram)
),
covered AS (
  SELECT row, count(DISTINCT place) AS n
  FROM (SELECT DISTINCT row, unnest(range(p, p + need)) AS place
        FROM (SELECT DISTINCT row, p, need FROM found))
  GROUP BY row
),
named AS (
  SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM found) GROUP BY row
),
runs AS (
  SELECT row, min(p) AS p, max(p) - min(p) + any_value(need) AS length
  FROM (SELECT *, p - row_number() OVER (PARTITION BY row, item, need, p - i ORDER BY p) AS part
        FROM found)
  GROUP BY row, item, need, p - i, part
),
best AS (
  SELECT row, max(length) AS longest,
         min(p - 1) FILTER (length = best_length) AS longest_start
  FROM (SELECT *, max(length) OVER (PARTITION BY row) AS best_length FROM runs)
  GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
       coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       covered.n IS NOT NULL AS contaminated, coalesce(longest, 0)::BIGINT AS longest,
       longest_start::BIGINT AS longest_start
FROM texts LEFT JOIN covered USING (row) LEFT JOIN named USING (row) LEFT JOIN best USING (row)
"""


# CRC-32 of the decimal digits, bit by bit with the polynomial of zlib.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, \
''), lambda d: ascii(d)::BIGINT)), lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], \
lambda c, z: {step}))".format(step=_CRC_STEP)


def _leaf_sql(text: str) -> str:
    value = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
    names = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(value.format(n) for n in names) + ")"


def _levels_sql(name: str, group: str, levels: int) -> str:
    """Levels 1 to ``levels`` over ``{name}0(group, i, h)``; a single node stays as it is."""
    parts = []
    for k in range(levels):
        parts.append(f"""
{name}{k + 1} AS (
  SELECT {group}, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h)
                                     ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{k})
  GROUP BY {group}, i // 16
)""")
    return ",".join(parts)


def _proof_sql(name: str, group: str, levels: int, start: str) -> str:
    """``{name}path{k}``: of each row the siblings so far, and what its leaf is folded to."""
    parts = [f"{name}path0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        parts.append(f"""
{name}run{k} AS (
  SELECT {group}, i // 16 AS p, list(h ORDER BY i) AS run,
         count(*) OVER (PARTITION BY {group}) = 1 AND count(*) = 1 AS alone
  FROM {name}{k} GROUP BY {group}, i // 16
),
{name}path{k + 1} AS (
  SELECT a.* REPLACE (
           a.i // 16 AS i,
           CASE WHEN alone THEN proof ELSE
             proof || array_to_string(run[1:a.i % 16] || run[a.i % 16 + 2:], '') END AS proof,
           CASE WHEN alone THEN folded ELSE
             sha256(array_to_string(run[1:a.i % 16], '') || folded
                    || array_to_string(run[a.i % 16 + 2:], '')) END AS folded)
  FROM {name}path{k} a JOIN {name}run{k} r ON a.{group} = r.{group} AND a.i // 16 = r.p
)""")
    return ",".join(parts)


# Six levels hold 16,777,216 documents of a source, four hold 65,536 sources.
SQL["op12_merkle_manifest"] = f"""
WITH sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM (SELECT DISTINCT source FROM documents)
),
hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 5 = 0
              THEN {_leaf_sql(LOWERED.replace("coalesce(text, '')", "text"))}
              ELSE {_leaf_sql("text")} END AS tampered
  FROM documents
),
leaves AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         leaf, tampered
  FROM hashed h JOIN sources q ON h.source IS NOT DISTINCT FROM q.source
),
src0 AS (SELECT s, i, leaf AS h FROM leaves),
{_levels_sql("src", "s", 6)},
top0 AS (SELECT 0 AS t, s AS i, h FROM src6),
{_levels_sql("top", "t", 4)},
started AS (SELECT doc_id, leaf, s, i, '' AS proof, tampered AS folded FROM leaves),
{_proof_sql("src", "s", 6, "started")},
risen AS (
  SELECT doc_id, leaf, h AS subroot, 0 AS t, p.s AS i, proof, folded
  FROM srcpath6 p JOIN src6 q ON p.s = q.s
),
{_proof_sql("top", "t", 4, "risen")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = h AS verified
FROM toppath4, top4
"""
