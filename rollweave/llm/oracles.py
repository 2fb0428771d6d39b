"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import hashlib
import re

from .licences import SPELLINGS, all_known

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram FROM places),
found AS (SELECT g.doc_id, g.s, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.gram = x.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  coalesce(items.items_sha256, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM k
"""

OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, 23 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>)'))
    + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>)')) AS size
  FROM c
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt, sum(size) AS size
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(size AS BIGINT) AS formatted_chars
FROM g
"""


# Three plain questions about a line, for engines without lookahead: it goes if the first says yes, or the second yes and the third no.
_OWNED = r"^[ \t\x0b\x0c\r]*(?:©|\(c\)[ \t\x0b\x0c\r]*(?:[0-9<\[{]|©|copyright\b)|copyright\b[ \t\x0b\x0c\r]*(?:\(c\)|©|by\b|[0-9<\[{]))"
_NAMED = r"^[ \t\x0b\x0c\r]*copyright\b.*\b(?:authors|contributors|developers|inc|llc|ltd|gmbh|corp|corporation|foundation|(?:19|20)[0-9][0-9])\b"
_PROSE = r"^[ \t\x0b\x0c\r]*copyright\b[ \t\x0b\x0c\r]*(?:notice|notices|holder|holders|owner|owners|law|laws|treaty|treaties)\b"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+"


def plain_canonical(text: str) -> str:
    """Canonical form of a licence text, written again in Python."""
    lines = [x for x in text.lower().split("\n") if not (re.search(_OWNED, x) or re.search(_NAMED, x, re.S) and not re.search(_PROSE, x))]
    spelt = dict(SPELLINGS)
    return " ".join(spelt.get(w, w) for w in re.split(_MARKS, "\n".join(lines)) if w)


def _canonical(text: str) -> str:
    """SQL of the same, '' where there are no words."""
    lines = f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: NOT (regexp_matches(x, '{_OWNED}') OR regexp_matches(x, '{_NAMED}', 's') AND NOT regexp_matches(x, '{_PROSE}')))"
    words = f"list_filter(string_split_regex(array_to_string({lines}, chr(10)), '{_MARKS}'), lambda w: w <> '')"
    pairs = ", ".join(f"'{found}': '{by}'" for found, by in SPELLINGS)
    return f"coalesce(array_to_string(list_transform({words}, lambda w: coalesce(MAP {{{pairs}}}[w], w)), ' '), '')"


def _op8() -> str:
    digests: dict[str, str] = {}
    for name, text in all_known():
        if plain := plain_canonical(text):
            key = hashlib.sha256(plain.encode()).hexdigest()
            digests[key] = min(name, digests.get(key, name))
    known = ", ".join(f"('{k}', '{n}')" for k, n in sorted(digests.items()))
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS v(digest, licence)),
d AS (SELECT doc_id, {_canonical("text")} AS c FROM documents),
l AS (
  SELECT doc_id, k.licence FROM (
    SELECT doc_id, sha256({_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  ) x JOIN known k ON x.digest = k.digest
),
n AS (SELECT doc_id, count(*) AS n_notices, string_agg(licence, ',' ORDER BY licence) AS notices FROM l GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.c <> '' THEN sha256(d.c) END AS text_sha256, k.licence, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known k ON d.c <> '' AND sha256(d.c) = k.digest LEFT JOIN n ON d.doc_id = n.doc_id
"""


ORACLES: dict[str, str] = {"op2_chat_format": OP2, "op5_decontaminate": OP5, "op8_licences": _op8(), "op10_exact_dedup": OP10}
