"""DuckDB SQL for the queries."""

from __future__ import annotations

from ..functions.text import PUNCTUATION
from .queries import START_YEAR

#: White space as the queries' tables have it.
_S = r"[\s\x1c-\x1f\x0b\x85\p{Z}]"


def _lcs(a: str, b: str) -> str:
    """Bit-parallel longest common subsequence of two texts of up to 62 characters."""
    full = f"((1::BIGINT << length({a})::INTEGER) - 1)"
    mask = f"list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, (i + 1)::INTEGER, 1) = ch THEN 1::BIGINT << i::INTEGER ELSE 0::BIGINT END)), 0)::BIGINT)"
    return f"(length({a}) - bit_count(list_reduce({mask}, lambda st, mm: ((st + (st & mm)) | (st - (st & mm))) & {full}, {full})))"


def _tokens(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda x: x <> '')), ' ')"


def _misspelt(c: str) -> str:
    return f"array_to_string(list_reverse(string_split(replace({c}, 'e', ''), ' ')), ' ')"


_STRIP = rf"^{_S}+|{_S}+$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{_STRIP}', '', 'g')"


def _collapse(c: str) -> str:
    return f"regexp_replace({c}, '{_S}+', ' ', 'g')"


_POSTCODE = "lower(substr(c_mktsegment, 1, 2)) || c_nationkey || '  ' || right(c_name, 1) || 'bg'"
_SPACED = "substr(upper(replace(p, ' ', '')), 1, length(replace(p, ' ', '')) - 3) || ' ' || right(upper(replace(p, ' ', '')), 3)"
_GOOD = f"length(replace(p, ' ', '')) BETWEEN 5 AND 7 AND regexp_full_match({_SPACED}, '[A-Z]{{1,2}}[0-9][A-Z0-9]? [0-9][A-Z]{{2}}')"
_TITLE = "array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
_MARKS = PUNCTUATION.replace("'", "''")

_PARTS = f"""
l AS (SELECT p_partkey AS row_key, {_misspelt("p_name")} AS name, p_size AS size, p_brand AS brand FROM part),
ln AS (SELECT DISTINCT size, brand, {_tokens("name")} AS t FROM l),
r AS (SELECT p_partkey, p_name, p_size, p_brand, {_tokens("p_name")} AS t FROM part),
rn AS (SELECT p_size, p_brand, t, min(p_partkey) AS p_partkey FROM r GROUP BY ALL),
pairs AS (SELECT ln.size, ln.brand, ln.t, rn.p_partkey, length(ln.t) + length(rn.t) AS n, {_lcs("ln.t", "rn.t")} AS c FROM ln JOIN rn ON ln.size = rn.p_size AND ln.brand = rn.p_brand)
"""


def _best(threshold: int) -> str:
    return f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY size, brand, t ORDER BY 200.0 * c / n DESC, p_partkey) AS k FROM pairs WHERE 200 * c >= {threshold} * n) WHERE k = 1)"


_SCHOOLS = f"""
l AS (
  SELECT p_partkey AS row_key, {_misspelt("p_name")} AS name, '  ' || lower(p_brand) AS school, 'Year ' || p_size AS year_group, lower(p_brand) AS k, p_size AS n,
    CASE WHEN p_size BETWEEN 0 AND 13 THEN make_date({START_YEAR} - p_size - 5, 9, 1) END AS a, CASE WHEN p_size BETWEEN 0 AND 13 THEN make_date({START_YEAR} - p_size - 4, 8, 31) END AS b
  FROM part
),
r AS (SELECT p_partkey, p_name, upper(p_brand) AS school, lower(p_brand) AS k, make_date({START_YEAR - 4} - p_size, 1 + p_size % 12, 15) AS dob, {_tokens("p_name")} AS t FROM part),
ln AS (SELECT DISTINCT k, a, b, {_tokens("name")} AS t FROM l WHERE a IS NOT NULL),
rn AS (SELECT k, dob, t, min(p_partkey) AS p_partkey FROM r GROUP BY ALL),
pairs AS (SELECT ln.k, ln.a, ln.t, rn.p_partkey, length(ln.t) + length(rn.t) AS n, {_lcs("ln.t", "rn.t")} AS c FROM ln JOIN rn ON ln.k = rn.k AND rn.dob BETWEEN ln.a AND ln.b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, a, t ORDER BY 200.0 * c / n DESC, p_partkey) AS rank FROM pairs WHERE 200 * c >= 70 * n) WHERE rank = 1)
"""


def _duplicates(threshold: int, strict: bool, twins: bool, name: str = "p_name", told: str = "CAST(p_partkey AS VARCHAR)", more: str = "") -> str:
    block = "p_size, p_brand" if strict else "p_size"
    same = " AND ".join(f"u.{c} = v.{c}" for c in block.split(", "))
    first_u, first_v = "split_part(u.p_name, ' ', 1)", "split_part(v.p_name, ' ', 1)"
    twin = f"AND 200 * {_lcs(first_u, first_v)} >= 70 * (length({first_u}) + length({first_v}))" if twins else ""
    return f"""
WITH RECURSIVE n AS (SELECT {block}, p_name, {_tokens(name)} AS t, min(p_partkey) AS node FROM part GROUP BY {block}, p_name),
links AS (
  SELECT u.node AS a, v.node AS b FROM n u JOIN n v ON {same} AND u.node < v.node
  WHERE 200 * {_lcs("u.t", "v.t")} >= {threshold} * (length(u.t) + length(v.t)) {twin}
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
cluster AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
ids AS (SELECT p_partkey, {told} AS id FROM part),
members AS (SELECT p.p_partkey, c FROM part p JOIN n ON {" AND ".join(f"p.{x} = n.{x}" for x in block.split(", "))} AND p.p_name = n.p_name JOIN cluster USING (node)),
told AS (SELECT c, string_agg(id, ', ' ORDER BY id) AS ids, count(*) AS k FROM members JOIN ids USING (p_partkey) GROUP BY c)
SELECT p.p_partkey, p.p_name, p.p_size, p.p_brand{more}, CASE WHEN k > 1 THEN told.ids END AS "Potential Duplicates"
FROM part p JOIN members USING (p_partkey) JOIN told USING (c) JOIN ids USING (p_partkey)
"""


_ORDERS = """
o AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '  ' WHEN o_totalprice > 200000 THEN NULL ELSE o_orderpriority END AS a,
    CASE WHEN o_totalprice > 100000 THEN '5-LOW' ELSE o_orderpriority END AS b, o_totalprice AS c, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS d
  FROM orders
)
"""
_ERRORS = """
e AS (
  SELECT event_id, event_type, value, coalesce(value < 1, true) AS small, coalesce(event_type = 'purchase', false) AND coalesce(value < 50, true) AS cheap FROM events
)
"""

ORACLES: dict[str, str] = {
    "format_name": f"SELECT p_partkey, {_TITLE} AS name FROM (SELECT p_partkey, upper(p_name) || '-' || lower(p_brand) AS x FROM part)",
    "find_numbers": "SELECT doc_id, regexp_matches(text, '[0-9]') AS has_numbers, regexp_matches(CAST(n_chars AS VARCHAR), '[0-9]') AS count_has FROM documents",
    "remove_numbers": f"SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN {_strip("regexp_replace(text, '[0-9]+', '', 'g')")} ELSE text END AS text FROM documents",
    "full_name": "SELECT p_partkey, p_brand || CASE WHEN p_size > 25 THEN ' ' || p_name ELSE '' END || ' ' || p_type AS name FROM part",
    "full_name_missing": "SELECT p_partkey, nullif(concat_ws(' ', CASE WHEN p_size % 3 = 2 THEN p_brand END, CASE WHEN p_size % 5 <> 0 THEN p_name END), '') AS name FROM part",
    "reverse_timestamp": """
SELECT o_orderkey, strftime(CASE WHEN day(t) <= 12 THEN make_timestamp(year(t), day(t), month(t), 3, 4, 5) ELSE t END, '%Y-%m-%d %H:%M:%S') AS reversed
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '03:04:05' AS t FROM orders)""",
    "raise_modes": f"""
SELECT p_partkey, 'SW' || left(CAST(p_size AS VARCHAR), 1) || 'A 1AB' AS postcode, 'Year ' || p_size AS year_group, CAST(p_size AS BIGINT) AS number,
  make_date({START_YEAR} - p_size - 4, 8, 31)::VARCHAR AS last_day FROM part WHERE p_size BETWEEN 1 AND 13""",
    "further_education": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'Year 2' ELSE 'Reception' END AS year_group,
  CASE WHEN p_size % 2 = 0 THEN 'FE Level ' || p_size WHEN p_size % 3 = 0 THEN 'Year 2' ELSE 'Reception' END AS kept FROM part""",
    "remove_diacritics": "SELECT doc_id, strip_accents(text) AS text FROM documents",
    "remove_punctuation": f"SELECT doc_id, {_strip(_collapse(f"translate({_strip('text')}, '{_MARKS}', '{' ' * len(PUNCTUATION)}')"))} AS text FROM documents",
    "format_postcode": f"SELECT c_custkey, CASE WHEN {_GOOD} THEN {_SPACED} END AS postcode, CASE WHEN {_GOOD} THEN {_SPACED} ELSE p END AS kept FROM (SELECT c_custkey, {_POSTCODE} AS p FROM customer)",
    "valid_postcode": f"SELECT c_custkey, regexp_full_match(upper(replace({_POSTCODE}, '  ', ' ')), '[A-Z]{{1,2}}[0-9][A-Z0-9]? [0-9][A-Z]{{2}}') AS valid FROM customer",
    "clean_year_group": """
SELECT p_partkey, CASE WHEN p_size = 0 THEN 'Reception' WHEN p_size BETWEEN 1 AND 13 THEN 'Year ' || p_size END AS from_text,
  CASE WHEN p_size = 0 THEN 'Reception' WHEN p_size BETWEEN 1 AND 13 THEN 'Year ' || p_size ELSE CAST(p_size AS VARCHAR) END AS from_number,
  CASE WHEN p_size BETWEEN 0 AND 13 THEN CAST(p_size AS BIGINT) END AS number FROM part""",
    "year_group_from_date": f"""
SELECT o_orderkey, CASE WHEN n = 0 THEN 'Reception' WHEN n < 0 THEN 'Student too young for school' WHEN n <= 13 THEN 'Year ' || n END AS year_group
FROM (SELECT o_orderkey, {START_YEAR} - year(o_orderdate) - CASE WHEN month(o_orderdate) >= 9 THEN 5 ELSE 4 END AS n FROM orders)""",
    "reverse_date": "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END::VARCHAR AS reversed FROM orders",
    "dob_range": f"SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 13 THEN make_date({START_YEAR} - p_size - 5, 9, 1) END::VARCHAR AS first_day, CASE WHEN p_size BETWEEN 0 AND 13 THEN make_date({START_YEAR} - p_size - 4, 8, 31) END::VARCHAR AS last_day FROM part",
    "snake_case_columns": "SELECT n_nationkey AS nation_key, n_name AS nation_name FROM nation",
    "fuzzy_score_pairs": f"""
WITH n AS (SELECT DISTINCT p_name FROM part), o AS (SELECT {_misspelt("p_name")} AS other, split_part(p_name, ' ', 1) AS f FROM n),
p AS (SELECT p_name, other, {_tokens("p_name")} AS s, {_tokens("other")} AS t FROM n JOIN o ON split_part(p_name, ' ', 1) = f)
SELECT p_name, other, round_even(200.0 * {_lcs("p_name", "other")} / (length(p_name) + length(other)), 2) AS ratio,
  round_even(200.0 * {_lcs("s", "t")} / (length(s) + length(t)), 2) AS token_sort FROM p""",
    "fuzzy_match": f"""
WITH {_PARTS}, {_best(70)}
SELECT l.row_key, l.name, l.size, l.brand, p.p_partkey AS "HEAT: p_partkey", p.p_name AS "HEAT: p_name", p.p_size AS "HEAT: p_size", p.p_brand AS "HEAT: p_brand",
  round_even(200.0 * b.c / b.n, 2) AS "Fuzzy Score", 'name, size and brand' AS "Match Type"
FROM l JOIN best b ON l.size = b.size AND l.brand = b.brand AND {_tokens("l.name")} = b.t JOIN part p USING (p_partkey)""",
    "fuzzy_remaining": f"""
WITH {_PARTS}, {_best(92)}
SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM best b WHERE l.size = b.size AND l.brand = b.brand AND {_tokens("l.name")} = b.t)""",
    "reused_records": f"""
WITH {_PARTS}, {_best(70)}
SELECT b.p_partkey, count(*) AS matches FROM l JOIN best b ON l.size = b.size AND l.brand = b.brand AND {_tokens("l.name")} = b.t GROUP BY b.p_partkey HAVING count(*) > 1""",
    "exact_match": "SELECT o_orderkey, o_custkey, o_totalprice, 'customer' AS \"Match Type\", c_name AS \"HEAT: c_name\" FROM orders JOIN customer ON o_custkey = c_custkey",
    "exact_match_verify": """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name AS "HEAT: c_name", 'customer' AS "Match Type", c_custkey AS "HEAT: c_custkey", c_nationkey AS "HEAT: c_nationkey"
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "exact_remaining": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "exact_match_null_keys": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, 'segment' AS \"Match Type\", c_mktsegment AS \"HEAT: segment_id\" FROM customer",
    "school_age_match": f"""
WITH {_SCHOOLS}
SELECT l.row_key, l.name, l.school, l.year_group, r.p_partkey AS "HEAT: p_partkey", r.p_name AS "HEAT: p_name", r.school AS "HEAT: school", r.dob::VARCHAR AS "HEAT: dob",
  round_even(200.0 * b.c / b.n, 2) AS "Fuzzy Score", 'school and age' AS "Match Type"
FROM l JOIN best b ON l.k = b.k AND l.a = b.a AND {_tokens("l.name")} = b.t JOIN r ON r.p_partkey = b.p_partkey""",
    "school_age_remaining": f"""
WITH {_SCHOOLS}
SELECT row_key, name, school, year_group FROM l WHERE NOT EXISTS (SELECT 1 FROM best b WHERE l.k = b.k AND l.a = b.a AND {_tokens("l.name")} = b.t)""",
    "waterfall": f"""
WITH {_PARTS}, {_best(80)},
exact AS (SELECT l.row_key, l.name, p.p_partkey AS register_key FROM l JOIN part p ON l.name = p.p_name AND l.size = p.p_size AND l.brand = p.p_brand)
SELECT row_key, name, 'exact' AS match_type, register_key FROM exact
UNION ALL SELECT l.row_key, l.name, 'fuzzy', b.p_partkey FROM l JOIN best b ON l.size = b.size AND l.brand = b.brand AND {_tokens("l.name")} = b.t
WHERE l.row_key NOT IN (SELECT row_key FROM exact)""",
    "dedupe_permissive": _duplicates(90, False, True),
    "dedupe_strict": _duplicates(75, True, True),
    "dedupe_twins_off": _duplicates(75, True, False),
    "dedupe_own_ids": _duplicates(85, True, False, "p_brand || ' ' || p_name", "'#' || row_number() OVER (ORDER BY p_partkey)", ', ids.id AS "Duplicate ID"'),
    "exact_dupe_groups": "SELECT p_partkey, p_name, p_size, p_brand, count(*) OVER (PARTITION BY p_name, p_size) AS group_size FROM part",
    "get_updates": f"WITH {_ORDERS} SELECT o_orderkey, CASE WHEN a IS DISTINCT FROM b AND trim(a) <> '' THEN a END AS update FROM o",
    "contextual_updates": f"WITH {_ORDERS} SELECT o_orderkey, CASE WHEN a IS DISTINCT FROM b AND trim(a) <> '' AND a NOT IN ('1-URGENT', '2-HIGH') THEN a END AS update FROM o",
    "multi_updates": f"""
WITH {_ORDERS} SELECT o_orderkey, CASE WHEN a IS DISTINCT FROM b AND trim(a) <> '' AND a <> '1-URGENT' THEN a END AS update_priority,
  CASE WHEN c IS DISTINCT FROM d THEN c END AS update_price FROM o""",
    "error_report": f"""
WITH {_ERRORS} SELECT event_id, CAST(small AS BIGINT) + CAST(cheap AS BIGINT) AS n_errors,
  CASE WHEN small AND cheap THEN '''value'': too small; ''Model Error'': cheap purchase' WHEN small THEN '''value'': too small' WHEN cheap THEN '''Model Error'': cheap purchase' END AS details,
  CASE WHEN small OR cheap THEN 'Invalid' ELSE 'Valid' END AS status FROM e""",
    "error_report_dates": """
SELECT event_id, CAST(ts AS DATE)::VARCHAR AS day, CAST(v IS NULL OR v < 1 AS BIGINT) + CAST(coalesce(event_type = 'purchase', false) AND (v IS NULL OR v < 50) AS BIGINT) AS n_errors
FROM (SELECT event_id, ts, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""",
    "error_report_counts": f"WITH {_ERRORS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE small OR cheap) AS n_invalid, CAST(coalesce(sum(CAST(small AS BIGINT) + CAST(cheap AS BIGINT)), 0) AS BIGINT) AS n_errors FROM e",
}
