"""DuckDB SQL for the corpus operators that SQL can express over whole tables.

The others are held against brute force, library results, round trips or held-out accuracy in tests/llm.
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e AS a JOIN e AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, both_.b FROM r JOIN both_ ON r.reach = both_.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""

_FIVE = "CAST(concat('0x', substr(hex, 5 * g + 1, 5)) AS BIGINT)"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_FIVE} >> {shift}) & 31 AS INT) + 1, 1)" for shift in (15, 10, 5, 0))

_WARC = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {_LETTERS}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""



def _matches(text: str, pattern: str) -> str:
    """A list of (s, m): where each match starts, and the match."""
    parts, found = f"regexp_split_to_array({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST(coalesce(list_sum(list_transform({parts}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'm': {found}[i]}})"


_KINDS = [
    (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    (1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) <= 255))"),
    (2, "card", r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT) ELSE CAST(substr(reverse(d), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse(d), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
]
_FOUND = " UNION ALL ".join(f"SELECT uid, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e, CASE {k} WHEN 0 THEN '0:' || lower(m) WHEN 1 THEN '1:' || m ELSE '{k}:' || d END AS value FROM (SELECT uid, u.s AS s, u.m AS m, regexp_replace(u.m, '[^0-9]', '', 'g') AS d FROM (SELECT uid, unnest({_matches('t', pattern)}) AS u FROM docs)) WHERE {check}" for k, kind, pattern, check in _KINDS)
_TERM = r"\p{L}{4,}"

_PII = f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
held AS (SELECT DISTINCT uid, value FROM found),
words AS (SELECT DISTINCT uid, lower(w) AS term FROM (SELECT uid, unnest(regexp_extract_all(t, '{_TERM}')) AS w FROM docs) AS x),
ne AS (SELECT value, count(*) AS ne FROM held GROUP BY 1),
nt AS (SELECT term, count(*) AS nt FROM words GROUP BY 1),
pairs AS (SELECT value, term, count(*) AS net FROM held JOIN words USING (uid) GROUP BY 1, 2),
rated AS (SELECT value, term, net, nt, ne / (total + 1) AS p FROM pairs JOIN ne USING (value) JOIN nt USING (term) CROSS JOIN (SELECT count(*) AS total FROM docs) AS c),
risky AS (SELECT value, term FROM rated WHERE ln((net + 0.5 * p) / (nt + 0.5) / p) / -ln(p) >= 0.9),
gone AS (SELECT DISTINCT uid, term FROM held JOIN risky USING (value)),
placed AS (SELECT uid, lower(u.m) AS term, u.s AS s, u.s + length(u.m) AS e FROM (SELECT uid, unnest({_matches('t', _TERM)}) AS u FROM docs WHERE uid IN (SELECT uid FROM gone)) AS x),
free AS (SELECT p.* FROM placed p JOIN gone USING (uid, term) WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.uid = p.uid AND f.s < p.e AND f.e > p.s)),
every AS (SELECT uid, s, k, kind, e FROM found UNION ALL SELECT uid, s, 4, 'term', e FROM free),
listed AS (SELECT uid, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k, e) FILTER (WHERE k < 4) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k, e) AS spans,
  count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone FROM every GROUP BY uid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (uid)
"""

ORACLE: dict[str, str] = {"op5_pii_sanitise": _PII, "op6_jaccard_join": _JACCARD, "op7_warc": _WARC}
