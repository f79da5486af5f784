"""SQL for DuckDB that says what queries of this subpackage must return, by plain comparison of everything."""

from __future__ import annotations

import string

from .license_scan import TEMPLATES
from .secret_scan import RULES

_LOW = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACED = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
_PLAIN = r"coalesce(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_PLAIN_TEXT = _PLAIN.format(_LOW.format("text"))
_NOTICES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)

#: Components of documents that links of 4-word shingles join.
_COMPONENTS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SPACED.format(_LOW.format("text"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {{percent}} * (x.n + y.n - i)),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
"""

ORACLES = {
    "op1_substring_dedup": f"""WITH d AS MATERIALIZED (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
r AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (g) WHERE low < doc_id),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM w ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op3_license_scans": f"""WITH t AS (SELECT license, {_PLAIN_TEXT} AS w FROM (VALUES {_NOTICES}) v(license, text)),
tg AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT license, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS side FROM tg GROUP BY license),
d AS MATERIALIZED (SELECT doc_id, {_PLAIN_TEXT} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, license, n, g, unnest(CASE side WHEN 1 THEN [p] ELSE [p // side, p // side - 1] END) AS win FROM g JOIN tg USING (g) JOIN tn USING (license)),
ok AS (SELECT DISTINCT doc_id, license FROM m WHERE win >= 0 GROUP BY doc_id, license, n, win HAVING 100 * count(DISTINCT g) >= 80 * n)
SELECT doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses FROM d LEFT JOIN ok USING (doc_id) GROUP BY doc_id""",
    "op5_benchmark_decontamination": f"""WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN_TEXT} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN_TEXT} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS MATERIALIZED (SELECT doc_id, n, i, item_id FROM g JOIN win USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op9_ngram_jaccard_join": _COMPONENTS.format(percent=85) + "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id",
    "op13_minhash_near_dedup": _COMPONENTS.format(percent=80) + "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id",
}


def _matches(order: int, kind: str, regex: str, group: int, least: int) -> str:
    """Spans of a rule: lengths of what stands between matches and of the matches add up to their places."""
    regex = regex.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, begin, begin + len(w[i]) AS stop FROM (SELECT *, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0) AS begin FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS w, regexp_extract_all(t, '{regex}', {group}) AS h, string_split_regex(t, '{regex}') AS p FROM d))) WHERE len(h[i]) >= {least}"""


_SPAN = "kind || ':' || begin::BIGINT || ':' || stop::BIGINT"
ORACLES["op7_secret_scans"] = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(_matches(k, r.kind, r.regex, r.group, r.least) for k, r in enumerate(RULES))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY begin, o) FILTER (WHERE o < {sum(r.base for r in RULES)}), '')) AS base_sha256, coalesce(string_agg({_SPAN}, ',' ORDER BY begin, o) FILTER (WHERE kind IS NOT NULL), '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""

#: Table of CRC-32, and the CRC-32 of a text's UTF-8 with it (t.t).
_CRC_TABLE = "t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(key: str) -> str:
    octets = f"list_transform(range(octet_length(encode({key}))), lambda i: ('0x' || substr(hex(encode({key})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _edit(state: str, cost: str, letter: str, allowed: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {allowed} THEN {{'c': struct_extract({state}, 'c') + {cost}, 'a': struct_extract({state}, 'a') || '{letter}'}} END"


def _closed(columns: str, states: str) -> str:
    """The four states with inserts: to user from all but user, then to assistant."""
    inner = f"SELECT {columns}, n0, n1, list_min([n2, {', '.join(_edit(s, '5', 'I') for s in ('n0', 'n1', 'n3'))}]) AS n2, n3 FROM ({states})"
    return f"SELECT {columns}, n0, n1, n2, list_min([n3, {_edit('n2', '5', 'I')}]) AS n3 FROM ({inner})"


_STAY = "CASE WHEN truncated THEN 5 ELSE 0 END"
_KEPT = {s: {x: _edit(s, _STAY, "K", f"NOT forced AND initial = '{x}'") for x in "sua"} for s in ("n0", "n1", "n2", "n3")}
_REROLED = {s: _edit(s, f"1 + {_STAY}", "R", "NOT forced") for s in ("n0", "n1", "n2", "n3")}
_STEP = f"""SELECT conv_id, pos, {_edit("n0", "2", "D")} AS n0, list_min([{_edit("n1", "2", "D")}, {_KEPT["n0"]["s"]}]) AS n1,
list_min([{_edit("n2", "2", "D")}, {", ".join(x for s in ("n0", "n1", "n3") for x in (_KEPT[s]["u"], _REROLED[s]))}]) AS n2,
list_min([{_edit("n3", "2", "D")}, {_KEPT["n2"]["a"]}, {_REROLED["n2"]}]) AS n3 FROM (SELECT r.*, n0, n1, n2, n3 FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.pos = v.pos + 1)"""
ORACLES["op12_conversation_repair"] = rf"""WITH RECURSIVE {_CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, coalesce((lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1)) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM p),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, illegal, blank, again AND NOT blank AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, blank OR again AS forced FROM f),
v AS (SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS n0, NULL::STRUCT(c BIGINT, a VARCHAR) AS n1, {{'c': 5::BIGINT, 'a': 'I'}} AS n2, {{'c': 10::BIGINT, 'a': 'II'}} AS n3 FROM (SELECT DISTINCT conv_id FROM r)
UNION ALL {_closed("conv_id, pos", _STEP)}),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(pos) AS last FROM r GROUP BY conv_id),
e AS MATERIALIZED (SELECT g.*, list_min([n0, n3]) AS best FROM g JOIN v ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.pos = g.last),
l AS (SELECT conv_id, j, substr(struct_extract(best, 'a'), j, 1) AS edit FROM (SELECT conv_id, best, unnest(range(1, length(struct_extract(best, 'a')) + 1)) AS j FROM e)),
m AS (SELECT conv_id, edit, j, count(*) FILTER (WHERE edit <> 'I') OVER w AS pos, count(*) FILTER (WHERE edit <> 'D') OVER w AS nth FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
o AS (SELECT m.conv_id, nth, edit, CASE WHEN edit <> 'I' THEN role END AS role, CASE edit WHEN 'I' THEN '' ELSE text END AS text, max(CASE WHEN nth = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS s FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.pos = m.pos AND edit <> 'I' WHERE edit <> 'D'),
x AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth) AS whole FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(struct_extract(best, 'c'), 0) AS cost, coalesce(struct_extract(best, 'a'), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLES["op11_spelling_variants"] = rf"""WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT w, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM u, t),
d AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM h),
n AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS x FROM (SELECT word, n, unnest(range(length(word))) AS i FROM n)),
l AS (SELECT DISTINCT n.word AS short, n.n AS short_n, x.word AS long, x.n AS long_n FROM n JOIN x ON n.word = x.x),
p AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM x a JOIN x b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION ALL SELECT short, long, long_n FROM l UNION ALL SELECT long, short, short_n FROM l),
b AS (SELECT a, count(*) AS n_near, max(m) AS m FROM p GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(b.n_near, 0) AS n_near, form, CASE WHEN form IS NOT NULL THEN b.m END AS form_n FROM n LEFT JOIN b ON b.a = n.word LEFT JOIN (SELECT p.a, min(p.b) AS form FROM p JOIN b ON b.a = p.a AND b.m = p.m JOIN n ON n.word = p.a WHERE p.m >= 10 * n.n GROUP BY p.a) q ON q.a = n.word),
r AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, max_by(root, depth) AS root FROM r GROUP BY word) USING (word)"""
