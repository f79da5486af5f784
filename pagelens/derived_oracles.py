"""SQL for the queries of ``derived_queries``, by plain comparison of everything."""

from __future__ import annotations

from .derived_queries import RULES
from .operators.crawl import AGENTS
from .oracles import _HOST, _PATH, _SEGMENT, _TITLE, _clean, _tags, _terms


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WHITE = "' ' || chr(9) || chr(10)"
_ADDRESSES = f"a AS MATERIALIZED (SELECT page_id, url, {_HOST} AS site, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages)"
_BODIES = f"""{_ADDRESSES},
s AS (SELECT site, min(regexp_extract(path, '^/([^/]*)', 1)) AS step, min(page_id) AS first FROM a GROUP BY site),
b AS (SELECT site, [200, 200, 404, 200, 503, 200, 200, 403, 200, 200][(first % 10 + 1)::INT] AS status, replace([{", ".join(map(_text, RULES))}][length(site) % 5 + 1], '{{}}', step) AS body FROM s),
o AS MATERIALIZED (SELECT site, body, CASE WHEN status = 404 THEN 'no file' WHEN status <> 200 THEN 'not fetched' WHEN trim(body, {_WHITE}) = '' THEN 'blank' ELSE 'rules' END AS reason FROM b)"""
_RULES = rf"""{_BODIES},
l AS (SELECT site, pos, trim(regexp_replace(lines[pos], '#.*$', ''), {_WHITE}) AS x FROM (SELECT site, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT site, string_split(body, chr(10)) AS lines FROM o WHERE reason = 'rules'))),
k AS (SELECT site, pos, lower(trim(split_part(x, ':', 1), {_WHITE})) AS key, trim(substr(x, strpos(x, ':') + 1), {_WHITE}) AS value FROM l WHERE contains(x, ':')),
f AS (SELECT *, key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent' AS fresh FROM k WHERE key IN ('user-agent', 'allow', 'disallow')),
g AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY site ORDER BY pos) AS grp FROM f),
n AS MATERIALIZED (SELECT DISTINCT site, grp, lower(value) AS agent FROM g WHERE key = 'user-agent'),
r AS MATERIALIZED (SELECT site, grp, key AS kind, value FROM g WHERE key <> 'user-agent' AND grp > 0)"""
_AGENTS = ", ".join(f"('{c}', '{a}')" for c, names in AGENTS.items() for a in names)
_VERDICTS = rf"""{_RULES},
w AS (SELECT * FROM (VALUES {_AGENTS}) v(class, agent)),
c AS (SELECT o.site, class, w.agent, min_by(n.grp, (CASE n.agent WHEN lower(w.agent) THEN 0 ELSE 1 END) * 1000000 + n.grp) AS grp, min(CASE n.agent WHEN lower(w.agent) THEN 0 ELSE 1 END) AS rank FROM o CROSS JOIN w LEFT JOIN n ON n.site = o.site AND n.agent IN (lower(w.agent), '*') WHERE reason <> 'not fetched' GROUP BY ALL),
m AS (SELECT page_id, site, grp, kind, value FROM a JOIN r USING (site) WHERE value <> '' AND regexp_matches(path, '^' || replace(regexp_replace(value, '([.+?^(){{}}\[\]|\\])', '\\\1', 'g'), '*', '.*'))),
v AS MATERIALIZED (SELECT page_id, class, c.agent, CASE WHEN grp IS NULL THEN 'none' WHEN rank = 0 THEN 'explicit' ELSE 'wildcard' END AS grp_kind, kind, value FROM a JOIN c USING (site) LEFT JOIN m USING (page_id, site, grp) QUALIFY row_number() OVER (PARTITION BY page_id, c.agent ORDER BY length(value) DESC NULLS LAST, kind, value DESC) = 1)"""
_LOCATION = r"""CASE WHEN location LIKE 'http%' THEN location WHEN location LIKE '//%' THEN split_part(url, '//', 1) || location WHEN location LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || location ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || substr(location, 8) END"""
_LANDINGS = rf"""WITH RECURSIVE {_ADDRESSES},
j AS (SELECT a.*, b.url AS next FROM a LEFT JOIN a b ON b.page_id = a.page_id + 1),
x AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN [200, 404, 503, NULL][(page_id % 4 + 1)::INT] WHEN page_id % 13 = 8 THEN 200 ELSE [301, 302, 308][(page_id % 3 + 1)::INT] END AS status,
CASE WHEN page_id % 7 = 0 OR page_id % 13 = 7 THEN NULL WHEN page_id % 13 = 5 THEN '?from=' || page_id WHEN page_id % 13 = 6 THEN url WHEN page_id % 2 = 0 THEN next ELSE regexp_replace(next, '^[a-z]+:', '') END AS location FROM j
UNION ALL SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/r/' || page_id, 302, '../x/..' || path FROM a UNION ALL SELECT url, 599, NULL FROM a WHERE page_id % 17 = 0),
y AS (SELECT url, status, location FROM x QUALIFY row_number() OVER (PARTITION BY url ORDER BY status NULLS LAST, coalesce(location, '')) = 1),
h AS MATERIALIZED (SELECT url, status, CASE WHEN status BETWEEN 300 AND 399 THEN {_LOCATION} END AS next FROM y),
w AS (SELECT url AS start, url, 0 AS hops FROM h UNION ALL SELECT start, next, hops + 1 FROM w JOIN h USING (url) WHERE next IS NOT NULL AND hops < 5),
z AS MATERIALIZED (SELECT start, url, CASE WHEN hops < 5 THEN status END AS status, hops FROM w LEFT JOIN h USING (url) QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1)"""
_HEADS = f"""t AS MATERIALIZED (SELECT page_id, url, {_HOST} AS site, CASE WHEN page_id % 11 > 0 THEN {_TITLE} END AS title, CASE WHEN page_id % 11 > 0 THEN {_terms(f"concat_ws(' ', coalesce({_TITLE}, ''), array_to_string(list_distinct({_tags('html', 'h1')})[1:2], ' '))")} END AS terms FROM pages)"""

DERIVED_ORACLES = {
    "page_robots_verdicts": f"WITH {_VERDICTS} SELECT page_id, agent, grp_kind, coalesce(kind = 'allow', true) AS allowed, CASE kind WHEN 'allow' THEN 'Allow: ' WHEN 'disallow' THEN 'Disallow: ' END || value AS rule FROM v",
    "page_index_gate": f"""WITH {_VERDICTS} SELECT page_id, CASE WHEN bool_and(class = 'training' OR coalesce(kind = 'allow', true)) AND page_id % 9 > 0 THEN 1 ELSE 0 END AS "G2" FROM v GROUP BY page_id""",
    "site_robots_observation": f"WITH {_BODIES} SELECT site, reason <> 'not fetched' AS observed, reason FROM o",
    "site_robots_groups": f"WITH {_RULES} SELECT n.site, n.grp, n.agent, kind, value FROM n LEFT JOIN r USING (site, grp)",
    "site_blocked_classes": f"""WITH {_RULES}, w AS (SELECT * FROM (VALUES {_AGENTS}) v(class, agent)),
c AS (SELECT o.site, class, w.agent, min_by(n.grp, (CASE n.agent WHEN lower(w.agent) THEN 0 ELSE 1 END) * 1000000 + n.grp) AS grp FROM o CROSS JOIN w LEFT JOIN n ON n.site = o.site AND n.agent IN (lower(w.agent), '*') WHERE reason <> 'not fetched' GROUP BY ALL),
d AS (SELECT site, class, agent, coalesce((SELECT max_by(kind = 'allow', length(value) * 2 + (kind = 'allow')::INT) FROM r WHERE r.site = c.site AND r.grp = c.grp AND value IN ('/', '/*', '/$')), true) AS allowed FROM c)
SELECT site, class, bool_and(allowed) AS allowed, coalesce(string_agg(agent, ',' ORDER BY agent) FILTER (WHERE NOT allowed), '') AS blocked FROM d GROUP BY site, class""",
    "site_sitemap_lines": f"WITH {_BODIES} SELECT site, (pos - 1)::INT AS pos, lines[pos] AS line FROM (SELECT site, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT site, regexp_extract_all(body, '(?im)^ *sitemap *: *([^ \\n]+)', 1) AS lines FROM o WHERE reason = 'rules'))",
    "site_noindex_lines": f"WITH {_BODIES} SELECT site, '/old' AS path FROM o WHERE reason = 'rules' AND contains(body, 'Noindex: /old')",
    "page_redirects": f"{_LANDINGS} SELECT * FROM z",
    "page_canonical_landing": f"""{_LANDINGS} SELECT start, CASE WHEN status = 200 THEN 3 WHEN status = 404 OR status >= 500 THEN 0 WHEN status IS NULL THEN NULL WHEN hops <= 1 THEN 2 ELSE 1 END AS "T5" FROM z""",
    "page_peer_items": f"""WITH {_HEADS},
l AS (SELECT site, list(url ORDER BY page_id) AS urls FROM t WHERE page_id % 3 > 0 GROUP BY site),
u AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN urls ELSE [url] || coalesce(urls, []) END AS urls FROM t LEFT JOIN l USING (site)),
k AS (SELECT page_id, urls, unnest(range(0, len(urls))) AS i, greatest(1, len(urls) // 6) AS step FROM u),
p AS MATERIALIZED (SELECT k.page_id, i // step AS nth, t.url, t.title, t.terms FROM k JOIN t ON t.url = k.urls[i + 1] AND t.terms IS NOT NULL WHERE i % step = 0 AND i // step < 6),
c AS (SELECT a.page_id, count(*) AS n, string_agg(a.url || ' ' || b.url, '|' ORDER BY a.url || ' ' || b.url) AS shown FROM p a JOIN p b ON a.page_id = b.page_id AND a.nth < b.nth WHERE len(list_intersect(a.terms, b.terms)) >= 0.6 * len(list_distinct(a.terms || b.terms)) AND len(a.terms) > 0 AND len(b.terms) > 0 GROUP BY a.page_id),
d AS (SELECT t.page_id, count(*) AS n FROM t JOIN p ON p.page_id = t.page_id AND p.title = t.title AND p.url <> t.url AND t.title <> '' GROUP BY t.page_id),
m AS (SELECT page_id, count(*) AS n FROM p GROUP BY page_id)
SELECT t.page_id, coalesce(m.n, 0)::INT AS n_peers, coalesce(c.n, 0)::INT AS n_clashes, coalesce(shown, '') AS clashes, coalesce(d.n, 0)::INT AS n_twins, CASE WHEN coalesce(m.n, 0) < 3 THEN NULL WHEN coalesce(c.n, 0) = 0 THEN 3 WHEN c.n = 1 THEN 2 WHEN c.n <= 3 THEN 1 ELSE 0 END AS "K1"
FROM t LEFT JOIN m USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN d USING (page_id)""",
}

# What was spliced in follows from page_id; only the text of the page itself is read for the values that should stand in it.
_MISSED = f"""SELECT page_id, CASE page_id % 7 WHEN 1 THEN [12.5::VARCHAR] WHEN 6 THEN ['4.5', '7', 'True'] END AS told, {_clean("html")} || CASE page_id % 2 WHEN 0 THEN ' 12.5 ' ELSE '' END AS body, url FROM pages"""
DERIVED_ORACLES |= {
    "page_jsonld_types": "SELECT page_id, [0, 1, 1, 2, 1, 1, 1][(page_id % 7 + 1)::INT] AS blocks, CASE WHEN page_id % 7 IN (2, 5) THEN 1 ELSE 0 END AS broken, ['', 'Article', 'Product', 'FAQPage,Organization', 'Thing', 'Article', 'HowTo,Thing'][(page_id % 7 + 1)::INT] AS types FROM pages",
    "page_jsonld_values": """SELECT page_id, key, value FROM pages JOIN (VALUES (1, '@type', 'Article'), (1, 'price', '12.5'), (3, '@type', 'Organization'), (3, '@type', 'FAQPage'), (4, '@type', 'Thing'), (6, 'ratingValue', '4.5'), (6, 'reviewCount', '7'), (6, 'ratingCount', 'True')) v(rest, key, value) ON page_id % 7 = rest""",
    "page_declared_items": f"""WITH m AS ({_MISSED}), n AS (SELECT page_id, len(list_filter(told, lambda x: NOT contains(body, x))) AS missed FROM m)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN contains(url, '#') THEN 1 ELSE 3 END WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS "T4", CASE page_id % 7 WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE 3 END AS "T7", [0, 2, 2, 3, 1, 2, 3][(page_id % 7 + 1)::INT] AS "T8",
CASE missed WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS "T9", CASE page_id % 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE CASE WHEN {_SEGMENT} IS NULL THEN NULL ELSE 0 END END AS "I3" FROM pages JOIN n USING (page_id)""",
    "page_descriptions": f"SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'Page ' || page_id || ' of ' || {_HOST} || ', one of many' WHEN 3 THEN 'it' END AS description FROM pages",
    "page_image_list": """SELECT page_id, pos, CASE WHEN rest = 1 AND pos = 0 THEN '/i/' || page_id || '.png' ELSE src END AS src, CASE WHEN rest = 1 AND pos = 0 THEN 'pic ' || page_id ELSE alt END AS alt FROM pages JOIN (VALUES (1, 0, NULL, NULL), (1, 1, '', ''), (2, 0, '/j.png', NULL)) v(rest, pos, src, alt) ON page_id % 3 = rest""",
    "page_outside_domains": "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'in.net,out' || page_id % 10 || '.org' ELSE '' END AS domains FROM pages",
    "page_noindex_signals": "SELECT page_id AS id, 'meta' AS place FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT page_id, 'header' FROM pages WHERE page_id % 14 = 0",
}
