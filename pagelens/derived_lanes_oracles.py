"""SQL for the queries of ``derived_lanes``: what was derived by id gives its results by id."""

from __future__ import annotations

from .derived_lanes import DATES
from .derived_oracles import _ADDRESSES, _BODIES
from .functions.text import MARKETING
from .oracles import _DATED, _FIRST, _FIRST_SENTENCE, _HOST, _IS_FACT, _LONG, _PAGE, _PATH, _SITE_TERMS, _TITLE, ORACLES, _clean, _terms
from .plans.fixes import CHECKS, FIXES
from .site_oracles import _MINE, SITE_ORACLES


def _list(*values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SITES = f"""{_ADDRESSES}, s AS MATERIALIZED (SELECT site, length(site) AS n, min(page_id) AS first, 'https://' || site AS origin FROM a GROUP BY site)"""
_POINTS = f"""{_SITES}, v AS (SELECT *, v, begin || site AS url FROM s, (VALUES (0, 'http://'), (1, 'http://www.'), (2, 'https://'), (3, 'https://www.')) x(v, begin)),
e AS (SELECT site, url AS variant, CASE WHEN [200, 200, 403, NULL, 200][((n + v * first) % 5 + 1)::INT] = 200 THEN ['https://' || site || '/', 'https://' || upper(site) || ':443', url][((first + v * (n % 2)) % 3 + 1)::INT] END AS final FROM v)"""
# What a site's robots.txt declares comes first; an address that has to be joined counts as usable but not as declared.
_MAPS = f"""{_BODIES}, n AS (SELECT o.site, length(o.site) AS n, s.first, contains(body, 'Sitemap: /a.xml') AND reason = 'rules' AS own, contains(body, 'SITEMAP: https://x.org') AND reason = 'rules' AS far FROM o JOIN s USING (site)),
c AS (SELECT site, 'https://' || site AS origin, n % 3 AS kind, far, CASE WHEN own AND first % 2 = 0 THEN 'a.xml' WHEN n % 3 = 0 THEN 'sitemap.xml' WHEN n % 3 = 1 THEN 'sitemap_index.xml' END AS chosen FROM n)"""
_XML = "replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_EVIDENCE = f"""{_PAGE}, x AS (SELECT page_id, title, words, nav, blocks, h1, {_terms('coalesce(title, \'\')')} AS tt, {_terms("array_to_string(h1, ' ')")} AS th, {_terms(f"regexp_replace({_PATH}, '[-_/]+', ' ', 'g')")} AS tu, {_terms(f"coalesce({_FIRST_SENTENCE}, '')")} AS tf FROM p WHERE page_id % 13 > 0),
y AS (SELECT *, list_sort(list_intersect(tt, {_terms(f"array_to_string({_FIRST}, ' ')")})) AS hit, len(list_filter({_FIRST}, lambda w: list_contains(nav, lower(w)))) AS in_nav, list_filter(blocks, lambda b: {_IS_FACT}) AS held, flatten(list_transform(blocks, lambda b: regexp_extract_all(b.text, '{MARKETING}'))) AS phrases FROM x),
k AS (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest(tt || th || tu || tf) AS term FROM x) GROUP BY ALL), m AS (SELECT page_id, max(n) AS most FROM k GROUP BY page_id),
z AS (SELECT page_id, most, CASE WHEN most > 1 THEN list(term ORDER BY term) ELSE [] END AS terms FROM k JOIN m USING (page_id) WHERE n = most GROUP BY page_id, most),
r AS (SELECT page_id, 'C2' AS item, CASE WHEN len(hit) >= 2 THEN CASE WHEN in_nav / greatest(1, len({_FIRST})) < 0.3 THEN 3 WHEN in_nav / greatest(1, len({_FIRST})) <= 0.6 THEN 2 ELSE 1 END WHEN len(hit) = 1 THEN 1 ELSE 0 END AS score, len(hit) AS n, in_nav AS of, array_to_string(hit[1:6], '|') AS evidence FROM y
UNION ALL SELECT page_id, 'C3', CASE WHEN coalesce(len(held) / nullif(len(blocks), 0), 0) >= 0.3 THEN 3 WHEN len(held) / nullif(len(blocks), 0) >= 0.15 THEN 2 WHEN len(held) > 0 THEN 1 ELSE 0 END, len(held), len(blocks), array_to_string(list_transform(held[1:3], lambda b: b.text[1:110]), '|') FROM y
UNION ALL SELECT page_id, 'C4', CASE len(phrases) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END, len(phrases), len(blocks), array_to_string(phrases[1:5], '|') FROM y
UNION ALL SELECT y.page_id, 'K2', CASE coalesce(most, 0) WHEN 4 THEN 3 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END, coalesce(most, 0), 4, coalesce(array_to_string(terms[1:5], '|'), '') FROM y LEFT JOIN z USING (page_id))"""
_TEXT = f"CASE page_id % 4 WHEN 1 THEN 'Page ' || page_id || ' of ' || {_HOST} || ', one of many' WHEN 3 THEN 'it' END"
_HTML = """'<p>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || ['', '<p>They say amazing things.</p><p>It is the best ever.</p>', '<p>Plain.</p>'][(doc_id % 3 + 1)::INT]
|| ['', '<a href=''/a''>a</a><a href=''/b''>b</a><a href=''/a''>a</a>', '<a href=''/a''>a</a><a href=''/b''>b</a><a href=''/c''>c</a>', '<a href=''/1''>1</a><a href=''/2''>2</a><a href=''/3''>3</a><a href=''/4''>4</a><a href=''/5''>5</a>'][(doc_id % 4 + 1)::INT]
|| ['', '<img src=''a.png''>', '<img src=''a.png'' alt=''a''><figcaption>A</figcaption>'][(doc_id % 3 + 1)::INT]
|| ['', '<script type="application/ld+json">{"@type":["ImageObject","HowTo"]}</script>', '<script type="application/ld+json">{"@type":"Article",}</script>', '<script type="application/ld+json">{"@type":"Other"}</script>', '<script type="application/ld+json">{</script>'][(doc_id % 5 + 1)::INT] || ['', '<p>Open [待核]</p>'][(doc_id % 2 + 1)::INT]"""
_CARD = ORACLES["lane_scorecard"]

LANE_ORACLES = {
    "page_lastmod_dates": f"SELECT page_id, {_list(*(d for d, _ in DATES))}[(page_id % {len(DATES)} + 1)::INT] AS lastmod, [{', '.join(str(v).lower() for _, v in DATES)}][(page_id % {len(DATES)} + 1)::INT] AS valid FROM pages",
    "page_joined_links": r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[^?#]*') AS page, regexp_replace(url, '#.*$', '') AS bare FROM pages), d AS (SELECT *, regexp_replace(page, '[^/]*$', '') AS folder FROM u)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://o.org/x' WHEN 1 THEN split_part(origin, '//', 1) || '//cdn.net/' || page_id WHEN 2 THEN origin || '/root?q=' || page_id WHEN 3 THEN folder || 'page' || page_id || '.html' WHEN 4 THEN regexp_replace(folder, '[^/]*/$', '') || 'up/' || page_id WHEN 5 THEN page || '?only=' || page_id WHEN 6 THEN bare || '#part' ELSE 'mailto:a@b.c' END AS joined FROM d""",
    "page_source_tier": "SELECT page_id, ['first', 'first', 'weak', 'first', 'first', 'second'][(page_id % 6 + 1)::INT] AS tier FROM pages",
    "site_entry_points": f"WITH {_POINTS} SELECT site, variant, final FROM e",
    "site_variant_landings": f"""WITH {_POINTS}, g AS (SELECT site, count(final) AS seen, count(*) FILTER (WHERE final IS NULL) AS missing, count(DISTINCT CASE WHEN contains(final, ':443') OR final = 'https://' || site || '/' THEN 'https://' || site ELSE final END) AS places FROM e GROUP BY site)
SELECT site, seen, missing, places, CASE WHEN seen < 2 THEN NULL WHEN places = 1 THEN CASE WHEN missing = 0 THEN 3 ELSE 2 END WHEN places = 2 THEN 1 ELSE 0 END AS "T6" FROM g""",
    "site_sitemaps": f"WITH {_MAPS} SELECT site, origin || '/' || chosen AS url FROM c WHERE chosen IS NOT NULL",
    # Without a usable address, /sitemap.xml was not found and /sitemap_index.xml failed, but two more are never answered.
    "site_sitemap_found": f"""WITH {_MAPS} SELECT c.site, CASE WHEN chosen IS NOT NULL AND far THEN 3 WHEN chosen IS NOT NULL THEN 2 END AS "T1" FROM c""",
    "site_sitemap_entries": f"""WITH {_MAPS}, l AS (SELECT site, url, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS pos FROM a WHERE NOT contains(url, '<'))
SELECT site, pos::INT AS pos, {_XML} AS loc, CASE WHEN page_id % 2 = 0 THEN '2026-08-20' END AS lastmod FROM l JOIN c USING (site) WHERE chosen = 'sitemap.xml' AND pos < 40
UNION ALL SELECT site, x.pos, CASE x.pos WHEN 0 THEN origin || '/first' WHEN 1 THEN '/loose' ELSE '#frag' END, NULL FROM c, (VALUES (0), (1), (2)) x(pos) WHERE chosen = 'sitemap_index.xml' UNION ALL SELECT site, 0, '/declared', NULL FROM c WHERE chosen = 'a.xml'""",
    "site_sitemap_limits": f"WITH {_MAPS} SELECT site, issue FROM c, (VALUES ('index_truncated'), ('child_unreachable')) x(issue) WHERE chosen = 'sitemap_index.xml'",
    "sitemap_issue_examples": f"""WITH e AS (SELECT {_HOST} AS site, page_id, CASE WHEN page_id % 11 = 0 THEN '/rel/' || page_id ELSE url END AS loc, CASE WHEN page_id % 3 = 1 THEN page_id || '.01.2026' END AS bad FROM pages),
i AS (SELECT site, 'relative' AS issue, page_id, loc AS example FROM e WHERE starts_with(loc, '/') UNION ALL SELECT site, 'cross_host', page_id, loc FROM e WHERE NOT starts_with(loc, '/') AND regexp_replace(regexp_extract(lower(loc), '^https?://([^/?#:]*)', 1), '^www\\.', '') <> site
UNION ALL SELECT site, 'fragment', page_id, loc FROM e WHERE contains(loc, '#') UNION ALL SELECT site, 'lastmod_format', page_id, bad FROM e WHERE bad IS NOT NULL)
SELECT site, issue, (row_number() OVER (PARTITION BY site, issue ORDER BY page_id DESC) - 1)::INT AS nth, example FROM i QUALIFY row_number() OVER (PARTITION BY site, issue ORDER BY page_id DESC) <= 2""",
    "title_classes": f"{_SITE_TERMS}, s AS (SELECT site, page_id, array_to_string(list(term ORDER BY term), ' ') AS terms FROM (SELECT DISTINCT site, page_id, term FROM t) GROUP BY ALL) SELECT site, page_id, min(page_id) OVER w AS class, count(*) OVER w AS n_pages FROM s WINDOW w AS (PARTITION BY site, terms)",
    "title_class_links": f"""{_SITE_TERMS}, s AS (SELECT site, page_id, list(term ORDER BY term) AS terms FROM (SELECT DISTINCT site, page_id, term FROM t) GROUP BY ALL), c AS (SELECT site, terms, min(page_id) AS class, count(*) AS n FROM s GROUP BY ALL),
x AS (SELECT a.site, a.class AS a, b.class AS b, a.n AS pages_a, b.n AS pages_b, len(list_intersect(a.terms, b.terms)) AS i, len(a.terms) + len(b.terms) AS u FROM c a JOIN c b ON a.site = b.site AND a.class < b.class)
SELECT site, a, b, pages_a, pages_b, round(i / (u - i), 9) AS jaccard FROM x WHERE i >= 0.6 * (u - i)""",
    "page_item_evidence": f"""{_EVIDENCE} SELECT page_id, item, true AS machine_locked, true AS observed, score, n::INT AS n, of::INT AS of, evidence, NULL::VARCHAR AS reason FROM r
UNION ALL SELECT page_id, item, true, false, NULL, NULL, NULL, NULL, 'page not observed' FROM pages, (VALUES ('C2'), ('C3'), ('C4'), ('K2')) i(item) WHERE page_id % 13 = 0""",
    "page_meta_lengths": f"""WITH p AS (SELECT page_id, {_HOST} AS site, {_TITLE} AS title, {_TEXT} AS text FROM pages), t AS (SELECT *, len(coalesce(title, '')) AS n, len(coalesce(text, '')) AS m, {_terms("coalesce(title, '')")} AS a, {_terms("coalesce(text, '')")} AS b, count(*) OVER (PARTITION BY site) AS peers,
CASE WHEN title <> '' THEN count(*) OVER (PARTITION BY site, title) - 1 END AS twins, CASE WHEN text <> '' THEN count(*) OVER (PARTITION BY site, text) - 1 END AS same, len(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(text, ''), '{MARKETING}')) AS hype FROM p),
j AS (SELECT *, len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0) AS alike FROM t)
SELECT page_id AS id, (n >= 6 AND m >= 20)::INT AS "MG1", CASE WHEN n = 0 THEN 0 WHEN n BETWEEN 15 AND 60 THEN 3 WHEN n BETWEEN 10 AND 70 THEN 2 ELSE 1 END AS "M1", CASE WHEN m = 0 THEN 0 WHEN m BETWEEN 70 AND 155 THEN 3 WHEN m BETWEEN 50 AND 175 THEN 2 ELSE 1 END AS "M2",
CASE WHEN len(a) = 0 OR len(b) = 0 THEN NULL WHEN alike <= 0.3 THEN 3 WHEN alike <= 0.5 THEN 2 WHEN alike <= 0.7 THEN 1 ELSE 0 END AS "M4", CASE WHEN peers < 2 THEN NULL WHEN twins >= 2 THEN 0 WHEN twins = 1 THEN 1 WHEN same > 0 THEN 2 ELSE 3 END AS "M7", CASE hype WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS "C4" FROM j""",
    "page_exit_codes": f"SELECT page_id, CASE verdict WHEN 'PASS' THEN 0 ELSE 1 END AS audit, CASE verdict WHEN 'PASS' THEN 0 WHEN 'REWORK' THEN 1 ELSE 2 END AS write FROM ({_CARD})",
    "page_reports": f"""SELECT page_id, sha256('<!doctype html><meta charset=utf-8><title>' || page_id || '</title><h1>' || page_id || '</h1><table>' || array_to_string(list_transform([['verdict', verdict], ['points', got::VARCHAR], ['of', "full"::VARCHAR], ['failed gates', failed_gates], ['below floor', below_floor], ['not observed', unobserved]], lambda x: '<tr><th>' || x[1] || '</th><td>' || x[2] || '</td></tr>'), '') || '</table>') AS report_sha256 FROM ({_CARD})""",
    "page_fixes": f"""{_LONG}, f AS (SELECT * FROM (VALUES {", ".join("('" + i + "', '" + k + "', '" + v.replace("'", "''") + "')" for i, own in FIXES.items() for k, v in own.items())}) v(item, key, fix)), c AS (SELECT * FROM (VALUES {", ".join("('" + i + "', '" + v.replace("'", "''") + "')" for i, v in CHECKS.items())}) v(item, command)),
t AS (SELECT s.page_id, s.item, action_rank, coalesce(f.fix, d.fix) AS fix FROM s LEFT JOIN f ON f.item = s.item AND f.key = score::VARCHAR LEFT JOIN f d ON d.item = s.item AND d.key = 'default' WHERE score < pass_at),
u AS (SELECT * FROM t WHERE fix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY action_rank) = 1)
SELECT u.page_id, u.item, u.fix, replace(replace(replace(command, '{{url}}', url), '{{origin}}', regexp_extract(url, '^[a-z]+://[^/?#]*')), '{{host}}', {_HOST}) AS command FROM u JOIN pages USING (page_id) LEFT JOIN c ON c.item = u.item""",
    "document_draft_blocks": f"SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN sha256({_HTML} || chr(10)) END AS block_sha256 FROM documents WHERE NOT contains(coalesce(text, ''), '```')",
    "document_draft_items": f"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN {_clean("replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")} ELSE '' END AS own, doc_id % 10 > 0 AS kept FROM documents),
n AS (SELECT *, len(regexp_extract_all(own, '{MARKETING}')) + CASE WHEN kept AND doc_id % 3 = 1 THEN len(regexp_extract_all('They say amazing things.', '{MARKETING}')) + len(regexp_extract_all('It is the best ever.', '{MARKETING}')) ELSE 0 END AS hype FROM h)
SELECT doc_id, CASE hype WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS "C4", CASE WHEN NOT kept OR doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 WHEN doc_id % 5 = 1 THEN 3 ELSE 2 END AS "W6", CASE WHEN NOT kept THEN 0 ELSE [0, 3, 2, 1, 0][(doc_id % 5 + 1)::INT] END AS "W8", CASE WHEN NOT kept THEN 0 ELSE [0, 1, 2, 3][(doc_id % 4 + 1)::INT] END AS "W9",
(kept AND doc_id % 3 = 1)::INT AS "D1", (kept AND doc_id % 4 IN (1, 2) AND (doc_id % 2 = 0 OR doc_id % 4 = 1))::INT AS "D2" FROM n""",
    "page_draft_line": f"""{_PAGE}, d AS MATERIALIZED (SELECT site, page_id, coalesce(len(list_filter(blocks, lambda b: regexp_matches(b.text, '{_DATED}'))) / nullif(len(blocks), 0), 0.0) AS density FROM p),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= 6), o AS (SELECT d.page_id, f.density FROM d JOIN f ON d.site = f.site AND d.page_id <> f.page_id QUALIFY row_number() OVER (PARTITION BY d.page_id ORDER BY f.page_id) <= 5),
l AS (SELECT page_id, CASE WHEN count(*) >= 3 THEN list(density ORDER BY density)[count(*) // 2 + 1] END AS line FROM o GROUP BY page_id)
SELECT d.page_id, CASE WHEN density >= coalesce(line, 0.3) THEN 3 WHEN density >= 0.6 * coalesce(line, 0.3) THEN 2 WHEN density > 0 THEN 1 ELSE 0 END AS "W1" FROM d LEFT JOIN l USING (page_id)""",
    "page_answers": f"SELECT page_id, {_HOST} AS host, [200, 200, 403, 200, NULL][(page_id % 5 + 1)::INT] AS status, ['ok', 'ok', 'blocked', 'ok', 'unknown'][(page_id % 5 + 1)::INT] AS reach, CASE WHEN page_id % 5 < 4 THEN sha256(html) END AS text_sha256, CASE WHEN page_id % 5 = 4 THEN 'timed out' END AS error FROM pages",
}

_SENTENCES = _FIRST_SENTENCE.removesuffix("[1]")
_PICKED = f"""WITH h AS (SELECT page_id, {_HOST} AS site FROM pages), r AS (SELECT site FROM h WHERE site <> {_MINE} GROUP BY site ORDER BY count(*) DESC, site LIMIT 4),
w AS (SELECT page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM h WHERE site = {_MINE} OR site IN (FROM r)),
pick AS (SELECT page_id FROM w WHERE k % greatest(1, n // 12) = 0 AND k // greatest(1, n // 12) < 12), p AS"""
LANE_ORACLES["rival_topics"] = SITE_ORACLES["site_topics"].replace("WITH p AS", _PICKED, 1).replace("FROM pages), t AS", "FROM pages WHERE page_id IN (FROM pick)), t AS", 1)
LANE_ORACLES["page_winners"] = f"""{_PAGE}, q AS (SELECT page_id, len(blocks)::INT AS n_blocks, list_filter(blocks, lambda b: regexp_matches(b.text, '{_DATED}')) AS held, {_SENTENCES} AS said FROM p)
SELECT page_id, true AS observed, n_blocks, len(held)::INT AS n_fact_blocks, array_to_string(list_transform(held[1:6], lambda b: b.text[1:220]), '|') AS quotable, array_to_string((list_filter(said, lambda s: regexp_matches(s, '[?？]$')))[1:6], '|') AS questions FROM q"""
