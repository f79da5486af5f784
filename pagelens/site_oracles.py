"""SQL for the queries of ``site_queries``: over inline rows the rows that their rules give, worked out by hand."""

from __future__ import annotations

from .operators.crawl import AGENTS
from .operators.teardown import LANG_CODES, UNIT_WORDS
from .oracles import _DATED, _HOST, _LONG, _PAGE, ORACLES, _terms
from .plans.rubric import ACTION_ORDER, AUDIT_WEIGHTS


def _rows(columns: str, *rows: tuple) -> str:
    def value(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    names = ", ".join(f'"{c}"' for c in columns.split())
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({names})"


_NEVER = (None,) * 11
_META = _rows(
    "id MG1 M1 M2 M3 M4 M5 M6 C4",
    (1, 1, 3, 3, 3, 3, 3, 3, 3), (2, 0, 1, 1, 0, 2, 0, 0, 3), (3, 0, 3, 0, 1, None, 0, 2, 3), (4, 0, 3, 0, 0, None, 0, 2, 3), (5, 0, 0, 3, None, None, 3, None, 3),
    (6, 1, 3, 1, 1, 0, 1, 2, 3), (7, 1, 1, 3, 3, 3, 1, 3, 3), (8, 0, 3, 1, 2, 3, 0, 3, 3), (9, 1, 3, 1, 0, 3, 0, None, 0), (10, 1, 3, 1, 1, 1, 0, 2, 3),
)
_BRANDS = f"brands AS (SELECT DISTINCT unnest(l || flatten(list_transform(l, lambda p: regexp_extract_all(p, '[a-z]{{4,}}')))) AS term FROM (SELECT DISTINCT list_filter(string_split(site, '.'), lambda p: len(p) > 2) AS l FROM p))"
_NOISE = ", ".join(f"'{w}'" for w in [*LANG_CODES, *UNIT_WORDS])
_CITES = r"""len(list_filter(regexp_extract_all(b.html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1) || regexp_extract_all(b.html, '\]\(([^)\s]+)\)', 1), lambda h: regexp_matches(h, '^https?://'))) > 0"""
#: No page of the tables has JSON-LD.
_TRAITS = rf"""{_PAGE}, t AS MATERIALIZED (SELECT site, page_id, {_terms("concat_ws(' ', coalesce(title, ''), h1[1])")} AS terms, len(words) AS n_words, coalesce(len(list_filter(blocks, lambda b: regexp_matches(b.text, '{_DATED}'))) / nullif(len(blocks), 0), 0.0) AS density,
len(regexp_extract_all(html, '(?i)<table[\s>]')) AS tables, len(regexp_extract_all(html, '(?i)<img[^>]*>')) AS images, regexp_matches(html, '(?is)<(video|iframe)[^>]*>') AS video, len(list_filter(blocks, lambda b: {_CITES})) AS cited FROM p)"""
_MINE = "'ththth.example.net'"

SITE_ORACLES = {
    "robots_observation": _rows("site observed reason", ("all", True, "rules"), ("blank", True, "blank"), ("gone", True, "no file"), ("html", False, "html"), ("down", False, "not fetched"), ("cut", False, "not fetched"), ("refused", False, "not fetched"), ("training", True, "rules"), ("search", True, "rules"), ("two", True, "rules")),
    "robots_groups": _rows(
        "site grp agent kind value",
        ("all", 1, "*", "allow", "/"), ("training", 1, "gptbot", "disallow", "/"), ("training", 1, "ccbot", "disallow", "/"), ("training", 2, "*", "disallow", "/private"), ("search", 1, "googlebot", "disallow", "/"),
        ("search", 2, "oai-searchbot", "disallow", "/*"), ("search", 2, "oai-searchbot", "allow", "/$"), ("two", 1, "bingbot", "disallow", ""), ("two", 2, "bingbot", "disallow", "/"), ("two", 3, "*", "disallow", "/"), ("two", 3, "*", "allow", "/"),
    ),
    "robots_rule_lines": _rows(
        "site agent grp_kind allowed rule",
        *((s, a, "wildcard", True, "Allow: /") for s, names in (("all", ("Googlebot", "Bingbot", "OAI-SearchBot", "GPTBot")), ("two", ("Googlebot", "OAI-SearchBot", "GPTBot"))) for a in names),
        ("training", "GPTBot", "explicit", False, "Disallow: /"), ("search", "Googlebot", "explicit", False, "Disallow: /"), ("search", "OAI-SearchBot", "explicit", True, "Allow: /$"),
    ),
    "blocked_classes": _rows("site class blocked", ("training", "training", "CCBot,GPTBot"), ("search", "search", "Googlebot")),
    "robots_sitemap_lines": _rows("site pos line", ("training", 0, "https://training/map.xml"), ("search", 0, "/a.xml"), ("search", 1, "b.xml")),
    "robots_noindex_lines": _rows("site path", ("search", "/old")),
    "blocked_by_server": _rows("site agents", ("a", "ChatGPT-User,OAI-SearchBot"), ("c", "")),
    "index_gate_of_robots": _rows("site G2", ("all", 1), ("blank", 0), ("gone", 1), ("training", 1), ("search", 0), ("two", 1)),
    "sitemap_discovery": _rows("site url", ("a", "https://a.com/sitemap.xml"), ("b", "https://b.com/sitemap_index.xml"), ("d", "https://cdn.d.com/map.xml")),
    "sitemap_found_in_crawl": _rows("site T1", ("a", 3), ("b", 2), ("c", 0), ("d", 2)),
    "sitemap_parse": _rows("site pos loc lastmod", ("a", 0, "https://a.com/", "2026-08-20"), ("a", 1, "/b", None), ("b", 0, "https://b.com/0", None), ("b", 1, "https://b.com/2", None), ("b", 2, "https://b.com/3", None), ("d", 0, "https://d.com/x", None)),
    "sitemap_limits": _rows("site issue", ("b", "index_truncated"), ("b", "child_unreachable")),
    "lastmod_dates": _rows(
        "lastmod valid",
        *((d, True) for d in ("2026-08-20", "2026-8-2", "2026-08-20T10:00:00", "2026-08-20T10:00:00Z", "2026-08-20T10:00:00+08:00", "2026-08-20T10:00:00+0800", "2026-08-20T10:00:00.5Z", "2026-08-20T10:00Z", " 2026-08-20 ")),
        *((d, False) for d in ("2026-13-45", "2026-02-30", "2026-08-20T10:00:00.5", "2026-08-20T10:00", "2026-08-20T25:00:00", "20.08.2026", "2026-08", "")),
    ),
    "joined_links": _rows(
        "id url",
        *enumerate(("https://o.org/x", "http://cdn.net/y?z#w", "http://Host.com:80/root?q=1", "http://Host.com:80/a/b/page.html", "http://Host.com:80/a/up/x", "http://Host.com:80/top", "http://Host.com:80/a/b/c.html?only", "http://Host.com:80/a/b/c.html?old#part", "http://Host.com:80/a/b/c.html?old#f", "mailto:a@b.c", "http://Host.com:80/a/b/sub/", "http://Host.com:80/a/")),
    ),
    "origins": rf"SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS origin, 'https://' || {_HOST} AS bare FROM pages",
    "inline_audit_items": _rows(
        "page_id G3 T4 T7 T8 C1 C2 C3 C4 I1 I2 I3",
        (1, 1, 3, 3, 3, 0, 3, 0, 3, 3, 3, None), (2, 0, 0, 0, 2, 3, 0, 0, 3, 0, 1, 0), (3, 0, 2, 2, 1, 2, 0, 0, 3, 0, 3, 3), (4, 0, 1, 3, 2, 0, 0, 0, 3, 0, 2, 2), (5, 0, 1, 1, 0, 0, 0, 0, 3, 0, 3, 1),
        (6, 0, 0, 3, 0, 0, 0, 3, 3, 0, 2, 0), (7, 0, 0, 3, 0, 0, 0, 3, 3, 0, 3, 0), (8, *_NEVER), (9, *_NEVER), (10, *_NEVER), (11, 0, 0, 0, 1, 0, 0, 0, 3, 0, 0, None), (12, 0, 0, 3, 0, 0, 0, 0, 3, 0, 0, None), (13, 0, 0, 3, 0, 0, 0, 0, 3, 0, 0, None),
    ),
    "jsonld_types": _rows("page_id blocks broken types", (1, 1, 0, "Article,Thing"), (2, 1, 1, "Article"), (3, 2, 1, "Organization"), (4, 1, 0, "FAQPage"), (5, 3, 2, ""), (6, 1, 0, ""), (7, 1, 0, ""), (8, 0, 0, ""), (9, 0, 0, ""), (11, 1, 1, "Nope"), (12, 1, 0, ""), (13, 1, 0, "")),
    "jsonld_values": _rows("page_id key value", (1, "price", "12.5"), (3, "@type", "Organization"), (4, "@type", "FAQPage"), (4, "price", "99"), (4, "ratingValue", "4.5"), (4, "reviewCount", "7"), (4, "ratingCount", "True"), (5, "a", "1"), (7, "price", "10"), (7, "ratingValue", "4"), (12, "price", "5"), (13, "price", "5"), (13, "ratingValue", "6")),
    "jsonld_consistency": _rows("page_id T9", (1, 3), (2, None), (3, None), (4, 0), (5, None), (6, None), (7, 3), (9, None), (11, None), (12, 2), (13, 1)),
    "page_images": _rows("id pos src alt", (1, 0, "a.png", "x"), (1, 1, "", ""), (1, 2, "b.png", None)),
    "external_domains": _rows("id domains", (1, "a.net,b.org"), (2, "")),
    "winner_pages": _rows(
        "page_id observed n_blocks n_fact_blocks quotable questions",
        (1, True, 4, 2, "It has 30 MB of data. Is this a question that is long enough? Yes it is, indeed it is.|Since 2020-05 it works", "Is this a question that is long enough?|Since 2020-05 it works no fact Will it work for all of us tomorrow？"),
    ),
    "noindex_of_answers": _rows("id place", (1, "meta"), (2, "header"), (3, "header")),
    "decoded_answers": _rows("id text", (1, "Grüße"), (2, "<p>é</p>"), (3, "<meta charset='windows-1252'>€"), (4, "ok �"), (5, None)),
    "site_topics": f"""{_TRAITS}, {_BRANDS}, own AS (SELECT DISTINCT unnest(terms) AS term FROM t WHERE site = {_MINE}), x AS (SELECT site, page_id, unnest(terms) AS term, density, tables, cited, images FROM t WHERE site <> {_MINE}),
cov AS (SELECT site, term, count(DISTINCT page_id) AS n FROM x WHERE term NOT IN (SELECT term FROM own) AND term NOT IN (SELECT term FROM brands) AND NOT (regexp_matches(term, '^[a-z]+$') AND (term IN ({_NOISE}) OR len(term) < 3)) GROUP BY ALL HAVING count(DISTINCT page_id) >= 2),
f AS (SELECT term, n, site FROM cov QUALIFY row_number() OVER (PARTITION BY term ORDER BY site) = 1), best AS (SELECT * FROM x WHERE term IN (SELECT term FROM f) QUALIFY row_number() OVER (PARTITION BY term ORDER BY density DESC, tables + cited DESC, page_id) = 1),
me AS (SELECT max(density) AS d, max(tables) AS ta, max(cited) AS ci FROM t WHERE site = {_MINE})
SELECT f.term AS topic, f.n AS rival_pages, f.site AS rival, best.page_id, round(density, 9) AS density, coalesce(nullif(concat_ws(',', CASE WHEN density >= 0.3 THEN 'facts' END, CASE WHEN tables > 0 THEN 'tables' END, CASE WHEN cited > 0 THEN 'sources' END, CASE WHEN images > 0 THEN 'images' END), ''), 'presence') AS why,
CASE WHEN d IS NULL THEN 'own site not seen' ELSE concat_ws(',', CASE WHEN density > d THEN 'facts' END, 'faq', CASE WHEN ta = 0 THEN 'tables' END, CASE WHEN ci = 0 THEN 'sources' END) END AS lack
FROM f JOIN best USING (term), me ORDER BY rival_pages DESC, best.density DESC, topic LIMIT 20""",
    "bench_gaps": f"""{_TRAITS}, b AS (SELECT site, count(*) AS observed, round(median(density), 9) AS median_density, trunc(median(n_words))::BIGINT AS median_words, count(*) FILTER (WHERE tables > 0) AS with_table, 0 AS with_faq, count(*) FILTER (WHERE images > 0) AS with_image, count(*) FILTER (WHERE video) AS with_video, count(*) FILTER (WHERE cited > 0) AS with_citation FROM t GROUP BY site)
SELECT *, concat_ws(',', CASE WHEN with_table = 0 THEN 'table' END, 'faq', CASE WHEN with_video = 0 THEN 'video' END, CASE WHEN with_citation = 0 THEN 'citation' END) AS gaps, observed >= 3 AS usable FROM b""",
    "inline_topics": _rows("topic rival_pages rival page_id density why lack", ("gamma", 2, "bravo.com", 3, 0.5, "facts,sources", "facts,faq,tables,sources"), ("delta", 2, "bravo.com", 3, 0.5, "facts,sources", "facts,faq,tables,sources"), ("epsilon", 3, "charlie.com", 4, 0.0, "presence", "faq,tables,sources")),
    "topic_pages": _rows("question topic page_id", ("AMM", "gamma", 3), ("eps", "epsilon", 4)),
    "inline_bench": _rows(
        "site observed median_density median_words with_table with_faq with_image with_video with_citation gaps usable",
        ("mine.com", 1, 0.0, 5, 0, 0, 0, 0, 0, "table,faq,video,citation", False), ("bravo.com", 2, 0.375, 9, 1, 1, 1, 0, 1, "video", False), ("charlie.com", 3, 0.0, 7, 0, 0, 0, 0, 0, "table,faq,video,citation", True),
    ),
    "fix_lookup": _rows(
        "entity item passed has_fix begins",
        ("p", "G1", True, True, "Make the pag"), ("p", "G2", False, True, "Take the rul"), ("p", "T1", False, True, "Publish a si"), ("p", "T3", True, False, None), ("p", "C1", None, False, None), ("q", "G1", False, True, "Publish the "),
        ("q", "T4", True, False, None), ("q", "T7", False, True, "Mend the JSO"), ("r", "K2", False, True, "Use one keyw"), ("r", "T2", False, True, "Split the si"), ("r", "C3", False, True, "Add numbers "), ("s", "T4", True, False, None),
    ),
    "next_fix": _rows("entity item", ("p", "G2"), ("q", "G1"), ("r", "T2")),
    "fix_first": _rows("entity item", ("p", "G2"), ("q", "G1"), ("r", "C3")),
    "check_commands": _rows("item command", ("G2", "curl -s https://www.a.com:8443/robots.txt"), ("T4", "curl -s https://www.a.com:8443/x?y | grep -i canonical"), ("T6", "curl -sIL http://a.com https://a.com http://www.a.com https://www.a.com"), ("C3", None), ("K1", None)),
    "meta_branches": _META,
    "meta_scorecard": f"""WITH l AS (SELECT id, item, score FROM (SELECT *, NULL::INT AS "M7" FROM ({_META})) UNPIVOT INCLUDE NULLS (score FOR item IN ("MG1", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "C4"))),
c AS (SELECT id, coalesce(sum(2 * score) FILTER (WHERE item <> 'MG1'), 0) AS got, 6 * count(score) FILTER (WHERE item <> 'MG1') AS "full", coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE item = 'MG1' AND score < 1), '') AS failed_gates, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE item <> 'MG1' AND score < 2), '') AS below_floor, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE score IS NULL), '') AS unobserved FROM l GROUP BY id)
SELECT id, got::BIGINT AS got, "full", failed_gates, below_floor, unobserved, CASE WHEN failed_gates <> '' THEN 'REJECT' WHEN below_floor <> '' THEN 'REWORK' ELSE 'PASS' END AS verdict FROM c""",
    "draft_block_extract": _rows("id block", (1, "<p>kept 12 GB</p>\n"), (2, "# M\n"), (3, None), (4, None)),
    "draft_branches": _rows("id W2 W3 W5 W6 W8", (1, 3, 3, 3, 3, 3), (2, 3, 3, 0, 1, 2), (3, 3, 3, 2, 2, 1), (4, 0, None, None, 0, 0), (5, 3, 3, 1, 0, 0)),
    "draft_scorecard": _rows("id failed_gates unobserved verdict", *((k, "D1,D2", "W3,W4,W5,WG1" if k == 4 else "WG1", "REJECT") for k in range(1, 6))),
    "rubric_lines": _rows("nth line", (-2, "| item | kind | weight | passes at |"), (-1, "|-|-|-|-|"), *((k, f"| G{k + 1} | gate | - | 1 |") for k in range(3))),
    "html_reports": _rows(
        "entity html",
        *((e, f"<!doctype html><meta charset=utf-8><title>{n}</title><h1>{n}</h1><table><tr><th>verdict</th><td>{v}</td></tr><tr><th>points</th><td>{g}</td></tr><tr><th>of</th><td>{f}</td></tr><tr><th>failed gates</th><td></td></tr><tr><th>below floor</th><td>{b}</td></tr><tr><th>not observed</th><td>{u}</td></tr></table>") for e, n, v, g, f, b, u in (("a<b&c", "a&lt;b&amp;c", "REWORK", 5, 9, "C1", "T1,T2"), ("d", "d", "PASS", 0, 0, "", ""))),
    ),
    "run_changes": _rows("item old new change", ("C1", 3, 2, "worse"), ("C2", 1, 3, "fixed"), ("C3", None, None, "still_unobserved"), ("C4", None, 0, "observability_changed")),
}

# --- queries of ``queries`` that need these rows ---------------------------------------------------------------------

_RULED = {"a": ("wildcard", True), "b": ("wildcard", True), "c": ("none", True), "d": ("wildcard", False)}
_NAMED = {("a", "Googlebot"): ("explicit", True), ("a", "GPTBot"): ("explicit", False), ("a", "CCBot"): ("explicit", False), ("d", "Bingbot"): ("explicit", True)}
SITE_ORACLES["robots_decision"] = _rows("site agent grp_kind allowed", *((site, a, *_NAMED.get((site, a), told)) for site, told in _RULED.items() for names in AGENTS.values() for a in names))
SITE_ORACLES["meta_items"] = _rows(
    "id MG1 M1 M2 M3 M4 M5 M6 C4",
    (1, 1, 3, 3, 3, 3, 3, 3, 3), (2, 0, 1, 1, 0, 2, 0, 0, 3), (3, 1, 3, 3, 1, 3, 2, 3, 0), (4, 1, 1, 3, 0, 3, 0, None, 3), (5, 0, 0, 0, None, None, 0, 0, 3), (6, 1, 3, 1, 1, 0, 0, 2, 3),
)

_UNSEEN = ("G1", "G2", "T1", "T2", "T3", "T5", "T6")
_ALL = f"""rubric AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {w or 'NULL'}, {2 if w else 1}, {ACTION_ORDER.index(i)})" for i, w in AUDIT_WEIGHTS.items())}) v(item, weight, pass_at, action_rank)),
long AS (SELECT page_id, item, score FROM wide UNPIVOT INCLUDE NULLS (score FOR item IN ({", ".join(f'"{i}"' for i in AUDIT_WEIGHTS)}))), s AS (SELECT * FROM long JOIN rubric USING (item))"""
_FULL = f"""WITH wide AS (SELECT i.*, "T9", "K2", "K1", {", ".join(f'NULL::INT AS "{i}"' for i in _UNSEEN)} FROM ({ORACLES["audit_items"]}) i LEFT JOIN ({ORACLES["declared_values"]}) USING (page_id) LEFT JOIN ({ORACLES["shared_term"]}) USING (page_id) LEFT JOIN (SELECT page_id, {_HOST} AS site FROM pages) USING (page_id) LEFT JOIN ({ORACLES["keyword_overlap"]}) USING (site)),
{_ALL}"""
# The three queries on all items follow the three on page items, with these rows in place of theirs.
for _name in ("lane_scorecard", "next_action", "run_compare"):
    SITE_ORACLES[_name.replace("lane_", "full_") if "lane" in _name else f"full_{_name}"] = _FULL + ORACLES[_name].removeprefix(_LONG)

SITE_ORACLES["entry_points"] = _rows(
    "site variant final",
    ("x.com", "http://x.com", "https://x.com/"), ("x.com", "https://x.com", "https://x.com:443"), ("x.com", "http://www.x.com", None), ("x.com", "https://www.x.com", None),
    ("www.y.org", "http://y.org", "http://y.org/"), ("www.y.org", "https://y.org", None), ("www.y.org", "http://www.y.org", None), ("www.y.org", "https://www.y.org", "https://www.y.org/"),
)
# The site has no declared sitemap (2), both schemes in it (1), one dead address (1), and two of its entry points answer, as one (2).
_EVIDENCE = f"""WITH wide AS (SELECT i.*, "T9", NULL::INT AS "K1", CASE WHEN page_id = 1 THEN 1 WHEN page_id NOT IN (8, 9, 10) THEN 0 END AS "K2", CASE WHEN page_id = 8 THEN 0 WHEN page_id <> 10 THEN 1 END AS "G1", 1 AS "G2", 2 AS "T1", 1 AS "T2", 1 AS "T3", CASE page_id WHEN 1 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 3 END AS "T5", 2 AS "T6" FROM ({SITE_ORACLES["inline_audit_items"]}) i LEFT JOIN ({SITE_ORACLES["jsonld_consistency"]}) USING (page_id)),
{_ALL}"""
SITE_ORACLES["evidence_scorecard"] = _EVIDENCE + ORACLES["lane_scorecard"].removeprefix(_LONG)
