"""SQL for DuckDB that says what each query must return; written apart from the Spark code."""

from __future__ import annotations

from .functions.text import DANGLING, MARKETING, SOURCE_MARK, STOP, UNIT, WORD

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_DROP = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("script", "style", "head", "noscript", "svg", "template"))


def _sub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"


def _clean(e: str) -> str:
    for pattern, to in ((f"(?is){_DROP}", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]+>", " "), ("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&[a-zA-Z#0-9]{2,8};", " "), (_WS, " ")):
        e = _sub(e, pattern, to)
    return f"trim({e})"


def _words(e: str) -> str:
    return f"regexp_extract_all({e}, '{WORD.replace(chr(39), chr(39) * 2)}')"


def _tags(e: str, name: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({e}, '(?is)<{name}[^>]*>(.*?)</{name}>', 1), lambda x: {_clean('x')}), lambda x: x <> '')"


def _terms(e: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z]{{2,}}'), lambda w: w NOT IN ({stop})))"


_TITLE = f"CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN {_clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} END"
_LANG = r"""CASE WHEN regexp_matches(html, '(?is)<html[^>]*\blang=["'']([\w\-]+)') THEN regexp_extract(html, '(?is)<html[^>]*\blang=["'']([\w\-]+)', 1) END"""
_HOST = r"regexp_replace(split_part(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*://)?([^/?#]*)', 1), ':', 1), '^www\.', '')"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1)"
_SEGMENT = f"nullif(regexp_extract({_PATH}, '^/([a-z]{{2}}(?:-[A-Z]{{2}})?)(?:/|$)', 1), '')"
_HREFS = r"""regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#][^"'']*)["'']', 1)"""
_BLOCKS = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("p", "li", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "th", "dd"))
#: Each match of a block element: its tag, and its text without the outer tags.
_EACH = f"list_filter(list_transform(regexp_extract_all(html, '(?is){_BLOCKS}'), lambda m: {{'tag': lower(regexp_extract(m, '(?i)^<(figcaption|blockquote|h[1-6]|p|li|td|th|dd)', 1)), 'html': m, 'text': {_clean('m')}}}), lambda b: b.text <> '')"
_FACT = rf"(?i)[0-9][0-9,\.]*\s*(?:{UNIT})|(19|20)[0-9]{{2}}\s*[-/年]\s*[0-9]{{1,2}}|(19|20)[0-9]{{2}}\s*年|[0-9][0-9,\.]*\s*(?:到|至|-|~|–)\s*[0-9]"
_IS_FACT = rf"""(regexp_matches(b.text, '{_FACT}') OR regexp_matches(b.html, '(?i)href=["'']https?://'))"""
_NAV = f"list_distinct(flatten(list_transform(regexp_extract_all(html, '(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>'), lambda h: {_words(f'lower({_clean("h")})')})))"
_PAGE = f"""WITH p AS MATERIALIZED (SELECT page_id, url, {_HOST} AS site, {_TITLE} AS title, {_LANG} AS lang, {_words(_clean('html'))} AS words, {_tags('html', 'h1')} AS h1, {_NAV} AS nav, {_EACH} AS blocks, html FROM pages)"""
_SITE_TERMS = f"""WITH t AS MATERIALIZED (SELECT {_HOST} AS site, page_id, unnest({_terms(f"concat_ws(' ', {_TITLE}, array_to_string({_tags('html', 'h1')}, ' '))")}) AS term FROM pages), cov AS (SELECT site, term, count(DISTINCT page_id) AS n_pages FROM t GROUP BY ALL HAVING count(DISTINCT page_id) >= 2)"""
_FIRST = "words[1:50]"
_ITEMS = f"""{_PAGE}, twin AS (SELECT site, title, count(*) - 1 AS twins FROM p WHERE title <> '' GROUP BY ALL), e AS (
SELECT p.*, twins, {_SEGMENT} AS segment, len(title) AS n, len(list_intersect({_terms('title')}, {_terms(f"array_to_string({_FIRST}, ' ')")})) AS hit,
len(list_filter({_FIRST}, lambda w: list_contains(nav, lower(w)))) / greatest(1, len({_FIRST})) AS in_nav, len(list_filter(blocks, lambda b: {_IS_FACT})) / nullif(len(blocks), 0) AS fact,
list_sum(list_transform(blocks, lambda b: len(regexp_extract_all(b.text, '{MARKETING}')))) AS hype FROM p LEFT JOIN twin USING (site, title)),
items AS (SELECT page_id, (len(words) >= 120)::INT AS "G3", 0 AS "T4", 0 AS "T7", 0 AS "T8", CASE len(h1) WHEN 1 THEN 3 WHEN 0 THEN 0 ELSE 2 END AS "C1",
CASE WHEN hit >= 2 THEN CASE WHEN in_nav < 0.3 THEN 3 WHEN in_nav <= 0.6 THEN 2 ELSE 1 END WHEN hit = 1 THEN 1 ELSE 0 END AS "C2",
CASE WHEN coalesce(fact, 0) >= 0.3 THEN 3 WHEN fact >= 0.15 THEN 2 WHEN fact > 0 THEN 1 ELSE 0 END AS "C3",
CASE WHEN coalesce(hype, 0) = 0 THEN 3 WHEN hype = 1 THEN 2 WHEN hype <= 3 THEN 1 ELSE 0 END AS "C4",
CASE WHEN coalesce(title, '') = '' THEN 0 WHEN twins >= 2 THEN 0 WHEN twins = 1 THEN 1 WHEN n BETWEEN 15 AND 60 THEN 3 ELSE 2 END AS "I1",
CASE WHEN lang IS NULL THEN 0 WHEN contains(lang, '_') THEN 1 WHEN segment IS NOT NULL AND lower(lang[1:2]) <> segment[1:2] THEN 2 ELSE 3 END AS "I2",
CASE WHEN segment IS NOT NULL THEN 0 END AS "I3" FROM e)"""
_LONG = f"""{_ITEMS}, rubric AS (SELECT * FROM (VALUES ('G3', NULL, 1, 2), ('T4', 3, 2, 5), ('T7', 3, 2, 6), ('T8', 2, 2, 10), ('C1', 2, 2, 12), ('C2', 3, 2, 13), ('C3', 3, 2, 15), ('C4', 2, 2, 16), ('I1', 2, 2, 18), ('I2', 1, 2, 19), ('I3', 1, 2, 20)) v(item, weight, pass_at, action_rank)),
long AS (SELECT page_id, item, score FROM items UNPIVOT INCLUDE NULLS (score FOR item IN ("G3", "T4", "T7", "T8", "C1", "C2", "C3", "C4", "I1", "I2", "I3"))), s AS (SELECT * FROM long JOIN rubric USING (item))"""
_AGG = "coalesce(array_to_string(list_sort(list(item) FILTER (WHERE {})), ','), '')"

_UNIT_FACT = rf"(?i)[0-9][0-9,\.]*\s*(?:{UNIT})"
_DATED = rf"{_UNIT_FACT}|(19|20)[0-9]{{2}}\s*[-/年]\s*[0-9]{{1,2}}|(19|20)[0-9]{{2}}\s*年"
_NUMERIC = rf"{_UNIT_FACT}|[0-9][0-9,\.]*\s*(?:到|至|-|~|–)\s*[0-9]"
_LINKS = r"""(regexp_extract_all({0}, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1) || regexp_extract_all({0}, '\]\(([^)\s]+)\)', 1))"""
_FIRST_SENTENCE = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_clean('html')}, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) >= 20)[1]"
_LD_VALUES = r"""regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>', 1), chr(10)), '"(?:price|ratingValue|reviewCount|ratingCount)"\s*:\s*"?([^",}\]\s]+)', 1)"""

ORACLES = {
    "page_clean_text_stats": f"SELECT page_id, len({_clean('html')})::INT AS n_chars, len({_words(_clean('html'))})::INT AS n_words FROM pages",
    "page_head_facts": f"SELECT page_id, {_TITLE} AS title, {_LANG} AS lang, CAST(NULL AS VARCHAR) AS description, len({_tags('html', 'h1')})::INT AS h1_count FROM pages",
    "page_link_counts": f"SELECT page_id, len(list_distinct(list_filter(h, lambda x: starts_with(x, '/') OR contains(x, host))))::INT AS n_internal, len(list_distinct(list_filter(h, lambda x: NOT (starts_with(x, '/') OR contains(x, host)) AND regexp_matches(x, '^https?://'))))::INT AS n_external FROM (SELECT page_id, {_HREFS} AS h, {_HOST} AS host FROM pages)",
    "page_structure_counts": r"SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:ul|ol)[\s>]'))::INT AS n_lists, len(regexp_extract_all(html, '(?i)<table[\s>]'))::INT AS n_tables, len(regexp_extract_all(html, '(?i)<img[^>]*>'))::INT AS n_images FROM pages",
    "page_blocks": f"SELECT page_id, (i - 1)::INT AS pos, b.tag AS tag, b.text AS text FROM (SELECT page_id, unnest({_EACH}) AS b, generate_subscripts({_EACH}, 1) AS i FROM pages)",
    "first_50_words": f"SELECT page_id, array_to_string(({_words(_clean('html'))})[1:50], ' ') AS first FROM pages",
    "nav_word_share": f"{_PAGE} SELECT page_id, len(list_filter({_FIRST}, lambda w: list_contains(nav, lower(w))))::INT AS in_nav, len({_FIRST})::INT AS n FROM p",
    "title_terms": f"SELECT page_id, array_to_string(list_sort({_terms(_TITLE)}), ',') AS terms FROM pages",
    "sentence_extract": r"SELECT doc_id, len(s)::INT AS n_sentences, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]')))::INT AS n_with_number FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{0b}]+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) >= 20) AS s FROM documents)",
    "fact_density_by_page": f"{_PAGE} SELECT page_id, len(blocks)::INT AS n_blocks, len(list_filter(blocks, lambda b: {_IS_FACT}))::INT AS n_facts FROM p",
    "url_parts": rf"""SELECT page_id, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) || coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS norm, {_SEGMENT} AS segment,
array_to_string(list_filter(regexp_extract_all(lower(regexp_replace({_PATH}, '[-_/]', ' ', 'g')), '[a-z]{{2,}}'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in STOP)})), ' ') AS path_terms FROM pages""",
    "source_tier": "SELECT * FROM (VALUES ('https://www.cdc.gov/flu', 'first'), ('https://arxiv.org/abs/1', 'first'), ('https://medium.com/x', 'weak'), ('http://blog.example.org/a', 'second'), ('https://docs.example.com/', 'first'), ('https://shop.example.org:8080/p', 'first')) v(url, tier)",
    "term_coverage": f"{_SITE_TERMS} SELECT * FROM cov",
    "topic_gaps": f"""{_SITE_TERMS}, r AS (SELECT * FROM cov WHERE site <> 'ththth.example.net' AND term NOT IN (SELECT term FROM cov WHERE site = 'ththth.example.net') AND term NOT IN ('min', 'sec', 'tool', 'page'))
SELECT term, n_pages AS rival_pages, site AS rival FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY site) = 1 ORDER BY rival_pages DESC, term LIMIT 20""",
    "title_keyword_clash": f"""{_SITE_TERMS}, n AS (SELECT page_id, count(*) AS n FROM t GROUP BY ALL), pr AS (SELECT a.site, a.page_id AS a, b.page_id AS b, count(*) AS i FROM t a JOIN t b ON a.site = b.site AND a.term = b.term AND a.page_id < b.page_id GROUP BY ALL)
SELECT site, a, b, round(i / (x.n + y.n - i), 9) AS jaccard FROM pr JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE i / (x.n + y.n - i) >= 0.6""",
    "duplicate_titles": f"SELECT title, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {_TITLE} AS title FROM pages) GROUP BY title HAVING count(*) > 1",
    "systematic_sample": f"SELECT site, page_id FROM (SELECT {_HOST} AS site, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY {_HOST}) AS n FROM pages) WHERE k % greatest(1, n // 5) = 0 AND k / greatest(1, n // 5) < 5",
    "bench_summary": f"{_PAGE}, f AS (SELECT site, len(words) AS n, len(list_filter(blocks, lambda b: {_IS_FACT})) / nullif(len(blocks), 0) AS density, regexp_matches(html, '(?i)<(?:ul|ol)[\\s>]') AS li, regexp_matches(html, '(?i)<table[\\s>]') AS ta, regexp_matches(html, '(?i)<img[^>]*>') AS im FROM p) SELECT site, count(*) AS n_pages, trunc(median(n))::BIGINT AS median_words, round(median(density), 9) AS median_density, count(*) FILTER (WHERE li) AS with_lists, count(*) FILTER (WHERE ta) AS with_tables, count(*) FILTER (WHERE im) AS with_images FROM f GROUP BY site",
    "audit_items": f"{_ITEMS} SELECT * FROM items",
    "lane_scorecard": f"""{_LONG}, c AS (SELECT page_id, coalesce(sum(score * weight), 0)::BIGINT AS got, coalesce(sum(3 * weight) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS "full", {_AGG.format('score < pass_at AND weight IS NULL')} AS failed_gates, {_AGG.format('score < pass_at AND weight IS NOT NULL')} AS below_floor, {_AGG.format('score IS NULL')} AS unobserved FROM s GROUP BY page_id)
SELECT *, round(got / nullif("full", 0), 9) AS ratio, CASE WHEN failed_gates <> '' THEN 'REJECT' WHEN below_floor <> '' THEN 'REWORK' ELSE 'PASS' END AS verdict FROM c""",
    "next_action": f"{_LONG} SELECT page_id, arg_min(item, action_rank) AS item FROM s WHERE score < pass_at GROUP BY page_id",
    "run_compare": f"""{_LONG}, o AS (SELECT page_id, item, CASE WHEN item IN ('C1', 'I1') THEN score - 1 WHEN item = 'I2' THEN NULL WHEN item = 'C2' AND score < 3 THEN score + 1 ELSE score END AS old FROM long WHERE page_id % 2 = 0 OR item <> 'C2'),
d AS (SELECT item, CASE WHEN old IS NULL AND score IS NULL THEN 'still_unobserved' WHEN old IS NULL OR score IS NULL THEN 'observability_changed' WHEN score > old THEN 'fixed' WHEN score < old THEN 'worse' END AS change FROM long JOIN o USING (page_id, item)) SELECT item, change, count(*) AS n FROM d WHERE change IS NOT NULL GROUP BY ALL""",
    "reach_class": "SELECT page_id, ['ok', 'unknown', 'blocked', 'dead', 'unknown', 'blocked', 'dead', 'unknown'][page_id % 8 + 1] AS reach FROM pages",
    "sitemap_hygiene": rf"""WITH e AS (SELECT {_HOST} AS site, CASE WHEN page_id % 11 = 0 THEN '/rel' ELSE url END AS loc, CASE page_id % 3 WHEN 0 THEN '2026-01-02' WHEN 1 THEN '02.01.2026' END AS lastmod FROM pages), h AS (SELECT *, regexp_matches(loc, '^https?://') AS abs, regexp_replace(regexp_extract(lower(loc), '^https?://([^/?#:]*)', 1), '^www\.', '') AS host FROM e)
SELECT site, count(*) AS n, count(*) FILTER (WHERE NOT abs) AS relative, count(*) FILTER (WHERE abs AND host <> site) AS cross_host, count(*) FILTER (WHERE contains(loc, '#')) AS fragment, count(DISTINCT CASE WHEN abs THEN regexp_extract(loc, '^(https?)', 1) END) > 1 AS mixed_scheme, count(*) FILTER (WHERE lastmod = '02.01.2026') AS lastmod_format, count(*) >= 5 AND count(lastmod) = count(*) AND count(DISTINCT lastmod) = 1 AS lastmod_uniform FROM h GROUP BY site""",
    "marketing_hits": f"{_PAGE} SELECT page_id, coalesce(list_sum(list_transform(blocks, lambda b: len(regexp_extract_all(b.text, '{MARKETING}')))), 0)::INT AS hits FROM p",
    "dangling_paragraphs": f"{_PAGE} SELECT page_id, len(list_filter(blocks, lambda b: b.tag IN ('p', 'blockquote') AND regexp_matches(b.text, '{DANGLING}')))::INT AS n_dangling FROM p",
    "fact_density_docs": rf"SELECT doc_id, len(x)::INT AS n_lines, len(list_filter(x, lambda l: regexp_matches(l, '{_FACT}')))::INT AS n_facts FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ ]')) AS x FROM documents)",
    "lang_vs_url_segment": f"{_PAGE} SELECT page_id, lower(lang[1:2]) = ({_SEGMENT})[1:2] AS agrees FROM p",
    "title_length_class": f"{_PAGE} SELECT page_id, len(title)::INT AS n, CASE WHEN len(title) < 15 THEN 'short' WHEN len(title) <= 60 THEN 'good' WHEN len(title) > 60 THEN 'long' ELSE 'none' END AS kind FROM p",
    "noindex_signals": "SELECT * FROM (VALUES (1, 'meta'), (2, 'header'), (3, 'meta'), (3, 'header')) v(id, place)",
    "sample_liveness": f"""WITH s AS (SELECT {_HOST} AS site, CASE WHEN page_id % 7 > 0 THEN [200, 200, 200, 200, 403, 404][page_id % 6 + 1] END AS status, page_id % 4 = 0 AS redirected FROM pages),
c AS (SELECT site, count(*) FILTER (WHERE status = 404) AS dead, count(*) FILTER (WHERE status = 403) AS blocked, count(*) FILTER (WHERE status = 200 AND redirected) AS redirected FROM s GROUP BY site)
SELECT *, CASE WHEN dead >= 2 THEN 0 WHEN dead = 1 THEN 1 WHEN redirected > 0 THEN 2 ELSE 3 END AS "T3" FROM c""",
    "variant_landings": """SELECT * FROM (VALUES ('a', 2, 0, 1, 3), ('b', 2, 1, 1, 2), ('c', 2, 0, 2, 1), ('d', 1, 1, 1, NULL)) v(site, seen, missing, places, "T6")""",
    "redirect_chain": """WITH RECURSIVE h AS (SELECT * FROM (VALUES ('http://a/', 301, 'https://a/'), ('https://a/', 302, 'https://a/home'), ('https://a/home', 200, NULL), ('https://loop/', 301, 'https://loop/'), ('https://gone/', 404, NULL)) v(url, status, location)),
w AS (SELECT url AS start, url, 0 AS hops FROM h UNION ALL SELECT start, location, hops + 1 FROM w JOIN h USING (url) WHERE location IS NOT NULL AND hops < 5)
SELECT start, url, CASE WHEN hops < 5 THEN status END AS status, hops FROM w LEFT JOIN h USING (url) QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1""",
    "draft_items": """SELECT *, 3 AS "C4" FROM (VALUES (1, 1, 1, 3, 3, 3, 2, 3, 3, 3, 2, 1, 1), (2, NULL, 0, NULL, 1, 0, NULL, 1, 1, 0, 0, 0, 0), (3, 0, 0, NULL, NULL, NULL, NULL, 0, 3, 0, 0, 0, 0)) v(id, "WG1", "W1", "W2", "W3", "W4", "W5", "W6", "W7", "W8", "W9", "D1", "D2")""",
    "page_draft_items": rf"""{_PAGE}, q AS (SELECT *, {_terms("coalesce(title, '')")} AS asked, lower(array_to_string(words[1:50], ' ')) AS spaced, lower(array_to_string(words[1:50], '')) AS joined, {_LINKS.format("html")} AS links,
len(list_filter(blocks, lambda b: regexp_matches(b.text, '{_DATED}'))) / nullif(len(blocks), 0) AS ratio, list_filter(blocks, lambda b: regexp_matches(b.text, '{_NUMERIC}')) AS num, len(list_filter(blocks, lambda b: b.tag IN ('p', 'blockquote') AND regexp_matches(b.text, '{DANGLING}'))) AS dang FROM p),
r AS (SELECT *, len(list_filter(asked, lambda t: contains(spaced, t) OR contains(joined, t))) AS hit, len(list_distinct(list_filter(links, lambda l: l LIKE '/%'))) AS inner_n,
len(list_filter(num, lambda b: len(list_filter({_LINKS.format("b.html")}, lambda l: regexp_matches(l, '^https?://'))) > 0 OR regexp_matches(b.html, '{SOURCE_MARK}'))) / nullif(len(num), 0) AS share,
list_filter(links, lambda l: regexp_matches(l, '^https?://')) AS ext FROM q),
u AS (SELECT page_id, url, length(url) % 4 AS k FROM (SELECT page_id, url, min(pos) AS pos FROM (SELECT page_id, unnest(ext) AS url, generate_subscripts(ext, 1) AS pos FROM r) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 8),
c AS (SELECT page_id, CASE WHEN count(*) FILTER (WHERE k < 3) = 0 THEN NULL WHEN count(*) FILTER (WHERE k IN (1, 2)) = 0 THEN 3 WHEN count(*) FILTER (WHERE k = 2) = 0 THEN 2 WHEN count(*) FILTER (WHERE k = 2) = 1 THEN 1 ELSE 0 END AS "W3" FROM u GROUP BY page_id)
SELECT page_id AS id, CASE WHEN title <> '' THEN (hit >= least(2, len(asked)) AND len(words) >= 20)::INT END AS "WG1", CASE WHEN ratio >= 0.3 THEN 3 WHEN ratio >= 0.18 THEN 2 WHEN ratio > 0 THEN 1 ELSE 0 END AS "W1",
CASE WHEN share >= 0.6 THEN 3 WHEN share >= 0.3 THEN 2 WHEN share > 0 THEN 1 WHEN share = 0 THEN 0 END AS "W2", "W3", CASE WHEN dang = 0 THEN 3 WHEN dang = 1 THEN 2 WHEN dang <= 3 THEN 1 ELSE 0 END AS "W7",
CASE WHEN inner_n >= 5 THEN 3 WHEN inner_n >= 3 THEN 2 WHEN inner_n >= 1 THEN 1 ELSE 0 END AS "W9", 0 AS "D1" FROM r LEFT JOIN c USING (page_id)""",
    "reach_gate": 'SELECT page_id AS id, [1, NULL, 0, 0, NULL, 0, 0, NULL][page_id % 8 + 1] AS "G1" FROM pages',
    "index_gate": """SELECT * FROM (VALUES ('a', 1), ('b', 0), ('c', 0)) v(site, "G2")""",
    "sitemap_found": """SELECT * FROM (VALUES ('a', 3), ('b', 2), ('c', 1), ('d', 0), ('e', NULL)) v(site, "T1")""",
    "canonical_landing": """SELECT * FROM (VALUES ('http://a/', 3), ('https://a/', 3), ('https://a/home', 3), ('https://loop/', NULL), ('https://gone/', 0)) v(start, "T5")""",
    "declared_values": rf"""WITH v AS (SELECT page_id, {_clean('html')} AS body, {_LD_VALUES} AS x FROM pages) SELECT page_id, CASE WHEN len(x) = 0 THEN NULL ELSE [3, 2, 1, 0][least(3, len(list_filter(x, lambda y: NOT contains(body, y)))) + 1] END AS "T9" FROM v""",
    "keyword_overlap": f"""{_SITE_TERMS}, n AS (SELECT page_id, count(*) AS n FROM t GROUP BY ALL), pr AS (SELECT a.site, a.page_id AS a, b.page_id AS b, count(*) AS i FROM t a JOIN t b ON a.site = b.site AND a.term = b.term AND a.page_id < b.page_id GROUP BY ALL),
k AS (SELECT site, count(*) AS k FROM pr JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE i / (x.n + y.n - i) >= 0.6 GROUP BY site)
SELECT site, CASE WHEN n < 3 THEN NULL WHEN k IS NULL THEN 3 WHEN k = 1 THEN 2 WHEN k <= 3 THEN 1 ELSE 0 END AS "K1" FROM (SELECT {_HOST} AS site, count(*) AS n FROM pages GROUP BY 1) LEFT JOIN k USING (site)""",
    "shared_term": rf"""WITH g AS (SELECT page_id, unnest([{_terms(f"coalesce({_TITLE}, '')")}, {_terms(f"array_to_string({_tags('html', 'h1')}, ' ')")}, {_terms(_sub(_PATH, "[-_/]+", " "))}, {_terms(f"coalesce({_FIRST_SENTENCE}, '')")}]) AS p FROM pages),
c AS (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest(p) AS term FROM g) GROUP BY ALL), m AS (SELECT page_id, max(n) AS n FROM c GROUP BY page_id)
SELECT page_id, coalesce(n, 1)::INT - 1 AS "K2" FROM pages LEFT JOIN m USING (page_id)""",
    "repeated_heads": rf"""WITH h AS (SELECT page_id, {_HOST} AS site, {_TITLE} AS t, regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]*content=["'']([^"'']*)', 1)[:300] AS d FROM pages)
SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY site) < 2 THEN NULL WHEN t <> '' AND count(*) OVER (PARTITION BY site, t) > 2 THEN 0 WHEN t <> '' AND count(*) OVER (PARTITION BY site, t) = 2 THEN 1 WHEN d <> '' AND count(*) OVER (PARTITION BY site, d) > 1 THEN 2 ELSE 3 END AS "M7" FROM h""",
}
ORACLES["sitemap_score"] = f"""SELECT site, CASE WHEN n > 50000 THEN 0 WHEN relative + cross_host + fragment > 0 OR mixed_scheme THEN 1 WHEN lastmod_format > 0 OR lastmod_uniform THEN 2 ELSE 3 END AS "T2" FROM ({ORACLES["sitemap_hygiene"]})"""
