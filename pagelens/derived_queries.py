"""Queries on what the tables of pages do not hold themselves: robots rules, redirects and lists of pages, derived from their addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import jsonld_walk
from .operators import peers, redirects, robots_index
from .operators import probes as P
from .plans import page_audit, site_items
from .sources.tables import pages, table


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, site and path of each page."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", U.bare_host(url).alias("site"), F.when(U.path(url) == "", "/").otherwise(U.path(url)).alias("path"))


# --- robots rules ----------------------------------------------------------------------------------------------------

#: robots.txt of a site, by the length of its name modulo 5; the gap is the first step of its least path.
RULES = [
    "User-agent: *\nDisallow: /{}/\nAllow: /{}/*.html$\n",
    "User-agent:\tGooglebot\nDisallow:\t/\n\tUser-agent: *\nAllow: /\nDisallow: /*/\nAllow: /{}/\n\nUser-agent: GPTBot\n",
    "# all closed\nUser-agent: *\nDisallow: / # but\nAllow: /{}\nUser-agent: GPTBot\nUser-agent: ccbot\nDisallow: /*5\nSitemap: /a.xml\nAllow: /{}/8\nDisallow: /{}/8\n",
    " \n",
    "Disallow: /lost\nUser-agent: bingbot\nCrawl-delay: 5\nUser-agent: Claude-User\nDisallow: /{}/\nDisallow:\nUser-agent: bingbot\nAllow: /\nUser-agent: *\nDisallow: /*.html$\nDisallow: /e\nNoindex: /old\nSITEMAP: https://x.org/map.xml\n",
]


def _robots(addresses: DataFrame) -> DataFrame:
    """(site, status, body): the answers for robots.txt, a fifth of which has another status."""
    sites = addresses.groupBy("site").agg(F.min(F.regexp_extract("path", r"^/([^/]*)", 1)).alias("step"), F.min("page_id").alias("first"))
    bodies = F.element_at(F.array(*map(F.lit, RULES)), (F.length("site") % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, (200, 200, 404, 200, 503, 200, 200, 403, 200, 200))), (F.col("first") % 10 + 1).cast("int"))
    return sites.select("site", status.alias("status"), F.replace(bodies, F.lit("{}"), F.col("step")).alias("body"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = _addresses(spark, sf_dir)
    seen = C.observed_robots(_robots(addresses)).where("observed")
    asked = addresses.select("site", F.col("page_id").alias("page"), "path")
    return robots_index.page_verdicts(seen, C.robots_rules(seen), asked, C.agent_table(spark))


def page_robots_verdicts(spark, sf_dir):
    """What each agent may do with each page, by the page's own path."""
    return _verdicts(spark, sf_dir).select(F.col("page").alias("page_id"), "agent", "grp_kind", "allowed", "rule")


def page_index_gate(spark, sf_dir):
    """G2 of each page by its own path; every ninth page sends noindex."""
    marked = table(spark, sf_dir, "pages").where("page_id % 9 = 0").select(F.col("page_id").alias("page"))
    return robots_index.page_index_gate(_verdicts(spark, sf_dir), C.agent_table(spark), marked).withColumnRenamed("page", "page_id")


def site_robots_observation(spark, sf_dir):
    return C.observed_robots(_robots(_addresses(spark, sf_dir))).select("site", "observed", "reason")


def site_robots_groups(spark, sf_dir):
    return C.robots_rules(C.observed_robots(_robots(_addresses(spark, sf_dir))).where("observed")).select("site", "grp", "agent", "kind", "value")


def site_blocked_classes(spark, sf_dir):
    return C.robots_classes(_robots(_addresses(spark, sf_dir))).select("site", "class", "allowed", "blocked")


def site_sitemap_lines(spark, sf_dir):
    return C.robots_sitemaps(C.observed_robots(_robots(_addresses(spark, sf_dir))))


def site_noindex_lines(spark, sf_dir):
    return C.robots_noindex(C.observed_robots(_robots(_addresses(spark, sf_dir))))


# --- redirects -------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, location): pages that lead on to the next ones by whole, rooted, relative and other addresses, some twice.

    Every page also has an address of its own under /r/, which leads to it by a relative location.
    """
    page, k, url = _addresses(spark, sf_dir), F.col("page_id"), F.col("url")
    following = page.select((k - 1).alias("page_id"), url.alias("next"))
    chained = page.join(following, "page_id", "left").select("page_id", "url", "next", "path")
    location = (
        F.when(k % 7 == 0, None)
        .when(k % 13 == 5, F.concat(F.lit("?from="), k))
        .when(k % 13 == 6, url)
        .when(k % 13 == 7, "")
        .when(k % 2 == 0, F.col("next"))
        .otherwise(F.regexp_replace("next", "^[a-z]+:", ""))
    )
    status = F.when(k % 7 == 0, F.element_at(F.array(*map(F.lit, (200, 404, 503, None))), (k % 4 + 1).cast("int"))).when(k % 13 == 8, 200).otherwise(F.element_at(F.array(*map(F.lit, (301, 302, 308))), (k % 3 + 1).cast("int")))
    own = chained.select("url", status.alias("status"), location.alias("location"))
    twice = chained.where(k % 17 == 0).select("url", F.lit(599).alias("status"), F.lit(None).cast("string").alias("location"))
    under = page.select(F.concat(U.origin_of(url), F.lit("/r/"), k).alias("url"), F.lit(302).alias("status"), F.concat(F.lit("../x/.."), F.col("path")).alias("location"))
    return own.unionByName(twice).unionByName(under)


def _landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    return redirects.follow_redirects(answers.select(F.col("url").alias("start")), answers)


def page_redirects(spark, sf_dir):
    return _landings(spark, sf_dir)


def page_canonical_landing(spark, sf_dir):
    return site_items.canonical_landing(_landings(spark, sf_dir))


# --- peers -----------------------------------------------------------------------------------------------------------


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, site, url, title, terms) of each page; every eleventh was not observed."""
    html: Column = F.when(F.col("page_id") % 11 > 0, F.col("html"))
    title = T.title(html)
    heads = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(T.distinct_tags(html, "h1"), 1, 2), " "))
    return pages(spark, sf_dir).select(F.col("page_id").alias("page"), U.bare_host(F.col("url")).alias("site"), "url", title.alias("title"), F.when(html.isNotNull(), T.terms(heads)).alias("terms"))


def page_peer_items(spark, sf_dir):
    """K1 of each page by its own peers; its site lists two of three pages."""
    entries = _addresses(spark, sf_dir).where("page_id % 3 > 0").select("site", F.col("page_id").alias("pos"), "url")
    told = peers.peer_items(peers.page_peers(_heads(spark, sf_dir).withColumn("on_list", F.col("page") % 3 > 0), entries))
    shown = F.array_join(F.array_sort(F.transform("clashes", lambda c: F.concat(c["a"], F.lit(" "), c["b"]))), "|")
    return told.select(F.col("page").alias("page_id"), "n_peers", F.size("clashes").alias("n_clashes"), shown.alias("clashes"), F.size("twins").alias("n_twins"), "K1")


# --- pages with what the tables lack, spliced in by page_id -----------------------------------------------------------

#: JSON-LD by page_id modulo 7: fine, with a comma too many, twice, with a key twice, with text behind it, and deep.
LD = [
    [],
    ['{"@type": "Article", "offers": {"price": 12.50}}'],
    ['{"@type": "Product", "price": "3",}'],
    ['{"@type": "Organization"}', '{"@type": "FAQPage", "mainEntity": []}'],
    ['{"@type": "Article", "@type": "Thing"}'],
    ['{"@type": "Article"} and more'],
    ['{"@graph": [{"@type": ["HowTo", "Thing"], "aggregateRating": {"ratingValue": 4.50, "reviewCount": 7, "ratingCount": true, "best": null}}]}'],
]


def spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a description, canonical and alternate links, robots, JSON-LD, images, links and prices, each on some pages alone."""
    k, url, host = F.col("page_id"), F.col("url"), U.bare_host(F.col("url"))

    def one_of(n: int, *texts) -> Column:
        return F.element_at(F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts)), (k % n + 1).cast("int"))

    whole = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    link = lambda rel, href: whole(f'<link rel="{rel}" href="', href, '">')
    own = whole(F.lit('<link rel="alternate" hreflang="'), U.lang_segment(url), '" href="', url, '">')
    head = F.concat(
        one_of(4, "", whole('<meta name="description" content="Page ', k, " of ", host, ', one of many">'), '<meta content="x" name="description">', whole("<META NAME='description' CONTENT='it's ", k, "'>")),
        one_of(5, "", link("canonical", url), link("canonical", whole("/rel/", k)), whole(link("canonical", url), link("canonical", url)), link("canonical", F.when(url.startswith("https"), F.regexp_replace(url, "^https", "http")).otherwise(F.regexp_replace(url, "^http", "https")))),
        one_of(3, "", whole(F.coalesce(own, F.lit("")), '<link rel="alternate" hreflang="X-Default" href="/">'), F.coalesce(own, F.lit(""))),
        one_of(10, "<meta name='robots' content='\tNoIndex, follow'>", *["<meta name='robots' content='index'>"] * 9),
        one_of(7, *("".join(f'<script type="application/ld+json">{x}</script>' for x in blocks) for blocks in LD)),
    )
    tail = F.concat(
        one_of(2, "<p>It costs 12.5 now</p>", "<p>No price</p>"),
        one_of(3, "", whole('<img src="/i/', k, '.png" alt="pic ', k, '"><IMG alt="">'), "<img src='/j.png'>"),
        one_of(4, "", whole('<a href="https://www.Out', k % 10, '.org/x">o</a><a href="http://in.net:80">i</a>'), whole('<a href="https://', host, '/own">own</a>'), "<a href='/in'>in</a>"),
    )
    return pages(spark, sf_dir).withColumn("html", F.concat(F.regexp_replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), head)), tail))


def _ld(spark, sf_dir):
    return jsonld_walk.page_facts(spliced(spark, sf_dir))


def page_jsonld_types(spark, sf_dir):
    return _ld(spark, sf_dir).select("page_id", "ld.blocks", "ld.broken", F.array_join("ld.types", ",").alias("types"))


def page_jsonld_values(spark, sf_dir):
    return _ld(spark, sf_dir).select("page_id", F.explode("ld.pairs").alias("p")).select("page_id", "p.key", "p.value")


def page_declared_items(spark, sf_dir):
    """T4, T7, T8, T9 and I3 of the pages, with what their heads declare."""
    return page_audit.audit_items(page_audit.facts(spliced(spark, sf_dir)), declared=True).select("page_id", "T4", "T7", "T8", "T9", "I3")


def page_descriptions(spark, sf_dir):
    return spliced(spark, sf_dir).select("page_id", T.meta_description(F.col("html")).alias("description"))


def page_image_list(spark, sf_dir):
    found = spliced(spark, sf_dir).select("page_id", F.posexplode(T.images(F.col("html"))).alias("pos", "i"))
    return found.select("page_id", "pos", "i.src", "i.alt")


def page_outside_domains(spark, sf_dir):
    outside = T.external_links(F.col("html"), U.bare_host(F.col("url")))
    return spliced(spark, sf_dir).select("page_id", F.array_join(U.domains(outside), ",").alias("domains"))


def page_noindex_signals(spark, sf_dir):
    """Places that keep a page out of indexes; every fourteenth answer has a header that does."""
    header = F.when(F.col("page_id") % 14 == 0, "none, NOINDEX")
    return P.noindex_signals(spliced(spark, sf_dir).select(F.col("page_id").alias("id"), T.meta_robots(F.col("html")).alias("meta_robots"), header.alias("header")))


_QUERIES = [
    page_robots_verdicts, page_index_gate, site_robots_observation, site_robots_groups, site_blocked_classes, site_sitemap_lines, site_noindex_lines, page_redirects, page_canonical_landing,
    page_peer_items, page_jsonld_types, page_jsonld_values, page_declared_items, page_descriptions, page_image_list, page_outside_domains, page_noindex_signals,
]
