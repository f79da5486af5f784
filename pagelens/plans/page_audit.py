"""Page facts and the page-level items of the audit lane, as one wide row for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..functions import urls as U
from ..operators.ordering import settled
from ..operators.relational import alike_pages, similar_classes
from ..sources.tables import reach
from .site_items import declared_score, keyword_overlap, shared_score

# JSON-LD types that describe a page and not its site.
PAGE_TYPES = "SoftwareApplication WebApplication Product Article FAQPage HowTo BlogPosting NewsArticle Course Recipe Quiz Dataset ItemList".split()
ITEMS = ["G3", "T4", "T7", "T8", "C1", "C2", "C3", "C4", "I1", "I2", "I3"]
# Fixed value: languages that are written from right to left.
RIGHT_TO_LEFT = "(?i)^(ar|he|fa|ur)"
_ALTERNATE = r"""(?is)<link[^>]+rel=["']alternate["'][^>]*hreflang=["'][^"']+["'][^>]*href=["']([^"']+)["']"""


def observed(pages: DataFrame) -> Column:
    """Whether there is a page to judge: some HTML, and a status, where one is given, of a page that answers."""
    some = F.coalesce(F.col("html") != "", F.lit(False))
    return some & (reach(F.col("status")) == "ok") if "status" in pages.columns else some


def facts(pages: DataFrame) -> DataFrame:
    """What a page says, without its HTML; every later step works on these columns.

    A page that was not observed has its page_id, url and site, and NULL in all other columns.  ld is parsed JSON-LD, and
    ld_raw its blocks as they stand there, for steps that parse only those of pages that have some.
    """
    html = F.when(observed(pages), F.col("html"))
    host = U.bare_host(F.col("url"))
    base = pages.select(
        "page_id", "url", host.alias("site"), T.title(html).alias("title"), T.meta_description(html).alias("description"), T.lang(html).alias("lang"), T.clean_text(html).alias("body"),
        T.tags(html, "h1").alias("h1"), T.distinct_tags(html, "h2").alias("h2"), T.nav_words(html).alias("nav"), T.blocks(html).alias("blocks"),
        F.size(T.internal_links(html, host)).alias("n_internal"), F.size(T.external_links(html, host)).alias("n_external"), U.domains(T.external_links(html, host)).alias("domains"),
        F.regexp_count(html, F.lit(r"(?i)<(?:ul|ol)[\s>]")).alias("n_lists"), F.regexp_count(html, F.lit(r"(?i)<table[\s>]")).alias("n_tables"), F.regexp_count(html, F.lit(r"(?i)<img[^>]*>")).alias("n_images"),
        html.rlike("(?is)<(video|iframe)[^>]*>").alias("has_video"), T.canonicals(html).alias("canonical"), J.page_facts(html).alias("ld"), J.blocks(html).alias("ld_raw"),
        T.extract_all(html, r"""(?is)<link[^>]+hreflang=["']([^"']+)["'][^>]*>""").alias("hreflang"), T.extract_all(html, _ALTERNATE).alias("alternate"), html.rlike(r"""(?i)<html[^>]+dir=["']?rtl""").alias("rtl"),
    )
    return base.withColumn("words", T.words(F.col("body")))


def audit_items(page: DataFrame, more: dict[str, Column] | None = None, declared: bool = False, compat: bool = True) -> DataFrame:
    """page_id and a score for each of ITEMS, of ``more`` and, if ``declared``, of T9; NULL is unobserved, and so are all items of a page that is."""
    return scored_pages(page, more, declared, compat).select("page_id", *ITEMS, *(more or {}), *(["T9"] if declared else []))


def scored_pages(page: DataFrame, more: dict[str, Column] | None = None, declared: bool = False, compat: bool = True) -> DataFrame:
    """page_id, site, ITEMS, ``more``, T9 and terms (of title and h1), from one reading of the pages.

    Pages are parsed once, into a table of scores; JSON-LD, and the text that its values should stand in, is in it for
    pages with blocks alone, and only these go through Python.  Titles are counted in that table, and the join with them is
    one of two plain tables, which Spark splits where a title stands on very many pages of a site.

    With ``compat``, C2 looks for terms in the first words joined by spaces alone, where the characters of a text in Han
    stand apart and no pair of them is found; without, also in the words as they follow one another.
    """
    more = more or {}
    size, title = F.size, F.coalesce("title", F.lit(""))
    first = F.slice("words", 1, 50)
    in_nav = F.size(F.filter(first, lambda w: F.array_contains(F.col("nav"), F.lower(w)))) / F.greatest(F.lit(1), F.size(first))
    said = T.terms(F.array_join(first, " "))
    said = said if compat else F.array_union(said, T.terms(F.array_join(first, "")))
    hit = F.size(F.array_intersect(T.terms(F.concat_ws(" ", title, F.coalesce("description", F.lit("")))), said))
    fact = F.size(F.filter("blocks", T.is_fact)) / F.nullif(size("blocks"), F.lit(0))
    hype = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.regexp_count(b["text"], F.lit(T.MARKETING_SCAN)))
    types, n_ld, broken = F.col("ld.types"), F.col("ld.blocks"), F.col("ld.broken")
    has_ld = F.size("ld_raw") > 0
    on_page, on_site = F.size(F.array_intersect(types, F.array(*map(F.lit, PAGE_TYPES)))), F.size(F.array_except(types, F.array(*map(F.lit, PAGE_TYPES))))
    segment, wide = U.lang_segment(F.col("url")), T.wide_length(title)
    twins = F.col("twins")
    href = F.get("canonical", F.lit(0))
    same = F.lower(F.split_part(href, F.lit("://"), F.lit(1))) == F.lower(F.split_part(F.col("url"), F.lit("://"), F.lit(1)))
    own = F.exists("alternate", lambda h: U.norm_url(h) == U.norm_url(F.col("url")))
    named = F.exists("hreflang", lambda h: F.lower(h) == "x-default")
    step = lambda x, *cuts: F.when(x >= cuts[0], 3).when(x >= cuts[1], 2).when(x > cuts[2], 1).otherwise(0)
    spoken = F.when(F.col("lang").isNull(), 0).when(F.col("lang").contains("_"), 1).when(segment.isNotNull() & (F.lower(F.substring("lang", 1, 2)) != F.lower(F.substring(segment, 1, 2))), 2).otherwise(3)
    seen = lambda score, item: F.when(F.col("body").isNotNull(), score).alias(item)
    # No name of a column of page is given anew here: an expression with a lambda would take the new one for it.
    scored = page.select(
        "page_id", "site", "title", wide.alias("wide"), F.col("body").isNotNull().alias("seen"),
        seen((size("words") >= 120).cast("int"), "G3"),
        seen(F.when(size("canonical") != 1, 0).when(~href.rlike("^https?://"), 2).when(href.contains("#") | ~same, 1).otherwise(3), "T4"),
        F.when(has_ld, F.col("ld_raw")).alias("ld_raw"), F.when(has_ld, F.col("body")).alias("ld_body"),
        seen(F.when(size("h1") == 1, 3).when(size("h1") > 1, 2).otherwise(0), "C1"),
        seen(F.when(hit >= 2, F.when(in_nav < 0.3, 3).when(in_nav <= 0.6, 2).otherwise(1)).when(hit == 1, 1).otherwise(0), "C2"),
        seen(step(F.coalesce(fact, F.lit(0.0)), 0.3, 0.15, 0), "C3"),
        seen(F.when(hype == 0, 3).when(hype == 1, 2).when(hype <= 3, 1).otherwise(0), "C4"),
        seen(F.when(F.col("lang").rlike(RIGHT_TO_LEFT) & ~F.col("rtl"), F.least(spoken, F.lit(2))).otherwise(spoken), "I2"),
        seen(F.when((size("hreflang") == 0) & segment.isNull(), None).when(size("hreflang") == 0, 0).when(own & named, 3).when(own, 2).otherwise(1), "I3"),
        T.terms(F.concat_ws(" ", F.col("title"), F.array_join(F.array_distinct("h1"), " "))).alias("terms"),
        *(seen(score, item) for item, score in more.items()),
    )
    scored = settled(scored)
    ld_items = {
        "T7": F.when(n_ld == 0, 0).when(broken == 0, 3).when(broken == n_ld, 0).when(broken == 1, 2).otherwise(1),
        "T8": F.when(size(types) == 0, 0).when((on_page > 0) & (on_site > 0), 3).when(on_page > 0, 2).otherwise(1),
        **({"T9": declared_score(F.col("ld_body"), F.col("ld.pairs"))} if declared else {}),
    }
    parsed = scored.where("ld_raw is not null").withColumn("ld", J.facts_of(F.col("ld_raw")))
    plain = scored.where("ld_raw is null").withColumn("ld", J.no_facts())
    told = [df.select("*", *(F.when(F.col("seen"), x).alias(i) for i, x in ld_items.items())).drop("ld", "ld_raw", "ld_body") for df in (parsed, plain)]
    scored = told[0].unionByName(told[1])
    titled = scored.where("title <> ''").groupBy("site", "title").agg((F.count(F.lit(1)) - 1).alias("twins"))
    scored = scored.join(settled(titled), ["site", "title"], "left")
    titles = F.when(title == "", 0).when(twins >= 2, 0).when(twins == 1, 1).when(F.col("wide").between(15, 60), 3).otherwise(2)
    return scored.withColumn("I1", F.when(F.col("seen"), titles)).select("page_id", "site", "terms", *ITEMS, *more, *(["T9"] if declared else []))


def site_overlap(scored: DataFrame) -> DataFrame:
    """(site, K1) of ``scored_pages``; K1 is the same for all numbers of pairs from four on."""
    classes, _, links = similar_classes(scored.select("site", "page_id", F.explode("terms").alias("term")), enough=4)
    return keyword_overlap(alike_pages(classes, links), scored.select("site"))


def all_items(pages: DataFrame, by_page: list[DataFrame], by_site: list[DataFrame], items: list[str], overlap: bool = False) -> DataFrame:
    """page_id and each of ``items``: those of scored_pages with K2 and T9, from one reading of the pages, and those of tables by page_id and by site.

    With ``overlap``, K1 is that of all pages of a site.  NULL is unobserved, as are items without a table.
    """
    places = (F.col("title"), F.array_join("h1", " "), F.regexp_replace(U.path(F.col("url")), "[-_/]+", " "), F.get(T.sentences(F.col("body")), F.lit(0)))
    wide = settled(scored_pages(facts(pages), {"K2": shared_score(*places)}, declared=True))
    by_site = [site_overlap(wide), *by_site] if overlap else by_site
    for found in by_page:
        wide = wide.join(settled(found), "page_id", "left")
    for found in by_site:
        wide = wide.join(settled(found), "site", "left")
    return wide.select("page_id", *(F.col(i) if i in wide.columns else F.lit(None).cast("int").alias(i) for i in items))
