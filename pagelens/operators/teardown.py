"""What other sites systematically write about: topics, the page to look at for each, and what one's own site lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from .order_statistics import exact_medians
from .ordering import settled
from .relational import systematic_sample, term_coverage

# Codes of languages and countries, and words of measure and of anything, that are no topics.
LANG_CODES = (
    "ar bg bn cs da de el en es et fa fi fr gu he hi hr hu id it iw ja jp kn ko lt lv ml mr ms nb nl no pl pt ro ru sk sl sr sv sw "
    "ta te th tr uk ur vi zh cn tw hant hans br mx us gb ca au"
).split()
UNIT_WORDS = "min mins sec secs hr hrs kb mb gb ms px pcs pct num no yes new top all free best online tool tools app apps site web page".split()
DENSE, TOP = 0.3, 20
RIVALS, PAGES = 4, 12


def scanned_pages(pages: DataFrame, mine: str, rivals: DataFrame, most: int = RIVALS, per_site: int = PAGES) -> DataFrame:
    """The pages (site, page_id, ...) that a teardown looks at: evenly spaced ones of one's own site and of the first rivals (site, pos)."""
    first = rivals.where(F.col("site") != mine).orderBy("pos", "site").limit(most).select("site")
    sites = first.unionByName(rivals.sparkSession.createDataFrame([(mine,)], "site string"))
    return systematic_sample(pages.join(F.broadcast(sites), "site", "left_semi"), "site", "page_id", per_site)  # most + 1 sites


def page_traits(facts: DataFrame) -> DataFrame:
    """What is compared of each page that was observed; the others are in no statistic.

    Pages are parsed once, into a table of their traits; JSON-LD goes through Python for pages that have some alone.
    """
    seen = facts.where("body is not null")
    first = F.get("h1", F.lit(0))
    base = seen.select(
        "site", "page_id", "url",
        T.terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), first)).alias("terms"),
        F.size("words").alias("n_words"),
        F.coalesce(F.size(F.filter("blocks", T.has_fact)) / F.nullif(F.size("blocks"), F.lit(0)), F.lit(0.0)).alias("density"),
        F.when(F.size("ld_raw") > 0, F.col("ld_raw")).alias("blocks_ld"), "n_tables", "n_images", "has_video",
        F.size(F.filter("blocks", T.is_cited)).alias("n_cited"),
    )
    base = settled(base)
    some = base.where("blocks_ld is not null").withColumn("types", J.facts_of(F.col("blocks_ld"))["types"])
    none = base.where("blocks_ld is null").withColumn("types", J.no_facts()["types"])
    return some.unionByName(none).drop("blocks_ld")


def page_terms(traits: DataFrame) -> DataFrame:
    return traits.select("site", "page_id", F.explode("terms").alias("term"))


def brand_words(sites: DataFrame) -> DataFrame:
    """(term) of (site): the labels of host names and the runs of letters in them, which are nobody else's topics."""
    labels = F.filter(F.split(F.lower("site"), r"\."), lambda p: F.char_length(p) > 2)
    parts = F.flatten(F.transform(labels, lambda p: T.extract_all(p, "[a-z]{4,}", 0)))
    return sites.select(F.explode(F.concat(labels, parts)).alias("term")).distinct()


def without_noise(terms: DataFrame, brands: DataFrame) -> DataFrame:
    """terms without brands, codes, words that say nothing and Latin words of one or two letters."""
    latin = F.col("term").rlike("^[a-z]+$")
    noise = latin & (F.col("term").isin(*LANG_CODES, *UNIT_WORDS) | (F.char_length("term") < 3))
    return terms.where(~noise).join(brands, "term", "left_anti")


def best_pages(traits: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, page): of each term the page with the most facts, then the most structure, then the first one."""
    keys = traits.select("page_id", "density", (F.col("n_tables") + F.size("types") + F.col("n_cited")).alias("structure"), F.explode("terms").alias("term"))
    held = keys.join(terms.select("term").distinct(), "term", "left_semi")
    best = held.groupBy("term").agg(F.max(F.struct("density", "structure", (-F.col("page_id")).alias("minus"))).alias("b")).select("term", (-F.col("b.minus")).alias("page_id"))
    return best.join(traits.select("page_id", F.struct("*").alias("page")), "page_id").select("term", "page")


def _reasons(*tests: tuple[Column, str], otherwise: str) -> Column:
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise))), ",")


def why_it_works(page: str) -> Column:
    """What speaks for a page, as names joined by commas."""
    p = lambda c: F.col(f"{page}.{c}")
    return _reasons(
        (p("density") >= DENSE, "facts"), (p("n_tables") > 0, "tables"), (p("n_cited") > 0, "sources"), (F.array_contains(p("types"), "FAQPage"), "faq"),
        (F.array_contains(p("types"), "HowTo"), "steps"), (p("n_images") > 0, "images"), otherwise="presence",
    )


def own_best(traits: DataFrame, mine: str) -> DataFrame:
    """One row: the most that any page of one's own site has, NULL without a page."""
    own = traits.where(F.col("site") == mine)
    # Each type once: there are as many as the vocabulary has, whatever the number of pages.
    types = own.select(F.explode("types").alias("type")).distinct().agg(F.collect_list("type").alias("my_types"))
    return own.agg(F.max("density").alias("my_density"), F.max("n_tables").alias("my_tables"), F.max("n_cited").alias("my_cited")).crossJoin(types)  # one row each


def you_lack(page: str) -> Column:
    """What a page has beyond all of one's own pages, whose best stands in the same row."""
    gaps = _reasons(
        (F.col(f"{page}.density") > F.col("my_density"), "facts"), (~F.array_contains("my_types", "FAQPage"), "faq"), (F.col("my_tables") == 0, "tables"),
        (F.col("my_cited") == 0, "sources"), otherwise="nothing measured",
    )
    return F.when(F.col("my_density").isNull(), "own site not seen").otherwise(gaps)


def topics(traits: DataFrame, mine: str, top: int | None = TOP) -> DataFrame:
    """topic, rival_pages, rival, page_id, density, why and lack: what others cover and ``mine`` has on no page.

    The pages counted are those of the first rival that covers the topic; the page is the best of all rivals.
    """
    traits = settled(traits)  # pages are parsed once, for all that follows
    brands = brand_words(traits.select("site").distinct())
    own = page_terms(traits.where(F.col("site") == mine)).select("term").distinct()
    rivals = traits.where(F.col("site") != mine)
    covered = without_noise(term_coverage(page_terms(rivals)).join(own, "term", "left_anti"), brands)
    first = covered.groupBy("term").agg(F.min_by("n_pages", "site").alias("rival_pages"), F.min("site").alias("rival"))
    told = first.join(best_pages(rivals, first), "term").crossJoin(F.broadcast(own_best(traits, mine)))  # one row
    told = told.select(F.col("term").alias("topic"), "rival_pages", "rival", F.col("page.page_id").alias("page_id"), F.col("page.density").alias("density"), why_it_works("page").alias("why"), you_lack("page").alias("lack"))
    return told.orderBy(F.desc("rival_pages"), F.desc("density"), "topic").limit(top) if top else told


def topic_pages(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, topic, page_id): the pages of topics that hold a question, by any number of both.

    A question's least run of letters of three, or the whole of a shorter one, has to stand in the topic: they meet on that
    by an equi-join, and the question is then looked for.
    """
    parts = lambda text, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))
    asked = questions.where("question is not null").select("question", F.lower("question").alias("low")).distinct()
    asked = asked.withColumn("key", F.when(F.char_length("low") < 3, F.col("low")).otherwise(F.array_min(parts(F.col("low"), 3))))
    topic = F.lower("topic")
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *(parts(topic, n) for n in (1, 2, 3))))
    met = found.select("topic", "page_id", F.explode(keys).alias("key")).join(asked, "key").where(topic.contains(F.col("low")))
    return met.select("question", "topic", "page_id").distinct()


def bench(traits: DataFrame, *group: str) -> DataFrame:
    """Medians and counts of comparable pages, what none of them does, and whether they are enough for a line."""
    traits = settled(traits)
    medians = exact_medians(traits, list(group), ["density", "n_words"])
    medians = medians.select(*group, F.col("density").alias("median_density"), F.col("n_words").cast("long").alias("median_words"))
    told = traits.groupBy(*group).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col("n_tables") > 0).alias("with_table"),
        F.count_if(F.array_contains("types", "FAQPage")).alias("with_faq"), F.count_if(F.col("n_images") > 0).alias("with_image"), F.count_if("has_video").alias("with_video"), F.count_if(F.col("n_cited") > 0).alias("with_citation"),
    )
    gaps = F.array_compact(F.array(*(F.when(F.col(f"with_{x}") == 0, F.lit(x)) for x in ("table", "faq", "video", "citation"))))
    told = told.join(medians, list(group), "left").select(*group, "observed", "median_density", "median_words", "with_table", "with_faq", "with_image", "with_video", "with_citation")
    return told.withColumns({"gaps": F.array_join(gaps, ","), "usable": F.col("observed") >= 3})


def winner_pages(facts: DataFrame) -> DataFrame:
    """What a writer takes from each comparable page; pages that were not observed have NULL."""
    seen = F.col("body").isNotNull()
    told = facts.select("page_id", "url", seen.alias("observed"), "title", F.size("blocks").alias("n_blocks"), F.size(F.filter("blocks", T.has_fact)).alias("n_fact_blocks"), T.quotable(F.col("blocks")).alias("quotable"), T.questions(F.col("body")).alias("questions"), F.slice("domains", 1, 10).alias("domains"))
    return told


