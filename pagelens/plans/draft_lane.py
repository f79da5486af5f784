"""Scores of drafts before they are published: the draft lane, one wide row for each draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import reach

# JSON-LD types that count, the line without comparable pages, and marks of what is still to be checked.
VALID_TYPES = "SoftwareApplication WebApplication HowTo FAQPage Article Product ItemList BlogPosting NewsArticle Course Recipe ImageObject VideoObject Quiz Dataset".split()
FALLBACK_LINE = 0.30
PENDING = r"\[(待核|需核|未验证)\]"
PENDING_SECTION = r"(?im)^#{1,4}\s*(待核|需核|needs?[ _-]?review)"
MAX_SOURCES, MAX_NUMBERS = 8, 3


def links(html: Column) -> Column:
    """Targets of HTML links, then of Markdown links."""
    return F.concat(T.extract_all(html, r"""(?i)<a[^>]+href=["']([^"']+)["']"""), T.extract_all(html, r"\]\(([^)\s]+)\)"))


def outside(html: Column) -> Column:
    return F.filter(links(html), lambda h: h.rlike("^https?://"))


def is_numeric(text: Column) -> Column:
    """A number with a unit, or a range."""
    return text.rlike(rf"(?i)[0-9][0-9,\.]*\s*(?:{T.UNIT})") | text.rlike(T.RANGE)


def numbers(text: Column) -> Column:
    """Numbers to look up in a source; years alone say nothing, and neither does a single digit."""
    return F.filter(T.extract_all(text, r"[0-9][0-9,]*\.?[0-9]*", 0), lambda n: ~n.rlike("^(19|20)[0-9]{2}$") & (F.regexp_count(n, F.lit("[0-9]")) >= 2))


def content_block(draft: Column) -> Column:
    """The first fenced block of HTML or Markdown of a draft: what is to be published; NULL without one."""
    return T.extract(draft, r"(?s)```(?:html|markdown|md)\s*\n(.*?)```")


def lines(densities: DataFrame) -> DataFrame:
    """(id, line) from (id, density) of comparable pages: the upper median of three or more."""
    found = densities.where("density is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by density desc)").alias("line"))
    return found.where("n >= 3").select("id", "line")


def _facts(drafts: DataFrame) -> DataFrame:
    block, draft = F.coalesce("block", F.lit("")), F.coalesce("draft", F.lit(""))
    images = T.extract_all(block, r"(?is)<img[^>]*>", 0)
    pictures = T.extract_all(block, r"!\[([^\]]*)\]\(([^)]+)\)")
    return drafts.select(
        "id",
        "self_host",
        T.terms(F.coalesce("question", F.lit(""))).alias("asked"),
        (F.coalesce("question", F.lit("")) != "").alias("has_question"),
        T.words(T.clean_text(block)).alias("words"),
        T.blocks(block).alias("blocks"),
        F.array_distinct(F.filter(links(block), lambda h: h.startswith("/"))).alias("internal"),
        F.slice(F.array_distinct(outside(block)), 1, MAX_SOURCES).alias("sources"),
        (F.size(images) + F.size(pictures) + F.regexp_count(block, F.lit(r"(?i)<(video|iframe)[^>]*>"))).alias("n_media"),
        (F.exists(images, lambda i: ~i.rlike(r"""(?i)alt=["'][^"']+""")) | F.exists(pictures, lambda a: F.trim(a) == "")).alias("no_alt"),
        block.rlike(r"(?is)<figcaption[^>]*>\s*\S").alias("captioned"),
        J.draft_facts(block).alias("ld"),
        F.exists(T.extract_all(draft, r"(?s)```bash\s*\n(.*?)```"), lambda b: b.rlike(r"\b(curl|grep)\b")).alias("has_check"),
        (draft.rlike(PENDING_SECTION) & (F.regexp_count(block, F.lit(PENDING)) <= F.regexp_count(draft, F.lit(rf"(?im)^\s*[-*]\s*.*{PENDING}")))).alias("listed"),
    )


def source_items(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """id, W3 and W4 of drafts with sources, from (url, status, text); a source without a row is unknown."""
    each = facts.select("id", "self_host", F.explode("sources").alias("url")).join(sources.select("url", "status"), "url", "left")
    state, tier = reach(F.col("status")), U.source_tier(F.col("url"), F.col("self_host"))
    count = lambda c: F.count_if(c)
    each = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), count(state == "dead").alias("dead"), count(state == "blocked").alias("blocked"), count(state == "unknown").alias("unknown"), count(tier == "first").alias("first"), count(tier == "weak").alias("weak"))
    w3 = F.when(F.col("unknown") == F.col("n"), None).when(F.col("dead") + F.col("blocked") == 0, 3).when(F.col("dead") == 0, 2).when(F.col("dead") == 1, 1).otherwise(0)
    w4 = F.when(2 * F.col("first") >= F.col("n"), 3).when(F.col("first") > 0, 2).when(F.col("weak") == F.col("n"), 0).otherwise(1)
    return each.select("id", w3.alias("W3"), w4.alias("W4"))


def traced_numbers(facts: DataFrame, sources: DataFrame, compat: bool = True) -> DataFrame:
    """id and W5: whether numbers of cited blocks stand in the first source of their block.

    With ``compat`` a number that is not whole counts as found wherever its source was read; without, it is looked for.

    Each number of a source is looked up once, however many drafts claim it, so a source that many drafts cite is read
    for its distinct numbers alone.
    """
    claims = facts.select("id", F.explode("blocks").alias("b")).where(is_numeric(F.col("b.text")))
    claims = claims.select("id", F.get(outside(F.col("b.html")), F.lit(0)).alias("url"), F.explode(F.slice(numbers(F.col("b.text")), 1, MAX_NUMBERS)).alias("number")).where("url is not null")
    claims = claims.groupBy("id", "url", "number").agg(F.count(F.lit(1)).alias("times"))
    plain = F.regexp_replace("number", ",", "")
    grouped = F.when(plain.rlike(r"^[0-9]{1,18}$"), F.regexp_replace(plain.cast("long").cast("string"), r"(?<=[0-9])(?=([0-9]{3})+$)", ","))
    body = F.coalesce("text", F.lit(""))
    held = claims.select("url", "number").distinct().join(sources.where(reach(F.col("status")) == "ok").select("url", "text"), "url")
    held = held.select("url", "number", (body.contains(F.col("number")) | body.contains(plain) | F.coalesce(body.contains(grouped), F.lit(compat) & ~plain.rlike("^[0-9]+$"))).alias("found"))
    got = claims.join(held, ["url", "number"]).groupBy("id").agg(F.sum("times").alias("n"), F.coalesce(F.sum(F.when(~F.col("found"), F.col("times"))), F.lit(0)).alias("miss"))
    return got.select("id", F.when(F.col("miss") == 0, 3).when(F.col("miss") == 1, 2).when(F.col("miss") < F.col("n"), 1).otherwise(0).alias("W5"))


def draft_items(drafts: DataFrame, sources: DataFrame, densities: DataFrame, compat: bool = True) -> DataFrame:
    """id and scores WG1, C4, W1 to W9, D1 and D2 of (id, draft, question, self_host); NULL is unobserved.

    What is to be published is the column block, if there is one, and else the draft's fenced block.
    """
    facts = _facts(drafts if "block" in drafts.columns else drafts.withColumn("block", content_block(F.col("draft"))))
    first = F.slice("words", 1, 50)
    spaced, joined = F.lower(F.array_join(first, " ")), F.lower(F.array_join(first, ""))
    hit = F.size(F.filter("asked", lambda t: F.contains(spaced, t) | F.contains(joined, t)))
    ratio = F.coalesce(F.size(F.filter("blocks", lambda b: b["text"].rlike(T.FACT))) / F.nullif(F.size("blocks"), F.lit(0)), F.lit(0.0))
    line = F.coalesce("line", F.lit(FALLBACK_LINE))
    numeric = F.filter("blocks", lambda b: is_numeric(b["text"]))
    share = F.size(F.filter(numeric, lambda b: (F.size(outside(b["html"])) > 0) | b["html"].rlike(T.SOURCE_MARK))) / F.nullif(F.size(numeric), F.lit(0))
    dangling = F.size(F.filter("blocks", lambda b: b["tag"].isin("p", "blockquote") & b["text"].rlike(T.DANGLING)))
    types = F.col("ld.types")
    valid = F.size(F.array_intersect(types, F.array(*map(F.lit, VALID_TYPES))))
    media = F.arrays_overlap(types, F.array(F.lit("ImageObject"), F.lit("VideoObject")))
    n = F.size("internal")
    hype = F.aggregate("blocks", F.lit(0), lambda k, b: k + F.regexp_count(b["text"], F.lit(T.MARKETING_SCAN)))
    own = facts.join(lines(densities), "id", "left").select(
        "id",
        F.when(F.col("has_question"), ((hit >= F.least(F.lit(2), F.size("asked"))) & (F.size("words") >= 20)).cast("int")).alias("WG1"),
        F.when(hype == 0, 3).when(hype == 1, 2).when(hype <= 3, 1).otherwise(0).alias("C4"),
        F.when(ratio >= line, 3).when(ratio >= 0.6 * line, 2).when(ratio > 0, 1).otherwise(0).alias("W1"),
        F.when(share >= 0.6, 3).when(share >= 0.3, 2).when(share > 0, 1).when(share == 0, 0).alias("W2"),
        F.when(F.col("n_media") == 0, 0).when(F.col("no_alt") | ~F.col("captioned"), 1).when(media, 3).otherwise(2).alias("W6"),
        F.when(dangling == 0, 3).when(dangling == 1, 2).when(dangling <= 3, 1).otherwise(0).alias("W7"),
        F.when(F.size(types) == 0, 0).when((valid == 0) & (F.col("ld.broken") > 0), 0).when(valid == 0, 1).when(valid >= 2, 3).otherwise(2).alias("W8"),
        F.when(n >= 5, 3).when(n >= 3, 2).when(n >= 1, 1).otherwise(0).alias("W9"),
        F.col("has_check").cast("int").alias("D1"),
        F.col("listed").cast("int").alias("D2"),
    )
    return own.join(source_items(facts, sources), "id", "left").join(traced_numbers(facts, sources, compat), "id", "left")
