"""What to do about a failing item, and how to check that it was done; the texts are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: Of an item, texts by the key of its finding; without one by its score, and "default" for all others.
FIXES = {
    "G1": {"blocked": "Let this address through in the protection rules of the host.", "dead": "Publish the page again, or redirect its address.", "default": "Make the page answer with status 200."},
    "G2": {"robots": "Take the rule for these agents out of robots.txt.", "noindex": "Take noindex out of the page and of the response header.", "server": "Let these agents through at the server; robots.txt is not what stops them."},
    "G3": {"default": "Send the text with the first HTML, rendered on the server."},
    "T1": {"0": "Publish a sitemap at /sitemap.xml.", "1": "Answer the sitemap's address with XML, not with a page."},
    "T2": {"default": "Write absolute addresses of this host, of one scheme and without fragments.", "0": "Split the sitemap and list its parts in an index."},
    "T3": {"default": "Take dead addresses out of the sitemap."},
    "T4": {"0": "Write exactly one canonical link.", "1": "Give the canonical link the page's own scheme and no fragment."},
    "T5": {"default": "Point the canonical link to an address that answers with status 200."},
    "T6": {"default": "Redirect all entry points to one of them."},
    "T7": {"0": "Add a JSON-LD block that parses.", "1": "Mend the JSON-LD blocks that do not parse."},
    "T8": {"0": "Add JSON-LD with a type.", "1": "Add a type that tells of this page and not of the site."},
    "T9": {"default": "Show the declared values in the text, or do not declare them."},
    "C1": {"default": "Give the page one main heading."},
    "C2": {"default": "Begin the text with what the title promises, before navigation."},
    "C3": {"default": "Add numbers with units, dates or sources to the paragraphs."},
    "C4": {"default": "Replace the stock phrases by what can be measured."},
    "K1": {"default": "Give each page its own keyword, or merge the pages."},
    "K2": {"default": "Use one keyword in title, heading, address and first sentence."},
    "I1": {"0": "Add a title that no other page has.", "1": "Change the title, which another page has too."},
    "I2": {"default": "Name the page's language on its html element, as its address does."},
    "I3": {"default": "Add an alternate link of the page itself and one of x-default."},
    "MG1": {"default": "Write both a title and a description."},
    **{m: {"default": text} for m, text in (("M1", "Bring the title to 15 to 60 characters."), ("M2", "Bring the description to 70 to 155 characters."), ("M3", "Move the keyword to the front of the title."), ("M4", "Let the description say what the title does not."), ("M5", "Name a number, a price or an output in the description."), ("M6", "Say what this kind of page has to say."), ("M7", "Give the page heads that no other page has."))},
}

#: Of an item, a command whose output shows it; {url}, {origin} and {host} are filled in.
CHECKS = {
    "G1": "curl -sI {url}",
    "G2": "curl -s {origin}/robots.txt",
    "G3": "curl -s {url} | wc -w",
    "T1": "curl -sI {origin}/sitemap.xml",
    "T2": "curl -s {origin}/sitemap.xml | grep '<loc>'",
    "T3": "curl -s {origin}/sitemap.xml | grep -o 'http[^<]*' | xargs -n1 curl -sI",
    "T4": "curl -s {url} | grep -i canonical",
    "T5": "curl -sIL {url}",
    "T6": "curl -sIL http://{host} https://{host} http://www.{host} https://www.{host}",
    "T7": "curl -s {url} | grep -A99 'ld+json'",
    "T8": "curl -s {url} | grep '@type'",
    "T9": "curl -s {url} | grep -i 'price\\|rating'",
    "C1": "curl -s {url} | grep -ci '<h1'",
    "C2": "curl -s {url} | head -c 4000",
    "I1": "curl -s {url} | grep -i '<title'",
    "I2": "curl -s {url} | grep -i '<html'",
    "I3": "curl -s {url} | grep -i hreflang",
}


def fix_table(spark: SparkSession, fixes: dict[str, dict[str, str]] = FIXES) -> DataFrame:
    return spark.createDataFrame([(i, own) for i, own in fixes.items()], "item string, fix map<string,string>")


def with_fixes(scores: DataFrame, rubric: DataFrame, fixes: DataFrame) -> DataFrame:
    """Scores (entity, item, score, fix_key) with kind, weight, passed and fix; what passed or was not observed has no fix.

    A gate keeps its fix when it passes, as its key may tell of something to see to.
    """
    own = scores.join(F.broadcast(rubric), "item").join(F.broadcast(fixes), "item", "left")  # a row for each criterion
    seen, passed = F.col("score").isNotNull(), F.col("score") >= F.col("pass_at")
    text = F.coalesce(F.element_at("fix", F.coalesce("fix_key", F.col("score").cast("string"))), F.element_at("fix", F.lit("default")), F.element_at("fix", F.col("score").cast("string")))
    return own.select("entity", "item", "kind", "weight", "action_rank", "score", passed.alias("passed"), F.when(seen & (~passed | (F.col("kind") == "gate")), text).alias("fix"))


def next_fix(fixed: DataFrame) -> DataFrame:
    """(entity, item, fix): the first failing item of the fixed order that something can be done about."""
    open_ = fixed.where("not passed and fix is not null")
    return open_.groupBy("entity").agg(F.min_by(F.struct("item", "fix"), "action_rank").alias("a")).select("entity", "a.item", "a.fix")


def fix_first(fixed: DataFrame, order: list[str]) -> DataFrame:
    """(entity, item, fix): gates before scores, then the heaviest, then the first of the rubric."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("item"))
    by = Window.partitionBy("entity").orderBy((F.col("kind") != "gate").cast("int"), F.desc(F.coalesce("weight", F.lit(0))), place)
    return fixed.where("not passed and fix is not null").withColumn("nth", F.row_number().over(by)).where("nth = 1").select("entity", "item", "fix")


def check_command(item: Column, url: Column) -> Column:
    """The command of an item for a page, NULL for items without one."""
    known = F.create_map(*(F.lit(x) for pair in CHECKS.items() for x in pair))
    command = F.element_at(known, item)
    for name, value in (("{url}", url), ("{origin}", U.origin_of(url)), ("{host}", U.bare_host(url))):
        command = F.replace(command, F.lit(name), value)
    return command
