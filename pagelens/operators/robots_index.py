"""Robots verdicts for the paths of pages, by an index of the rules' literal beginnings.

A rule can only match a path that begins with what stands before its first wildcard.  Rules are filed under their site
and this beginning; a page looks up the beginnings of its path that are as long as one that its site has, so that page
and rule meet by an equi-join, and only rules with wildcards are verified by their pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import settled


def rule_pattern(value: Column) -> Column:
    """The pattern of a rule: ``*`` stands for anything, ``$`` for the end, all else for itself."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(value, r"([.+?^(){}\[\]|\\])", r"\\$1"), r"\*", ".*"))


def group_of_agents(robots: DataFrame, rules: DataFrame, agents: DataFrame) -> DataFrame:
    """(site, agent, grp, rank): the first group that names the agent (0), else the first for * (1), else none (2)."""
    sites = robots.select("site").distinct().crossJoin(F.broadcast(agents.select("agent").distinct()))  # agents are a short fixed list
    named = rules.select("site", "grp", F.col("agent").alias("named")).distinct()
    asked = sites.join(named, "site", "left").where("named is null or named = lower(agent) or named = '*'")
    asked = asked.withColumn("rank", F.when(F.col("named") == F.lower("agent"), 0).when(F.col("named") == "*", 1).otherwise(2))
    best = asked.groupBy("site", "agent").agg(F.min(F.struct("rank", "grp")).alias("b"))
    return sites.join(best, ["site", "agent"], "left").select("site", "agent", F.col("b.grp").alias("grp"), F.coalesce("b.rank", F.lit(2)).alias("rank"))


def page_verdicts(robots: DataFrame, rules: DataFrame, pages: DataFrame, agents: DataFrame) -> DataFrame:
    """(site, page, agent, grp_kind, allowed, rule) for each page of (site, page, path) and each agent, by longest match.

    ``robots`` (site, body) are the sites that were observed; pages of others have no row.  ``rules`` are ``crawl.robots_rules``
    of them.  At equal length a rule that allows wins; rule is the line that decides, NULL if none matches.
    """
    rules = settled(rules)
    chosen = settled(group_of_agents(robots, rules, agents))
    index = rules.where("value <> ''").join(chosen.select("site", "grp").distinct(), ["site", "grp"], "left_semi").select("site", "grp", "kind", "value").distinct()
    index = settled(index.select("*", F.regexp_extract("value", r"^[^*$]*", 0).alias("begin"), F.col("value").rlike(r"[*$]").alias("wild")))
    lengths = index.groupBy("site").agg(F.collect_set(F.char_length("begin")).alias("lengths"))  # at most the lines of a file
    asked = pages.join(lengths, "site").select("site", "page", "path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    asked = asked.select("site", "page", "path", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("begin"))
    met = asked.join(index, ["site", "begin"]).where(~F.col("wild") | F.regexp_like("path", rule_pattern(F.col("value"))))
    won = met.groupBy("site", "page", "grp").agg(F.max(F.struct(F.char_length("value").alias("n"), (F.col("kind") == "allow").alias("allow"), "value")).alias("won"))
    told = pages.select("site", "page").join(chosen, "site").join(won, ["site", "page", "grp"], "left")
    kind = F.when(F.col("rank") == 0, "explicit").when(F.col("rank") == 1, "wildcard").otherwise("none")
    rule = F.concat(F.when(F.col("won.allow"), "Allow: ").otherwise("Disallow: "), F.col("won.value"))
    return told.select("site", "page", "agent", kind.alias("grp_kind"), F.coalesce("won.allow", F.lit(True)).alias("allowed"), F.when(F.col("won").isNotNull(), rule).alias("rule"))


def page_index_gate(verdicts: DataFrame, classes: DataFrame, signals: DataFrame) -> DataFrame:
    """(page, G2): open to all agents of (class, agent) but training's, and without a row in signals (page)."""
    held = verdicts.join(F.broadcast(classes), "agent").groupBy("page").agg(F.bool_and(F.col("allowed") | (F.col("class") == "training")).alias("open"))  # a short fixed list
    shut = signals.select("page", F.lit(True).alias("shut")).distinct()
    return held.join(shut, "page", "left").select("page", (F.col("open") & F.col("shut").isNull()).cast("int").alias("G2"))
