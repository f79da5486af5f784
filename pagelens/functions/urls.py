"""URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, stripped

# What marks a first-hand source and a weak one.
FIRST_SUFFIX = (".gov", ".edu", ".gov.cn", ".edu.cn", ".int", ".mil")
FIRST_MARK = (
    "doi.org arxiv.org pubmed nih.gov who.int oecd.org w3.org ietf.org rfc-editor.org schema.org sitemaps.org "
    "developers.google.com developer.mozilla.org docs. nature.com science.org acm.org ieee.org"
).split()
WEAK_MARK = (
    "medium.com zhihu.com jianshu.com csdn.net blogspot. wordpress.com substack.com x.com twitter.com facebook.com "
    "linkedin.com quora.com reddit.com pinterest. aggregator weibo.com xiaohongshu.com"
).split()


def bare_host(url: Column) -> Column:
    netloc = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*://)?([^/?#]*)", 1)
    return F.regexp_replace(F.split_part(netloc, F.lit(":"), F.lit(1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def norm_url(url: Column) -> Column:
    """One spelling of an address: lower host, no default port, no trailing slash, no fragment or parameters."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    plain = F.regexp_replace(path(url), r";[^/]*$", "")
    short = F.regexp_replace(plain, "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(short == "", "/").otherwise(short), query)


def lang_segment(url: Column) -> Column:
    return extract(path(url), r"^/([a-z]{2}(?:-[a-zA-Z]{2,4})?)(?:/|$)")


def origin_of(url: Column) -> Column:
    """Scheme and host with its port; https where no scheme is given."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)")


def joined(base: Column, link: Column) -> Column:
    """The address that a link on the page ``base`` means: absolute, without scheme, from the root, a query, a fragment or relative."""
    link = stripped(link)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    bare = F.regexp_replace(base, "#.*$", "")
    page = F.regexp_replace(bare, r"\?.*$", "")
    rooted = F.regexp_replace(path(page), "[^/]*$", "")
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    plain = F.regexp_replace(link, r"[?#].*$", "")
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.when(rooted == "", "/").otherwise(rooted), plain))
    # Steps "." go, and ".." takes the step before it along.
    steps = F.slice(F.split(whole, "/"), 2, 1 << 20)
    last = F.element_at(steps, -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    walked = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(bare, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(origin, walked, tail))
    )


def domains(links: Column, limit: int = 30) -> Column:
    """Sorted distinct hosts of absolute links."""
    hosts = F.transform(F.filter(links, lambda u: u.rlike("(?i)^https?://[^/?#]")), bare_host)
    return F.slice(F.array_sort(F.array_distinct(hosts)), 1, limit)


def source_tier(url: Column, self_host: Column | None = None) -> Column:
    host = bare_host(url)
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    first = any_of([host.endswith(s) for s in FIRST_SUFFIX] + [F.contains(host, F.lit(m)) for m in FIRST_MARK])
    tier = F.when(first, "first").when(any_of([F.contains(host, F.lit(m)) for m in WEAK_MARK]), "weak").otherwise("second")
    return tier if self_host is None else F.when(host == bare_host(self_host), "first").otherwise(tier)
