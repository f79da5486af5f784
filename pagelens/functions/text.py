"""Text and HTML facts as column expressions: Column in, Column out, no UDFs.

``\\s`` and ``\\d`` stand for the Unicode classes here.  An extraction without a match is NULL, never ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*|[一-鿿぀-ヿ가-힯]"
#: White space of all kinds but the plain space, as the Unicode class without its flag, which makes every match slower.
_ODD = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[ {_ODD}]+"
#: Runs of white space that are not one plain space already; most are, and stand as they do.
_RUNS = f"[{_ODD}][ {_ODD}]*| [ {_ODD}]+"
#: Spaces of all kinds, which stand at the ends of no sentence.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DROPPED = ("script", "style", "head", "noscript", "svg", "template")
BLOCK_TAGS = ("p", "li", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "th", "dd")
STOP = (
    "the a an and or for of to in on with your you online free best how what is are that this when which who can do "
    "does my me it its from by at as vs 的 了 吗 呢 和 与 怎么 如何 什么 多久 哪个 是不是"
).split()
UNIT = (
    r"%|％|percent|个百分点|倍|秒|分钟|小时|天|周|月|年|人|次|条|道|题|项|款|元|美元|"
    r"\$|USD|RMB|GB|MB|KB|TB|ms|px|字|词|分位|名"
)
FACT = rf"(?i)[0-9][0-9,\.]*\s*(?:{UNIT})|(19|20)[0-9]{{2}}\s*[-/年]\s*[0-9]{{1,2}}|(19|20)[0-9]{{2}}\s*年"
RANGE = r"[0-9][0-9,\.]*\s*(?:到|至|-|~|–)\s*[0-9]"
SOURCE_MARK = r"(?i)(来源|出处|据[^，。]{0,8}(称|报道|显示)|引自|source\s*:|according to|per\s+the|<cite[ >])"
MARKETING = (
    r"(?i)(#1\b|\bbest ever\b|\bamazing\b|\bworld.?s best\b|\bnumber one\b|\bfree forever\b|\bmost powerful\b|"
    r"\brevolutionary\b|\bgame.?changer\b|\bcutting.?edge\b|\bunleash\b|\bsupercharge\b|\bseamlessly\b|"
    r"\beffortlessly\b|业界领先|颠覆式|一键搞定|最强|极致体验|遥遥领先|全网最)"
)
#: The same phrases behind one word boundary for all, so that no place inside of a word is tried for each of them.
_PHRASES = MARKETING.removeprefix("(?i)(").removesuffix(")").split("|")
_AT_WORD, _OTHER = ([p for p in _PHRASES if p.startswith(r"\b") is k] for k in (True, False))
MARKETING_SCAN = rf"(?i)(\b(?:{'|'.join(p.removeprefix(chr(92) + 'b') for p in _AT_WORD)})|{'|'.join(_OTHER)})"
DANGLING = r"(?i)^\s*(它们|它|他们|该方案|该功能|该产品|这一点|这些|那些|上述|this\b|that\b|these\b|those\b|it\b|they\b)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row; a column that is used in a lambda is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; NULL without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clean_text(html: Column) -> Column:
    """Text without elements that are not shown, comments, tags and entities; white space is collapsed."""
    h = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED)})[^>]*>.*?</\1>", " ")
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]+>", " "), ("&(?:nbsp|#160);", " "), ("&amp;", "&"), ("&[a-zA-Z#0-9]{2,8};", " "), (_RUNS, " ")):
        h = F.regexp_replace(h, pattern, to)
    return F.trim(h)


def words(text: Column) -> Column:
    return extract_all(text, WORD, 0)


def first_words(text: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def tags(html: Column, name: str) -> Column:
    """Non-empty texts of all elements of a name."""
    return F.filter(F.transform(extract_all(html, rf"(?is)<{name}[^>]*>(.*?)</{name}>"), clean_text), lambda t: t != "")


def distinct_tags(html: Column, name: str, limit: int = 40) -> Column:
    return F.slice(F.transform(F.array_distinct(tags(html, name)), lambda t: F.substring(t, 1, 200)), 1, limit)


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?。！？])\s+|(?<=[。！？])"), lambda s: F.trim(s, F.lit(SPACES)))
    return F.filter(parts, lambda s: F.char_length(s) >= 20)


def title(html: Column) -> Column:
    return clean_text(extract(html, r"(?is)<title[^>]*>(.*?)</title>"))


def lang(html: Column) -> Column:
    return extract(html, r"""(?is)<html[^>]*\blang=["']([\w\-]+)""")


def meta_description(html: Column) -> Column:
    return F.substring(extract(html, r"""(?is)<meta[^>]+name=["']description["'][^>]*content=["']([^"']*)"""), 1, 300)


def meta_robots(html: Column) -> Column:
    return F.lower(stripped(extract(html, r"""(?is)<meta[^>]+name=["']robots["'][^>]*content=["']([^"']*)""")))


def canonicals(html: Column) -> Column:
    """Addresses of the canonical links, in order."""
    links = extract_all(html, r"""(?is)<link[^>]+rel=["']canonical["'][^>]*>""", 0)
    return F.array_compact(F.transform(links, lambda c: extract(c, r"""(?i)href=["']([^"']+)""")))


def images(html: Column, limit: int = 30) -> Column:
    """array<struct<src, alt>> of the first images; alt is NULL without one and '' if it is empty."""
    found = F.transform(extract_all(html, r"(?is)<img[^>]*>", 0), lambda i: F.struct(F.substring(F.regexp_extract(i, r"""(?i)src=["']([^"']+)""", 1), 1, 200).alias("src"), extract(i, r"""(?i)alt=["']([^"']*)""").alias("alt")))
    return F.slice(found, 1, limit)


def escaped(text: Column) -> Column:
    """Text that stands in HTML as it is."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def hrefs(html: Column) -> Column:
    return extract_all(html, r"""(?i)<a[^>]+href=["']([^"'#][^"']*)["']""")


def internal_links(html: Column, host: Column) -> Column:
    return F.array_distinct(F.filter(hrefs(html), lambda h: h.startswith("/") | ((host != "") & F.contains(h, host))))


def external_links(html: Column, host: Column) -> Column:
    return F.array_distinct(F.filter(hrefs(html), lambda h: ~(h.startswith("/") | ((host != "") & F.contains(h, host))) & h.rlike("^https?://")))


def blocks(html: Column) -> Column:
    """array<struct<tag, html, text>>: block elements with text, then rows of markdown tables."""
    pattern = rf"(?is)<({'|'.join(t for t in ('p', 'li', 'figcaption', 'h[1-6]', 'blockquote', 'td', 'th', 'dd'))})[^>]*>(.*?)</\1>"
    found = F.zip_with(extract_all(html, pattern, 1), extract_all(html, pattern, 2), lambda t, h: F.struct(F.lower(t).alias("tag"), h.alias("html"), clean_text(h).alias("text")))
    lines = F.filter(F.transform(F.split(html, r"\r\n|\n|\r"), stripped), lambda s: s.startswith("|") & (F.regexp_count(s, F.lit(r"\|")) >= 3) & ~s.rlike(r"^\|[\s\-:|]+\|$"))
    rows = F.transform(lines, lambda s: F.struct(F.lit("mdrow").alias("tag"), s.alias("html"), clean_text(F.regexp_replace(s, r"^\|+|\|+$", "")).alias("text")))
    return F.filter(F.concat(found, rows), lambda b: b["text"] != "")


def is_fact(block: Column) -> Column:
    """A number with a unit, a date, a range or a link to elsewhere."""
    return block["text"].rlike(FACT) | block["text"].rlike(RANGE) | block["html"].rlike(r"""(?i)href=["']https?://""")


def terms(text: Column) -> Column:
    """Distinct terms in order: words of two letters or more that mean something, then pairs of Han characters."""
    low = F.lower(text)
    plain = F.filter(extract_all(low, "[a-z]{2,}", 0), lambda w: ~w.isin(STOP))
    pairs = F.flatten(F.transform(extract_all(low, "[一-鿿]{2,}", 0), lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(plain, F.filter(pairs, lambda w: ~w.isin(STOP))))


def has_fact(block: Column) -> Column:
    """A number with a unit or a date in the text of a block."""
    return block["text"].rlike(FACT)


def is_cited(block: Column) -> Column:
    """A block with a link to elsewhere, in HTML or Markdown."""
    links = F.concat(extract_all(block["html"], r"""(?i)<a[^>]+href=["']([^"']+)["']"""), extract_all(block["html"], r"\]\(([^)\s]+)\)"))
    return F.exists(links, lambda h: h.rlike("^https?://"))


def questions(text: Column, limit: int = 6) -> Column:
    """Sentences that end with a question mark."""
    return F.slice(F.filter(sentences(text), lambda s: s.rlike(r"[?？]$")), 1, limit)


def quotable(blocks: Column, limit: int = 6) -> Column:
    """Texts of the first blocks that hold a fact."""
    return F.slice(F.transform(F.filter(blocks, has_fact), lambda b: F.substring(b["text"], 1, 220)), 1, limit)


def nav_words(html: Column) -> Column:
    """Lower-cased words inside of header and nav elements."""
    return F.array_distinct(F.flatten(F.transform(extract_all(html, r"(?is)<(header|nav)[^>]*>(.*?)</\1>", 2), lambda h: words(F.lower(clean_text(h))))))


def wide_length(text: Column) -> Column:
    """Length in which a Han character counts as two."""
    return F.char_length(text) + F.regexp_count(text, F.lit("[一-鿿]"))
