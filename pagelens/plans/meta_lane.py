"""Scores of (title, description) pairs: the meta lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Hooks of a description, verbs, and what a page type must say.
HOOKS = {
    "number": r"(?i)\d+\s*(秒|分钟|小时|天|次|个|条|页|张|人|%|percent|sec|second|min|minute|hour|day|x\b)",
    "price": r"(?i)(\$|¥|€|£|\d+\s*(美元|元|刀)|\b(usd|eur|cny|rmb)\b|/\s*(mo|month|月))",
    "free": r"(?i)(免费|不用注册|无需注册|不用登录|\bfree\b|no sign.?up|no account|no credit card)",
    "output": r"(?i)(导出|下载|支持|兼容|\b(mp4|gif|png|jpg|pdf|csv|svg|webp|json)\b|\b(instagram|linkedin|tiktok|youtube|twitter|facebook|x)\b|export|download)",
}
VERB = r"(?i)(生成|制作|转换|检测|分析|创建|上传|导出|下载|排期|发布|写|做|查|试|\bgenerate|\bcreate|\bconvert|\bmake|\bbuild|\bwrite|\bcheck|\bschedule|\bpublish|\bturn\b)"
TOOL_VERB = r"(?i)(生成器|转换器|检测器|分析器|编辑器|生成|转换|检测|分析|压缩|裁剪|去除|\bgenerator\b|\bconverter\b|\bchecker\b|\banalyzer\b|\beditor\b|\bmaker\b|\bcreator\b|\bremover\b|\bcompressor\b|\bdetector\b)"
AUDIENCE = r"(?i)(给|为|适合|面向|团队|个人|创作者|开发者|商家|新手|专业|运营|营销|设计师|\bfor\b|\bteams?\b|\bcreators?\b|\bdevelopers?\b|\bmarketers?\b|\bagencies\b|\bbeginners?\b|\bfreelancers?\b|\bbusinesses\b)"


def _length(n: Column, good: tuple[int, int], fair: tuple[int, int]) -> Column:
    return F.when(n == 0, 0).when(n.between(*good), 3).when(n.between(*fair), 2).otherwise(1)


def meta_items(pairs: DataFrame) -> DataFrame:
    """id and scores MG1, M1 to M6 and C4 of (id, title, description, keyword, page_type); NULL is unobserved."""
    title, text = T.stripped(F.coalesce("title", F.lit(""))), T.stripped(F.coalesce("description", F.lit("")))
    n, m = T.wide_length(title), T.wide_length(text)
    a, b = T.terms(title), T.terms(text)
    alike = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    wanted = T.terms(F.coalesce("keyword", F.lit("")))
    found = F.filter(F.transform(wanted, lambda t: F.instr(F.lower(title), t)), lambda at: at > 0)
    place = T.wide_length(F.substring(title, F.lit(1), F.array_min(found) - 1)) / F.greatest(F.lit(1), n)
    both = F.concat_ws(" ", title, text)
    hooks = sum(text.rlike(p).cast("int") for p in HOOKS.values())
    lower = F.lower(both)
    need = (
        F.when(F.col("page_type") == "home", (F.size(F.filter(wanted, lambda t: F.contains(lower, t))) > 0).cast("int") + both.rlike(AUDIENCE).cast("int"))
        .when(F.col("page_type") == "tool", both.rlike(TOOL_VERB).cast("int") + (both.rlike(HOOKS["output"]) | both.rlike(HOOKS["number"])).cast("int"))
        .when(F.col("page_type") == "pricing", both.rlike(r"\d").cast("int") + both.rlike(HOOKS["price"]).cast("int"))
    )
    hype = F.regexp_count(both, F.lit(T.MARKETING_SCAN))
    return pairs.select(
        "id",
        ((n >= 6) & (m >= 20)).cast("int").alias("MG1"),
        _length(n, (15, 60), (10, 70)).alias("M1"),
        _length(m, (70, 155), (50, 175)).alias("M2"),
        F.when(F.size(wanted) <= 0, None).when(F.size(found) == 0, 0).when(place <= 1 / 3, 3).when(place <= 1 / 2, 2).otherwise(1).alias("M3"),
        F.when((F.size(a) == 0) | (F.size(b) == 0), None).when(alike <= 0.3, 3).when(alike <= 0.5, 2).when(alike <= 0.7, 1).otherwise(0).alias("M4"),
        F.when(hooks >= 2, 3).when(hooks == 1, 2).when(text.rlike(VERB), 1).otherwise(0).alias("M5"),
        F.when(need == 2, 3).when(need == 1, 2).when(need == 0, 0).alias("M6"),
        F.when(hype == 0, 3).when(hype == 1, 2).when(hype <= 3, 1).otherwise(0).alias("C4"),
    )
