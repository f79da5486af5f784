"""Secret scans by a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression is reduced to a Boolean query of trigrams that every match must contain: an AND of
clauses, each an OR of options, each an AND of trigrams.  One pass over the texts posts those of the rules' trigrams
that a document has; postings are intersected option by option; and the texts of the documents that are left are
matched with the whole expression.  Rules without a mandatory trigram scan every document.

Trigrams are of lower-cased text, so that a posting may be one too many and never one too few.

Cases: a null text is an empty one, without secrets; rows repeat as they are; a null doc_id is kept; an empty table
gives an empty table; other columns are ignored, and ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import settled
from .columns import keyed, left_join_few, maybe_of

OPTIONS = 64
#: Matches, or characters, of a part of a long text.
PART = 1024
SPANS = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least ``least`` characters."""

    kind: str
    regex: str
    group: int
    least: int
    base: bool = True


#: The three base rules, and two that this method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
)
PLACEHOLDER = "<secret>"


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Clauses of options of trigrams; no clause: nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(options):
            clauses.append(sorted((o for o in options if not any(p < o for p in options)), key=sorted))

    def literal(items) -> set[str] | None:
        """All strings that the items match, lower-cased, if they are few."""
        found = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif op is sre.BRANCH:
                parts = [literal(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is sre.SUBPATTERN:
                more = literal(arg[3])
            elif op is sre.MAX_REPEAT and arg[1] == 1:
                more = literal(arg[2])
                more = more and more | ({""} if arg[0] == 0 else set())
            else:
                more = None
            if more is None or len(found) * len(more) > OPTIONS:
                return None
            found = {a + b for a in found for b in more}
        return found

    run: set[str] = {""}
    for item in parser.parse(regex):
        more = literal([item])
        if more is None or len(run) * len(more) > OPTIONS:
            close(run)
            run = more or {""}
        else:
            run = {a + b for a in run for b in more}
    close(run)
    return clauses


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the matches that count, in code points, end exclusive.

    The text between matches (split) and the matches themselves give every position by running sums of lengths.  Sums
    run over parts of ``PART`` matches, which are then put behind one another, so that no long array grows by ones.
    """
    regex, group = _quick(rule), rule.group
    between = F.split(text, regex, -1)
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    steps = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("n"))), held, lambda s, h: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), (F.char_length(h) >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(part: Column, begin: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            at = acc["at"] + s["gap"]
            span = F.struct(at.alias("start"), (at + s["n"]).alias("end"))
            return F.struct((at + s["n"]).alias("at"), F.when(s["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    # ``steps`` is named by a one-element array, so that it is made once.
    def whole_text(steps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PART).cast("int")), lambda c: F.slice(steps, c * PART + 1, PART))
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, s: n + s["gap"] + s["n"]))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.when(F.size(steps) > 0, F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), placed))).otherwise(none)

    return F.flatten(F.transform(F.array(steps), whole_text))


def _quick(rule: Rule) -> str:
    """The expression; of a rule that is a run of one class, one that finds long enough runs alone."""
    return f"{rule.regex[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]*\]\+", rule.regex) and rule.group == 0 else rule.regex


def _any_of(trigrams: list[str]) -> str:
    """A lookahead for Java that captures the trigram, of these, that begins at a place; none shares a branch by its first letter."""
    escaped = lambda t: re.sub(r"([^A-Za-z0-9])", r"\\\1", t)
    by_first = {c: [escaped(t[1:]) for t in trigrams if t[0] == c] for c in sorted({t[0] for t in trigrams})}
    return "(?=(" + "|".join(f"{escaped(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, _id, _k): the index of these trigrams, from one pass over the lower-cased texts; in a table."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(trigrams)), F.lit(1)))
    return settled(docs.where("text is not null").select(F.explode_outer(found).alias("trigram"), "_id", "_k").where("trigram is not null").distinct())


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _k, _rules): the rules whose trigram query a document's postings satisfy."""
    spark = docs.sparkSession
    terms, sizes = [], []
    for rule in rules:
        clauses = trigram_query(rule.regex)
        sizes += [(rule.kind, len(clauses))] if clauses else []
        terms += [(rule.kind, c, o, t, len(option)) for c, options in enumerate(clauses) for o, option in enumerate(options) for t in sorted(option)]
    if not terms:
        return docs.select("_id", "_k", F.array().cast("array<string>").alias("_rules")).limit(0)
    terms_df = spark.createDataFrame(terms, "rule string, clause int, option int, trigram string, needed int")  # of the rules alone
    sizes_df = spark.createDataFrame(sizes, "rule string, clauses int")
    index = postings(docs, sorted({t[3] for t in terms}))
    met = index.join(F.broadcast(terms_df), "trigram").groupBy("_id", "_k", "rule", "clause", "option", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed")
    met = met.groupBy("_id", "_k", "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(sizes_df), "rule").where("n = clauses")
    return settled(met.groupBy("_id", "_k").agg(F.collect_set("rule").alias("_rules")))


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, _id, _k and _spans (array<struct<start, kind_order, kind, end>>, by start and kind) of every row of docs.

    Texts are read for the index, by rules that scan everything, and for the candidates, which bitmaps of fixed size mark
    as the texts are read; spans alone are joined.
    """
    docs = keyed(docs)
    found = candidates(docs, rules)
    none = F.array().cast("array<struct<start:int,end:int>>")
    text = F.coalesce("text", F.lit(""))
    indexed = {r.kind for r in rules if trigram_query(r.regex)}
    spans = lambda kinds: F.concat(F.array().cast(SPANS), *kinds)
    scanned = spans([_tagged(F.when(text.rlike(_quick(r)), _spans(text, r)).otherwise(none), k, r.kind) for k, r in enumerate(rules) if r.kind not in indexed])
    asked = spans([_tagged(F.when(F.array_contains("_tags", r.kind), _spans(text, r)).otherwise(none), k, r.kind) for k, r in enumerate(rules) if r.kind in indexed])
    kinds = [r.kind for r in rules if r.kind in indexed]
    met = maybe_of(docs, F.xxhash64("_id", "_k"), found.select("_id", "_k", F.explode("_rules").alias("rule")), kinds, "rule") if kinds else docs.select("*", F.array().cast("array<string>").alias("_tags")).limit(0)
    met = met.select("_id", "_k", asked.alias("_met")).where(F.size("_met") > 0)
    met = settled(met).dropDuplicates(["_id", "_k"])
    rows = docs.select("doc_id", "_id", "_k", scanned.alias("_scanned")).join(met, ["_id", "_k"], "left")
    return rows.select("doc_id", "_id", "_k", F.sort_array(F.concat("_scanned", F.coalesce("_met", F.array().cast(SPANS)))).alias("_spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    found = find_secrets(docs, rules)
    count = [_count(k) for k in base]
    return found.select("doc_id", *count, F.sha2(_joined(F.filter("_spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def _piece(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text that is given in parts of ``PART`` characters."""
    first = F.floor(a / PART).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(some, a - first * PART + 1, b - a)).otherwise("")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with each run of overlapping spans in text replaced by the placeholder; other columns stay.

    Only texts with spans are dealt to where their spans are.
    """
    each = find_secrets(docs, rules).where(F.size("_spans") > 0).dropDuplicates(["_id", "_k"]).select("_id", "_k", F.explode("_spans").alias("s"))
    each = each.select("_id", "_k", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    order = Window.partitionBy("_id", "_k").orderBy("start", F.desc("end"))
    fresh = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    each = each.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = each.groupBy("_id", "_k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = settled(runs.groupBy("_id", "_k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_k"))
    text = F.col("row.text").cast("string")
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    found = left_join_few(rows, runs, ["_id", "_k"], F.xxhash64("_id", "_k")).select("row", "_runs", F.when(F.col("_runs").isNotNull(), parts).alias("parts"))
    left = F.transform(F.sequence(F.lit(0), F.size("_runs")), lambda i: _piece(F.col("parts"), F.coalesce(F.get("_runs", i - 1)["end"], F.lit(0)), F.coalesce(F.get("_runs", i)["start"], F.char_length(text))))
    own = lambda clean: [clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*own(F.when(F.col("_runs").isNull(), text).otherwise(F.array_join(left, placeholder))))
