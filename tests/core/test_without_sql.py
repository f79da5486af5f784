"""Every query has SQL; robots_decision gives what its rules say, worked out by hand."""

from pagelens.operators.crawl import AGENTS
from pagelens.plans.rubric import ACTION_ORDER, AUDIT_WEIGHTS
from pagelens.queries import inline_queries, oracle_sql, queries

DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys() and not queries().keys() & inline_queries().keys()


def test_robots_decision(spark):
    agents = [a for names in AGENTS.values() for a in names]
    others = {"a": ("wildcard", True), "b": ("wildcard", True), "c": ("none", True), "d": ("wildcard", False)}
    want = {(site, agent): told for site, told in others.items() for agent in agents}
    want |= {("a", "Googlebot"): ("explicit", True), ("a", "GPTBot"): ("explicit", False), ("a", "CCBot"): ("explicit", False), ("d", "Bingbot"): ("explicit", True)}
    rows = inline_queries()["robots_decision"](spark, DIR).collect()
    assert len(rows) == len(want) and {(r.site, r.agent): (r.grp_kind, r.allowed) for r in rows} == want


def test_full_scorecard(spark):
    """All 21 items of each page, from the queries of the single items, whose SQL is tested."""
    run = lambda name: queries()[name](spark, DIR).collect()
    scores = {r.page_id: dict.fromkeys(AUDIT_WEIGHTS) | {k: v for k, v in r.asDict().items() if k != "page_id"} for r in run("audit_items")}
    for name in ("shared_term", "declared_values"):
        for r in run(name):
            scores[r[0]][r.__fields__[1]] = r[1]
    overlap = {r.site: r.K1 for r in run("keyword_overlap")}
    for r in run("url_parts"):
        scores[r.page_id]["K1"] = overlap[r.host]
    cards, acts = {r.page_id: r for r in run("full_scorecard")}, {r.page_id: r.item for r in run("full_next_action")}
    assert cards.keys() == scores.keys()
    for page, s in scores.items():
        seen = {i: v for i, v in s.items() if v is not None}
        fails = {i for i, v in seen.items() if v < (2 if AUDIT_WEIGHTS[i] else 1)}
        below, gates = (",".join(sorted(i for i in fails if bool(AUDIT_WEIGHTS[i]) is k)) for k in (True, False))
        weights = {i: AUDIT_WEIGHTS[i] or 0 for i in seen}
        card = cards[page]
        assert (card.got, card.full) == (sum(seen[i] * w for i, w in weights.items()), 3 * sum(weights.values()))
        assert (card.below_floor, card.failed_gates, card.unobserved) == (below, gates, ",".join(sorted(s.keys() - seen.keys())))
        assert card.verdict == ("REJECT" if gates else "REWORK" if below else "PASS") and acts.get(page) == min(fails, key=ACTION_ORDER.index, default=None)
    assert any(s["K2"] is not None and s["K2"] < 2 for s in scores.values()) and all("T1" in c.unobserved for c in cards.values())
