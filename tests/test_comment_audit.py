"""Comment audits, one case for each fixed value and branch."""

import json

import pytest

from tessera.operators import comment_audit as audit

HEDGED = {
    "it might be a good idea to split": "Split", "It may be good idea to split": "Split", "it may be worth a test": "A test", "You may want to split": "Split", "you may wish to split": "Split", "might want to split": "Split", "think about retries": "Retries", "Try to split": "Split",
    "consider splitting": "Splitting", "maybe split": "Split", "might split": "Split", "could split": "Split", "perhaps split": "Split", "  possibly split": "Split", "consider": "consider", "You should consider it": "You should consider it", "considering all": "considering all", "maybe  \n x": "X",
}
VERDICTS = ["needs work", "needs some work", "not ideal here", "a bit off", "it could be improved", "sub-optimal", "suboptimal", "make it cleaner", "nicer names", "refactor", "Refactor this.", "needs refactor", "needs a refactor."]
FINE = ["cleaner than before", "a cleaner shape", "refactor this method now", "needs a refactor of x", "ideal"]
SIGNS = [
    "fails silently", "a silent catch", "under the hood", "behind the scenes", "shadowing", "hidden couplings", "implicit casts", "side effect", "side-effects", "sideeffectful", "mutates shared", "mutation caller", "swallowed errors", "suppressing warnings", "monkeypatched", "monkey-patch", "nonobvious effects", "unexpectedly", "gotchas", "leaking secrets",
]
COSTS = [
    "data loss", "data corruption", "outage", "incident", "exploitable", "injection", "rce", "race", "deadlock", "n+1", "memory leak", "revert", "regression", "test gap", "onboarding", "unreviewable", "cognitive load", "breaks callers", "break invariants", "when an", "when the next", "every reader",
]
RISKS = ["may cause issues", "might lead to a bug", "might lead to bugs", "could result in problems", "can be tricky", "not good practice", "follow best practices. "]
LONG = " and so the reader of this long sentence learns nothing that is new to anyone at all"


def enforced(spark, findings):
    raw = json.dumps({"findings": findings})
    return audit.enforced(spark.createDataFrame([("r", raw)], "id string, raw string")).orderBy("n").collect()


def kinds(issues):
    return [(i.field, i.kind) for i in issues]


def test_openings_and_verdicts(spark):
    rows = enforced(spark, [{"message": m, "severity": "info"} for m in HEDGED])
    assert [r.message for r in rows] == list(HEDGED.values())
    assert [("message", "hedged-opening") in kinds(r.strength) for r in rows] == [m == "consider" for m in HEDGED]
    rows = enforced(spark, [{"fixHint": v, "severity": "info"} for v in VERDICTS + FINE])
    assert [kinds(r.strength) for r in rows] == [[("fixHint", "empty-verdict")]] * len(VERDICTS) + [[]] * len(FINE)
    assert kinds(enforced(spark, [{"message": "short", "whyItMatters": "it"}])[0].strength) == [("message", "too-short")]
    assert enforced(spark, [{"message": "x" * 75 + " not ideal"}])[0].strength[0].offending == "x" * 75 + " not "


def test_signs_costs_and_risks(spark):
    rows = enforced(spark, [{"title": f"It {s} here", "why_it_matters": "Because it is so." + LONG} for s in SIGNS])
    assert all(r.side_effect and kinds(r.teaching) == [("whyItMatters", "undisclosed-side-effect")] for r in rows)
    assert [r.side_effect for r in rows[:5]] == ["silently", "silent catch", "under the hood", "behind the scenes", "shadowing"]
    rows = enforced(spark, [{"title": "silently", "why_it_matters": f"There is {c} to it." + LONG} for c in COSTS])
    assert [kinds(r.teaching) for r in rows] == [[]] * len(COSTS)
    rows = enforced(spark, [{"title": "t", "why_it_matters": LONG + " it " + x} for x in RISKS])
    assert [("whyItMatters", "unspecified-risk") in kinds(r.teaching) for r in rows] == [x != "might lead to a bug" for x in RISKS]
    assert enforced(spark, [{"title": "plain", "evidence": {"snippet": "// gotcha!"}}])[0].side_effect == "gotcha"
    assert enforced(spark, [{"title": "unexpected, silently"}])[0].side_effect == "silently"  # by the order of signs, not of words


@pytest.mark.parametrize(
    "finding, expected",
    [
        ({"severity": "Error"}, ["missing-why"]),
        ({"severity": "hint"}, []),
        ({"severity": "odd"}, []),
        ({"why_it_matters": "too little"}, ["shallow-why"]),
        ({"title": "Rename total", "why_it_matters": "rename: total!"}, ["shallow-why", "restates-title"]),
        ({"title": "Rename", "why_it_matters": "Rename it, since grand totals and totals differ in each of the reports that are read"}, []),
        ({"message": "One long message that says something about nothing much but is long enough", "why_it_matters": "one long message (that says something about nothing much) but is long enough."}, ["restates-title"]),
        ({"whyItMatters": "   "}, []),
        ({"severity": "critical", "whyItMatters": "Maybe" + LONG}, []),
    ],
)
def test_explanations(spark, finding, expected):
    assert [k for _, k in kinds(enforced(spark, [finding])[0].teaching)] == expected


def test_reports(spark):
    raw = [("a", json.dumps({"findings": [{"id": "f1", "severity": "error", "message": "nicer names, please"}, None, {"id": "f2", "message": "Rename total to grand_total"}]})), ("b", "no json"), ("c", None), ("d", "{}"), ("e", '{"findings": []}')]
    found = audit.enforced(spark.createDataFrame(raw, "id string, raw string"))
    assert [(r.id, r.n, r.finding_id) for r in found.orderBy("n").collect()] == [("a", 0, "f1"), ("a", 2, "f2")]
    assert sorted(tuple(r) for r in audit.report(found).collect()) == [("a", 0, "f1", "strength", "message", "empty-verdict", "nicer names, please"), ("a", 0, "f1", "teaching", "whyItMatters", "missing-why", "")]
