"""Audits of review comments: weak wording taken off or named, explanations held to what they must say, a report row for each finding that falls short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried: openings that turn a comment into a suggestion, and words that judge without saying what.
OPENINGS = (
    r"it (?:might|may) be (?:a )?good idea to\b",
    r"it (?:might|may) be worth\b",
    r"you may (?:want|wish) to\b",
    r"might want to\b",
    r"think about\b",
    r"try to\b",
    r"consider\b",
    r"maybe\b",
    r"might\b",
    r"could\b",
    r"perhaps\b",
    r"possibly\b",
)
VERDICTS = (
    r"\bneeds (?:some )?work\b",
    r"\bnot ideal\b",
    r"\ba bit (?:messy|ugly|rough|off)\b",
    r"\bcould be (?:better|cleaner|nicer|improved)\b",
    r"\bsub[- ]?optimal\b",
    r"\bcleaner\b(?! (?:than|version|shape|form))",
    r"\bnicer\b",
    r"^refactor(?:\s+this)?\.?$",
    r"^needs (?:a )?refactor\.?$",
)
# Risks that name nothing, signs of a hidden side effect (the first found names it), and costs that are concrete.
VAGUE_RISKS = (
    r"\bmay (?:cause|lead to|result in) (?:issues?|problems?|bugs?)\b",
    r"\bmight (?:cause|lead to|result in) (?:issues?|problems?|bugs?)\b",
    r"\bcould (?:cause|lead to|result in) (?:issues?|problems?|bugs?)\b",
    r"\bcan be (?:problematic|risky|bad|tricky)\b",
    r"\bnot (?:great|good|ideal) practice\b",
    r"\bbest practices?\b\.?\s*$",
)
SIDE_EFFECTS = (
    r"\bsilently\b",
    r"\bsilent (?:failure|fallback|swallow|catch)\b",
    r"\bunder the hood\b",
    r"\bbehind the scenes\b",
    r"\bshadow(?:s|ing|ed)?\b",
    r"\bhidden (?:side effect|mutation|coupling|dependency)s?\b",
    r"\bimplicit (?:cast|conversion|coercion|mutation|dependency|contract)s?\b",
    r"\bside[- ]?effect(?:s|ful)?\b",
    r"\bmutat(?:es|ion|ing) (?:shared|global|external|caller)\b",
    r"\bswallow(?:s|ed|ing) (?:errors?|exceptions?)\b",
    r"\bsuppress(?:es|ed|ing) (?:errors?|exceptions?|warnings?)\b",
    r"\bmonkey[- ]?patch\w*",
    r"\bnon[- ]?obvious (?:effect|mutation|dependency)s?\b",
    r"\bunexpected(?:ly)?\b",
    r"\bgotcha\w*",
    r"\bleak(?:s|ed|ing) (?:state|memory|secrets?|context)\b",
)
COSTS = (
    r"\bdata (?:loss|corruption|leak)\b",
    r"\boutage\b",
    r"\bincident\b",
    r"\bexploit\w*",
    r"\binjection\b",
    r"\brce\b",
    r"\brace\b",
    r"\bdeadlock\b",
    r"\bn\+1\b",
    r"\bmemory leak\b",
    r"\brevert\b",
    r"\bregression\b",
    r"\btest gap\b",
    r"\bonboarding\b",
    r"\bunreviewable\b",
    r"\bcognitive load\b",
    r"\bbreaks? (?:callers?|consumers?|contracts?|invariants?)\b",
    r"\bwhen (?:the|an?|another|a concurrent|the next)\b",
    r"\bevery (?:caller|consumer|reader|contributor)\b",
)
EXPLAINED = ("critical", "error", "warning")
SHORTEST_MESSAGE, SHORTEST_WHY, SHOWN_COMMENT, SHOWN_WHY, LONGER_THAN_TITLE = 12, 60, 80, 120, 40
BLANKS = " \t\n\x0b\f\r"
ISSUE = "struct<field:string,kind:string,offending:string>"


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def any_of(patterns: tuple[str, ...]) -> str:
    """One expression for the first of the patterns that fits at a place."""
    return f"(?i)(?:{'|'.join(patterns)})"


OPENING = f"(?i)^(?:{'|'.join(OPENINGS)})"


def without_hedge(text: Column) -> Column:
    """Text without the weak opening that it begins with, capitalised anew; as it is where nothing else is left."""
    own = F.ltrim(text, F.lit(BLANKS))
    rest = F.ltrim(F.regexp_replace(own, OPENING, ""), F.lit(BLANKS))
    return F.when(~own.rlike(OPENING), text).when(rest == "", own).otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))


def issue(field: str, kind: str, offending: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), offending.alias("offending"))


def strength_issues(message: Column, why: Column, fix: Column) -> Column:
    """Array of (field, kind, offending) of a finding's wording: too short a message, a weak opening, a verdict without a target."""
    found = []
    for field, text in (("message", message), ("whyItMatters", why), ("fixHint", fix)):
        own = trimmed(text)
        shown = F.substring(own, 1, SHOWN_COMMENT)
        if field == "message":
            found.append(F.when((own != "") & (F.length(own) < SHORTEST_MESSAGE), issue(field, "too-short", own)))
        found.append(F.when(own.rlike(OPENING), issue(field, "hedged-opening", shown)))
        found.append(F.when(own.rlike(any_of(VERDICTS)), issue(field, "empty-verdict", shown)))
    return F.filter(F.array(*found).cast(f"array<{ISSUE}>"), lambda x: x.isNotNull())


def side_effect(prose: Column) -> Column:
    """The words that hint at a hidden side effect, by the first sign that is met; null for none."""
    found = [F.when(prose.rlike(f"(?i){p}"), F.lower(F.trim(F.regexp_extract(prose, f"(?i)({p})", 1)))) for p in SIDE_EFFECTS]
    return F.coalesce(*found)


def compared(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[\\s.,;:!?\"'`()\\[\\]]+", " "))


def restates(why: Column, title: Column, message: Column) -> Column:
    """Whether an explanation only says its title, or a little more, or its message again."""
    w, t, m = compared(why), compared(title), compared(message)
    like_title = (t != "") & (t.contains(w) | w.contains(t))
    return (w != "") & F.when(like_title, F.length(w) < F.length(t) + LONGER_THAN_TITLE).otherwise((m != "") & (w == m))


def teaching_issues(severity: Column, title: Column, message: Column, why: Column, hidden: Column) -> Column:
    """Array of (field, kind, offending) of a finding's explanation: missing (for what is serious), shallow, said before, vague, or silent on a ``hidden`` side effect."""
    why, title, message = trimmed(why), trimmed(title), trimmed(message)
    shown = F.substring(why, 1, SHOWN_WHY)
    there = why != ""
    found = [
        F.when(~there & F.lower(F.coalesce(severity, F.lit("info"))).isin(*EXPLAINED), issue("whyItMatters", "missing-why", F.lit(""))),
        F.when(there & (F.length(why) < SHORTEST_WHY), issue("whyItMatters", "shallow-why", shown)),
        F.when(there & restates(why, title, message), issue("whyItMatters", "restates-title", shown)),
        F.when(there & why.rlike(any_of(VAGUE_RISKS)), issue("whyItMatters", "unspecified-risk", shown)),
        F.when(there & hidden & ~why.rlike(any_of(COSTS)), issue("whyItMatters", "undisclosed-side-effect", shown)),
    ]
    return F.filter(F.array(*found).cast(f"array<{ISSUE}>"), lambda x: x.isNotNull())


FINDING = "struct<id:string,severity:string,title:string,message:string,why_it_matters:string,whyItMatters:string,fix_hint:string,fixHint:string,evidence:struct<snippet:string>>"


def enforced(results: DataFrame) -> DataFrame:
    """Findings of review results (id, raw JSON), one row each: wording rewritten, side effect named, and what is left to object to.

    (id, n, finding_id, severity, title, message, why, fix, side_effect, strength, teaching); malformed
    results have no rows.
    """
    rows = results.select("id", F.posexplode(F.from_json("raw", f"struct<findings:array<{FINDING}>>")["findings"]).alias("n", "f")).where("f IS NOT NULL")
    rows = rows.select("id", "n", F.col("f.id").alias("finding_id"), "f.severity", "f.title", *[without_hedge(F.col(f"f.{c}")).alias(c) for c in ("message", "whyItMatters", "fixHint")], F.col("f.why_it_matters").alias("own_why"), F.col("f.fix_hint").alias("own_fix"), F.col("f.evidence.snippet").alias("snippet"))
    prose = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("message", F.lit("")), F.coalesce("snippet", F.lit("")))
    why = F.coalesce("own_why", "whyItMatters")
    rows = rows.withColumn("side_effect", side_effect(prose))
    rows = rows.withColumns({"strength": strength_issues(F.col("message"), F.col("whyItMatters"), F.col("fixHint")), "teaching": teaching_issues(F.col("severity"), F.col("title"), F.col("message"), why, F.col("side_effect").isNotNull())})
    return rows.select("id", "n", "finding_id", "severity", "title", "message", why.alias("why"), F.coalesce("own_fix", "fixHint").alias("fix"), "side_effect", "strength", "teaching")


def report(findings: DataFrame) -> DataFrame:
    """(id, n, finding_id, audit, field, kind, offending): a row for each issue of enforced findings."""
    def named(audit: str) -> Column:
        return F.transform(audit, lambda x: F.struct(F.lit(audit).alias("audit"), x["field"].alias("field"), x["kind"].alias("kind"), x["offending"].alias("offending")))

    both = F.concat(named("strength"), named("teaching"))
    return findings.select("id", "n", "finding_id", F.explode(both).alias("x")).select("id", "n", "finding_id", "x.*")
