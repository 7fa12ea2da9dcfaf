"""Review results: guards, quotas, explanations, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "hint", "warning", "error", "critical")


def guarded(results: DataFrame, most: int = 25) -> DataFrame:
    """Findings of review results (id, raw JSON) that pass the schema: known severity, title and reason, lines in order; at most ``most`` a result (the schema's limit)."""
    schema = "struct<score:double,findings:array<struct<id:string,severity:string,title:string,why_it_matters:string,evidence:struct<kind:string,snippet:string,start_line:int,end_line:int>>>>"
    rows = results.select("id", F.posexplode(F.from_json("raw", schema)["findings"]).alias("n", "f")).where(F.col("n") < most)
    good = F.col("f.severity").isin(*SEVERITIES) & (F.trim("f.title") != "") & (F.trim("f.why_it_matters") != "") & (F.coalesce("f.evidence.end_line", "f.evidence.start_line", F.lit(1)) >= F.coalesce("f.evidence.start_line", F.lit(1)))
    return rows.where(F.coalesce(good, F.lit(False))).select("id", "n", "f.severity", "f.title", F.col("f.why_it_matters").alias("why"))


def quota(findings: DataFrame, per_scope: dict[str, int]) -> DataFrame:
    """The first findings (id, scope, n) of each review up to its scope's quota."""
    limit = F.lit(0)
    for scope, most in per_scope.items():
        limit = F.when(F.col("scope") == scope, F.lit(most)).otherwise(limit)
    w = Window.partitionBy("id").orderBy("n")
    return findings.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")


def should_escalate(critical: Column, score: Column, threshold: float = 5.0) -> Column:
    return (critical > 0) | (score < threshold)


def convention_digest(conventions: DataFrame, by: str) -> DataFrame:
    """(by, digest): id@confidence, sorted and joined."""
    return conventions.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", "id", "confidence"))), ",").alias("digest"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


# What an explanation must hold, and phrases that say nothing.
EXPLANATION_SECTIONS = ("what", "why", "how")
EMPTY_PHRASES = r"(?i)\b(various things|does stuff|handles everything|as needed|and so on|self-explanatory)\b"


def explanation_faults(sections: Column, shortest: int = 24) -> Column:
    """Faults of an explanation (map of section to text): missing, short or empty sections."""
    found = []
    for name in EXPLANATION_SECTIONS:
        body = F.trim(F.coalesce(sections[name], F.lit("")))
        found += [F.when(body == "", F.lit(f"missing:{name}")), F.when((body != "") & (F.length(body) < shortest), F.lit(f"short:{name}")), F.when(body.rlike(EMPTY_PHRASES), F.lit(f"vague:{name}"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def pack_score(findings: DataFrame, penalties: dict[str, float], qualities: dict[str, float], cap: float = 10.0) -> DataFrame:
    """(review, score): 10 less the findings' penalties (review, severity, quality) times their quality's factor, the sum capped."""
    def lookup(column: str, table: dict[str, float], default: float) -> Column:
        out = F.lit(default)
        for name, value in table.items():
            out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
        return out

    points = lookup("severity", penalties, 0.0) * lookup("quality", qualities, 1.0)
    return findings.groupBy("review").agg(F.round(10 - F.least(F.sum(points), F.lit(cap)), 2).alias("score"))
