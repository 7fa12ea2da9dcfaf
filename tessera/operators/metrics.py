"""Usage metrics, severity scores, risk indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import FUNCTIONALITY_CATEGORIES, js_round, review_score, severity_penalty
from ..functions.text import fnv1a

# What a text must mention to carry a risk.
RISKS = {
    "auth": r"(?i)\b(auth|permission|login|session|token|policy|role)\w*",
    "payment": r"(?i)\b(payment|billing|invoice|refund|charge|subscription)\w*",
    "db-write": r"(?i)\b(insert|update|delete|upsert|save|create)\w*\s*\(",
    "fs-write": r"(?i)\b(writeFile|appendFile|unlink|mkdir|file_put_contents)\b",
    "network": r"(?i)\b(fetch|axios|http|curl|request)\w*",
    "env": r"(?i)(process\.env|getenv|env\()",
    "crypto": r"(?i)\b(encrypt|decrypt|hash|cipher|hmac|bcrypt)\w*",
}


def usage_totals(events: DataFrame) -> DataFrame:
    """(kind, uses, latency_sum, latency_count, latency_avg) of events (kind, n, latency): additive sums, so streams and batches agree."""
    n = F.greatest(F.coalesce(F.col("n"), F.lit(1)), F.lit(1))
    out = events.groupBy("kind").agg(F.sum(n).alias("uses"), F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency_sum"), F.count("latency").alias("latency_count"))
    return out.withColumn("latency_avg", F.when(F.col("latency_count") > 0, js_round(F.col("latency_sum") / F.col("latency_count"))))


def frequent_sources(events: DataFrame) -> DataFrame:
    """(path_hash, uses): how often each source was used."""
    return events.where("path_hash IS NOT NULL").groupBy("path_hash").agg(F.sum(F.greatest(F.coalesce(F.col("n"), F.lit(1)), F.lit(1))).alias("uses"))


def last_by_kind(events: DataFrame, most: int = 64, key: str = "kind", order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """The last ``most`` events of each key, in reverse order (nth 1 is the last): a limit Spark applies before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def scored_findings(findings: DataFrame, by: str) -> DataFrame:
    """(by, functionality_penalty, style_penalty, score) of findings (by, severity, category)."""
    points = severity_penalty(F.col("severity"))
    functional = F.lower(F.coalesce(F.col("category"), F.lit("other"))).isin(*FUNCTIONALITY_CATEGORIES)
    sums = findings.groupBy(by).agg(F.sum(F.when(functional, points).otherwise(0.0)).alias("functionality_penalty"), F.sum(F.when(functional, 0.0).otherwise(points)).alias("style_penalty"))
    return sums.withColumn("score", review_score(F.col("functionality_penalty") + F.col("style_penalty")))


def seniority(score: Column) -> Column:
    """The band of a score out of ten."""
    return F.when(score >= 9, "Senior").when(score >= 7.5, "Mid-level").when(score >= 6, "Junior").otherwise("Novice")


def demo_score(findings: DataFrame, reviews: DataFrame, most: int) -> DataFrame:
    """(id, score): 10 less the penalties of each review's first findings (id, n, severity), at least 3; one without findings is moved by up to 0.1, by a hash of its seed (reviews: id, seed)."""
    counted = findings.where(F.col("n") <= most).groupBy("id").agg(F.sum(severity_penalty(F.col("severity"))).alias("penalty"))
    jitter = ((fnv1a(F.col("seed")) % 10_000) / 10_000 - 0.5) * 0.2
    raw = F.coalesce(10 - F.col("penalty"), 10 + jitter)
    return reviews.join(counted, "id", "left").select("id", F.round(F.least(F.lit(10.0), F.greatest(F.lit(3.0), raw)), 2).alias("score"))


def index_health(files: DataFrame, chunks: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """One row: files, chunks, the newest file's time, incomplete without chunks, possibly stale without them or with age."""
    counts = files.agg(F.count("*").alias("files"), F.max("mtime").alias("updated_at"))
    cut = chunks.agg(F.count("*").alias("chunks"))
    both = counts.crossJoin(cut)  # one row each
    old = F.coalesce(now.cast("double") - F.col("updated_at").cast("double") > days * 86_400, F.lit(True))
    return both.select("files", "chunks", "updated_at", (F.col("chunks") == 0).alias("incomplete"), ((F.col("chunks") == 0) | old).alias("possibly_stale"))


def parser_failures(files: DataFrame, most: int = 40) -> DataFrame:
    """The first files (path, parse_status) that couldn't be parsed (a report's limit)."""
    return files.where("parse_status = 'error'").select("path", F.lit("parseStatus=error").alias("message")).orderBy("path").limit(most)


def added_counts(a: Column, b: Column) -> Column:
    """Two maps of counts, summed key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def task_risks(text: Column, callers: Column, tests: Column, most: int = 8) -> Column:
    """Risk ids of a task's evidence: what it mentions, many callers, no tests."""
    named = [F.when(text.rlike(p), F.lit(name)) for name, p in RISKS.items()]
    named += [F.when(callers >= 12, F.lit("high-callers")), F.when(tests == 0, F.lit("no-tests"))]
    return F.slice(F.filter(F.array(*named), lambda x: x.isNotNull()), 1, most)


def freshness(at: Column, now: Column, days: int = 7) -> Column:
    """fresh or stale by age in days; unknown without a time."""
    return F.when(at.isNull(), F.lit("unknown")).when(now.cast("double") - at.cast("double") > days * 86_400, F.lit("stale")).otherwise(F.lit("fresh"))


# Names of fields that could hold a person's text.
PRIVATE_KEYS = ("query", "text", "content", "excerpt", "path", "code", "prompt", "body")


def scrubbed(payload: Column) -> Column:
    """A map of strings without fields that could hold a person's text or look like a path."""
    return F.map_filter(payload, lambda k, v: ~F.lower(k).isin(*PRIVATE_KEYS) & ~F.coalesce(v, F.lit("")).rlike(r"[/\\]\w+[/\\]|\n"))


def evaluation_tasks(feedback: DataFrame) -> DataFrame:
    """(task, query, item): feedback on missing context (at, query, missing array of paths) as retrieval tasks."""
    task = F.concat(F.lit("feedback-"), F.substring(F.sha2(F.concat_ws("|", F.col("at").cast("string"), "query"), 256), 1, 16))
    return feedback.select(task.alias("task"), "query", F.explode("missing").alias("item"))
