"""Claims and their evidence: references, confidence, model output checks, link status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path

# What a component's certainty counts.
CERTAINTY = {"certain": 1.0, "high": 0.85, "medium": 0.6, "low": 0.3}
FRESHNESS = {"fresh": (0.9, 0.8), "stale": (0.35, 1.2), "missing": (0.1, 1.5), "unknown": (0.5, 0.4)}


def certainty(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CERTAINTY.items():
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out


def claim_confidence(certainties: Column, n_sources: Column, freshness: Column, by_model: Column) -> tuple[Column, Column]:
    """(score 0 to 1, level): a weighted mean of what is known, with a prior of 0.55 at weight 0.55.

    Missing sources, or a model's claim without any, make a claim low whatever the score.
    """
    known = F.filter(F.transform(certainties, certainty), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    parts = [(mean, F.lit(2.0)), (F.least(F.lit(1.0), n_sources / 3), F.lit(1.2)), (F.when(by_model, F.lit(0.4)), F.lit(1.5))]
    for name, (value, weight) in FRESHNESS.items():
        parts.append((F.when(freshness == name, F.lit(value)), F.lit(weight)))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    score = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.55))
    value = F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / (weight + 0.55)))).otherwise(0.5)
    bare = (F.coalesce(freshness, F.lit("")) == "missing") | (F.coalesce(by_model, F.lit(False)) & (F.coalesce(n_sources, F.lit(0)) == 0))
    return value, F.when(bare, "low").when(value >= 0.72, "high").when(value >= 0.45, "medium").otherwise("low")


def references(hits: DataFrame) -> DataFrame:
    """Hits (path, start_line, end_line, ...) with safe ranges: lines from 1, ends not before starts, plain paths."""
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    return hits.withColumns({"path": normal_path(F.col("path")), "start_line": start, "end_line": F.greatest(F.coalesce("end_line", start), start)})


def evidence_ids(refs: DataFrame, by: str, order: tuple[str, ...], start: int = 1) -> DataFrame:
    """References of each ``by`` numbered evidence-1, evidence-2, ..."""
    w = Window.partitionBy(by).orderBy(*order)
    return refs.withColumn("evidence_id", F.concat(F.lit("evidence-"), F.row_number().over(w) + (start - 1)))


def model_claims(outputs: DataFrame) -> DataFrame:
    """(id, claim_no, text, evidence_ids) of model outputs (id, raw): JSON, fenced or not."""
    body = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col("raw"))
    parsed = F.from_json(F.trim(body), "struct<claims:array<struct<text:string,evidenceIds:array<string>>>>")
    return outputs.select("id", F.posexplode(parsed["claims"]).alias("claim_no", "c")).select("id", "claim_no", F.col("c.text").alias("text"), F.col("c.evidenceIds").alias("evidence_ids"))


def checked_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with their rejection reason (null: accepted): no text, no evidence, unknown evidence (id, evidence_id)."""
    cited = claims.select("id", "claim_no", F.explode("evidence_ids").alias("evidence_id"))
    unknown = cited.join(evidence.select("id", "evidence_id"), ["id", "evidence_id"], "left_anti").groupBy("id", "claim_no").agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown"))
    both = claims.join(unknown, ["id", "claim_no"], "left")
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty-text").when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "no-evidence").when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown-evidence:"), F.array_join("unknown", ",")))
    return both.withColumn("rejected", reason).drop("unknown")


def link_status(refs: DataFrame, files: DataFrame, workspace: str) -> DataFrame:
    """References (workspace, path, fingerprint) with status ok, stale, missing or wrong_workspace."""
    both = refs.join(files.select("path", F.col("hash").alias("__hash")), "path", "left")
    status = F.when(F.col("workspace") != workspace, "wrong_workspace").when(F.col("__hash").isNull(), "missing").when((F.coalesce("fingerprint", F.lit("")) != "") & (F.col("fingerprint") != F.col("__hash")), "stale").otherwise("ok")
    return both.withColumn("status", status).drop("__hash")


def attributed(claims: DataFrame) -> DataFrame:
    """Claims (text, sources array) with their kind: without a source a claim is a general consideration."""
    return claims.withColumn("kind", F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.lit("attributed")).otherwise(F.lit("general_consideration")))


def citations(text: Column) -> Column:
    """Evidence ids that a text cites as [evidence-1]."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(evidence-\d+)\]"), 1))


def without_unknown_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers (id, text) with citations of unknown evidence (id, evidence_id) removed."""
    known = evidence.groupBy("id").agg(F.collect_set("evidence_id").alias("known"))
    both = answers.join(known, "id", "left")
    bad = F.array_except(citations(F.col("text")), F.coalesce("known", F.array().cast("array<string>")))
    return both.withColumn("text", F.aggregate(bad, F.col("text"), lambda t, e: F.replace(t, F.concat(F.lit("["), e, F.lit("]")), F.lit("")))).drop("known")
