"""Generated memory: provenance documents, staleness, status precedence.

Documents are rows (path, status, claims): claims are an array of (id, text, sources), and
sources an array of (path, start_line, end_line, fingerprint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import PRECEDENCE

DOCUMENT = "path string, status string, claims array<struct<id:string,text:string,sources:array<struct<path:string,start_line:int,end_line:int,fingerprint:string>>>>"
HUMAN_FLOOR = 400
GENERATED_DIR = r"^\.(memory|notes)/generated/|(^|/)generated-memory/"


def sources(documents: DataFrame) -> DataFrame:
    """(doc_path, claim_id, path, start_line, end_line, fingerprint), one row a source."""
    claims = documents.select(F.col("path").alias("doc_path"), F.explode("claims").alias("c"))
    return claims.select("doc_path", F.col("c.id").alias("claim_id"), F.explode("c.sources").alias("s")).select("doc_path", "claim_id", "s.*")


def stale_sources(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Cited sources (doc_path, path, fingerprint) with their reason against the files' hashes (path, hash), if stale: missing file, missing fingerprint or mismatch."""
    both = cited.join(files.select("path", "hash"), "path", "left")
    reason = (
        F.when(F.col("hash").isNull(), F.lit("missing-source"))
        .when(F.coalesce(F.col("fingerprint"), F.lit("")) == "", F.lit("missing-fingerprint"))
        .when(F.col("fingerprint") != F.col("hash"), F.lit("fingerprint-mismatch"))
    )
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_path", "path", "reason")


def stale_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(path, stale, reasons) of all documents."""
    found = stale_sources(sources(documents).select("doc_path", "path", "fingerprint").distinct(), files)
    per_doc = found.groupBy("doc_path").agg(F.array_sort(F.collect_set(F.concat_ws(":", "reason", "path"))).alias("reasons"))
    both = documents.select("path", "status").join(per_doc, F.col("path") == F.col("doc_path"), "left")
    return both.select("path", ((F.col("status") == "stale") | F.col("reasons").isNotNull()).alias("stale"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def refreshed(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with the status of stale ones set so."""
    state = stale_documents(documents, files).select("path", "stale")
    return documents.join(state, "path", "left").withColumn("status", F.when(F.col("stale"), F.lit("stale")).otherwise(F.col("status"))).drop("stale")


def generated_path(path: Column) -> Column:
    return path.rlike(GENERATED_DIR)


def faults(documents: DataFrame) -> DataFrame:
    """(path, errors): what a document's claims lack: an id, a text, a source, a source that isn't generated itself."""
    bad = F.transform(
        "claims",
        lambda c: F.concat_ws(
            ",",
            F.when(F.coalesce(c["id"], F.lit("")) == "", "claim-without-id"),
            F.when(F.trim(F.coalesce(c["text"], F.lit(""))) == "", "claim-without-text"),
            F.when(F.coalesce(F.size(c["sources"]), F.lit(0)) <= 0, "claim-without-source"),
            F.when((F.size(c["sources"]) > 0) & F.forall(c["sources"], lambda s: generated_path(s["path"])), "only-generated-sources"),
        ),
    )
    return documents.select("path", F.array_distinct(F.filter(F.flatten(F.transform(bad, lambda b: F.split(b, ","))), lambda e: e != "")).alias("errors"))


def upserted(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    return documents.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def with_status(documents: DataFrame, status: DataFrame) -> DataFrame:
    """Documents with new statuses (path, status)."""
    return documents.join(status.select("path", F.col("status").alias("__new")), "path", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def influences(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("generated")).isin("rejected", "stale")


def precedence(status: Column) -> Column:
    """Band of a generated document, always below human text."""
    band = F.when(status == "approved", PRECEDENCE["approved_memory"]).when(status == "reviewed", PRECEDENCE["reviewed_memory"]).when(influences(status), PRECEDENCE["generated_memory"]).otherwise(0)
    return F.least(band, F.lit(HUMAN_FLOOR - 1))


def without_self_citations(documents: DataFrame) -> DataFrame:
    """Documents without claims whose sources are all generated."""
    return documents.withColumn("claims", F.filter("claims", lambda c: ~F.forall(c["sources"], lambda s: generated_path(s["path"]))))


def merged_text(existing: Column, generated: Column) -> Column:
    """Generated text with the human block of the existing one, between its markers, kept."""
    block = F.regexp_extract(existing, r"(?s)(<!-- human:start -->.*?<!-- human:end -->)", 1)
    return F.when(F.coalesce(block, F.lit("")) == "", generated).otherwise(F.concat(F.rtrim(generated), F.lit("\n\n"), block, F.lit("\n")))


def accepted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that may be written, the others with their errors): faultless, and in a folder for generated memory."""
    checked = documents.join(faults(documents), "path").withColumn("errors", F.when(generated_path(F.col("path")), F.col("errors")).otherwise(F.concat("errors", F.array(F.lit("outside-generated-folder")))))
    return checked.where("size(errors) = 0").drop("errors"), checked.where("size(errors) > 0").select("path", "errors")
