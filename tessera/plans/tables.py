"""Queries on index tables, provenance and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, memory, store
from ..sources.bindings import FILES_SQL, files, key_edges, table


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, scanned): the documents as an older index (a third changed, a fifth missing, some gone since) and as found now."""
    now = files(spark, sf_dir).select("id", "path", F.sha2("text", 256).alias("hash"), F.when(F.col("language") == "es", "local_only").otherwise("normal").alias("privacy"))
    old = now.where("id % 5 <> 0").select("path", F.when(F.col("id") % 3 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"), F.when(F.col("id") % 7 == 0, "normal").otherwise(F.col("privacy")).alias("privacy"))
    gone = files(spark, sf_dir).select(F.concat(F.lit("old/"), "path").alias("path"), F.sha2("path", 256).alias("hash"), F.lit("normal").alias("privacy"))
    return old.unionByName(gone), now.drop("id")


SNAPSHOTS_SQL = f"""now AS (SELECT id, path, sha256(text) AS hash, CASE WHEN language = 'es' THEN 'local_only' ELSE 'normal' END AS privacy FROM ({FILES_SQL})),
old AS (SELECT path, CASE WHEN id % 3 = 0 THEN sha256(hash) ELSE hash END AS hash, CASE WHEN id % 7 = 0 THEN 'normal' ELSE privacy END AS privacy FROM now WHERE id % 5 <> 0
  UNION ALL SELECT 'old/' || path, sha256(path), 'normal' FROM ({FILES_SQL}))"""


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = snapshots(spark, sf_dir)
    return store.changed(scanned, stored).select("path", "hash", "privacy")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = snapshots(spark, sf_dir)
    return store.upsert(stored, store.changed(scanned, stored)).select("path", "hash", "privacy")


def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = snapshots(spark, sf_dir)
    return store.pruned(stored, scanned).select("path", "hash", "privacy")


def replace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after all customers of nation 3 were indexed anew with one edge each, and the symbols of nation 4's customers vanished."""
    edges = key_edges(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    paths = customers.where("c_nationkey = 3").select(F.concat(F.lit("customer/"), "c_custkey").alias("path"))
    gone = customers.where("c_nationkey = 4").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    symbols = edges.select(F.col("to_symbol").alias("id")).distinct().join(gone, "id", "left_anti")
    fresh = paths.select(F.concat(F.lit("new:"), "path").alias("id"), F.col("path").alias("from_path"), F.lit("region/0").alias("to_path"), F.lit("import").alias("kind"), F.lit("x").alias("specifier"), F.col("path").alias("from_symbol"), F.lit(None).cast("string").alias("to_symbol"), F.lit("low").alias("confidence"), F.lit("heuristic").alias("method"))
    return store.replaced_edges(edges, fresh, paths, symbols).groupBy("kind").agg(F.count("*").alias("edges"), F.min("id").alias("first"), F.max("id").alias("last"))


def remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 5").select(F.concat(F.lit("customer/"), "c_custkey").alias("path"))
    return store.removed_file_edges(key_edges(spark, sf_dir), gone).groupBy("kind").agg(F.count("*").alias("edges"))


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day as changes of customers' files: opened orders create, finished ones update, the rest delete; urgent ones rename."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("hash"), F.col("c_mktsegment").alias("text"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "rename").when(F.col("o_orderstatus") == "O", "create").when(F.col("o_orderstatus") == "F", "update").otherwise("delete")
    changes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), kind.alias("type"), F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit("moved/"), F.col("o_custkey") % 50).alias("new_path"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderpriority").alias("text"))
    return store.apply_changes(stored, changes).select("path", "hash", "text")


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = snapshots(spark, sf_dir)
    cited = stored.select(F.substring_index("path", "/", 2).alias("doc_path"), "path", F.when(F.col("privacy") == "normal", F.col("hash")).alias("fingerprint"))
    return memory.stale_sources(cited, scanned)


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = snapshots(spark, sf_dir)
    refs = stored.select(F.when(F.col("path").startswith("src1/"), "other").otherwise("here").alias("workspace"), "path", F.col("hash").alias("fingerprint"))
    return attribution.link_status(refs, scanned, "here").groupBy("status").agg(F.count("*").alias("refs"))


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") - 2).alias("end_line"), (F.col("l_suppkey") - 3).alias("supplier"))
    return attribution.evidence_ids(attribution.references(refs), "path", ("start_line", "supplier")).select("path", "start_line", "end_line", "evidence_id")


def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    level = F.when(F.col("value") > 60, "certain").when(F.col("value") > 30, "high").when(F.col("value") > 10, "medium").otherwise("low")
    fresh = F.element_at(F.array(*map(F.lit, ("fresh", "stale", "missing", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    score, band = attribution.claim_confidence(F.array(level, F.when(F.col("event_type") == "click", F.lit("low"))), F.col("user_id") % 5, fresh, F.col("event_type") == "error")
    return events.select("event_id", F.round(score, 6).alias("score"), band.alias("level"))


QUERIES = {f.__name__: f for f in (changed_only, upsert_merge, prune_missing, replace_edges, remove_files, apply_changes, stale_sources, link_status, evidence_ids, claim_confidence)}

from ..sources.bindings import EDGES_SQL  # noqa: E402

ORACLES = {
    "changed_only": f"WITH {SNAPSHOTS_SQL} SELECT now.path, now.hash, now.privacy FROM now LEFT JOIN old USING (path) WHERE old.path IS NULL OR now.hash <> old.hash OR now.privacy <> old.privacy",
    "upsert_merge": f"WITH {SNAPSHOTS_SQL} SELECT path, hash, privacy FROM now UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM now)",
    "prune_missing": f"WITH {SNAPSHOTS_SQL} SELECT * FROM old WHERE path IN (SELECT path FROM now)",
    "replace_edges": f"""WITH e AS ({EDGES_SQL}), n AS (SELECT 'customer/' || c_custkey AS p, c_nationkey AS k FROM customer),
r AS (SELECT id, kind FROM e WHERE from_path NOT IN (SELECT p FROM n WHERE k = 3) AND to_symbol NOT IN (SELECT p FROM n WHERE k = 4) UNION ALL SELECT 'new:' || p, 'import' FROM n WHERE k = 3)
SELECT kind, count(*) AS edges, min(id) AS first, max(id) AS last FROM r GROUP BY kind""",
    "remove_files": f"WITH e AS ({EDGES_SQL}), g AS (SELECT 'customer/' || c_custkey AS p FROM customer WHERE c_nationkey = 5) SELECT kind, count(*) AS edges FROM e WHERE from_path NOT IN (FROM g) AND to_path NOT IN (FROM g) GROUP BY kind",
    "apply_changes": """WITH c AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rename' WHEN o_orderstatus = 'O' THEN 'create' WHEN o_orderstatus = 'F' THEN 'update' ELSE 'delete' END AS type, CAST(o_custkey AS VARCHAR) AS path, 'moved/' || o_custkey % 50 AS new_path, CAST(o_orderkey AS VARCHAR) AS hash, o_orderpriority AS text FROM orders),
r AS (SELECT seq, path, type NOT IN ('delete', 'rename') AS lives, hash, text FROM c UNION ALL SELECT seq, new_path, true, hash, text FROM c WHERE type = 'rename'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC, lives DESC) AS n FROM r) WHERE n = 1)
SELECT path, hash, text FROM l WHERE lives UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT path FROM l)""",
    "stale_sources": f"""WITH {SNAPSHOTS_SQL}, c AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS doc_path, path, CASE WHEN privacy = 'normal' THEN hash END AS f FROM old)
SELECT doc_path, c.path, CASE WHEN now.path IS NULL THEN 'missing-source' WHEN f IS NULL THEN 'missing-fingerprint' ELSE 'fingerprint-mismatch' END AS reason FROM c LEFT JOIN now USING (path) WHERE now.path IS NULL OR f IS NULL OR f <> now.hash""",
    "link_status": f"WITH {SNAPSHOTS_SQL} SELECT CASE WHEN starts_with(old.path, 'src1/') THEN 'wrong_workspace' WHEN now.path IS NULL THEN 'missing' WHEN old.hash <> now.hash THEN 'stale' ELSE 'ok' END AS status, count(*) AS refs FROM old LEFT JOIN now USING (path) GROUP BY 1",
    "evidence_ids": "SELECT CAST(l_orderkey AS VARCHAR) AS path, greatest(l_linenumber, 1) AS start_line, greatest(l_linenumber - 2, greatest(l_linenumber, 1)) AS end_line, 'evidence-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS evidence_id FROM lineitem",
    "claim_confidence": """WITH x AS (SELECT event_id, user_id % 5 AS n, event_type, event_id % 4 AS f, CASE WHEN value > 60 THEN 1.0 WHEN value > 30 THEN 0.85 WHEN value > 10 THEN 0.6 ELSE 0.3 END::DOUBLE AS c FROM events),
m AS (SELECT *, CASE WHEN event_type = 'click' THEN (c + 0.3) / 2 ELSE c END::DOUBLE AS mean FROM x),
s AS (SELECT *, 0.55::DOUBLE + mean * 2 + least(1, n / 3) * 1.2 + CASE WHEN event_type = 'error' THEN 0.6 ELSE 0 END + CASE f WHEN 0 THEN 0.72 WHEN 1 THEN 0.42 WHEN 2 THEN 0.15 ELSE 0.2 END AS score, 0.55::DOUBLE + 2 + 1.2 + CASE WHEN event_type = 'error' THEN 1.5 ELSE 0 END + CASE f WHEN 0 THEN 0.8 WHEN 1 THEN 1.2 WHEN 2 THEN 1.5 ELSE 0.4 END AS weight FROM m),
v AS (SELECT *, greatest(0, least(1, score / weight)) AS v FROM s)
SELECT event_id, round(v, 6) AS score, CASE WHEN f = 2 OR (event_type = 'error' AND n = 0) THEN 'low' WHEN v >= 0.72 THEN 'high' WHEN v >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM v""",
}
