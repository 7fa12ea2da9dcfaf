"""Queries on stored versions, declared conventions, chunks by file type, and files beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_path
from ..operators import chunks, conventions, hybrid, store
from ..sources.bindings import FILES_SQL, files, table
from ..sources.scratch import scratch_path
from ..sources.trees import local_path, write_files


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files in four versions of a store: whole, with the buckets of changed ones rewritten, with a second table, and wiped."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_mktsegment").alias("hash"), F.col("c_nationkey").alias("n"))
    index = store.IndexStore(spark, scratch_path(spark, "versions"))
    index.publish({"files": own})
    changed = own.where("n < 3").withColumn("hash", F.lit("changed"))
    buckets = index.touched(changed)
    index.publish({"files": store.upsert(index.read("files", buckets=buckets), changed)}, {"files": buckets}, {"by": "test"})
    index.publish({"edges": own.select(F.col("path").alias("id"), "n")}, {})
    index.wipe()
    rows = [index.read("files", v).select(F.lit(v).alias("version"), F.lit("files").alias("name"), "hash") for v in index.versions()]
    rows += [index.read("edges", v).select(F.lit(v), F.lit("edges"), F.lit("")) for v in index.versions()[2:]]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("version", "name", "hash").agg(F.count("*").alias("rows"))


def declared_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file of declared conventions for each supplier, some without id or label, read back."""
    root = scratch_path(spark, "declared")
    one = lambda i: F.struct(F.when(F.col("s_suppkey") % 3 != i, F.concat(F.lit(f"c{i}:"), "s_suppkey")).alias("id"), F.when(F.col("s_nationkey") % 4 != i, F.col("s_name")).alias("label"), F.lit("high").alias("confidence"), F.lit("style").alias("category"))
    said = F.to_json(F.struct(F.array(one(0), one(1), one(2)).alias("conventions")))
    write_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("declared/"), "s_suppkey", F.lit(".json")).alias("path"), said.alias("text")), root, "declared")
    return conventions.declared(spark, f"file://{local_path(root)}/declared/*.json").select("id", "label", "confidence", "category")


KINDS = (".md", ".ts", ".php", "/README.md", ".yml")


def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 5 + 1).cast("int"))
    body = F.regexp_replace(F.regexp_replace("text", "[#{}]", " "), r"(?m)^The (\w+)", "## $1")
    return files(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("id").cast("string"), ending).alias("path"), body.alias("text"))


def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of five types, cut as each type asks: chunks, their kind and weight by file."""
    return chunks.chunk_files(typed_files(spark, sf_dir)).groupBy("path", "kind", F.round("weight", 2).alias("weight")).agg(F.count("*").alias("chunks"))


def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "./").otherwise(""), F.lit("a\\"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "\\").otherwise("/"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", normal_path(raw).alias("path"))


def files_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths from an order to its customer, customers as hits: the files with the best scores, with all labels."""
    walked = table(spark, sf_dir, "orders").select(F.array(F.concat(F.lit("o/"), "o_orderkey"), F.concat(F.lit("c/"), "o_custkey")).alias("nodes"), F.concat(F.lit("o/"), "o_orderkey").alias("seed"), (F.col("o_orderkey") % 91).alias("score"), F.array(F.lit("call"), F.col("o_orderstatus")).alias("kinds"))
    hits = table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("path"), (F.col("c_custkey") % 97).cast("double").alias("score"), F.when(F.col("c_nationkey") < 5, "symbol").otherwise("chunk").alias("result_type"))
    return hybrid.related_files(walked, hits, 40).select("path", "score", F.array_join("labels", ",").alias("labels"))


QUERIES = {f.__name__: f for f in (store_versions, declared_conventions, chunk_dispatch, normal_paths, files_beside)}

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
ORACLES = {
    "store_versions": """SELECT v AS version, 'files' AS name, CASE WHEN v > 1 AND c_nationkey < 3 THEN 'changed' ELSE c_mktsegment END AS hash, count(*) AS rows FROM customer, (VALUES (1), (2), (3)) x(v) GROUP BY ALL
UNION ALL SELECT 3, 'edges', '', count(*) FROM customer""",
    "declared_conventions": """SELECT 'c' || i || ':' || s_suppkey AS id, s_name AS label, 'high' AS confidence, 'style' AS category FROM supplier, (VALUES (0), (1), (2)) x(i) WHERE s_suppkey % 3 <> i AND s_nationkey % 4 <> i""",
    "chunk_dispatch": f"""WITH f AS (SELECT id % 5 AS k, 'd/' || id || {list(KINDS)}[id % 5 + 1] AS path, string_split_regex(regexp_replace(regexp_replace(text, '[#{{}}]', ' ', 'g'), '(?m)^The (\\w+)', '## \\1', 'g'), '\\r?\\n') AS l FROM ({FILES_SQL})),
h AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{1,3}}\\s+\\S')) AS h FROM f),
w AS (SELECT path, k, count(*) AS n FROM (SELECT path, k, l, unnest(list_filter(range(0, len(l), 68), lambda s: s = 0 OR s + 12 < len(l))) AS s FROM f) WHERE trim(array_to_string(l[s + 1:s + 80], chr(10)), {_BLANK}) <> '' GROUP BY ALL)
SELECT path, 'memory' AS kind, CASE k WHEN 3 THEN 2.0 ELSE 1.4 END AS weight, len(h) + CASE WHEN trim(array_to_string(l[1:coalesce(h[1] - 1, len(l))], chr(10)), {_BLANK}) <> '' THEN 1 ELSE 0 END AS chunks FROM h WHERE k IN (0, 3) AND (len(h) > 0 OR trim(array_to_string(l, chr(10)), {_BLANK}) <> '')
UNION ALL SELECT path, CASE k WHEN 2 THEN 'source' ELSE 'config' END, CASE k WHEN 2 THEN 1.0 ELSE 0.9 END, n FROM w WHERE k NOT IN (0, 3)""",
    "normal_paths": "SELECT c_custkey, 'a/' || c_mktsegment || '/' || c_name AS path FROM customer",
    "files_beside": """WITH b AS (SELECT 'c/' || o_custkey AS path, CAST(o_orderkey % 91 AS DOUBLE) AS score, 'call>' || o_orderstatus AS label FROM orders UNION ALL SELECT 'c/' || c_custkey, c_custkey % 97, CASE WHEN c_nationkey < 5 THEN 'symbol' ELSE 'chunk' END FROM customer)
SELECT path, max(score) AS score, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM b GROUP BY path ORDER BY max(score) DESC, path LIMIT 40""",
}
