"""Queries on graphs and line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import graph, select
from ..sources.bindings import EDGES_SQL, HITS_SQL, key_edges, line_hits, table


def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.degrees(key_edges(spark, sf_dir))
    return got.select("node", "degree", F.round(scores.hub_damping(F.col("degree")), 6).alias("damping"))


def import_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("region/1",), ("nation/3",)], "node string")
    edges = key_edges(spark, sf_dir)
    got = graph.import_distance(edges, seeds, 3).join(graph.degrees(edges), "node", "left")
    return got.select("node", "distance", scores.import_distance_score(F.greatest("distance", F.lit(1)), F.coalesce("degree", F.lit(0))).alias("score"))


def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    got = graph.neighbours(key_edges(spark, sf_dir), customers)
    return got.groupBy("symbol", "direction").agg(F.count("*").alias("edges"), F.min("id").alias("first"))


def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("node"))
    return graph.incident(key_edges(spark, sf_dir), nations).select("node", "id", "kind")


def confident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.meets_confidence(key_edges(spark, sf_dir), "medium", ("call", "import", "export"))
    priority = scores.edge_priority(F.col("kind"), F.col("specifier"), F.col("confidence"), F.col("method")).cast("long")
    return got.groupBy("kind", priority.alias("priority")).agg(F.count("*").alias("edges"))


def fanout_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_fan_out(key_edges(spark, sf_dir), 3, "to_path").select("to_path", "id")


def invalidation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.concat(F.lit("nation/"), "n_nationkey").alias("path"))
    return graph.invalidated(key_edges(spark, sf_dir), changed)


def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("node"))
    got = graph.simple_paths(key_edges(spark, sf_dir), seeds, 3, 12)
    sure = F.forall(F.arrays_zip("confidences", "methods"), lambda x: scores.deterministic(x["confidences"], x["methods"]))
    score = scores.relation_score(F.col("nodes"), F.transform("nodes", lambda n: F.lit(None).cast("string")), F.col("kinds"), F.col("specifiers"), F.col("confidences"), sure, F.lit(False))
    return got.select("seed", F.array_join("nodes", ">").alias("path"), score.cast("long").alias("score"))


def tightest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 97).cast("int")
    symbols = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").cast("string").alias("path"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))
    positions = lines.select(F.col("l_suppkey").cast("string").alias("path"), (F.col("l_linenumber") * 13).alias("line")).distinct()
    return graph.tightest_symbol(positions, symbols)


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.overlap_pairs(line_hits(spark, sf_dir))


def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.drop_overlaps(line_hits(spark, sf_dir)).select("id", "path", "start_line", "end_line", "score")


def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "chunk").when(F.col("lang") == "fr", "symbol").otherwise("file")
    ranked = docs.select(F.col("doc_id").alias("id"), kind.alias("type"), "n_chars", F.col("n_chars").alias("chars"), (-F.col("n_chars") % 977).alias("rank"))
    return select.within_budget(ranked.select("rank", "id", "type", "chars"), k=20, order=("rank", "id"), pool=200).select("id", "type", "chars")


QUERIES = {f.__name__: f for f in (edge_degree, import_distance, callers_callees, incident_edges, confident_edges, fanout_cap, invalidation_closure, bounded_paths, tightest_interval, overlap_pairs, overlap_dedupe, budget_select)}

_PRIORITY = "CASE WHEN confidence IN ('certain', 'high') OR method = 'ast' THEN 50 WHEN confidence IN ('heuristic', 'low') THEN 0 WHEN method NOT IN ('heuristic', 'unresolved') THEN 50 ELSE 0 END + CASE confidence WHEN 'certain' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 0 END + CASE kind WHEN 'call' THEN 12 WHEN 'import' THEN 6 WHEN 'require' THEN 6 ELSE 0 END"
_DEGREE = f"g AS (SELECT node, count(*) AS degree FROM (SELECT unnest([from_path, to_path]) AS node FROM ({EDGES_SQL}) WHERE kind IN ('import', 'require', 'export')) GROUP BY node)"

ORACLES = {
    "edge_degree": f"WITH {_DEGREE} SELECT node, degree, round(1 / log2(2 + degree), 6) AS damping FROM g",
    "import_distance": f"""WITH RECURSIVE {_DEGREE}, e AS (SELECT from_path AS a, to_path AS b FROM ({EDGES_SQL}) WHERE kind IN ('import', 'require', 'export')), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, d) AS (SELECT unnest(['region/1', 'nation/3']), 0 UNION SELECT u.b, d + 1 FROM r JOIN u ON r.node = u.a WHERE d < 3),
m AS (SELECT node, min(d) AS d FROM r GROUP BY node)
SELECT node, d AS distance, CAST(greatest(1, floor(greatest(5, 35 - (greatest(d, 1) - 1) * 12) * (1 / log2(2 + coalesce(degree, 0))) + 0.5)) AS BIGINT) AS score FROM m LEFT JOIN g USING (node)""",
    "callers_callees": f"""WITH e AS ({EDGES_SQL}), c AS (SELECT 'customer/' || c_custkey AS symbol FROM customer)
SELECT symbol, 'in' AS direction, count(*) AS edges, min(id) AS first FROM e JOIN c ON to_symbol = symbol GROUP BY symbol UNION ALL SELECT symbol, 'out', count(*), min(id) FROM e JOIN c ON from_symbol = symbol GROUP BY symbol""",
    "incident_edges": f"WITH e AS ({EDGES_SQL}), n AS (SELECT 'nation/' || n_nationkey AS node FROM nation) SELECT DISTINCT node, id, kind FROM e JOIN n ON from_path = node OR to_path = node",
    "confident_edges": f"SELECT kind, CAST({_PRIORITY} AS BIGINT) AS priority, count(*) AS edges FROM ({EDGES_SQL}) WHERE confidence IN ('certain', 'high', 'medium') AND kind IN ('call', 'import', 'export') GROUP BY ALL",
    "fanout_cap": f"SELECT to_path, id FROM (SELECT to_path, id, row_number() OVER (PARTITION BY to_path ORDER BY {_PRIORITY} DESC, id) AS n FROM ({EDGES_SQL})) WHERE n <= 3",
    "invalidation_closure": f"""WITH e AS ({EDGES_SQL}), c AS (SELECT 'nation/' || n_nationkey AS p FROM nation WHERE n_regionkey = 2)
SELECT DISTINCT path FROM (SELECT to_path AS path FROM e WHERE from_path IN (FROM c) UNION SELECT from_path FROM e WHERE to_path IN (FROM c)) WHERE path NOT IN (FROM c)""",
    "bounded_paths": f"""WITH RECURSIVE e AS ({EDGES_SQL}), r AS (SELECT 'customer/' || c_custkey AS seed, 'customer/' || c_custkey AS node, 'customer/' || c_custkey AS path, 0 AS hops, 9 AS worst, true AS sure FROM customer
UNION ALL SELECT seed, to_path, path || '>' || to_path, hops + 1, least(worst, CASE confidence WHEN 'certain' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END), sure AND confidence IN ('certain', 'high') FROM r JOIN e ON node = from_path WHERE hops < 3)
SELECT seed, path, CAST(100 - 8 * hops + CASE WHEN sure THEN 40 ELSE -25 END + 4 * worst AS BIGINT) AS score FROM r WHERE hops > 0""",
    "tightest_interval": """WITH s AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS path, l_partkey % 97 AS a, l_partkey % 97 + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
p AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS path, l_linenumber * 13 AS line FROM lineitem)
SELECT path, line, id AS symbol FROM (SELECT p.path, p.line, s.id, row_number() OVER (PARTITION BY p.path, p.line ORDER BY b - a, s.id) AS n FROM p JOIN s ON p.path = s.path AND line BETWEEN a AND b) WHERE n = 1""",
    "overlap_pairs": f"WITH h AS ({HITS_SQL}) SELECT x.path, x.id AS a, y.id AS b FROM h x JOIN h y ON x.path = y.path AND x.id < y.id AND x.start_line <= y.end_line AND y.start_line <= x.end_line",
    "budget_select": """WITH RECURSIVE h AS (SELECT id, type, chars, row_number() OVER (ORDER BY rank, id) AS n FROM (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'chunk' WHEN 'fr' THEN 'symbol' ELSE 'file' END AS type, n_chars AS chars, -n_chars % 977 AS rank FROM documents)),
r(n, kept, used, f, s, c, fits) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0, 0, false
UNION ALL SELECT h.n, kept + x::INT, used + CASE WHEN x THEN chars ELSE 0 END, f + (x AND type = 'file')::INT, s + (x AND type = 'symbol')::INT, c + (x AND type = 'chunk')::INT, x
FROM (SELECT h.*, r.kept, r.used, r.f, r.s, r.c, kept < 20 AND used + chars <= 24000 AND ceil((used + chars) / 4) <= 6000 AND (type <> 'file' OR f < 12) AND (type <> 'symbol' OR s < 20) AND (type <> 'chunk' OR c < 24) AS x FROM r JOIN h ON h.n = r.n + 1) h)
SELECT id, type, chars FROM h JOIN r USING (n) WHERE fits""",
}


def document_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, files, symbols, edges) of the documents: first words as symbols, turns of one source as imports."""
    from ..operators import chunks
    from ..sources.bindings import files as document_files

    own = document_files(spark, sf_dir)
    cut = chunks.window_chunks(own, 40, 6).withColumns({"kind": F.lit("source"), "weight": F.lit(1.0)})
    cut = cut.withColumn("id", F.concat_ws(":", "path", "start_line"))
    files_ = own.select("path", F.length("text").alias("size"), F.col("id").alias("mtime"))
    name = F.regexp_extract("text", r"^(\w+ \w+)", 1)
    symbols = own.select(F.concat(F.lit("s:"), "path").alias("id"), F.regexp_replace(name, " ", "").alias("name"), "path", F.lit(1).alias("start_line"), F.lit(3).alias("end_line")).where("name <> ''")
    source = F.element_at(F.split("path", "/"), 1)
    edges = own.select(F.concat(F.lit("e:"), "path").alias("id"), F.col("path").alias("from_path"), F.concat(F.lit("hub/"), source).alias("to_path"), F.lit("import").alias("kind"), source.alias("specifier"), F.concat(F.lit("s:"), "path").alias("from_symbol"), F.lit(None).cast("string").alias("to_symbol"), F.lit("high").alias("confidence"), F.lit("ast").alias("method"))
    return cut, files_, symbols, edges


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question over all documents' chunks, paths, first words and sources, and the instruction documents of a project."""
    from ..operators import hybrid
    from .governance import DOCS

    docs = spark.createDataFrame(DOCS, "doc_path string, doc_type string, scope string, binding string, status string, globs string, user_configured boolean")
    got = hybrid.search(*document_index(spark, sf_dir), "inea edes ontion src3 french", k=20, documents=docs)
    return got.select("id", "result_type", "path", F.round("score", 4).alias("score"), "confidence")


def relationship_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import paths

    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("node"))
    got = paths.relationship_paths(key_edges(spark, sf_dir), seeds)
    return got.select("seed", "path_id", F.array_join("nodes", ">").alias("nodes"), "confidence", "deterministic", "cycle", "score")


def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import paths

    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("node"))
    return paths.change_impact(key_edges(spark, sf_dir), seeds, paths.Budget(depth=2))


QUERIES.update({f.__name__: f for f in (hybrid_search, relationship_paths, change_impact)})
