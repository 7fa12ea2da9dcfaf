"""The given tables seen as this engine's rows: files, chunks, edges, hits, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, language, text): documents as Markdown files by source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), "text")


FILES_SQL = "SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.md' AS path, lang AS language, text FROM documents"

# Words at line starts that stand for headings and list items.
MARKS = (("\nThe ", "\n# The "), ("\nIs ", "\n## Is "), ("\nAnd ", "\n### And "), ("\nOf ", "\n- Of "))


def marked(text: Column) -> Column:
    for old, new in MARKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def marked_sql(text: str = "text") -> str:
    for old, new in MARKS:
        text = f"replace({text}, '{old}', '{new}')".replace("\n", "' || chr(10) || '")
    return text


FOLDERS = ("src", "secrets", "generated", "vendor", "customer-data", "fixtures/private", "legacy", "config")
ENDINGS = (".ts", ".php", ".pem", ".md", ".json")


def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language): documents dealt over a project's folders and file types."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("lang").alias("language"))


PROJECT_SQL = f"SELECT {list(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/' || source || '/' || doc_id || {list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS path, lang AS language FROM documents"


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges: nation to region (export), customer to nation (import), supplier to nation (require), order to customer (call)."""
    def edges(name: str, a: str, a_key: str, b: str, b_key: str, kind: str, confidence: str) -> DataFrame:
        source, target = F.concat(F.lit(f"{a}/"), F.col(a_key)), F.concat(F.lit(f"{b}/"), F.col(b_key))
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{kind}:"), source).alias("id"), source.alias("from_path"), target.alias("to_path"), F.lit(kind).alias("kind"), F.lit(f"{a}.{b}").alias("specifier"),
            source.alias("from_symbol"), target.alias("to_symbol"), F.lit(confidence).alias("confidence"), F.lit("ast" if confidence == "certain" else "heuristic").alias("method"),
        )

    parts = [
        edges("nation", "nation", "n_nationkey", "region", "n_regionkey", "export", "certain"),
        edges("customer", "customer", "c_custkey", "nation", "c_nationkey", "import", "high"),
        edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "require", "low"),
        edges("orders", "order", "o_orderkey", "customer", "o_custkey", "call", "medium"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge_sql(name: str, a: str, a_key: str, b: str, b_key: str, kind: str, confidence: str) -> str:
    s, t = f"'{a}/' || {a_key}", f"'{b}/' || {b_key}"
    method = "ast" if confidence == "certain" else "heuristic"
    return f"SELECT '{kind}:' || {s} AS id, {s} AS from_path, {t} AS to_path, '{kind}' AS kind, '{a}.{b}' AS specifier, {s} AS from_symbol, {t} AS to_symbol, '{confidence}' AS confidence, '{method}' AS method FROM {name}"


EDGES_SQL = " UNION ALL ".join([
    _edge_sql("nation", "nation", "n_nationkey", "region", "n_regionkey", "export", "certain"),
    _edge_sql("customer", "customer", "c_custkey", "nation", "c_nationkey", "import", "high"),
    _edge_sql("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "require", "low"),
    _edge_sql("orders", "order", "o_orderkey", "customer", "o_custkey", "call", "medium"),
])


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, start_line, end_line, score): line items as ranked line ranges of their order."""
    start = (F.col("l_partkey") % 50 + 1).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("path"), start.alias("start_line"), (start + F.col("l_quantity").cast("int") % 20).alias("end_line"), (F.col("l_suppkey") % 100).cast("double").alias("score")
    )


HITS_SQL = "SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey % 50 + 1 AS INTEGER) AS start_line, CAST(l_partkey % 50 + 1 AS INTEGER) + CAST(l_quantity AS INTEGER) % 20 AS end_line, CAST(l_suppkey % 100 AS DOUBLE) AS score FROM lineitem"


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, at, n, latency, path_hash): events as usage events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("n"), F.col("value").alias("latency"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("path_hash")
    )


EVENTS_SQL = "SELECT event_id AS id, event_type AS kind, ts AS happened, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, value AS latency, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS path_hash FROM events"


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, target): the path of each page's URL without its leading slash."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1).alias("target"))


TARGETS_SQL = "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS target FROM pages"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, specifier, confidence, method): each page's links as imports."""
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("n", "specifier")
    own = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), links)
    return own.select("path", (F.col("n") + 1).alias("line"), "specifier", F.when(F.col("specifier").startswith("http"), "low").otherwise("high").alias("confidence"), F.lit("heuristic").alias("method"))


LINKS_SQL = """SELECT path, CAST(n AS INTEGER) AS line, l[n] AS specifier, CASE WHEN starts_with(l[n], 'http') THEN 'low' ELSE 'high' END AS confidence, 'heuristic' AS method
FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT 'page/' || page_id AS path, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""
