"""Queries on file trees: written from the given tables through the guarded sink, read back through the tree source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bindings import FILES_SQL, files
from ..sources.scratch import scratch_path
from ..sources.trees import read_tree, write_files

ENDINGS = (".ts", ".md", ".log", ".tmp", ".ts")
IGNORES = {"p/.gitignore": "# logs\n*.log\n", "p/src1/.gitignore": "/de\n!*.log\n", "p/src2/.gitignore": "*.ts\n!*5.ts\n"}


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files with ignore files at two levels, read back: what is left, with size and digest."""
    root = scratch_path(spark, "tree")
    folder = F.when(F.col("id") % 7 == 0, "node_modules").otherwise(F.col("language"))
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("id") % 5 + 1).cast("int"))
    source = F.split("path", "/")[0]
    own = files(spark, sf_dir).select(F.concat(F.lit("p/"), source, F.lit("/"), folder, F.lit("/"), F.col("id").cast("string"), ending).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    write_files(own.unionByName(spark.createDataFrame(list(IGNORES.items()), "path string, text string")), root, "p")
    return read_tree(spark, root).where("reason IS NULL").select("path", "size", F.sha2("text", 256).alias("sha256"))


def written_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of memory documents, the first with human blocks in every second one; the second job is sent twice and counts once."""
    root = scratch_path(spark, "memory")
    rows = files(spark, sf_dir).select(F.concat(F.lit("memory/generated/"), F.col("language"), F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), "id", "text")
    block = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<!-- human:start -->\nkept "), F.col("id").cast("string"), F.lit("\n<!-- human:end -->\n"))).otherwise(F.lit(""))
    write_files(rows.select("path", F.concat(F.lit("first\n"), block).alias("text")), root, "memory/generated", "first")
    for body in (F.concat(F.lit("second "), F.sha2("text", 256), F.lit("\n")), F.lit("a replay")):
        write_files(rows.select("path", body.alias("text")), root, "memory/generated", "second")
    return read_tree(spark, root).where("reason IS NULL").select("path", F.sha2("text", 256).alias("sha256"))


_TREE = f"""WITH f AS (SELECT id, split_part(path, '/', 1) AS source, CASE WHEN id % 7 = 0 THEN 'node_modules' ELSE language END AS folder, {list(ENDINGS)}[id % 5 + 1] AS ending, coalesce(text, '') AS t FROM ({FILES_SQL})),
n AS (SELECT *, 'p/' || source || '/' || folder || '/' || id || ending AS path FROM f)
SELECT path, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS sha256 FROM n WHERE folder <> 'node_modules' AND ending <> '.log' AND NOT (source = 'src1' AND folder = 'de') AND NOT (source = 'src2' AND ending = '.ts' AND id % 10 <> 5)
UNION ALL SELECT path, CAST(length(t) AS BIGINT), sha256(t) FROM (VALUES {", ".join(f"('{p}', '{t}')".replace(chr(10), "' || chr(10) || '") for p, t in IGNORES.items())}) v(path, t)"""
_MEMORY = f"""SELECT 'memory/generated/' || language || '/' || id || '.md' AS path, sha256('second ' || sha256(text) || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || '<!-- human:start -->' || chr(10) || 'kept ' || id || chr(10) || '<!-- human:end -->' ELSE '' END || chr(10)) AS sha256 FROM ({FILES_SQL})"""

QUERIES = {f.__name__: f for f in (tree_files, written_memory)}
ORACLES = {"tree_files": _TREE, "written_memory": _MEMORY}
