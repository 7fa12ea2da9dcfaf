"""Queries on diagnostics and older indexes: scrubbed payloads, traces of stages, tables of old JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, diagnostics
from ..sources import workspace
from ..sources.bindings import FILES_SQL, files, table
from ..sources.scratch import scratch_path


def scrubbed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested payloads, with private keys at several depths, in objects and lists; some aren't objects."""
    deep = F.struct(F.col("event_id").alias("ok"), F.col("event_type").alias("text"), F.struct(F.lit("x").alias("excerpt"), F.lit(1).alias("n")).alias("inner"))
    payload = F.struct(F.col("event_type").alias("kind"), F.lit("q").alias("query"), F.struct(F.lit("a/b").alias("path"), F.array(deep, deep).alias("items"), F.col("user_id").alias("user")).alias("nested"), F.lit("t").alias("task"))
    text = F.when(F.col("event_id") % 10 == 0, F.lit("[1, 2]")).when(F.col("event_id") % 10 == 1, F.lit("{broken")).otherwise(F.to_json(payload))
    return diagnostics.scrubbed(table(spark, sf_dir, "events").select("event_id", text.alias("payload")))


def unsafe_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents, as diagnostics of three kinds, must not be written."""
    kind = F.col("id") % 4
    key = F.when(kind == 0, "text").when(kind == 1, "excerpt").otherwise("note")
    body = F.when(kind == 2, F.concat(F.lit("key sk-"), F.substring(F.sha2("text", 256), 1, 24))).otherwise(F.substring(F.regexp_replace("text", r'["\\]', " "), 1, 100))
    said = F.concat(F.lit('{"'), key, F.lit('": "'), body, F.lit('"}'))
    return files(spark, sf_dir).select("id", F.array_join(diagnostics.unsafe(said), ",").alias("reasons"))


def query_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the stages of a look for sections: files, chunks, chunks that name a word, files of these."""
    trace = diagnostics.Trace(spark)
    own = trace.watch("files", files(spark, sf_dir))
    cut = trace.watch("chunks", chunks.window_chunks(own.select("path", "text")), lines=F.sum(F.col("end_line") - F.col("start_line") + 1))
    named = trace.watch("named", cut.where(F.lower("text").contains("the ")))
    found = trace.watch("found", named.select("path").distinct())
    trace.run("search", lambda: found.write.format("noop").mode("overwrite").save())
    stages = trace.stages()
    assert stages.where("stage = 'search' AND ms >= 0").head(1)
    return stages.where("stage <> 'search'").select("stage", "rows", F.coalesce(F.get_json_object("metrics", "$.lines").cast("long"), F.lit(0)).alias("lines"))


def old_index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexes of six versions, one JSON a line, of which four are understood; rows of their tables."""
    n, version = F.col("id").cast("string"), (F.col("id") % 6).cast("int")
    one = lambda *fields: F.struct(*fields)
    file = F.create_map("path", one(F.sha2("text", 256).alias("hash"), F.col("language"), F.length("text").alias("byteLength"), F.when(version > 2, "normal").alias("privacy")))
    chunk = F.create_map(F.concat(F.lit("c"), n), one(F.col("path"), F.lit(1).alias("startLine"), F.lit(9).alias("endLine"), F.when(version > 1, F.col("language")).alias("kind")))
    symbol = F.when(version > 1, F.create_map(F.concat(F.lit("s"), n), one(F.lit("Doc").alias("name"), F.col("path"))))
    edge = F.when(version > 2, F.array(one(F.concat(F.lit("e"), n).alias("id"), F.col("path").alias("fromPath"), F.lit("README.md").alias("toPath"), F.lit("import").alias("kind"))))
    noted = F.when(version > 3, F.create_map(F.concat(F.lit("x"), n), F.lit("why")))
    whole = F.to_json(F.struct(version.alias("version"), file.alias("files"), F.when(F.col("id") % 11 > 0, chunk).alias("chunks"), symbol.alias("symbols"), edge.alias("edges"), noted.alias("explanations")))
    target = scratch_path(spark, "old-indexes")
    files(spark, sf_dir).select(F.when(F.col("id") % 13 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("value")).write.text(target)  # some are half written
    tables = workspace.old_tables(workspace.old_indexes(spark, target, lines=True))
    rows = [
        tables["files"].select(F.lit("file").alias("kind"), F.col("path").alias("id"), F.concat_ws(":", "language", "size", "privacy").alias("value")),
        tables["chunks"].select(F.lit("chunk"), "id", F.concat_ws(":", "path", "start_line", "end_line", "kind")),
        tables["symbols"].select(F.lit("symbol"), "id", F.concat_ws(":", "name", "path")),
        tables["edges"].select(F.lit("edge"), "id", F.concat_ws(":", "from_path", "to_path", "kind")),
        tables["explanations"].select(F.lit("explanation"), "id", "text"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


QUERIES = {f.__name__: f for f in (scrubbed_payloads, unsafe_payloads, query_trace, old_index_tables)}

_OLD = f"SELECT *, id % 6 AS v FROM ({FILES_SQL}) WHERE id % 6 BETWEEN 1 AND 4 AND id % 11 > 0 AND id % 13 > 0"
ORACLES = {
    "scrubbed_payloads": """SELECT event_id, CASE WHEN event_id % 10 > 1 THEN CAST(json_object('kind', event_type, 'nested', json_object('items', [json_object('ok', event_id, 'inner', json_object('n', 1)), json_object('ok', event_id, 'inner', json_object('n', 1))], 'user', user_id)) AS VARCHAR) END AS payload FROM events""",
    "unsafe_payloads": f"""SELECT id, CASE WHEN id % 4 = 0 AND length(text) >= 80 THEN 'long-text' WHEN id % 4 = 1 THEN 'excerpt' WHEN id % 4 = 2 THEN 'secret-like-key' ELSE '' END AS reasons FROM ({FILES_SQL})""",
    "query_trace": f"""WITH l AS (SELECT path, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN [] ELSE string_split_regex(text, '\\r?\\n') END AS l FROM ({FILES_SQL})),
c AS (SELECT path, array_to_string(l[s + 1:s + 80], chr(10)) AS t, least(80, len(l) - s) AS n FROM (SELECT path, l, unnest(list_filter(range(0, greatest(len(l), 1), 68), lambda s: len(l) > 0 AND (s = 0 OR s + 12 < len(l)))) AS s FROM l))
SELECT 'files' AS stage, count(*) AS rows, CAST(0 AS BIGINT) AS lines FROM ({FILES_SQL}) UNION ALL SELECT 'chunks', count(*), sum(n)::BIGINT FROM c UNION ALL SELECT 'named', count(*), 0 FROM c WHERE contains(lower(t), 'the ') UNION ALL SELECT 'found', count(DISTINCT path), 0 FROM c WHERE contains(lower(t), 'the ')""",
    "old_index_tables": f"""WITH o AS ({_OLD}) SELECT 'file' AS kind, path AS id, language || ':' || length(text) || CASE WHEN v > 2 THEN ':normal' ELSE '' END AS value FROM o
UNION ALL SELECT 'chunk', 'c' || id, path || ':1:9' || CASE WHEN v > 1 THEN ':' || language ELSE '' END FROM o UNION ALL SELECT 'symbol', 's' || id, 'Doc:' || path FROM o WHERE v > 1
UNION ALL SELECT 'edge', 'e' || id, path || ':README.md:import' FROM o WHERE v > 2 UNION ALL SELECT 'explanation', 'x' || id, 'why' FROM o WHERE v > 3""",
}
