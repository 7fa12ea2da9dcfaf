"""Queries on ranking and text structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.text import STOP_WORDS
from ..operators import chunks, evaluate, lexical
from ..sources.bindings import FILES_SQL, PROJECT_SQL, files, marked, marked_sql, project_paths, table

QUESTION = "inea edes ontion thha inea"
TERMS = ("inea", "edes", "ontion", "thha")
TOKENS = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP_WORDS}, t))"
PROBE = [((i * 7) % 13 - 6) / 6 for i in range(64)]


def doc_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.tokens(F.col("text"))).cast("long")
    return files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("avg_tokens"))


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequency(files(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lexical.top_k(lexical.bm25(files(spark, sf_dir), QUESTION), 20)
    return best.select("id", F.round("score", 6).alias("score"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = lexical.postings(files(spark, sf_dir))
    lengths = files(spark, sf_dir).select("id", F.size(text.tokens(F.col("text"))).alias("dl"))
    return lexical.bm25_from_postings(posted, lengths, QUESTION).select("id", F.round("score", 6).alias("score"))


BM25_SQL = f"""d AS (SELECT id, path, language, {TOKENS.format("text")} AS t FROM ({FILES_SQL})),
s AS (SELECT id, path, language, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))} FROM d),
c AS (SELECT count(*) AS n, avg(dl) AS a, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM s),
b AS (SELECT id, path, language, {" + ".join(f"{2.0 if i == 0 else 1.0} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / greatest(a, 1.0)))" for i in range(len(TERMS)))} AS score FROM s, c)"""


def bm25_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("language") == "en", "memory").otherwise("source")
    scored = lexical.bm25(files(spark, sf_dir), QUESTION, keep=("path", "language")).withColumn("kind", kind).withColumn("weight", F.lit(1.1))
    best = lexical.top_k(lexical.boosted(scored, "src3/fr/3.md"), 20)
    return best.select("id", "path", F.round("score", 6).alias("score"))


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", scores.overlap_score("inea edes ontion", F.col("text")).cast("long").alias("overlap")).where("overlap > 0")


def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", scores.path_score("src3 french fr", F.col("path")).cast("long").alias("score"))


def repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = text.repetition(F.col("text"))
    penalty = scores.generated_penalty(F.col("path"), F.length("text"), F.col("text")).cast("long")
    return files(spark, sf_dir).select("id", F.round(ratio, 6).alias("ratio"), penalty.alias("penalty"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.cosine_top_k(table(spark, sf_dir, "embeddings"), PROBE, 25).select("vec_id", F.round("score", 5).alias("score"))


def fuse_lex_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexical.bm25(files(spark, sf_dir), QUESTION)
    probe = F.array(*[F.lit(x) for x in PROBE])
    near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), lexical.cosine(F.col("embedding"), probe).alias("score")).where("score > 0.1")
    return lexical.fuse(words, near).select("id", F.round("score", 4).alias("score"))


COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[])"


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source ranked by BM25, good ones as relevant: quality at 5."""
    scored = lexical.bm25(files(spark, sf_dir), QUESTION, keep=("path",)).withColumn("task", F.element_at(F.split("path", "/"), 1))
    from pyspark.sql import Window

    ranked = scored.select("task", F.col("id").alias("item"), F.row_number().over(Window.partitionBy("task").orderBy(F.desc(F.round("score", 6)), "id")).alias("rank"))
    good = table(spark, sf_dir, "labels").where("quality = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("task"), F.col("doc_id").alias("item"))
    per_task = evaluate.retrieval_quality(ranked, good, 5)
    return per_task.select("task", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr")])


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunks.window_chunks(files(spark, sf_dir), 20, 5)
    return got.select("path", "start_line", "end_line", F.sha2("text", 256).alias("hash"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).withColumn("text", marked(F.col("text")))
    return chunks.section_chunks(own).select("path", "title", "start_line", "end_line", F.length("text").alias("chars"))


def heading_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).withColumn("text", marked(F.col("text")))
    got = chunks.heading_sections(own)
    return got.select("path", "line", "level", F.array_join("ancestry", " > ").alias("ancestry"))


def bullet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).withColumn("text", marked(F.col("text")))
    return chunks.bullets(own).select("path", "line", F.length("text").alias("chars"), chunks.looks_like_instruction(F.col("text")).alias("instruction"))


def chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    return files(spark, sf_dir).select("path", text.chunk_id(F.col("path"), one, F.size(text.lines(F.col("text"))), F.lit("")).alias("id"), F.sha2("text", 256).alias("hash"), text.query_fingerprint(F.col("path")).alias("fingerprint"))


def language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return project_paths(spark, sf_dir).groupBy(text.language(path).alias("language"), text.extension(path).alias("extension")).agg(F.count("*").alias("files"), F.count_if(text.generated_path(path)).alias("generated"))


LINES = "string_split_regex(text, '\\r?\\n')"
TRIMMED = "trim(array_to_string(l[{a}:{b}], chr(10)), ' ' || chr(9) || chr(10) || chr(13))"

QUERIES = {
    "doc_token_stats": doc_token_stats,
    "term_document_frequency": term_document_frequency,
    "bm25_topk": bm25_topk,
    "bm25_all": bm25_all,
    "bm25_boosted": bm25_boosted,
    "lexical_overlap": lexical_overlap,
    "path_scores": path_scores,
    "repetition_ratio": repetition_ratio,
    "cosine_topk": cosine_topk,
    "fuse_lex_vec": fuse_lex_vec,
    "eval_metrics": eval_metrics,
    "window_chunks": window_chunks,
    "section_chunks": section_chunks,
    "heading_ancestry": heading_ancestry,
    "bullet_rules": bullet_rules,
    "chunk_fingerprint": chunk_fingerprint,
    "language_detection": language_detection,
}

_HEADINGS = f"""h AS (SELECT path, CAST(i AS INTEGER) AS line, length(regexp_extract(l[i], '^(#{{1,6}})\\s+\\S', 1)) AS level, regexp_extract(l[i], '^#{{1,6}}\\s+(.*?)\\s*$', 1) AS title
  FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split_regex({marked_sql()}, '\\r?\\n') AS l FROM ({FILES_SQL})))
  WHERE regexp_matches(l[i], '^#{{1,6}}\\s+\\S'))"""

ORACLES = {
    "doc_token_stats": f"SELECT language, count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS avg_tokens FROM (SELECT language, len({TOKENS.format('text')}) AS n FROM ({FILES_SQL})) GROUP BY language",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({TOKENS.format('text')}) AS term FROM ({FILES_SQL})) GROUP BY term",
    "bm25_topk": f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, id LIMIT 20",
    "bm25_all": f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM b WHERE score > 0",
    "bm25_boosted": f"""WITH {BM25_SQL}, x AS (SELECT id, path, score * CASE WHEN path = 'src3/fr/3.md' THEN 1.35 WHEN regexp_replace(path, '/[^/]*$', '') = 'src3/fr' THEN 1.2 ELSE 1.0 END * CASE WHEN language = 'en' THEN 1.45 ELSE 1.1 END AS s FROM b WHERE score > 0)
SELECT id, path, round(s, 6) AS score FROM x ORDER BY s DESC, id LIMIT 20""",
    "lexical_overlap": f"""SELECT id, overlap FROM (SELECT id, CAST(least(40, floor((list_contains(t, 'inea')::INT + list_contains(t, 'edes')::INT + list_contains(t, 'ontion')::INT) / 3 * 40 + 0.5)) AS BIGINT) AS overlap
FROM (SELECT id, {TOKENS.format('text')} AS t FROM ({FILES_SQL}))) WHERE overlap > 0""",
    "path_scores": f"SELECT path, CAST(least(50, floor((contains(path, 'src3')::INT + contains(path, 'french')::INT + contains(path, 'fr')::INT) / 3 * 50 + 0.5)) AS BIGINT) AS score FROM ({FILES_SQL})",
    "repetition_ratio": f"""WITH d AS (SELECT id, text, list_transform(list_filter(list_transform({LINES}, lambda x: trim(x)), lambda x: length(x) > 0), lambda x: x) AS k FROM ({FILES_SQL})),
g AS (SELECT *, list_transform(range(1, greatest(length(text) - 7, 1) + 1, 4), lambda i: substr(text, i, 8)) AS grams FROM d),
r AS (SELECT id, text, CASE WHEN length(text) < 200 THEN 0.0 WHEN len(k) < 8 THEN (len(grams) - len(list_distinct(grams))) / len(grams) ELSE (len(k) - len(list_distinct(k))) / len(k) END AS ratio FROM g)
SELECT id, round(ratio, 6) AS ratio, CAST(CASE WHEN length(text) > 200000 THEN 25 ELSE 0 END + CASE WHEN ratio > 0.45 THEN floor(ratio * 30 + 0.5) ELSE 0 END AS BIGINT) AS penalty FROM r""",
    "cosine_topk": f"SELECT vec_id, round({COSINE}, 5) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 25",
    "fuse_lex_vec": f"WITH {BM25_SQL}, v AS (SELECT vec_id AS id, {COSINE} AS s FROM embeddings WHERE {COSINE} > 0.1) SELECT id, round(coalesce(b.score, 0) + coalesce(v.s, 0) * 10, 4) AS score FROM (SELECT * FROM b WHERE score > 0) b FULL JOIN v USING (id)",
    "eval_metrics": f"""WITH {BM25_SQL}, k AS (SELECT split_part(path, '/', 1) AS task, id, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY round(score, 6) DESC, id) AS rank FROM b WHERE score > 0),
g AS (SELECT DISTINCT source AS task, doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
p AS (SELECT k.task, count(*) FILTER (rank <= 5) AS shown, count(*) FILTER (rank <= 5 AND g.id IS NOT NULL) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first FROM k LEFT JOIN g ON k.task = g.task AND k.id = g.id GROUP BY k.task),
w AS (SELECT task, count(*) AS wanted FROM g GROUP BY task)
SELECT task, round(coalesce(hits / nullif(shown, 0), 0), 6) AS precision, round(coalesce(hits / wanted, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr FROM w FULL JOIN p USING (task)""",
    "window_chunks": f"""SELECT path, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 20, len(l)) AS INTEGER) AS end_line, sha256({TRIMMED.format(a='s + 1', b='s + 20')}) AS hash
FROM (SELECT path, l, unnest(list_filter(range(0, len(l), 15), lambda s: s = 0 OR s + 5 < len(l))) AS s FROM (SELECT path, {LINES} AS l FROM ({FILES_SQL}))) WHERE {TRIMMED.format(a='s + 1', b='s + 20')} <> ''""",
    "section_chunks": f"""WITH d AS (SELECT path, string_split_regex({marked_sql()}, '\\r?\\n') AS l FROM ({FILES_SQL})),
h AS (SELECT path, l, list_sort(list_distinct(list_concat([1], list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{1,3}}\\s+\\S'))))) AS h FROM d),
c AS (SELECT path, l, h[j] AS a, coalesce(h[j + 1] - 1, len(l)) AS b FROM (SELECT *, unnest(range(1, len(h) + 1)) AS j FROM h)),
t AS (SELECT path, regexp_extract(l[a], '^#{{1,3}}\\s+(.*?)\\s*$', 1) AS title, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, {TRIMMED.format(a='a', b='b')} AS body FROM c)
SELECT path, title, start_line, end_line, CAST(length(body) AS INTEGER) AS chars FROM t WHERE body <> ''""",
    "heading_ancestry": f"""WITH {_HEADINGS}
SELECT h.path, h.line, CAST(h.level AS INTEGER) AS level, coalesce((SELECT string_agg(a.title, ' > ' ORDER BY a.line) FROM h a WHERE a.path = h.path AND a.line < h.line AND a.level < h.level
  AND NOT EXISTS (SELECT 1 FROM h y WHERE y.path = h.path AND y.line > a.line AND y.line < h.line AND y.level <= a.level)), '') AS ancestry FROM h""",
    "bullet_rules": f"""WITH r AS (SELECT path, CAST(i AS INTEGER) AS line, regexp_extract(l[i], '^\\s*(?:[-*+]|\\d+[.)])\\s+(.+?)\\s*$', 1) AS t
  FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split_regex({marked_sql()}, '\\r?\\n') AS l FROM ({FILES_SQL}))))
SELECT path, line, CAST(length(t) AS INTEGER) AS chars, regexp_matches(t, '(?i)\\b(must|should|never|always|do not|don''t|avoid|prefer|use|ensure|require[sd]?|shall|only)\\b') OR regexp_matches(t, '(?i)^(add|keep|write|run|follow|name|place|put|return|throw|validate)\\b') OR (length(t) >= 8 AND regexp_matches(t, '[A-Za-z]')) AS instruction
FROM r WHERE length(t) >= 4""",
    "chunk_fingerprint": f"SELECT path, substr(sha256(path || ':1:' || len({LINES}) || ':'), 1, 24) AS id, sha256(text) AS hash, substr(sha256(lower(trim(path))), 1, 32) AS fingerprint FROM ({FILES_SQL})",
    "language_detection": """SELECT CASE e WHEN 'ts' THEN 'typescript' WHEN 'php' THEN 'php' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' ELSE 'other' END AS language, e AS extension, count(*) AS files, count(*) FILTER (regexp_matches(path, '(?i)(^|/)(generated|gen|\\.generated|__generated__|dist|build|out|coverage|\\.next)(/|$)')) AS generated
FROM (SELECT path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM (""" + PROJECT_SQL + ")) GROUP BY ALL",
}
