"""Lexical and vector ranking: postings, BM25, cosine similarity, fusion, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import memory_boost, path_boost
from ..functions.text import query_tokens, tokens

K1, B = 1.2, 0.75


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): written once by term, every query reads its terms' rows only."""
    terms = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return terms.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df); postings have one row a term and document."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def term_frequency(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) straight from texts: each document's distinct terms, one partial sum and one shuffle of terms."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25_term(tf: Column, dl: Column, df: Column, n: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(average, F.lit(1.0))))


def bm25_from_postings(posted: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(id, score) over stored postings; lengths holds (id, dl) of all documents. Repeated query terms count again."""
    wanted = query_tokens(query)
    if not wanted:
        return lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    times = {t: wanted.count(t) for t in wanted}
    hits = posted.where(F.col("term").isin(*times))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average"))
    repeat = F.lit(0)
    for term, n in times.items():
        repeat = F.when(F.col("term") == term, F.lit(n)).otherwise(repeat)
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # as many rows as query terms, and one row
    return scored.groupBy("id").agg(F.sum(bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("average")) * repeat).alias("score"))


def equals(term: str):
    return lambda x: x == term


def bm25(chunks: DataFrame, query: str, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = (), of_hits: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """(id, score, kept columns) of all documents with a score, without stored postings: one pass counts the query's terms only.

    ``of_hits`` gives more columns by the array of a text's words that are the query's; they are computed
    in the same pass, where there is such a word. The counts (a few numbers a document) are persisted, as
    corpus figures and scores both need them.
    """
    wanted = query_tokens(query)
    terms = list(dict.fromkeys(wanted))
    more = of_hits(F.col("_own")) if of_hits else {}
    split = chunks.withColumn("_terms", tokens(F.col(text_col)))
    split = split.withColumn("_own", F.filter("_terms", lambda x: x.isin(*terms)))
    found = [F.when(F.size("_own") > 0, c).alias(name) for name, c in more.items()]
    counted = split.select(F.col(id_col).alias("id"), *keep, F.size("_terms").alias("dl"), *[F.size(F.filter("_own", equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)], *found).persist()
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    parts = [bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("average")) * wanted.count(t) for i, t in enumerate(terms)]
    return counted.crossJoin(F.broadcast(corpus)).select("id", *keep, *more, sum(parts, F.lit(0.0)).alias("score")).where("score > 0")


def boosted(scored: DataFrame, path_hint: str | None = None, prefer_memory: bool = True) -> DataFrame:
    """Scores times path and memory boosts; scored has path, kind and weight."""
    factor = path_boost(F.col("path"), path_hint) * memory_boost(F.col("kind"), F.col("weight"), prefer_memory)
    return scored.withColumn("score", F.col("score") * factor)


def top_k(scored: DataFrame, k: int = 8, id_col: str = "id") -> DataFrame:
    """The k best, ties by id: a TakeOrderedAndProject, no global sort."""
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    probe = F.array(*[F.lit(float(x)) for x in query])
    return top_k(vectors.select(id_col, cosine(F.col(vector_col), probe).alias("score")), k, id_col)


def fuse(lexical: DataFrame, vector: DataFrame, weight: float = 10.0) -> DataFrame:
    """(id, lexical, vector, score): lexical score plus weighted similarity where both are there, else what is there."""
    both = lexical.select("id", F.col("score").alias("lexical")).join(vector.select("id", F.col("score").alias("vector")), "id", "full_outer")
    return both.withColumn("score", F.coalesce("lexical", F.lit(0.0)) + F.coalesce(F.col("vector"), F.lit(0.0)) * weight)
