"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Each source gets a target in words: its weight's share of the mix, at most ``max_epochs``
times its size, with the excess shared again by weight (the water level at which the
targets sum up is found by running sums over the sources in order of their limits). A
source's complete epochs come first: every document that many times. The rest is filled
with documents in order of exponential keys ``-ln(u) / quality``, prefix-summed to the
budget; ``u`` is a hash of the document's id, so reruns agree, and the document at the
edge gives the words that are left. Documents of one key stand in order of id, then of
their text's hash.

No source is sorted in one task. A key's bin is its logarithm in steps of one over the
square root of the number of documents: whatever the qualities, an exponential key's
logarithm has a density of at most 1/e, so no bin holds more than about 0.37 times that
root of documents. Sizes are summed by source and bin before the shuffle, the running sum over bins
finds the bin at the budget's edge, and only that bin's documents are sorted. Documents
meet their source's figures in a join that salts the source, so that a source with a
third of all rows is dealt over all tasks.

The targets' windows see one row a source. Weights are a cycle given to the sources in
order, so none is missing.

Defined cases: null texts have no words and quality 1; a null source is one source, last
in order; null ids share one ``u``; rows that share an id and a text are interchangeable;
extra columns aren't read; a source without words has target 0; empty tables give
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

WEIGHTS, SHARE, MAX_EPOCHS, SALTS = (3, 1, 2), 1.5, 2, 32
#: Signs whose share lowers a document's quality.
NOISE = "#$%&*!|"


def quality(text: Column) -> Column:
    """1 for prose, down to 0.05 as signs take a quarter of the text."""
    size = F.coalesce(F.length(text), F.lit(0))
    noise = size - F.coalesce(F.length(F.translate(text, NOISE, "")), F.lit(0))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * noise / F.greatest(size, F.lit(1)))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with target; one row a source, so the windows below see as many rows."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1)))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / after).withColumn("pos", F.row_number().over(by_cap))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("pos", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    text = F.col(text_col)
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        (-F.log(u) / quality(text)).alias("key"),
        F.md5(F.coalesce(text, F.lit(""))).alias("text_hash"),
    )
    base = materialise(base, "mix-documents")
    bins = max(1, math.isqrt(base.count()))
    base = base.withColumn("bin", F.floor(F.log("key") * bins))
    binned = materialise(base.groupBy("source", "bin").agg(F.sum("size").alias("in_bin")), "mix-bins")
    goals = targets(binned.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, share, max_epochs)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = binned.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0))).alias("b")
    goals = goals.alias("g").join(edges, F.col("g.source").eqNullSafe(F.col("b.source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("in_bin")), "left")
    goals = goals.select("g.*", F.coalesce("b.bin", F.lit(-(1 << 62))).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    goals = materialise(goals, "mix-goals")

    salted = goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("g")
    dealt = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).alias("d")
    joined = dealt.join(salted, (F.col("d.salt") == F.col("g.salt")) & F.col("d.source").eqNullSafe(F.col("g.source")))
    joined = joined.select("d.doc_id", "d.source", "d.size", "d.key", "d.text_hash", "d.bin", "source_size", "target", "epochs", "rest", "edge", "before")
    whole = joined.where(F.col("bin") != F.col("edge")).withColumn("part", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    at_edge = joined.where(F.col("bin") == F.col("edge")).withColumn("part", F.greatest(F.lit(0), F.least("size", room)))
    both = whole.unionByName(at_edge)
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#$%&*!|', ''))) / greatest(length(coalesce(text, '')), 1)) AS q, md5(coalesce(text, '')) AS text_hash,
  (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
c AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS pos,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c WINDOW o AS (ORDER BY ratio, source IS NULL, source)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, pos) FROM l WHERE level <= ratio) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM e),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, g.rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id NULLS FIRST, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM k
"""

QUERIES = {"op7_source_mix": op7_source_mix}
ORACLES = {"op7_source_mix": SQL}
