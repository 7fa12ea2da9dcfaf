"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A batch is a set of signed rows (documents, tokens and characters gained or lost under a
key). Batches are summed by key before they are stored, and totals are sums over stored
batches, so inserts, deletes and revised counts (an old count lost, a new one gained) are
all additive and may come in any order. A batch is committed under its id: its rows are
written first, below a name of this attempt's own, then a commit file of the id's hash that
names the attempt: a whole file that can be made only once (a writer lost on the way leaves
none, and the batch can be sent again). So a batch whose id is committed changes
nothing, of two writers of one id one wins whole, and what a lost attempt left doesn't
count. ``compact`` folds committed batches into one.

Tokenizers are column expressions by version name; ``bpe_counts`` counts by a public
vocabulary in Arrow batches (the vocabulary, some 50,000 entries, is read once and sent to
the tasks). Everything else is DataFrame functions: one scan, then sums with a partial
aggregate before the shuffle.

Defined cases: a null text has 0 tokens and characters but is a document; null sources and
languages are keys of their own; repeated rows count each; empty batches commit and add
nothing; keys whose documents, tokens and characters are all 0 aren't in the totals.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.markers import exists, make_once
from .common import map_text, materialise, shared_dir, table

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, version string, docs long, tokens long, chars long"
WORD, PIECE = r"[^\x20\x09-\x0D]+", r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"


def counter(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


TOKENIZERS = {"words-1": counter(WORD), "pieces-1": counter(PIECE)}


class TokenRollup:
    """Totals kept at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def is_committed(self, batch_id: str) -> bool:
        if exists(self.spark, self.commit_file(batch_id)):
            return True
        folded = f"{self.path}/folded"
        return exists(self.spark, folded) and bool(self.spark.read.schema("batch string").parquet(folded).where(F.col("batch") == batch_id).head(1))

    def commit_file(self, batch_id: str) -> str:
        return f"{self.path}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def commit(self, batch_id: str, attempt: str) -> bool:
        """Make the commit file; False if somebody else has."""
        return make_once(self.spark, self.commit_file(batch_id), f"{attempt}\n")

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add signed rows (SCHEMA) under batch_id; False if it is committed already."""
        if self.is_committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        summed = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        summed.write.parquet(f"{self.path}/deltas/attempt={attempt}")
        return self.commit(batch_id, attempt)

    def committed(self) -> DataFrame:
        """Stored rows of committed batches."""
        if not all(exists(self.spark, f"{self.path}/{folder}") for folder in ("commits", "deltas")):
            return self.spark.createDataFrame([], f"{SCHEMA}, attempt string")
        rows = self.spark.read.schema(f"{SCHEMA}, attempt string").parquet(f"{self.path}/deltas")
        named = self.spark.read.text(f"{self.path}/commits").select(F.col("value").alias("attempt"))
        return rows.join(named.where("attempt <> ''"), "attempt", "left_semi")

    def totals(self) -> DataFrame:
        summed = self.committed().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def compact(self, path: str, batch_ids: DataFrame) -> TokenRollup:
        """The same totals at a new path, in one batch; batch_ids (a column ``batch``: what the writers still might send again) count as committed there."""
        new = TokenRollup(self.spark, path)
        batch_ids.select("batch").write.parquet(f"{path}/folded")
        new.apply("base", self.committed().select(*KEYS, *SUMS))
        return new


def count(docs: DataFrame, tokenizers: dict | None = None, text_col: str = "text") -> DataFrame:
    """Docs' rows (SCHEMA), one for each document and tokenizer version."""
    text = F.col(text_col)
    counts = F.array(*[F.struct(F.lit(v).alias("version"), f(text).alias("tokens")) for v, f in (tokenizers or TOKENIZERS).items()])
    chars = F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars")
    return docs.select("source", "lang", chars, F.explode(counts).alias("c")).select("source", "lang", "c.version", F.lit(1).cast("long").alias("docs"), "c.tokens", "chars")


def lost(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: -F.col(c) for c in SUMS})


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that replace old counts with new ones."""
    return lost(old).unionByName(new)


def bpe_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Docs with n_tokens by a byte-level BPE; ``vocabulary`` is a file of base64 tokens and ranks that Spark can read."""
    lines = docs.sparkSession.read.text(vocabulary).collect()
    shared = docs.sparkSession.sparkContext.broadcast([row["value"] for row in lines])

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda column: [pa.array([len(own.encode_ordinary(t)) if t else 0 for t in column.to_pylist()], pa.int64())]

    return map_text(docs, "n_tokens long", make, text_col)


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, take back exact copies, then recount words without a document's repeated lines; replays change nothing."""
    text = F.col("text")
    once = F.aggregate(F.array_distinct(F.split(text, "\n", -1)), F.lit(0).cast("long"), lambda n, line: n + F.regexp_count(line, F.lit(WORD)))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        F.sha2(text, 256).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"),
        *[f(text).alias(v) for v, f in TOKENIZERS.items()],
        F.coalesce(once, F.lit(0)).cast("long").alias("recount"),
    )
    docs = materialise(docs, "token-counts")
    kept = docs.groupBy("digest").agg(F.min_by(F.struct("source", "lang", "chars", "recount", *TOKENIZERS), F.struct("doc_id", "source", "lang")).alias("d")).select("d.*")
    kept = materialise(kept, "token-kept")

    def rows(of: DataFrame, columns: dict[str, str]) -> DataFrame:
        counts = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for v, c in columns.items()])
        return of.select("source", "lang", "chars", F.explode(counts).alias("c")).select("source", "lang", "c.version", F.lit(1).cast("long").alias("docs"), "c.tokens", "chars")

    own = {v: v for v in TOKENIZERS}
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    for _ in range(2):  # the second round is a replay
        rollup.apply("load", rows(docs, own))
        rollup.apply("copies", revised(rows(docs, own), rows(kept, own)))
        rollup.apply("recount", revised(rows(kept, {"words-1": "words-1"}), rows(kept, {"words-1": "recount"})))
    return rollup.totals()


SQL = rf"""
WITH k AS (SELECT source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang) AS n FROM documents) WHERE n = 1),
c AS (SELECT source, lang, coalesce(length(text), 0) AS chars,
  coalesce(list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: len(regexp_extract_all(x, '{WORD}')))), 0) AS w,
  coalesce(len(regexp_extract_all(text, '{PIECE}')), 0) AS p FROM k),
v AS (SELECT source, lang, 'words-1' AS version, w AS tokens, chars FROM c UNION ALL SELECT source, lang, 'pieces-1', p, chars FROM c)
SELECT source, lang, version, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(chars)::BIGINT AS chars FROM v GROUP BY ALL
"""

QUERIES = {"op1_token_rollup": op1_token_rollup}
ORACLES = {"op1_token_rollup": SQL}
