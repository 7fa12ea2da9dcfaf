"""Exact top-k search: tiled integer matrix products of queries and shards, merged in a tree.

Rows are dealt evenly into shards (their place is no function of id or vector, so copies of
one vector spread), queries into blocks, and either is packed into matrices. A tile is one
block of queries and one shard: a task multiplies the two matrices in slices, keeps each
query's k+1 best rows by partial selection, and forgets the scores. The lists of a query are
then merged in a tree of at most FAN lists a node. Both sides of a tile are bounded in bytes
(TILE_BYTES); what is shuffled is every shard once a query block, every query block once a
shard, and k+1 entries for each query and shard.

Components are ``floor(scale * x)``, x as double, and scores integer inner products, exact:
in double precision while no sum can reach 2**53, in Python integers beyond. A query's own
row is dropped from its list once: it is one entry of its id and its own score.

Defined cases: null vectors and vectors with null or non-finite components take no part;
vectors of unequal length multiply as if the shorter went on with zeros (an empty vector
scores 0); scores beyond a long are cut to its ends; rows with a null id are candidates,
last among ties, and no queries; repeated ids are queries and candidates each; ties go to
the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
Columns other than id and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

K, SCALE, QUERY_STEP = 10, 1024, 100
#: Bytes of a shard's matrix in double precision; a query block has a quarter.
TILE_BYTES = 4 << 20
#: Lists that a node of the merge tree takes.
FAN = 16
EXACT, LONG = 1 << 53, (1 << 63) - 1

BLOCK = "place int, first int, ids array<bigint>, width int, matrix binary"
BEST = "query_key bigint, query_id bigint, own bigint, best array<struct<neg:bigint,unnamed:boolean,vec_id:bigint>>"


def finite(vector: str) -> Column:
    """Whether a vector is there, and all its components are numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def dense(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; shorter lists go on with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(max(sizes, default=0)) if width is None else width
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(rows: DataFrame, parts: int, tall: int) -> DataFrame:
    """Rows (id, vector) dealt evenly over ``parts`` places, as matrices of at most ``tall`` rows."""

    def pack(batches):
        place, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, tall):
                part = batch.slice(at, tall)
                matrix = dense(part.column(1))
                # the columns of BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([first], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())],
                    names=["place", "first", "ids", "width", "matrix"],
                )
                first += part.num_rows

    return rows.repartition(parts).mapInArrow(pack, BLOCK)


def stacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 for null), whether they are null, and one matrix, of blocks in their order."""
    if not blocks.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, 0))
    blocks = blocks.sort_by("first")
    ids = pa.concat_arrays([c.flatten() for c in blocks["ids"].chunks])
    widths = blocks["width"].to_pylist()
    out = np.zeros((len(ids), max(widths)))
    at = 0
    for width, size, data in zip(widths, [len(x) for x in blocks["ids"]], blocks["matrix"].to_pylist(), strict=True):
        out[at : at + size, :width] = np.frombuffer(data, np.float64).reshape(size, width)
        at += size
    return ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), out


def whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where these are exact, else as Python integers."""
    if not matrix.size or np.abs(matrix).max() < EXACT / scale:
        return np.floor(matrix * scale)
    # beyond 2**53 a double is a whole number, and the product might not be finite
    exact = [[int(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in row] for row in matrix.tolist()]
    return np.array(exact, dtype=object).reshape(matrix.shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, exact, cut to a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object and np.abs(a).max() * np.abs(b).max() * width < EXACT:
        return (a @ b.T).astype(np.int64)
    whole_numbers = np.frompyfunc(int, 1, 1)
    return np.clip(whole_numbers(a) @ whole_numbers(b).T, -LONG, LONG).astype(np.int64)


def select(scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of each row's ``most`` largest scores, best first, ties to the smaller position."""
    if scores.shape[1] <= most:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, -most, axis=1)[:, -most][:, None]
    above, level = scores > least, scores == least
    chosen = above | level & (np.cumsum(level, axis=1) <= most - above.sum(axis=1, keepdims=True))
    places = np.nonzero(chosen)[1].reshape(len(scores), most)
    order = np.argsort(-np.take_along_axis(scores, places, axis=1), axis=1, kind="stable")
    return np.take_along_axis(places, order, axis=1)


def tile(scale: int, most: int):
    """The function of a tile: each query of a block with its ``most`` best rows of a shard."""

    def best(queries: pa.Table, shard: pa.Table) -> pa.Table:
        ids, unnamed, rows = stacked(shard)
        order = np.lexsort((ids, unnamed))  # ties go by position
        ids, unnamed, rows = ids[order], unnamed[order], whole(rows[order], scale)
        query_ids, _, asked = stacked(queries)
        asked = whole(asked, scale)
        keys = (queries["place"][0].as_py() << 32 if queries.num_rows else 0) + np.arange(len(query_ids))
        out = []
        step = max(1, TILE_BYTES // (8 * max(1, len(ids))))
        for a in range(0, len(query_ids), step):
            part = asked[a : a + step]
            scores = product(part, rows)
            chosen = select(scores, most)
            n, wide = chosen.shape
            flat = chosen.ravel()
            entries = pa.StructArray.from_arrays(
                [pa.array(-np.take_along_axis(scores, chosen, axis=1).ravel()), pa.array(unnamed[flat]), pa.array(ids[flat], mask=unnamed[flat])],
                names=["neg", "unnamed", "vec_id"],
            )
            own = [int(product(part[i : i + 1], part[i : i + 1])[0, 0]) for i in range(n)]
            out.append(pa.table({"query_key": keys[a : a + step], "query_id": query_ids[a : a + step], "own": pa.array(own, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), entries)}))
        return pa.concat_tables(out) if out else empty

    entry = pa.struct([("neg", pa.int64()), ("unnamed", pa.bool_()), ("vec_id", pa.int64())])
    empty = pa.table({"query_key": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "own": pa.array([], pa.int64()), "best": pa.array([], pa.list_(entry))})
    return best


def merged(lists: DataFrame, shards: int, most: int, fan: int = FAN) -> DataFrame:
    """One list a query, from lists of shards: a tree in which a node joins ``fan`` lists."""
    while shards > 1:
        together = F.array_sort(F.flatten(F.collect_list("best")))
        lists = lists.groupBy("query_key", F.floor(F.col("shard") / fan).cast("int").alias("shard")).agg(F.first("query_id").alias("query_id"), F.first("own").alias("own"), F.slice(together, 1, most).alias("best"))
        shards = -(-shards // fan)
    return lists


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", tile_bytes: int = TILE_BYTES, fan: int = FAN) -> DataFrame:
    """The k best rows of each query (a row for which ``is_query`` holds): query_id, rank, vec_id, score."""
    fine = rows.where(finite(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
    n, asked, width = fine.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    tall = max(1, tile_bytes // (8 * max(1, width or 0)))
    blocks, shards = max(1, -(-asked // max(1, tall // 4))), max(1, -(-n // tall))
    left = materialise(packed(fine.where("asks").select("vec_id", "vector"), blocks, tall), "topk-queries")
    right = materialise(packed(fine.select("vec_id", "vector"), shards, tall), "topk-shards")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = left.withColumns({"block": F.col("place"), "shard": to_all}).groupBy("block", "shard")
    right = right.withColumns({"shard": F.col("place"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).groupBy("block", "shard")
    work = tile(scale, k + 1)

    def run(key, queries, shard):
        got = work(queries, shard)
        return got.append_column("shard", pa.array([key[1].as_py()] * got.num_rows, pa.int32()))

    lists = left.cogroup(right).applyInArrow(run, f"{BEST}, shard int")
    lists = merged(lists, shards, k + 1, fan)
    own = F.array_position("best", F.struct((-F.col("own")).alias("neg"), F.lit(False).alias("unnamed"), F.col("query_id").alias("vec_id")))
    others = F.when(own > 0, F.concat(F.slice("best", F.lit(1), own - 1), F.slice("best", own + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    found = lists.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.neg")).alias("score"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


QUERIES = {"op13_topk_search": op13_topk_search}
ORACLES = {
    "op13_topk_search": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
""",
}
