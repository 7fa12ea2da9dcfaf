"""Quality classifier: a factorisation machine over hashed words and structure.

A document's features are its words, hashed into ``2 ** WORD_BITS`` buckets with the
square root of their share as value, and one indicator for each structure statistic
(shares of upper-case letters, digits, signs, line breaks, repeated lines and words, word
and text lengths, ...), quantised. Labels, language, source and id are no features. The
machine adds to a linear score all pairwise interactions through rank-``RANK`` factors, in
linear time: half of (square of the sum minus sum of the squares), factor by factor.

It is fitted on the driver on at most ``max_fit_rows`` labelled rows outside the held-out
fold (features are computed by executors; a hash of the id picks the rows), with AdaGrad
in a fixed order, so reruns agree. Scoring is one Arrow pass over whole texts without a
shuffle.

Defined cases: null and empty texts have only the structure features of an empty text;
without labels of both classes the score is 0.5 everywhere; repeated rows score alike;
empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_table, fold_of, labelled_sample, map_text, owners, slices, table, utf8, words

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
WORD_BITS, RANK, LEVELS = 14, 4, 24
SPACED = byte_table("space")
LINES = np.where(np.arange(256) == 10, 0, np.where(np.arange(256) == 0, 1, np.arange(256))).astype(np.uint8)

#: Classes of bytes whose shares are statistics.
CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "space": (9, 32), "line": (10, 13), "stop": (33, 46, 63), "comma": (44, 58, 59), "sign": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 124, 126), "wide": range(128, 256)}
STATS = (*CLASSES, "shout", "word_length", "words", "unique_words", "unique_lines", "line_length")
SIZE = (1 << WORD_BITS) + len(STATS) * LEVELS


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def unique_share(hashed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct items of each document over its items; 1 for none."""
    doc = owners(offsets).astype(U64)
    distinct = np.unique((hashed & U64(0xFFFFFFFFFF)) | (doc << U64(40)))
    count = np.bincount((distinct >> U64(40)).astype(np.int64), minlength=len(offsets) - 1)
    return np.where(np.diff(offsets) > 0, count / np.maximum(1, np.diff(offsets)), 1.0)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of consecutive documents: feature ids, values, n+1 row offsets."""
    offsets = offsets - offsets[0]
    n, size = len(offsets) - 1, np.diff(offsets)
    hashed, start, end, at = words(raw, offsets, SPACED)
    lines, _, _, line_at = words(raw, offsets, LINES)
    count = np.diff(at)
    key = owners(at).astype(U64) << U64(WORD_BITS) | hashed >> U64(64 - WORD_BITS)
    distinct, times = np.unique(key, return_counts=True)
    doc = (distinct >> U64(WORD_BITS)).astype(np.int64)
    ids, values = (distinct & U64((1 << WORD_BITS) - 1)).astype(np.int64), np.sqrt(times / count[doc])
    some = np.maximum(size, 1)
    stats = []
    for members in CLASSES.values():
        is_in = np.zeros(256, np.uint8)
        is_in[list(members)] = 1
        stats.append(np.sqrt(per_document(is_in[raw], offsets) / some) * 2)
    shouted = np.zeros(len(start), np.uint8)
    if len(start):
        shouted = (raw[end - 1] >= 65) & (raw[end - 1] <= 90) | (raw[end - 1] == 33) & (raw[np.maximum(end - 2, start)] == 33)
    stats.append(per_document(shouted, at) / np.maximum(1, count))
    stats.append(per_document(end - start, at) / np.maximum(1, count) / 16)
    stats.append(np.log2(1 + count) / 16)
    stats.append(unique_share(hashed, at))
    stats.append(unique_share(lines, line_at))
    stats.append(np.log2(1 + size / np.maximum(1, np.diff(line_at))) / 16)
    level = np.minimum((np.stack(stats, axis=1) * (LEVELS - 1)).astype(np.int64), LEVELS - 1)
    stat_ids = (1 << WORD_BITS) + np.arange(len(STATS)) * LEVELS + level
    # rows: statistics first, then words
    row = np.concatenate([np.repeat(np.arange(n), len(STATS)), doc])
    order = np.argsort(row, kind="stable")
    ids = np.concatenate([stat_ids.ravel(), ids])[order]
    values = np.concatenate([np.full(n * len(STATS), 0.3), values])[order]
    return ids, values, np.searchsorted(row[order], np.arange(n + 1))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, ids: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Linear part and pairwise interactions by the sum-of-squares identity; rows are never empty."""
        terms = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(terms, rows[:-1], axis=0)
        squares = np.add.reduceat(terms * terms, rows[:-1], axis=0)
        return self.bias + np.add.reduceat(self.linear[ids] * values, rows[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(ids: np.ndarray, values: np.ndarray, rows: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if len(np.unique(label)) < 2:
        m.factors[:] = 0
        return m
    share = label.mean()
    m.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            lengths = rows[chosen + 1] - rows[chosen]
            ptr = np.append(0, np.cumsum(lengths))
            flat = np.repeat(rows[chosen] - ptr[:-1], lengths) + np.arange(ptr[-1])
            i, x = ids[flat], values[flat]
            terms = m.factors[i] * x[:, None]
            sums = np.add.reduceat(terms, ptr[:-1], axis=0)
            off = (sigmoid(m.margin(i, x, ptr)) - label[chosen]) / len(chosen)
            own = np.repeat(off, lengths)
            used, where = np.unique(i, return_inverse=True)
            grad = np.bincount(where, own * x) + decay * m.linear[used]
            seen_w[used] += grad * grad
            m.linear[used] -= rate * grad / np.sqrt(seen_w[used])
            slope = (np.repeat(sums, lengths, axis=0) - terms) * (own * x)[:, None]
            grad = np.stack([np.bincount(where, slope[:, f]) for f in range(RANK)], axis=1) + decay * m.factors[used]
            seen_v[used] += grad * grad
            m.factors[used] -= 0.5 * rate * grad / np.sqrt(seen_v[used])
            seen_b += off.sum() ** 2
            m.bias -= rate * off.sum() / np.sqrt(seen_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 12_000) -> Machine:
    """Fit on at most max_fit_rows labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, max_fit_rows)

    def make():
        def work(column):
            raw, offs = utf8(column)
            ids, values = [], []
            for a, b in slices(offs):
                i, x, rows = features(raw[offs[a] : offs[b]], offs[a : b + 1])
                ids += [i[s:e] for s, e in zip(rows[:-1], rows[1:], strict=True)]
                values += [x[s:e] for s, e in zip(rows[:-1], rows[1:], strict=True)]
            return pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))

        return work

    got = map_text(sample, "ids array<int>, vals array<float>", make, "text", ["doc_id", "__label"]).toArrow().sort_by([("doc_id", "ascending"), ("__label", "ascending")])
    lists = got["ids"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = np.concatenate([c.flatten().to_numpy() for c in (lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists])] or [np.zeros(0)]).astype(np.int64)
    values = np.concatenate([c.flatten().to_numpy() for c in got["vals"].chunks] or [np.zeros(0)]).astype(np.float64)
    rows = np.append(0, np.cumsum([len(x) for x in got["ids"]], dtype=np.int64))
    return train(flat, values, rows, got["__label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Docs with score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value

        def work(column):
            raw, offs = utf8(column)
            out = [sigmoid(m.margin(*features(raw[offs[a] : offs[b]], offs[a : b + 1]))) for a, b in slices(offs)]
            return [pa.array(np.concatenate(out), pa.float64())]

        return work

    return map_text(docs, "score double", make, text_col, keep)


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality_fm": op10_quality_fm}
ORACLES: dict = {}
