"""Order-dependent selection: overlap removal and budgets."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranges import binned, first_shared_bin

# Caps of one retrieval.
BUDGETS = {"file": 12, "symbol": 20, "chunk": 24}
MAX_CHARS, MAX_TOKENS = 24_000, 6_000


def overlap_pairs(hits: DataFrame) -> DataFrame:
    """(path, a, b): hits of one path whose line ranges meet, a before b by id."""
    a, b = binned(hits).alias("a"), binned(hits).alias("b")
    meets = (F.col("a.path") == F.col("b.path")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bin") == first_shared_bin(F.col("a.start_line"), F.col("b.start_line"))) & (F.col("a.id") < F.col("b.id")) & (F.col("a.start_line") <= F.col("b.end_line")) & (F.col("b.start_line") <= F.col("a.end_line"))
    return a.join(b, meets).select("a.path", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


SEATS = "id string, path string, start_line int, end_line int, score double, seat_score double, seat_line int, seat_id string"


def settle(rows: list[tuple]) -> list[tuple]:
    """One path's hits (id, path, start_line, end_line, score) in rank order: a hit takes the seat of the first kept one it meets if it scores clearly more, or as much on fewer lines."""
    seats: list[tuple] = []
    for row in rows:
        _, _, start, end, score = row
        met = next((i for i, (k, _) in enumerate(seats) if k[2] <= end and start <= k[3]), None)
        if met is None:
            seats.append((row, row))
            continue
        held, first = seats[met]
        gap = score - held[4]
        if gap > 5 or abs(gap) <= 5 and end - start < held[3] - held[2]:
            seats[met] = (row, first)
    return [(*k, f[4], f[2], f[0]) for k, f in seats]


def _settle_sorted(batches):
    """Rows sorted by path and rank, many paths a batch; a path may go on in the next batch."""
    names = [f.split()[0] for f in SEATS.split(", ")]
    group: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False, name=None):
            if group and row[1] != group[0][1]:
                out += settle(group)
                group = []
            group.append(row)
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(settle(group), columns=names)


def drop_overlaps(hits: DataFrame) -> DataFrame:
    """Hits (id, path, start_line, end_line, score) without overlaps, with their seat's rank: ranges only meet within a path, so paths are dealt out and settled one after another in sorted batches."""
    own = hits.select("id", "path", F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.col("score").cast("double"))
    return own.repartition("path").sortWithinPartitions("path", F.desc("score"), "start_line", "id").mapInPandas(_settle_sorted, SEATS)


def literal(value, kind) -> Column:
    """A value collected from a column of type kind, as a column of that type."""
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def plain(value):
    """A row as a tuple that equals another where the columns do (NaN too)."""
    return tuple(map(plain, value)) if isinstance(value, tuple) else "NaN" if value != value else value


def within_budget(ranked: DataFrame, k: int = 20, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, budgets: dict[str, int] | None = None, order: tuple[str, ...] = ("rank",), pool: int = 1000) -> DataFrame:
    """The first hits that fit: (id, type, rank, chars). A hit that doesn't fit is passed over, later smaller ones may fit.

    All hits are walked, in passes of a top-k of ``pool`` rows each: of the rows behind
    the last one looked at, those that still fit. The first row of a pass always fits,
    so there are at most k passes and an empty one. Passes run when this is called.
    """
    caps = budgets or BUDGETS
    names = list(dict.fromkeys([*order, "id", "type", "chars"]))
    rows = ranked.select(F.struct(*names).alias("hit"))
    kind = rows.schema["hit"].dataType
    kept, chars, taken = [], 0, dict.fromkeys(caps, 0)
    last, seen = None, 0  # the last row looked at, and how many rows like it

    def fits(hit) -> bool:
        size = chars + hit["chars"]
        return size <= max_chars and math.ceil(size / 4) <= max_tokens

    while len(kept) < k:
        size = F.col("hit.chars") + F.lit(chars).cast("long")
        left = rows.where((size <= max_chars) & (F.ceil(size / 4) <= max_tokens))
        full = [t for t, most in caps.items() if taken[t] >= most]
        if full:
            left = left.where(~F.col("hit.type").isin(full))
        if last is not None:
            left = left.where(F.col("hit") >= literal(last, kind))
        block = [r["hit"] for r in left.orderBy("hit").limit(pool + seen).collect()]
        skip = 0
        while skip < min(seen, len(block)) and plain(block[skip]) == plain(last):
            skip += 1
        block = block[skip:]
        if not block:
            break
        for hit in block:
            last, seen = hit, seen + 1 if last is not None and plain(hit) == plain(last) else 1
            if len(kept) < k and fits(hit) and all(hit["type"] != t or taken[t] < most for t, most in caps.items()):
                kept.append(hit)
                chars += hit["chars"]
                if hit["type"] in taken:
                    taken[hit["type"]] += 1
    return ranked.sparkSession.createDataFrame(kept, kind)
