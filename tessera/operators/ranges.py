"""Joins of line ranges and of short lists: binned equi joins, and broadcasts whose size is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of one bin.
BIN = 64
#: Rows of a list that people write (rules, instruction files, ignore patterns) up to which it is broadcast.
LISTED = 20_000


def bin_of(line: Column) -> Column:
    return F.floor(line / BIN)


def binned(df: DataFrame, start: str = "start_line", end: str = "end_line", name: str = "bin") -> DataFrame:
    """A row for each bin of lines that a range touches, so that ranges which meet share a bin and a path with many ranges isn't one key."""
    return df.withColumn(name, F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.greatest(start, end)))))


def first_shared_bin(*starts: Column) -> Column:
    """The first bin that ranges which meet have in common: the last one to start tells; a pair is kept there only."""
    return bin_of(F.greatest(*starts))


def listed(df: DataFrame, most: int = LISTED) -> DataFrame:
    """A list, marked for a broadcast if it has no more than ``most`` rows; else Spark chooses how to join it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
