"""Diagnostics that may leave a machine: payloads without what people wrote, a check of what is written, and traces of a query's stages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import metrics, paths

# Keys that go at any depth, and what must not stand in what is written.
PRIVATE = ("originalQuery", "query", "task", "prompt", "excerpt", "text", "markdown", "workspaceRoot", "workspaceFingerprint", "fingerprint", "missingPath", "path", "selectedFiles")
UNSAFE = {
    "long-text": r'"text"\s*:\s*"[^"]{80,}',
    "excerpt": r'"excerpt"\s*:\s*"',
    "secret-like-key": r"\bsk-[a-zA-Z0-9]{20,}\b",
}
SEEDS, PATHS_A_SEED, MOST_PATHS, SHOWN_SOURCES = 3, 4, 12, 40


def without_private(value):
    """A JSON value without private keys, in objects and lists at any depth."""
    if isinstance(value, dict):
        return {k: without_private(v) for k, v in value.items() if k not in PRIVATE}
    return [without_private(v) for v in value] if isinstance(value, list) else value


def scrub(payload: str | None) -> str | None:
    """A JSON object without private keys; None for what isn't one (or is nested too deep to read)."""
    try:
        value = json.loads(payload or "")
        return json.dumps(without_private(value), ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def scrubbed(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Rows with a column of JSON objects scrubbed in place; one pass in Arrow batches, no shuffle."""
    schema = StructType([f if f.name != column else StructField(column, StringType()) for f in rows.schema])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            columns = batch.columns
            columns[at] = pa.array([scrub(x) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def unsafe(serialised: Column) -> Column:
    """Array of reasons why a serialised payload must not be written."""
    return F.filter(F.array(*[F.when(serialised.rlike(p), F.lit(name)) for name, p in UNSAFE.items()]), lambda x: x.isNotNull())


def asserted_safe(serialised: Column) -> Column:
    """The payload; a payload that is unsafe fails the job that would write it."""
    found = unsafe(serialised)
    return F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("unsafe diagnostics: "), F.array_join(found, ", ")))).otherwise(serialised)


class Trace:
    """Counts and times of a query's stages. A stage's rows are counted as they pass (no job of its own); its time is that of the action that ran it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.observed, self.timed = spark, {}, []

    def watch(self, name: str, df: DataFrame, **more: Column) -> DataFrame:
        """df, observed: its rows are counted under this stage when an action runs it."""
        self.observed[name] = Observation(name)
        return df.observe(self.observed[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()])

    def run(self, name: str, action: Callable):
        """What an action gives, with its time noted under this name."""
        begun = time.monotonic()
        try:
            return action()
        finally:
            self.timed.append((name, int((time.monotonic() - begun) * 1000)))

    def stages(self) -> DataFrame:
        """(stage, rows, metrics, ms): observed stages with their counts, actions with their time. Only after an action has run what was watched."""
        counts = [(name, o.get.get("rows", 0), json.dumps({k: v for k, v in o.get.items() if k != "rows"}, default=str), None) for name, o in self.observed.items()]
        return self.spark.createDataFrame(counts + [(n, None, "{}", ms) for n, ms in self.timed], "stage string, rows long, metrics string, ms long")


def source_freshness(selected: DataFrame, files: DataFrame, now: Column, days: int = 7, most: int = SHOWN_SOURCES) -> DataFrame:
    """(path, freshness) of the first selected paths (path, rank), by the time of their files (path, mtime): a report's limit."""
    shown = selected.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").limit(most)
    return shown.join(files.select("path", "mtime"), "path", "left").select("path", metrics.freshness(F.col("mtime"), now, days).alias("freshness"))


def path_summaries(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, nodes, score): the best relationship paths from the first seeds (node, rank), a report's limits on each."""
    first = seeds.orderBy("rank", "node").limit(SEEDS).select("node")
    found = paths.relationship_paths(edges, first, paths.Budget(depth=2, paths=PATHS_A_SEED, nodes=24))
    return found.where(F.size("nodes") > 1).select(F.array_join("nodes", " > ").alias("label"), "nodes", "score").orderBy(F.desc("score"), "label").limit(MOST_PATHS)
