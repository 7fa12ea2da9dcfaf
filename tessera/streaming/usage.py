"""Usage events and file changes as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import metrics, store
from ..sources.markers import file_system

EVENT = "id long, kind string, at timestamp, n long, latency double, path_hash string"
CHANGE = "seq long, type string, path string, new_path string, hash string, text string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of usage events as they arrive."""
    return spark.readStream.schema(EVENT).json(folder)


def running_totals(stream: DataFrame) -> DataFrame:
    """Usage totals by kind: the batch expression on a stream, for update or complete mode."""
    return metrics.usage_totals(stream)


def windowed_totals(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Uses by kind and hour with a watermark (an extension: the counters themselves have no windows)."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("uses"), F.sum("latency").alias("latency_sum"))


def last_events(stream: DataFrame, path: str, checkpoint: str, most: int = 64) -> StreamingQuery:
    """Keeps each kind's last events in a Parquet table: the new ones and the kept ones are cut together, batch by batch.

    A batch reads what the one before left, so that it can be run again; older folders go.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, target = batch.sparkSession, f"{path}/batch={batch_id}"
        old = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}") if batch_id else batch.limit(0)
        metrics.last_by_kind(old.unionByName(batch).dropDuplicates(["id"]), most).drop("nth").write.mode("overwrite").parquet(target)
        if batch_id > 1:
            fs, gone = file_system(spark, f"{path}/batch={batch_id - 2}")
            fs.delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_change_feed(spark: SparkSession, folder: str, index: store.IndexStore, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, feed: str = "changes", **options) -> StreamingQuery:
    """Applies file changes (JSON) to the store's files table, one published version a micro batch; ``after`` sees each batch (to reconcile dependents).

    Only buckets that hold changed paths are read and written. A version's notes say which batch
    came last; a batch that is run again after a failure isn't applied twice, but ``after`` is
    called again, since it may not have ended.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if index.marker()["notes"].get(feed, -1) < batch_id:
                paths = batch.select("path").unionByName(batch.where("new_path IS NOT NULL").select(F.col("new_path").alias("path")))
                buckets = index.touched(paths)
                files = store.apply_changes(index.read("files", buckets=buckets), batch)
                index.publish({"files": files}, {"files": buckets}, {feed: batch_id})
            if after:
                after(batch, batch_id)
        finally:
            batch.unpersist()

    return spark.readStream.schema(CHANGE).options(**options).json(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(stream: DataFrame, every: str = "2 seconds") -> DataFrame:
    """At most one event a key (path_hash) and span of time."""
    return stream.withWatermark("at", every).groupBy(F.window("at", every), "path_hash").agg(F.max_by(F.struct("id", "kind", "n", "latency"), "at").alias("last")).select("window", "path_hash", "last.*")


def coalesced(stream: DataFrame, silence: str = "400 milliseconds", late: str = "0 seconds") -> DataFrame:
    """(key, began, paths): the set of paths (key, path, at) to look at again, once nothing has come for a key in ``silence``; append mode."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", silence).alias("w"), "key").agg(F.sort_array(F.collect_set("path")).alias("paths")).select("key", F.col("w.start").alias("began"), "paths")


GAP_MS, IN_FLIGHT = 1_500, 2
VERDICT = "key string, id long, verdict string"


def judged(last: int | None, running: list[int], at: int, took: int, gap: int, most: int) -> tuple[str, int | None, list[int]]:
    """A request's verdict (start, busy, too-soon), and the key's last start and ends of what runs then."""
    running = [end for end in running if end > at]
    if len(running) >= most:
        return "busy", last, running
    if last is not None and at - last < gap:
        return "too-soon", last, running
    return "start", at, [*running, at + took]


def admitted(stream: DataFrame, gap: int = GAP_MS, most: int = IN_FLIGHT, late: str = "0 seconds") -> DataFrame:
    """(key, id, verdict) of requests (key, id, at, took in ms): a key starts one at most every ``gap`` ms, and has ``most`` in flight; append mode.

    A key's state holds its last start, the ends of what runs, and requests that the watermark
    hasn't passed; a timer wakes it when it has. So requests are judged in order of time (then id),
    however they come.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": None, "running": [], "waiting": []}
        for frame in frames:
            moments = frame["at"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            held["waiting"] += map(list, zip(moments, frame["id"].astype("int64").tolist(), frame["took"].astype("int64").tolist(), strict=True))
        now = state.getCurrentWatermarkMs()
        held["waiting"].sort()
        due = [x for x in held["waiting"] if x[0] <= now]
        held["waiting"] = held["waiting"][len(due) :]
        out = []
        for at, i, took in due:
            verdict, held["last"], held["running"] = judged(held["last"], held["running"], at, took, gap, most)
            out.append((key[0], i, verdict))
        state.update((json.dumps(held),))
        if held["waiting"]:
            state.setTimeoutTimestamp(max(held["waiting"][0][0], now + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "verdict"])

    timed = stream.withWatermark("at", late).groupBy("key")
    return timed.applyInPandasWithState(run, VERDICT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
