"""The streaming operators run to the end of what the given tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources.bindings import EVENTS_SQL, table, usage_events
from ..sources.scratch import scratch_path
from ..streaming import usage


def event_folder(spark: SparkSession, sf_dir: str) -> str:
    """The events as JSON files, as an editor would leave them."""
    folder = scratch_path(spark, "event-files")
    usage_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")).write.json(folder)
    return folder


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage totals kept by a stream over the event files."""
    target = scratch_path(spark, "stream-totals")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    totals = usage.running_totals(usage.events(spark, event_folder(spark, sf_dir)))
    query = totals.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(target)
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return last.select("kind", "uses", F.round("latency_sum", 3).alias("latency_sum"), "latency_count")


def stream_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's last 64 events, kept by a stream."""
    target = scratch_path(spark, "stream-last")
    query = usage.last_events(usage.events(spark, event_folder(spark, sf_dir)), target, scratch_path(spark, "stream-state"), 64)
    query.awaitTermination()
    rows = spark.read.parquet(target)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select("kind", "id")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files in a versioned store, orders of three days as a feed of changes that a stream applies."""
    folder = scratch_path(spark, "change-files")
    kind = F.when(F.col("o_orderstatus") == "O", "create").when(F.col("o_orderstatus") == "F", "update").otherwise("delete")
    changes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), kind.alias("type"), F.col("o_custkey").cast("string").alias("path"), F.lit(None).cast("string").alias("new_path"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderpriority").alias("text"))
    changes.write.json(folder)
    index = store.IndexStore(spark, scratch_path(spark, "stream-store"))
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("hash"), F.col("c_mktsegment").alias("text"))
    index.publish({"files": stored})
    usage.apply_change_feed(spark, folder, index, scratch_path(spark, "stream-state")).awaitTermination()
    return index.read("files").select("path", "hash", "text")


#: Microseconds of the events that make one of the streams below, so that a user's events come about a second apart.
SCALE = 30_000
END = "~end"


def request_folder(spark: SparkSession, sf_dir: str) -> str:
    """Events as requests, a day in about three seconds, in files that aren't in order of time; a last one ends the stream."""
    folder = scratch_path(spark, "request-files")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.timestamp_millis(F.floor(micros / SCALE / 1000)).alias("at"), (F.col("event_id") % 7 * 500).alias("took"), F.col("event_type").alias("path"))
    own.repartition(4, F.col("id") % 4).write.json(folder)
    end = own.agg(F.lit(END).alias("key"), F.lit(-1).alias("id"), (F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(0).alias("took"), F.lit(END).alias("path"))
    end.coalesce(1).write.mode("append").json(folder)
    return folder


def run_out(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What a stream in append mode gives until its input ends."""
    target = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target).where(F.col("key") != END)


def stream_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a throttle of 1,500 ms and two in flight for each user lets pass, and why it stops others."""
    requests = spark.readStream.schema("key string, id long, at timestamp, took long").json(request_folder(spark, sf_dir))
    return run_out(usage.admitted(requests), spark, "stream-admitted")


def stream_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of each user, gathered until more than 400 ms pass without one."""
    changes = spark.readStream.schema("key string, path string, at timestamp").json(request_folder(spark, sf_dir))
    got = run_out(usage.coalesced(changes), spark, "stream-coalesced")
    return got.select("key", F.unix_millis("began").alias("began"), F.array_join("paths", ",").alias("paths"))


QUERIES = {f.__name__: f for f in (stream_totals, stream_last_events, stream_changes, stream_admitted, stream_coalesced)}

_REQUESTS = f"SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, CAST(floor(epoch_us(ts) / {SCALE} / 1000) AS BIGINT) AS moment, event_id % 7 * 500 AS took, event_type AS path FROM events"

ORACLES = {
    "stream_admitted": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, id) AS n FROM ({_REQUESTS})),
w AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS verdict, CAST(NULL AS BIGINT) AS last, CAST([] AS BIGINT[]) AS running FROM (SELECT DISTINCT key FROM r)
  UNION ALL
  SELECT key, n, id, verdict, CASE verdict WHEN 'start' THEN moment ELSE last END, CASE verdict WHEN 'start' THEN list_append(busy, moment + took) ELSE busy END
  FROM (SELECT *, CASE WHEN len(busy) >= {usage.IN_FLIGHT} THEN 'busy' WHEN moment - last < {usage.GAP_MS} THEN 'too-soon' ELSE 'start' END AS verdict
        FROM (SELECT r.key, r.n, r.id, r.moment, r.took, w.last, list_filter(w.running, lambda e: e > r.moment) AS busy FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)))
SELECT key, id, verdict FROM w WHERE n > 0""",
    "stream_coalesced": f"""WITH g AS (SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY key ORDER BY moment, id) <= 400 THEN 0 ELSE 1 END AS fresh FROM ({_REQUESTS})),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY moment, id) AS session FROM g)
SELECT key, min(moment) AS began, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM s GROUP BY key, session""",
    "stream_totals": f"SELECT kind, sum(greatest(coalesce(n, 1), 1))::BIGINT AS uses, round(coalesce(sum(latency), 0), 3) AS latency_sum, count(latency) AS latency_count FROM ({EVENTS_SQL}) GROUP BY kind",
    "stream_last_events": f"SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY happened DESC, id DESC) AS n FROM ({EVENTS_SQL})) WHERE n <= 64",
    "stream_changes": """WITH l AS (SELECT o_custkey AS c, arg_max(CASE o_orderstatus WHEN 'O' THEN 'create' WHEN 'F' THEN 'update' ELSE 'delete' END, o_orderkey) AS type, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS text FROM orders GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS path, CAST(k AS VARCHAR) AS hash, text FROM l WHERE type <> 'delete' UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c FROM l)""",
}
