"""The bucketed store under races and lost writers, and streams with state across restarts."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.sources import markers
from tessera.streaming import usage

FILE = "path string, hash string, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_small_change_rewrites_its_bucket_only(spark, tmp_path):
    index = store.IndexStore(spark, str(tmp_path), buckets=8)
    files = spark.createDataFrame([(f"f{i}", "h", "t") for i in range(200)], FILE)
    edges = spark.createDataFrame([("e1", "f1")], "id string, from_path string")
    assert index.publish({"files": files, "edges": edges}) == 1
    before = index.marker()["tables"]
    change = spark.createDataFrame([("f7", "h2", "t2")], FILE)
    buckets = index.touched(change)
    assert len(buckets) == 1
    old = index.read("files", buckets=buckets)
    assert 0 < old.count() < 80
    assert index.publish({"files": store.upsert(old, change)}, {"files": buckets}, {"batch": 3}) == 2
    after = index.marker()["tables"]
    assert after["edges"] == before["edges"]  # neither read nor written
    assert {b for b in after["files"]["buckets"] if after["files"]["buckets"][b] != before["files"]["buckets"].get(b)} == {str(buckets[0])}
    assert index.read("files").count() == 200 and index.read("files").where("hash = 'h2'").count() == 1 and index.read("files", version=1).where("hash = 'h2'").count() == 0
    assert index.marker()["notes"] == {"batch": 3} and index.counts() == {"files": 200, "edges": 1}
    only = spark.createDataFrame([(f"f{i}", "h", "t") for i in range(200)], FILE).where(index.bucket_of(F.col("path")) == buckets[0])
    gone = index.publish({"files": only.limit(0)}, {"files": buckets})  # a bucket can become empty
    assert index.read("files", version=gone).count() == 200 - only.count()
    assert index.clean(keep=1) > 0 and index.versions() == [gone] and index.read("files").count() == 200 - only.count()
    index.wipe()
    assert index.counts() == {"files": 0, "edges": 0} and index.read("files").columns == ["path", "hash", "text"]


def test_of_two_publishers_one_fails(spark, tmp_path):
    index, other = store.IndexStore(spark, str(tmp_path)), store.IndexStore(spark, str(tmp_path))
    one, two = (spark.createDataFrame([("p", h, "t")], FILE) for h in "12")
    index.publish({"files": one})
    base = max(index.versions())
    index.publish({"files": one}, base=base)
    with pytest.raises(store.VersionTaken):
        other.publish({"files": two}, base=base)
    assert rows_of(other.read("files")) == [("p", "1", "t")]
    assert other.publish({"files": two}) == 3 and rows_of(index.read("files")) == [("p", "2", "t")]


def test_a_lost_publisher_is_never_read(spark, tmp_path, monkeypatch):
    index = store.IndexStore(spark, str(tmp_path))
    one, two = (spark.createDataFrame([("p", h, "t")], FILE) for h in "12")
    index.publish({"files": one})

    def lost(*_):
        raise RuntimeError

    monkeypatch.setattr(markers.os, "link", lost)
    with pytest.raises(RuntimeError):
        index.publish({"files": two})
    monkeypatch.undo()
    assert rows_of(index.read("files")) == [("p", "1", "t")] and index.publish({"files": two}) == 2
    assert rows_of(index.read("files")) == [("p", "2", "t")]


def test_markers(spark, tmp_path):
    path = f"file://{tmp_path}/deep/marker"
    assert markers.make_once(spark, path, "a\nb") and not markers.make_once(spark, path, "c")
    assert markers.read_text(spark, path) == "a\nb" and [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["marker"]


def test_change_feed_runs_again_after_a_failure(spark, tmp_path):
    index = store.IndexStore(spark, str(tmp_path / "i"), buckets=4)
    index.publish({"files": spark.createDataFrame([(f"f{i}", "h", "t") for i in range(20)], FILE)})
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps(c) for c in [{"seq": 1, "type": "delete", "path": "f1"}, {"seq": 2, "type": "rename", "path": "f2", "new_path": "g2", "hash": "h", "text": "t"}]))
    seen = []

    def after(batch, n):
        seen.append((n, batch.count()))
        if len(seen) == 1:
            raise RuntimeError("lost while dependents are reconciled")

    def run():
        return usage.apply_change_feed(spark, str(feed), index, str(tmp_path / "cp"), after)

    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    paths = {f"f{i}" for i in range(20)} - {"f1", "f2"} | {"g2"}
    assert {r.path for r in index.read("files").collect()} == paths  # published before the failure
    (feed / "2.json").write_text(json.dumps({"seq": 3, "type": "create", "path": "n", "hash": "h", "text": "t"}))
    run().awaitTermination()
    assert seen == [(0, 2), (0, 2), (1, 1)] and index.versions() == [1, 2, 3]  # the first batch isn't applied twice, but its dependents are told again
    assert {r.path for r in index.read("files").collect()} == paths | {"n"}


START = dt.datetime(2024, 1, 1)


def write_requests(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        for key, i, at, took in rows:
            f.write(json.dumps({"key": key, "id": i, "at": (START + dt.timedelta(milliseconds=at)).isoformat(timespec="milliseconds"), "took": took, "path": f"p{i % 3}"}) + "\n")


def made_requests():
    rng = random.Random(12)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 100, 399, 400, 401, 700, 1500, 3000])
        rows.append((rng.choice("ab"), i, at, rng.choice([0, 200, 1500, 5000])))
    return rows, at


def throttled_by_hand(rows, gap=1500, most=2):
    out, last, running = set(), {}, {}
    for key, i, at, took in sorted(rows, key=lambda r: (r[2], r[1])):
        running[key] = [e for e in running.get(key, []) if e > at]
        verdict = "busy" if len(running[key]) >= most else "too-soon" if key in last and at - last[key] < gap else "start"
        if verdict == "start":
            last[key] = at
            running[key].append(at + took)
        out.add((key, i, verdict))
    return out


def run_stream(spark, tmp_path, shape):
    stream = shape(spark.readStream.schema("key string, id long, at timestamp, took long, path string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("restarts", [0, 2])
def test_throttle_across_restarts(spark, tmp_path, restarts):
    """State and timers live in the checkpoint: a stream that stops and starts again judges like one that ran through."""
    rows, at = made_requests()
    rng = random.Random(1)
    shape = lambda stream: usage.admitted(stream, late="1 second")  # noqa: E731  else what comes at the watermark's own moment is late
    for part in range(3):
        own = rows[part * 134 : (part + 1) * 134]
        rng.shuffle(own)  # within a file in no order
        write_requests(tmp_path / "in", f"{part}", own)
        if restarts:
            run_stream(spark, tmp_path, shape)
    write_requests(tmp_path / "in", "end", [("~", -1, at + 86_400_000, 0)])
    got = run_stream(spark, tmp_path, shape)
    assert {tuple(r) for r in got.where("key <> '~'").collect()} == throttled_by_hand(rows) and got.where("key <> '~'").count() == len(rows)
    verdicts = {v for _, _, v in throttled_by_hand(rows)}
    assert verdicts == {"start", "busy", "too-soon"}


def test_coalescing_across_restarts(spark, tmp_path):
    rows, at = made_requests()
    expected = []
    for key in "ab":
        own = sorted((a, f"p{i % 3}") for k, i, a, _ in rows if k == key)
        groups = [[own[0]]]
        for x in own[1:]:
            if x[0] - groups[-1][-1][0] <= 400:
                groups[-1].append(x)
            else:
                groups.append([x])
        expected += [(key, g[0][0], sorted({p for _, p in g})) for g in groups]
    write_requests(tmp_path / "in", "0", rows[:200])
    run_stream(spark, tmp_path, usage.coalesced)
    write_requests(tmp_path / "in", "1", rows[200:])
    write_requests(tmp_path / "in", "2", [("~", -1, at + 86_400_000, 0)])
    got = run_stream(spark, tmp_path, usage.coalesced).where("key <> '~'")
    assert sorted((r.key, round((r.began - START).total_seconds() * 1000), r.paths) for r in got.collect()) == sorted(expected)
