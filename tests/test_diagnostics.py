"""Scrubbed payloads, safety checks, traces, and older indexes with what half-written ones leave."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import diagnostics
from tessera.sources import workspace


def test_scrub_at_any_depth(spark):
    deep: dict = {"text": 1, "keep": {"a": [{"path": "x", "b": [[{"query": 1, "c": None}], 2]}]}, "é": "ü", "Text": 2}
    assert json.loads(diagnostics.scrub(json.dumps(deep))) == {"keep": {"a": [{"b": [[{"c": None}], 2]}]}, "é": "ü", "Text": 2}
    assert [diagnostics.scrub(x) for x in (None, "", "[1]", "3", "{", "[" * 100_000)] == [None] * 6
    for key in diagnostics.PRIVATE:
        assert diagnostics.scrub(json.dumps({"a": {key: 1}, key: [2]})) == '{"a":{}}'
    rows = spark.createDataFrame([(1, '{"query":1,"n":2}', "own"), (2, None, "own")], "id int, payload string, text string")
    assert [tuple(r) for r in diagnostics.scrubbed(rows).orderBy("id").collect()] == [(1, '{"n":2}', "own"), (2, None, "own")]
    assert diagnostics.scrubbed(rows.limit(0)).count() == 0


def test_unsafe_payloads_fail_the_job(spark):
    said = {"long-text": json.dumps({"text": "x" * 80}), "excerpt": '{"excerpt" : "x"}', "secret-like-key": '{"n": "sk-' + "a1" * 10 + '"}'}
    rows = spark.createDataFrame(list(said.items()), "name string, payload string")
    assert {r.name: r.why for r in rows.select("name", diagnostics.unsafe(F.col("payload")).alias("why")).collect()} == {n: [n] for n in said}
    fine = spark.createDataFrame([(json.dumps({"text": "x" * 79, "n": "sk-short"}),), (None,)], "payload string")
    assert fine.select(diagnostics.asserted_safe(F.col("payload")).alias("p")).count() == 2
    with pytest.raises(Exception, match="unsafe diagnostics: long-text"):
        rows.where("name = 'long-text'").select(diagnostics.asserted_safe(F.col("payload")).alias("p")).collect()


def test_trace_counts_what_passes(spark):
    trace = diagnostics.Trace(spark)
    some = trace.watch("some", trace.watch("all", spark.range(100)).where("id % 3 = 0"), most=F.max("id"))
    assert trace.run("count", lambda: len(some.collect())) == 34
    with pytest.raises(RuntimeError):
        trace.run("broken", lambda: (_ for _ in ()).throw(RuntimeError()))
    rows = {r.stage: r for r in trace.stages().collect()}
    assert (rows["all"].rows, rows["some"].rows, json.loads(rows["some"].metrics)) == (100, 34, {"most": 99})
    assert rows["count"].ms >= 0 and rows["count"].rows is None and "broken" in rows


def test_summaries_beside_a_trace(spark):
    edges = spark.createDataFrame([(f"e{i}", a, b, "import", "./x", None, None, "certain", "ast") for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("d", "e"), ("x", "y")])], "id string, from_path string, to_path string, kind string, specifier string, from_symbol string, to_symbol string, confidence string, method string")
    seeds = spark.createDataFrame([("a", 1), ("d", 2), ("zz", 3), ("x", 4)], "node string, rank int")
    found = diagnostics.path_summaries(edges, seeds).collect()
    assert {r.nodes[0] for r in found} == {"a", "d"} and all(len(r.nodes) in (2, 3) and r.label == " > ".join(r.nodes) for r in found)  # the fourth seed is one too many
    files = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-20")], "path string, day string").select("path", F.to_timestamp("day").alias("mtime"))
    chosen = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("gone", 4)], "path string, rank int")
    assert {tuple(r) for r in diagnostics.source_freshness(chosen, files, F.to_timestamp(F.lit("2024-01-21"))).collect()} == {("a", "stale"), ("b", "fresh"), ("gone", "unknown")}


def index_of(version, **more):
    return json.dumps({"version": version, "files": {"a.ts": {"hash": "h", "byteLength": 3}}, "chunks": {"c1": {"path": "a.ts", "startLine": 1}}, **more})


def test_old_indexes_and_recovery(spark, tmp_path):
    symbols = {"symbols": {"s1": {"name": "f", "path": "a.ts", "exported": True}}}
    edges = {"edges": [{"id": "e1", "fromPath": "a.ts", "toPath": "b.ts", "resolutionMethod": "ast"}]}
    for version, text in {1: index_of(1), 2: index_of(2, **symbols), 3: index_of(3, **symbols, **edges), 4: index_of(4, **symbols, **edges, explanations={"x": "y"}), 5: index_of(5), 0: index_of(0), 6: '{"version": 3, "files": {}}'}.items():
        (tmp_path / f"{version}.json").write_text(text)
        tables = workspace.old_tables(workspace.old_indexes(spark, str(tmp_path / f"{version}.json")))
        counts = [tables[n].count() for n in ("files", "chunks", "symbols", "edges", "explanations")]
        assert counts == {1: [1, 1, 0, 0, 0], 2: [1, 1, 1, 0, 0], 3: [1, 1, 1, 1, 0], 4: [1, 1, 1, 1, 1]}.get(version, [0] * 5), version
    f, c, e = tables["files"].columns, tables["chunks"].columns, tables["edges"].columns
    assert (f, c[:4], e[1:3], e[-1]) == (["path", "hash", "language", "size", "privacy"], ["id", "path", "text", "start_line"], ["from_path", "to_path"], "method")
    whole, half = index_of(4, **symbols), index_of(4)[:40]
    for name, main, spare, expected in (("a", whole, None, "whole"), ("b", half, whole, "temporary"), ("c", None, whole, "temporary"), ("d", half, half, "empty"), ("e", None, None, "empty")):
        for suffix, text in (("", main), (".tmp", spare)):
            if text:
                (tmp_path / f"{name}.json{suffix}").write_text(text)
        state, tables = workspace.recovered(spark, str(tmp_path / f"{name}.json"))
        assert (name, state, tables["symbols"].count()) == (name, expected, 0 if expected == "empty" else 1)
