"""Multi-signal ranking of an index: candidates from symbols, paths, text and graph, merged, ranked, freed of overlaps and cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.scores import SIGNALS
from ..sources.scratch import materialised
from . import graph, lexical, policy, select

KEYS = ("id", "result_type", "path", "symbol_id", "start_line", "end_line", "chars", "deterministic")


def candidate(df: DataFrame, signals: dict[str, Column], **values: Column) -> DataFrame:
    """Rows of one branch in the common shape."""
    empty = {"symbol_id": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(1), "chars": F.lit(200), "deterministic": F.lit(False)}
    named = {**empty, **values}
    return df.select(*[named[k].cast({"start_line": "int", "end_line": "int", "chars": "long"}.get(k, "boolean" if k == "deterministic" else "string")).alias(k) for k in KEYS], *[signals.get(s, F.lit(None)).cast("double").alias(s) for s in SIGNALS])


def merged(candidates: DataFrame) -> DataFrame:
    """One row a candidate id: the largest of each signal, the widest range, the fewest characters."""
    return candidates.groupBy("id").agg(
        F.first("result_type").alias("result_type"), F.first("path").alias("path"), F.first("symbol_id", ignorenulls=True).alias("symbol_id"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("chars").alias("chars"), F.bool_or("deterministic").alias("deterministic"),
        *[F.max(s).alias(s) for s in SIGNALS],
    )


def candidates(chunks: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, selected: tuple[str, ...] = (), depth: int = 2, lexical_pool: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """All branches' rows: symbols, import and export names, paths, text, import distance, calls, tests and coverage, documents.

    chunks: id, path, text, start_line, end_line, kind, weight; files: path, size, mtime;
    symbols: id, name, path, start_line, end_line; edges as in graph; documents as in
    policy.applicable, with a title if there is one. All chunks that hold a word of the query
    are candidates, so that what paths, choices and penalties add can lift any of them;
    ``lexical_pool`` keeps the best by text alone (an editor's limit). What a chunk's text adds is
    computed where the text lies, in the one pass that splits it into terms; only numbers are joined.
    """
    bounds = files.agg(F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
    dated = files.crossJoin(F.broadcast(bounds))  # one row
    fresh = scores.recency(F.col("mtime"), F.col("oldest"), F.col("newest"))
    path_value = scores.path_score(query, F.col("path"))
    chosen = F.when(F.col("path").isin(*selected), F.lit(120)) if selected else F.lit(None)
    penalty = scores.generated_penalty(F.col("path"), F.col("size"))

    exact, alias = scores.symbol_scores(query, F.col("name"))
    named = symbols.withColumns({"exact": exact, "alias": alias}).where("exact > 0 OR alias > 0")
    by_symbol = candidate(
        named.join(dated, "path", "left"), {"exact_symbol": F.col("exact"), "symbol_alias": F.col("alias"), "path_relevance": path_value, "recency": fresh, "user_selected": chosen, "generated_penalty": penalty},
        id=F.concat(F.lit("sym:"), "id"), result_type=F.lit("symbol"), path=F.col("path"), symbol_id=F.col("id"), start_line=F.col("start_line"), end_line=F.col("end_line"), chars=F.greatest(F.lit(80), (F.col("end_line") - F.col("start_line") + 1) * 40), deterministic=F.col("exact") > 0,
    )
    wanted = dated.withColumn("score", path_value).where((F.col("score") > 0) | F.coalesce(chosen, F.lit(0)).cast("int").__gt__(0))
    by_path = candidate(
        wanted, {"path_relevance": F.col("score"), "recency": fresh, "user_selected": chosen, "generated_penalty": penalty},
        id=F.concat(F.lit("file:"), "path"), result_type=F.lit("file"), path=F.col("path"), chars=F.least(F.coalesce("size", F.lit(400)), F.lit(2000)),
    )
    of_text = lambda own: {"overlap": scores.overlap_of(query, own), "repeats": scores.repetition_penalty(F.col("text")), "chars": F.least(F.length("text"), F.lit(1500))}
    hits = lexical.boosted(lexical.bm25(chunks, query, keep=("path", "kind", "weight", "start_line", "end_line"), of_hits=of_text))
    hits = hits if lexical_pool is None else lexical.top_k(hits, lexical_pool)
    text = hits.join(files.select("path", "size"), "path", "left")
    lex = F.least(F.lit(45.0), F.col("score") * 3 + F.col("overlap"))
    heavy = scores.generated_penalty(F.col("path"), F.col("size")) + F.col("repeats")
    text = text.withColumns({"lex": lex, "heavy": heavy}).where("NOT (heavy >= 50 AND lex < 25)")
    by_text = candidate(
        text, {"lexical": F.col("lex"), "path_relevance": path_value, "user_selected": chosen, "generated_penalty": F.col("heavy")},
        id=F.concat(F.lit("chunk:"), "id"), result_type=F.lit("chunk"), path=F.col("path"), start_line=F.col("start_line"), end_line=F.col("end_line"), chars=F.col("chars"),
    )
    seeds = named.select(F.col("path").alias("node")).unionByName(wanted.where(F.col("score") >= 20).select(F.col("path").alias("node")))
    if selected:
        seeds = seeds.unionByName(files.where(F.col("path").isin(*selected)).select(F.col("path").alias("node")))
    seeds = seeds.distinct()
    near = graph.import_distance(edges, seeds, depth).where("distance > 0").join(graph.degrees(edges), "node", "left").withColumnRenamed("node", "path")
    by_import = candidate(
        near, {"import_distance": scores.import_distance_score(F.col("distance"), F.coalesce("degree", F.lit(0))), "path_relevance": path_value, "generated_penalty": scores.generated_penalty(F.col("path"))},
        id=F.concat(F.lit("dep:"), "path"), result_type=F.lit("dependency"), path=F.col("path"), deterministic=F.lit(True),
    )
    around = graph.neighbours(edges, named.where("exact > 0 OR alias >= 35").select("id"))
    calls = graph.capped_fan_out(around.where("kind = 'call'"), 12, "symbol").withColumn("other", F.when(F.col("direction") == "in", F.col("from_path")).otherwise(F.col("to_path")))
    by_call = candidate(
        calls, {"call_graph": F.when(F.col("direction") == "in", F.lit(30)).otherwise(F.lit(24)), "path_relevance": scores.path_score(query, F.col("other"))},
        id=F.concat(F.lit("call:"), "other"), result_type=F.lit("dependency"), path=F.col("other"), deterministic=scores.deterministic(F.col("confidence"), F.col("method")),
    )
    tests = graph.related_tests(edges, named.select("id", "path"))
    by_test = candidate(
        tests, {"test_relation": F.lit(28), "path_relevance": scores.path_score(query, F.col("from_path"))},
        id=F.concat(F.lit("test:"), "from_path"), result_type=F.lit("test"), path=F.col("from_path"), deterministic=scores.deterministic(F.col("confidence"), F.col("method")),
    )
    by_method = F.coalesce(F.col("method").isin(*scores.DETERMINISTIC_METHODS), F.lit(False))
    by_alias = candidate(
        edges.where(F.col("kind").isin("import", "export") & (F.col("specifier") != "")).withColumn("alias", scores.symbol_scores(query, F.col("specifier"))[1]).where("alias >= 20"),
        {"symbol_alias": F.col("alias"), "path_relevance": scores.path_score(query, F.col("from_path"))},
        id=F.concat(F.lit("alias:"), "id"), result_type=F.lit("dependency"), path=F.col("from_path"), chars=F.lit(120), deterministic=by_method,
    )
    covers = edges.where("kind = 'likelyTestCoverage'").withColumn("score", F.greatest(scores.path_score(query, F.col("to_path")), scores.path_score(query, F.col("from_path"))))
    covers = covers.join(seeds.select("node", F.lit(True).alias("seed")), F.col("to_path") == F.col("node"), "left").where((F.col("score") >= 15) | F.col("seed"))
    guessed = F.coalesce(F.col("confidence") == "heuristic", F.lit(False))
    by_coverage = candidate(
        covers, {"test_relation": F.when(guessed, F.lit(18)).otherwise(F.lit(38)), "path_relevance": F.col("score")},
        id=F.concat(F.lit("testcov:"), "id"), result_type=F.lit("test"), path=F.col("from_path"), chars=F.lit(400), deterministic=~guessed & by_method,
    )
    out = by_symbol
    for branch in (by_alias, by_path, by_text, by_import, by_call, by_test, by_coverage):
        out = out.unionByName(branch)
    if documents is None:
        return out
    return out.unionByName(document_candidates(documents, seeds, wanted.select(F.col("path").alias("node"), "score"), query))


def document_candidates(documents: DataFrame, seeds: DataFrame, scored: DataFrame, query: str) -> DataFrame:
    """Instruction and architecture documents that apply to a seed (node), or without any seed to the three best paths."""
    best = scored.where("score > 0").orderBy(F.desc("score"), "node").limit(3).select("node").join(seeds.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")
    fits = policy.applicable(seeds.unionByName(best).select(F.col("node").alias("target")), documents).select("doc_path").distinct()
    title = F.coalesce("title", F.lit("")) if "title" in documents.columns else F.lit("")
    own = fits.join(documents.withColumn("lex", scores.overlap_score(query, F.concat_ws(" ", title, "doc_path"))), "doc_path")
    built = F.col("doc_type").isin("architecture", "decision")
    own = own.where(~(F.lower("doc_path").contains("readme") & (F.col("lex") < 12) & (scores.path_score(query, F.col("doc_path")) < 10)))
    own = own.withColumns({
        "arch": F.when(built, 28 + F.least("lex", F.lit(15))),
        "instr": F.when(F.col("doc_type").isin("instruction", "convention"), F.lit(32)).when(F.col("lex") > 10, F.lit(12)),
    }).where("arch IS NOT NULL OR instr IS NOT NULL")
    return candidate(
        own, {"instruction_scope": F.col("instr"), "architecture": F.col("arch"), "lexical": F.when(F.col("lex") > 0, F.col("lex"))},
        id=F.concat(F.lit("doc:"), "doc_path"), result_type=F.when(built, F.lit("architecture")).otherwise(F.lit("instruction")), path=F.col("doc_path"), end_line=F.lit(40), chars=F.lit(800), deterministic=F.lit(True),
    )


def ranked(found: DataFrame) -> DataFrame:
    """Merged candidates with score and confidence, those above 0."""
    scored = merged(found).withColumn("score", scores.total()).where("score > 0")
    return scored.withColumn("confidence", scores.confidence_band(F.col("score"), F.col("deterministic")))


def search(chunks: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, k: int = 20, decisions: DataFrame | None = None, **options) -> DataFrame:
    """The hits that a context of bounded size takes, best first (rank)."""
    best = materialised(ranked(candidates(chunks, files, symbols, edges, query, **options)), "candidates")  # a few numbers a candidate, read three times below
    kept = select.drop_overlaps(best.select("id", "path", "start_line", "end_line", "score"))
    rows = best.join(kept.select("id", "seat_score", "seat_line", "seat_id"), "id")
    if decisions is not None:
        rows = policy.for_model(rows, decisions)
    rows = materialised(rows.withColumn("order", F.struct((-F.col("seat_score")).alias("score"), "path", "seat_line", "seat_id")).withColumn("type", F.col("result_type")), "ranked")  # read in each pass
    chosen = select.within_budget(rows.select("order", "id", "type", "chars"), k=k, order=("order",))
    return rows.join(F.broadcast(chosen.select("id")), "id").drop("type", "order").select("id", "result_type", "path", "symbol_id", "start_line", "end_line", "score", "confidence", "deterministic", *SIGNALS)


def best_files(hits: DataFrame, k: int = 10) -> DataFrame:
    """(path, score, result_type): each file's best hit."""
    best = hits.groupBy("path").agg(F.max("score").alias("score"), F.max_by("result_type", F.struct("score", "id")).alias("result_type"))
    return best.orderBy(F.desc("score"), "path").limit(k)


def relevant_symbols(hits: DataFrame, k: int = 30) -> DataFrame:
    """A search's symbols, best first."""
    return hits.where("result_type = 'symbol' OR symbol_id IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def with_definition(hits: DataFrame, symbols: DataFrame, symbol: str) -> DataFrame:
    """Hits of a symbol's context; its definition is put in front, at 200, where the search didn't find it."""
    own = symbols.where(F.col("id") == symbol).select(F.concat(F.lit("sym:"), "id").alias("id"), F.lit("symbol").alias("result_type"), "path", F.col("id").alias("symbol_id"), "start_line", "end_line", F.lit(200.0).alias("score"), F.lit("high").alias("confidence"))
    missing = own.join(hits.select("symbol_id"), "symbol_id", "left_anti")
    return hits.unionByName(missing, allowMissingColumns=True)


def related_files(paths: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """(path, score, labels): graph paths' nodes and hits by file, the better score, all labels."""
    walked = paths.select(F.explode("nodes").alias("path"), "seed", F.col("score").cast("double").alias("score"), F.array_join("kinds", ">").alias("label")).where("path <> seed").drop("seed")
    found = hits.select("path", "score", F.col("result_type").alias("label"))
    both = walked.unionByName(found).groupBy("path").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("label")).alias("labels"))
    return both.orderBy(F.desc("score"), "path").limit(k)
