"""Property-graph queries over edges (id, from_path, to_path, kind, specifier, from_symbol, to_symbol, confidence, method)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CONFIDENCE, confidence_rank, edge_priority
from .ranges import bin_of, binned

IMPORT_KINDS = ("import", "require", "fileDependency", "export")


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where((F.col("to_symbol") == symbol) & (F.col("kind") == "call"))


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where((F.col("from_symbol") == symbol) & (F.col("kind") == "call"))


def neighbours(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, direction, edge columns) of edges whose end is a symbol of ``symbols`` (id): two equi joins, no OR."""
    into = edges.join(symbols.select(F.col("id").alias("symbol")), F.col("to_symbol") == F.col("symbol")).withColumn("direction", F.lit("in"))
    out = edges.join(symbols.select(F.col("id").alias("symbol")), F.col("from_symbol") == F.col("symbol")).withColumn("direction", F.lit("out"))
    return into.unionByName(out)


def related_tests(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Test-coverage edges to a symbol, or to its file where they name no symbol."""
    tests = edges.where("kind = 'likelyTestCoverage'")
    s = symbols.select(F.col("id").alias("symbol"), F.col("path").alias("symbol_path"))
    direct = tests.join(s, F.col("to_symbol") == F.col("symbol"))
    by_file = tests.where("to_symbol IS NULL").join(s, F.col("to_path") == F.col("symbol_path"))
    return direct.unionByName(by_file).dropDuplicates(["symbol", "id"])


def incident(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(node, edge columns): edges at the paths of ``nodes`` (node), each once a node."""
    out = edges.join(nodes, F.col("from_path") == F.col("node"))
    into = edges.join(nodes, F.col("to_path") == F.col("node"))
    both = out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into)
    return both.dropDuplicates(["node", "id"])


def degrees(edges: DataFrame, kinds: tuple[str, ...] = ("import", "require", "export")) -> DataFrame:
    """(node, degree): ends of edges of these kinds at each path."""
    own = edges.where(F.col("kind").isin(*kinds))
    return own.select(F.explode(F.array("from_path", "to_path")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def import_distance(edges: DataFrame, seeds: DataFrame, depth: int = 2, kinds: tuple[str, ...] = IMPORT_KINDS) -> DataFrame:
    """(node, distance): breadth-first distance from the seeds (node), edges taken both ways.

    One join a level against distinct frontier nodes; the smallest level of each node is
    its distance, so no set of visited nodes is carried along.
    """
    own = edges.where(F.col("kind").isin(*kinds) & F.col("to_path").isNotNull())
    step = own.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).unionByName(own.select(F.col("to_path").alias("a"), F.col("from_path").alias("b"))).distinct()
    level = seeds.select("node").distinct()
    reached = level.withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        reached = reached.unionByName(level.withColumn("distance", F.lit(d)))
    return reached.groupBy("node").agg(F.min("distance").alias("distance"))


def symbol_walk(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "outgoing", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, symbol, depth): symbols that a walk from each seed (symbol) reaches, each once at its smallest depth.

    A level is one join of distinct (seed, symbol) pairs with the steps; pairs that an earlier level had go on no more.
    """
    own = edges.where("from_symbol IS NOT NULL AND to_symbol IS NOT NULL")
    own = own if kinds is None else own.where(F.col("kind").isin(*kinds))
    out, into = own.select(F.col("from_symbol").alias("a"), F.col("to_symbol").alias("b")), own.select(F.col("to_symbol").alias("a"), F.col("from_symbol").alias("b"))
    step = (out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into)).distinct()
    level = seeds.select(F.col("symbol").alias("seed"), "symbol").distinct()
    reached = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(step, F.col("symbol") == F.col("a")).select("seed", F.col("b").alias("symbol")).distinct().join(reached.select("seed", "symbol"), ["seed", "symbol"], "left_anti")
        reached = reached.unionByName(level.withColumn("depth", F.lit(d)))
    return reached


def meets_confidence(edges: DataFrame, least: str = "heuristic", kinds: tuple[str, ...] | None = None) -> DataFrame:
    kept = edges.where(confidence_rank(F.col("confidence")) >= CONFIDENCE[least])
    return kept if kinds is None else kept.where(F.col("kind").isin(*kinds))


def capped_fan_out(edges: DataFrame, most: int = 12, node_col: str = "from_path") -> DataFrame:
    """At most ``most`` edges a node, by priority, then id."""
    w = Window.partitionBy(node_col).orderBy(F.desc("priority"), "id")
    ranked = edges.withColumn("priority", edge_priority(F.col("kind"), F.col("specifier"), F.col("confidence"), F.col("method")))
    return ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def invalidated(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(path): files one edge away from changed ones (path), without these."""
    ends = edges.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).unionByName(edges.select(F.col("to_path").alias("a"), F.col("from_path").alias("b")))
    near = ends.join(changed.select(F.col("path").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("path")).where("path IS NOT NULL").distinct()
    return near.join(changed.select("path"), "path", "left_anti")


def tightest_symbol(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, symbol): the smallest symbol range that holds each position."""
    p, s = positions.withColumn("bin", bin_of(F.col("line"))).alias("p"), binned(symbols).alias("s")
    inside = p.join(s, (F.col("p.path") == F.col("s.path")) & (F.col("p.bin") == F.col("s.bin")) & (F.col("p.line") >= F.col("s.start_line")) & (F.col("p.line") <= F.col("s.end_line")))
    return inside.groupBy("p.path", "p.line").agg(F.min_by("s.id", F.struct(F.col("s.end_line") - F.col("s.start_line"), "s.id")).alias("symbol"))


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int = 3, fan_out: int = 12) -> DataFrame:
    """(seed, nodes, kinds, specifiers, confidences, methods) of all simple directed paths up to ``depth`` hops, fan-out capped by priority."""
    own = capped_fan_out(edges.where("to_path IS NOT NULL"), fan_out).select(
        F.col("from_path").alias("a"), F.col("to_path").alias("b"), "kind", "specifier", "confidence", "method"
    )
    grown = seeds.select(F.col("node").alias("seed"), F.array("node").alias("nodes"), *[F.array().cast("array<string>").alias(c) for c in ("kinds", "specifiers", "confidences", "methods")])
    found = None
    for _ in range(depth):
        grown = grown.join(own, F.element_at("nodes", -1) == F.col("a")).where(~F.array_contains("nodes", F.col("b"))).select(
            "seed",
            F.concat("nodes", F.array("b")).alias("nodes"),
            F.concat("kinds", F.array("kind")).alias("kinds"),
            F.concat("specifiers", F.array("specifier")).alias("specifiers"),
            F.concat("confidences", F.array("confidence")).alias("confidences"),
            F.concat("methods", F.array("method")).alias("methods"),
        )
        found = grown if found is None else found.unionByName(grown)
    return found
