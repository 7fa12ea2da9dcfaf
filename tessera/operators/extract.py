"""Code to symbols and edges: declarations, imports, routes, class relations, test coverage.

Files (path, text) are read in Arrow batches by the token grammar of functions.code; edges
are marked by how they were found. Exact resolution needs a compiler, which this engine
leaves to its input tables. What links files (extensions, routes, namespaces, tests) is
joins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..functions.text import TEST_FILE

SYMBOLS = "path string, id string, name string, kind string, start_line int, end_line int, exported boolean, container string, role string, parameters array<string>, summary string"
EDGES = "path string, id string, kind string, specifier string, to_path string, from_symbol string, to_symbol string, line int, confidence string, method string, evidence string"
#: Characters of texts whose rows are sent on together.
FLUSH_CHARS = 1 << 20
SCRIPT = r"\.[mc]?[jt]sx?$"


def script_language(path: str) -> str:
    return "typescript" if re.search(r"\.[mc]?tsx?$", path) else "javascript"


def symbol_rows(path: str, text: str) -> list[tuple]:
    if path.endswith(".php"):
        raw, out = re.split(r"\r?\n", text), []
        for d in code.php_declarations(text):
            name = f"{d.container}::{d.name}" if d.kind in ("method", "constructor") else f"namespace:{d.name}" if d.kind == "namespace" else d.name
            part = code.role(path, d) if d.kind in code.TYPES else None
            out.append((path, f"php:{path}:{name}:{d.line}", d.name, d.kind, d.line, d.end, d.exported, d.container, part, d.parameters, code.summary(raw, d.line)))
        return out
    if re.search(SCRIPT, path):
        own = script_language(path)
        return [(path, f"{own}:{path}:{d.name}:{d.line}", d.name, d.kind, d.line, d.end, d.exported, None, None, [], None) for d in code.script_declarations(text)]
    return []


def edge_rows(path: str, text: str) -> list[tuple]:
    names = [f.split()[0] for f in EDGES.split(", ")][1:]
    if path.endswith(".php"):
        return [(path, *(e[n] for n in names)) for e in code.php_edges(path, text)]
    out = []
    if re.search(SCRIPT, path):
        for line in code.read_lines(text):
            found = None if line.is_comment else code.script_import(line)
            if found:
                kind, spec = found
                out.append((path, "edge:" + code.digest(path, kind, spec, line.number), kind, spec, code.resolved(path, spec), None, None, line.number, "heuristic", "heuristic", "script-import"))
    return out


def chunk_rows(path: str, text: str) -> list[tuple]:
    return [(path, *block) for block in code.php_blocks(text)]


def per_file(rows, fields: str):
    """A mapInPandas function that turns each file into rows."""
    names = [re.split(r"\s", f)[0] for f in fields.split(", ")]

    return lambda batches: flushed(batches, lambda path, text: rows(path, text) if path else [], names)


def flushed(batches, rows, names: list[str]):
    """Frames of the rows that ``rows`` makes of each row with a text (its second value), sent on whenever texts of FLUSH_CHARS are read, so that no task holds a batch's rows at once."""
    for batch in batches:
        out, chars = [], 0
        for row in batch.itertuples(index=False, name=None):
            if row[1]:
                out += rows(*row)
                chars += len(row[1])
            if chars > FLUSH_CHARS:
                yield pd.DataFrame(out, columns=names)
                out, chars = [], 0
        yield pd.DataFrame(out, columns=names)


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS rows of scripts and PHP files (path, text)."""
    return files.select("path", "text").mapInPandas(per_file(symbol_rows, SYMBOLS), SYMBOLS)


def edges(files: DataFrame) -> DataFrame:
    """EDGES rows of scripts and PHP files (path, text), each id once."""
    return files.select("path", "text").mapInPandas(per_file(edge_rows, EDGES), EDGES).dropDuplicates(["id"])


PHP_CHUNKS = "path string, symbol string, start_line int, end_line int, text string, weight double"


def php_chunks(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PHP_CHUNKS rows and columns ``keep``: a chunk for each type and each function, which may lie inside each other."""
    source = files.where(F.col("path").endswith(".php")).select("path", "text", *keep)
    names = [f.split()[0] for f in PHP_CHUNKS.split(", ")]
    schema = files.sparkSession.createDataFrame([], PHP_CHUNKS).schema
    for c in keep:
        schema = schema.add(source.schema[c])

    def run(batches):
        yield from flushed(batches, lambda path, text, *kept: [(*found, *kept) for found in chunk_rows(path, text)], [*names, *keep])

    return source.mapInPandas(run, schema)


def enclosing_functions(positions: DataFrame) -> DataFrame:
    """(path, line, name, start_line, end_line): the function around each position (path, line, text); null where there is none."""
    fields = "path string, line int, name string, start_line int, end_line int"

    def run(batches):
        for batch in batches:
            out = []
            for path, line, text in zip(batch["path"], batch["line"], batch["text"], strict=True):
                kind = "python" if path.endswith(".py") else "php" if path.endswith(".php") else "script"
                out.append((path, line, *(code.enclosing(text or "", int(line), kind) or (None, None, None))))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")]).astype({"start_line": "Int32", "end_line": "Int32"})

    return positions.select("path", F.col("line").cast("int").alias("line"), "text").mapInPandas(run, fields)


def with_extensions(found: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target names no file as written: the file that an extension or an index file completes it to, as resolved_path."""
    endings = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".php", "/index.ts", "/index.tsx", "/index.js"]
    known = files.select(F.col("path").alias("resolved_path"))
    tries = F.array(F.col("to_path"), *[F.concat("to_path", F.lit(e)) for e in endings])
    options = found.where("to_path IS NOT NULL").select("id", F.posexplode(tries).alias("n", "resolved_path")).join(known, "resolved_path")
    best = options.groupBy("id").agg(F.min_by("resolved_path", "n").alias("resolved_path"))
    return found.join(best, "id", "left")


def namespace_path(name: Column, mapping: dict[str, str]) -> Column:
    """The file of a class by its namespace's folder, the longest prefix first; null without one."""
    out = F.lit(None).cast("string")
    for prefix, folder in sorted(mapping.items(), key=lambda x: len(x[0])):
        tail = F.replace(F.substring(name, F.lit(len(prefix) + 1), F.length(name)), F.lit("\\"), F.lit("/"))
        out = F.when(F.startswith(name, F.lit(prefix)), F.concat(F.lit(folder.rstrip("/") + "/"), tail, F.lit(".php"))).otherwise(out)
    return out


#: Routes of one path that are joined in one share.
ROUTES_A_SHARE = 64


def route_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """(route_id, from_path, to_path): script files that name a PHP route's path in quotes.

    Quoted paths are pulled out of the scripts first, so the link is an equi join. Links of a path
    are as many as its routes times its scripts; its routes are dealt into shares, and each share
    meets all its scripts, so that no task's links grow with that product. The number of partitions
    is told, as rows that are joined are few bytes beside their links, and Spark would put them together.
    """
    routes = found.where("startswith(specifier, 'route:')").select(F.col("id").alias("route_id"), F.col("path").alias("to_path"), F.regexp_extract("specifier", r"^route:\w+ /?(.*)$", 1).alias("route"))
    shares = routes.groupBy("route").agg(F.ceil(F.count("*") / ROUTES_A_SHARE).cast("int").alias("shares"))
    dealt = routes.join(shares, "route").withColumn("share", F.pmod(F.xxhash64("route_id", "to_path"), "shares").cast("int")).drop("shares")
    quoted = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("['\"`]/?([\\w/{}.-]+)['\"`]"), 1)))
    named = files.where(F.col("path").rlike(r"\.[mc]?[jt]sx?$")).select(F.col("path").alias("from_path"), quoted.alias("route"))
    spread = named.join(shares, "route").select("from_path", "route", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "route", "share").join(spread.repartition(parts, "route", "share"), ["route", "share"]).select("route_id", "from_path", "to_path")


def test_coverage(found: DataFrame, files: DataFrame) -> DataFrame:
    """likelyTestCoverage edges (from_path, to_path, confidence): a test's imports are high, a shared stem alone is heuristic."""
    is_test = F.col("path").rlike(TEST_FILE)
    tests = files.select("path").where(is_test)
    imported = with_extensions(found.where(F.col("kind").isin("import", "require")), files).where("resolved_path IS NOT NULL").join(tests, "path", "left_semi")
    high = imported.select(F.col("path").alias("from_path"), F.col("resolved_path").alias("to_path"), F.lit("high").alias("confidence"))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", ""), r"(?i)([._-]?(test|spec))$", "")
    by_name = tests.select(F.col("path").alias("from_path"), stem.alias("stem")).join(files.where(~is_test).select(F.col("path").alias("to_path"), stem.alias("stem")), "stem")
    low = by_name.join(high, ["from_path", "to_path"], "left_anti").select("from_path", "to_path", F.lit("heuristic").alias("confidence"))
    return high.unionByName(low).distinct()


def php_test_edges(found: DataFrame, files: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(from_path, specifier, to_path, evidence): what PHP tests import, outside tests, and the class that a describe block names."""
    is_test = lambda c: c.rlike(r"(?i)(^|/)tests?/") | c.rlike(r"(?i)\b(Test|Pest)\.php$") | c.rlike(r"(?i)\btest_[^/]*$")
    tests = files.where(F.col("path").endswith(".php") & is_test(F.col("path")))
    style = F.when(F.col("text").contains("uses(") | F.col("text").contains("test("), "pest-test").otherwise("phpunit-test")
    used = found.where("evidence = 'php-use-statement'").join(tests.select("path", style.alias("evidence_")), "path")
    imports = used.select(F.col("path").alias("from_path"), "specifier", namespace_path(F.col("specifier"), mapping).alias("to_path"), F.col("evidence_").alias("evidence"))
    imports = imports.where(F.col("to_path").isNotNull() & ~F.col("to_path").rlike(r"(?i)(^|/)tests?/"))
    name = F.regexp_extract("text", r"describe\(\s*['\"]([^'\"]+)['\"]", 1)
    described = tests.select(F.col("path").alias("from_path"), name.alias("specifier")).where("specifier <> ''")
    whole = F.when(F.col("specifier").contains("\\"), F.col("specifier")).otherwise(F.concat(F.lit("App\\"), "specifier"))
    return imports.unionByName(described.select("from_path", "specifier", namespace_path(whole, mapping).alias("to_path"), F.lit("pest-describe").alias("evidence")).where("to_path IS NOT NULL"))


def php_diagnostics(files: DataFrame) -> DataFrame:
    """(path, code) of PHP files without an opening tag, or with lookups in a container at run time."""
    own = files.where(F.col("path").endswith(".php"))
    text = F.coalesce("text", F.lit(""))
    codes = F.array(F.when(~text.contains("<?php") & ~text.contains("<?="), F.lit("php-missing-open-tag")), F.when(text.rlike(r"\b(app|resolve)\((['\"])[^'\"]+\2\)"), F.lit("php-container-runtime")))
    return own.select("path", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
