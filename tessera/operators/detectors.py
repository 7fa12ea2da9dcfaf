"""Documented rules against code: eight detectors, run together over all files of their scopes.

Scopes become literal expressions, so a file's rules are told in the pass that reads its
path. What a detector looks for (an operand: a module, a folder, a call, a variable) is a row,
and rows of one rule and file meet imports by path, an equi join. Texts are searched where they
lie, in one pass a detector; only hits leave.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .policy import glob_regex
from .rules import match_rows, unmarked

# What an import is in a text, what a test's path is, endings that a tested file's name loses, how lines of comment begin.
IMPORT = r"""(?:import\s+(?:[\s\S]*?\s+from\s+)?|require\s*\(\s*|from\s+)['"]([^'"]+)['"]"""
TEST_PATH = r"\.(test|spec)\."
CODE_ENDING = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs)$"
COMMENT = r"^\s*//|^\s*\*|^\s*#"
# How edges are resolved that count whatever their confidence.
SURE = ("compiler", "ast", "typescript-checker", "typescript-ast", "path-alias", "import-graph")
READS = ("process.env.{}", "getenv('{}')", 'getenv("{}")', "ENV['{}']", 'ENV["{}"]')
#: Characters of a name that a substring join compares as a key before it compares the whole.
KEY = 8


@dataclass(frozen=True)
class ConflictRule:
    """A rule of one detector. ``operands`` are what it forbids or asks for: modules, folders, providers, variables, names, a pattern, or globs of tests."""

    id: str
    detector: str
    applies_to: tuple[str, ...]
    operands: tuple[str, ...]
    calls: tuple[str, ...] = ()  # text that direct_database_access forbids beside imports
    must_match: bool = True  # of naming_rules


def rule_from(rule_id: str, detector: str, applies_to: list[str], fields: dict[str, list[str]]) -> ConflictRule:
    """A rule of a mapped instruction (see ``instructions.rule_of``) or a rule file's entry."""
    of = {"direct_database_access": "forbiddenImports", "forbidden_imports": "forbiddenImports", "required_abstraction": "requiredAbstractions", "prohibited_directory_deps": "prohibitedDirectories", "naming_rules": "namingPattern", "required_test_location": "requiredTestGlobs", "network_provider_access": "networkProviderPatterns", "environment_variable_access": "environmentVariablePatterns"}
    return ConflictRule(rule_id, detector, tuple(applies_to), tuple(fields.get(of[detector], ())), tuple(fields.get("databaseAccessPatterns", ())), fields.get("namingMustMatch", ["true"]) != ["false"])


def any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))


def scoped(rows: DataFrame, rules: list[ConflictRule]) -> DataFrame:
    """Rows with ``n``, the number of a rule whose scope holds their path; a row for each."""
    inside = F.array(*[F.when(any_glob(F.col("path"), r.applies_to), F.lit(i)) for i, r in enumerate(rules)])
    return rows.withColumn("n", F.explode(F.filter(inside, lambda x: x.isNotNull())))


def by_detector(rules: list[ConflictRule], *names: str) -> list[ConflictRule]:
    return [r for r in rules if r.detector in names]


def slashed(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def imports_of(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, specifier, line, sure): a file's trusted import edges; where it has none, the imports that its text shows."""
    own = edges.where(F.col("kind").isin("import", "require")).where(F.col("method").isNull() | F.col("method").isin(*SURE) | F.col("confidence").isin("high", "medium"))
    stored = own.select(F.col("from_path").alias("path"), "specifier", F.coalesce("start_line", F.lit(1)).cast("int").alias("line"), F.lit(True).alias("sure"))
    bare = files.join(stored.select("path").distinct(), "path", "left_anti").where(F.col("text").rlike("import|require|from"))
    shown = bare.select("path", F.explode(match_rows(unmarked(F.col("text")), IMPORT, None)).alias("x"))
    shown = shown.select("path", F.regexp_extract("x", IMPORT, 1).alias("specifier"), F.substring_index("x", " ", 1).cast("int").alias("line"), F.lit(False).alias("sure"))
    return stored.unionByName(shown)


HIT = ("rule_id", "detector", "path", "line", "detail", "confidence")


def hits(rows: DataFrame, rules: list[ConflictRule], line: Column, detail: Column, confidence: Column) -> DataFrame:
    """Rows (path, n) as hits of the rules that n numbers."""
    names = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.detector).alias("detector")) for r in rules])
    return rows.select(F.get(names, F.col("n")).alias("r"), "path", line.cast("int").alias("line"), detail.alias("detail"), confidence.alias("confidence")).select("r.*", "path", "line", "detail", "confidence")


def operands(spark: SparkSession, rules: list[ConflictRule], of) -> DataFrame:
    """(n, operand): a row for each thing that a rule looks for; as many as people write, so small."""
    return F.broadcast(spark.createDataFrame([(i, x) for i, r in enumerate(rules) for x in of(r)], "n int, operand string"))


def ticked(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def import_hits(files: DataFrame, imports: DataFrame, edges: DataFrame, rules: list[ConflictRule]) -> list[DataFrame]:
    """Imports of forbidden modules, databases and providers, and imports and edges into prohibited folders."""
    own = by_detector(rules, "forbidden_imports", "direct_database_access", "network_provider_access", "prohibited_directory_deps")
    if not own:
        return []
    folders = [i for i, r in enumerate(own) if r.detector == "prohibited_directory_deps"]
    wanted = operands(files.sparkSession, own, lambda r: [x.replace("\\", "/").removesuffix("/") if r.detector == "prohibited_directory_deps" else x.replace("\\", "/") for x in r.operands])
    named = scoped(files.select("path"), own).join(wanted, "n")
    used = named.join(imports, "path").where(slashed(F.col("specifier")).contains(F.col("operand")))
    is_folder = F.col("n").isin(folders)
    detail = (
        F.when(is_folder, ticked("Depends on prohibited directory `", F.col("operand"), "` via `", slashed(F.col("specifier")), "`"))
        .when(F.col("n").isin([i for i, r in enumerate(own) if r.detector == "direct_database_access"]), ticked("Direct database import `", F.col("specifier"), "`"))
        .when(F.col("n").isin([i for i, r in enumerate(own) if r.detector == "network_provider_access"]), ticked("Network provider import `", F.col("specifier"), "`"))
        .otherwise(ticked("Imports `", F.col("specifier"), "` (forbidden: `", F.col("operand"), "`)"))
    )
    out = [hits(used, own, F.col("line"), detail, F.when(is_folder | F.col("sure"), "high").otherwise("medium"))]
    if folders:
        into = edges.where(F.col("kind").isin("import", "require")).select(F.col("from_path").alias("path"), slashed(F.col("to_path")).alias("to"), F.coalesce("start_line", F.lit(1)).alias("line"))
        into = named.where(is_folder).join(into, "path").where(F.col("to").contains(F.col("operand")))
        out.append(hits(into, own, F.col("line"), ticked("File dependency into prohibited directory `", F.col("to"), "`"), F.lit("high")))
    return out


def text_hits(files: DataFrame, rules: list[ConflictRule]) -> list[DataFrame]:
    """Database calls and reads of variables outside comments, and files without a required name."""
    out = []
    text = F.col("text")
    own = by_detector(rules, "direct_database_access")
    if any(r.calls for r in own):
        called = scoped(files, own).join(operands(files.sparkSession, own, lambda r: r.calls), "n").where(text.contains(F.col("operand")))
        lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.contains(F.col("operand")) & ~x.rlike(COMMENT), i + 1))
        called = called.select("path", "n", "operand", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))
        out.append(hits(called, own, F.col("line"), ticked("Direct database usage `", F.col("operand"), "`"), F.lit("high")))
    own = by_detector(rules, "environment_variable_access")
    if own:
        reads = operands(files.sparkSession, own, lambda r: [form.format(x) for x in r.operands for form in READS])
        read = scoped(files, own).join(reads, "n").withColumn("at", F.expr("locate(operand, text)")).where("at > 0")
        before, behind = F.expr("substr(text, 1, at - 1)"), F.expr("substr(text, at)")
        read = read.where(~F.concat(F.substring_index(before, "\n", -1), F.substring_index(behind, "\n", 1)).rlike(COMMENT))
        out.append(hits(read, own, F.size(F.split(before, "\n", -1)), ticked("Reads environment variable via `", F.col("operand"), "`"), F.lit("high")))
    own = by_detector(rules, "required_abstraction")
    if own:
        needed = F.array(*[F.array(*map(F.lit, r.operands)).cast("array<string>") for r in own])
        lacking = scoped(files, own).withColumn("needed", F.get(needed, F.col("n"))).where((F.size("needed") > 0) & ~F.exists("needed", lambda x: text.contains(x)))
        out.append(hits(lacking, own, F.lit(1), ticked("Missing required abstraction(s): ", F.array_join(F.transform("needed", lambda x: ticked("`", x, "`")), ", ")), F.lit("medium")))
    return out


def name_hits(paths: DataFrame, rules: list[ConflictRule]) -> list[DataFrame]:
    """Base names that miss a required form or have a prohibited one."""
    own = [r for r in by_detector(rules, "naming_rules") if r.operands]
    if not own:
        return []
    name = basename(F.col("path"))
    bad = reduce(lambda a, b: a | b, [(F.col("n") == i) & (name.rlike(r.operands[0]) != F.lit(r.must_match)) for i, r in enumerate(own)])
    ends = F.get(F.array(*[F.lit(f"` {'does not match required' if r.must_match else 'matches prohibited'} pattern /{r.operands[0]}/") for r in own]), F.col("n"))
    return [hits(scoped(paths, own).where(bad), own, F.lit(1), ticked("Basename `", name, ends), F.lit("high"))]


def test_hits(paths: DataFrame, rules: list[ConflictRule]) -> list[DataFrame]:
    """Files without a test: none in their folder, and none that a rule's globs hold, whose path has their name in it.

    A name that stands anywhere in a path is the beginning of one of the path's endings, so
    names and endings meet by their first KEY characters.
    """
    own = [r for r in by_detector(rules, "required_test_location") if r.operands]
    if not own:
        return []
    folder = lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))
    asked = scoped(paths.where(~F.col("path").rlike(TEST_PATH)), own).withColumn("stem", F.regexp_replace(basename(F.col("path")), CODE_ENDING, ""))
    asked = asked.withColumns({"long": F.least(F.length("stem"), F.lit(KEY)), "folder": folder(F.col("path"))})
    stems = asked.select("stem", "long").distinct().withColumn("key", F.expr("substr(stem, 1, long)"))
    tests = paths.where(F.col("path").rlike(TEST_PATH)).select(F.col("path").alias("test"))
    endings = tests.select("test", F.explode(F.sequence(F.lit(1), F.length("test"))).alias("at")).select("test", F.expr("substr(test, at)").alias("ending"))
    endings = endings.select("test", "ending", F.explode(F.sequence(F.lit(1), F.least(F.length("ending"), F.lit(KEY)))).alias("long")).withColumn("key", F.expr("substr(ending, 1, long)"))
    met = stems.join(endings, ["long", "key"]).where(F.expr("startswith(ending, stem)")).select("stem", "test").distinct()
    inside = F.array(*[F.when(any_glob(F.col("test"), r.operands), F.lit(i)) for i, r in enumerate(own)])
    by_glob = met.select("stem", F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("n")).distinct()
    by_folder = met.select("stem", folder(F.col("test")).alias("folder")).distinct()
    lone = asked.join(by_glob, ["stem", "n"], "left_anti").join(by_folder, ["stem", "folder"], "left_anti")
    wanted = F.get(F.array(*[F.lit(", ".join(r.operands)) for r in own]), F.col("n"))
    return [hits(lone, own, F.lit(1), ticked("No matching test found for required globs: ", wanted), F.lit("medium"))]


def conflicts(files: DataFrame, edges: DataFrame, rules: list[ConflictRule]) -> DataFrame:
    """(rule_id, detector, path, line, detail, confidence) of files (path, text) and edges (from_path, to_path, kind, specifier, start_line, confidence, method).

    One row for each rule, path, line and detail; of equal ones the surer stays.
    """
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    paths = files.select("path")
    found = [*import_hits(files, imports_of(files, edges), edges, rules), *text_hits(files, rules), *name_hits(paths, rules), *test_hits(paths, rules)]
    if not found:
        return files.sparkSession.createDataFrame([], "rule_id string, detector string, path string, line int, detail string, confidence string")
    # high comes before medium
    return reduce(DataFrame.unionByName, found).groupBy(*HIT[:-1]).agg(F.min("confidence").alias("confidence"))
