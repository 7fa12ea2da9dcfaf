"""Rule scans: data-driven pattern findings over files, conflict detectors, roll-ups.

Rules are rows. From each pattern the driver takes literals that every match must hold; one
expression finds all rules' literals in one pass over a text, and only patterns whose
literals are there are searched. So a scan is one pass over the files whatever the number of
rules, not a join of rules and files, and its work on a text is in proportion to the text and
its matches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import finder, required
from ..functions.text import evidence, fnv1a_32
from .ranges import listed

SEVERITY = {"info": 1, "hint": 1, "warning": 2, "error": 3, "critical": 4}


@dataclass(frozen=True)
class Rule:
    """A finding for each line that a pattern matches, unless a negative pattern matches the file.

    With ``flags`` (which may be empty) patterns are searched in the whole text, over lines,
    and each match is a finding at the line where it begins.
    """

    id: str
    category: str
    severity: str
    title: str
    patterns: tuple[str, ...]
    negative: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("*",)
    path_includes: tuple[str, ...] = ()
    path_excludes: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    version: str = "1"
    origin: str = "builtin"
    flags: str | None = None
    priority: int = field(default=0, compare=False)


def assembled(*sources: list[Rule]) -> list[Rule]:
    """Rules of all sources by id; a later source overrides an earlier one."""
    return list({r.id: r for source in sources for r in source}.values())


def for_profile(rules: list[Rule], signals: set[str]) -> list[Rule]:
    """Rules whose required signals the project shows."""
    return [r for r in rules if set(r.signals) <= signals]


def fingerprint(rules: list[Rule]) -> str:
    return fnv1a_32(",".join(sorted(f"{r.id}@{r.version}" for r in rules)))


def any_of(tests: list[Column], default: bool) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(default)


def applies(rule: Rule, path: Column, language: Column) -> Column:
    speaks = F.lit(True) if "*" in rule.languages else language.isin(*rule.languages)
    low = F.lower(path)
    inside = any_of([low.contains(p) for p in rule.path_includes], True)
    return speaks & inside & ~any_of([low.contains(p) for p in rule.path_excludes], False)


#: Noncharacters that stand around a match while its line is told.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def candidates(text: Column, patterns: list[str]) -> Column:
    """Array of the numbers of those patterns of whose literals a text holds one; patterns without literals aren't among them."""
    needs = {i: required(p) for i, p in enumerate(patterns)}
    known = frozenset().union(*[n for n in needs.values() if n])
    if not known:
        return F.array().cast("array<int>")
    told = {x: [i for i, need in needs.items() if need and any(n in x for n in need)] for x in known}  # the longest literal at a place tells of those inside it
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(finder(known)), 1))
    table = F.from_json(F.lit(json.dumps(told)), "map<string,array<int>>")
    return F.array_distinct(F.flatten(F.transform(held, lambda x: F.element_at(table, x))))


def may_match(there: Column, pattern: str, patterns: dict[str, int]) -> Column:
    return F.array_contains(there, patterns[pattern]) if required(pattern) else F.lit(True)


def silenced(rule: Rule, text: Column, there: Column, patterns: dict[str, int]) -> Column:
    how = f"(?m{rule.flags or ''})"
    return any_of([may_match(there, p, patterns) & text.rlike(how + p) for p in rule.negative], False)


def unmarked(text: Column) -> Column:
    """Text without the noncharacters that mark matches."""
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, "  ")).otherwise(text)


def match_rows(text: Column, pattern: str, most: int | None) -> Column:
    """Array of "line match", a string for each match where it begins; ``most`` keeps the first.

    Matches are marked in the text. The marked text's lines, each repeated as often as matches
    begin in it, are the matches' lines in order: one pass, however many there are.
    """
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")
    begun = lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(OPEN), F.lit(""))))
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), begun))
    pieces = F.split(marked, OPEN, -1)
    rows = F.zip_with(lines, F.slice(pieces, 2, F.size(pieces)), lambda n, piece: F.concat(n.cast("string"), F.lit(" "), F.substring_index(piece, CLOSE, 1)))
    return rows if most is None else F.slice(rows, 1, most)


def matching(pattern: str):
    return lambda row: row["text"].rlike(pattern)


def found_lines(rule: Rule, text: Column, there: Column, patterns: dict[str, int], per_pattern: int | None = None) -> Column:
    """Array of "line text", one a matching line (a match, with flags); ``per_pattern`` keeps each pattern's first."""
    none = F.array().cast("array<string>")
    if rule.flags is not None:
        found = [F.when(may_match(there, p, patterns), match_rows(text, f"(?m{rule.flags})" + p, per_pattern)).otherwise(none) for p in rule.patterns]
        return F.array_distinct(F.concat(*found))
    rows = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    if per_pattern is None:
        rows = F.filter(rows, lambda x: any_of([x["text"].rlike(p) for p in rule.patterns], False))
    else:
        first = [F.slice(F.filter(rows, matching(p)), 1, per_pattern) for p in rule.patterns]
        rows = F.array_sort(F.array_distinct(F.concat(*first)))
    return F.transform(rows, lambda x: F.concat(x["line"].cast("string"), F.lit(" "), x["text"]))


def scan(files: DataFrame, rules: list[Rule], per_rule: int | None = None, max_bytes: int | None = None, per_pattern: int | None = None) -> DataFrame:
    """(rule_id, category, severity, path, line, evidence) for files (path, language, text).

    Which rules can hit a file is told first (path, language, literals, negative patterns), then
    only matches leave the row; equal matches of a line are one finding. ``per_rule`` keeps each
    rule's first findings in path and line order (a report's limit). ``max_bytes`` leaves longer
    files out and ``per_pattern`` keeps each pattern's first lines of a file (an interactive
    scan's limits). None keeps and scans all.
    """
    if not rules:
        raise ValueError("no rules")
    numbers = {p: i for i, p in enumerate(dict.fromkeys(p for r in rules for p in (*r.patterns, *r.negative)))}
    if max_bytes is not None:
        files = files.where(F.octet_length("text") <= max_bytes)
    held = files.select("path", "language", unmarked(F.col("text")).alias("text"), candidates(F.col("text"), list(numbers)).alias("there"))
    path, language, text, there = F.col("path"), F.col("language"), F.col("text"), F.col("there")
    can = lambda r: applies(r, path, language) & any_of([may_match(there, p, numbers) for p in r.patterns], False)
    found = [F.when(can(r) & ~silenced(r, text, there, numbers), found_lines(r, text, there, numbers, per_pattern)) for r in rules]
    rows = held.select(path, F.posexplode(F.array(*found)).alias("nth", "lines")).where("lines IS NOT NULL").select(path, "nth", F.explode("lines").alias("x"))
    known = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")) for r in rules])
    rows = rows.select(F.get(known, F.col("nth")).alias("r"), path, F.substring_index("x", " ", 1).cast("int").alias("line"), evidence(F.expr("substr(x, locate(' ', x) + 1)")).alias("evidence"))
    rows = rows.select("r.*", "path", "line", "evidence")
    if per_rule is None:
        return rows
    w = Window.partitionBy("rule_id").orderBy("path", "line")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_rule).drop("nth")


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def roll_up(findings: DataFrame) -> DataFrame:
    """(category, findings, files, worst): partial sums before the shuffle; distinct files by category and path."""
    by_file = findings.groupBy("category", "path").agg(F.count("*").alias("n"), F.max_by("severity", F.struct(severity_rank(F.col("severity")), "severity")).alias("worst"))
    return by_file.groupBy("category").agg(F.sum("n").alias("findings"), F.count("*").alias("files"), F.max_by("worst", F.struct(severity_rank(F.col("worst")), "worst")).alias("worst"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), "path", "line", "rule_id")


# ------------------------------------------------------------------ documented rules against code


def forbidden_imports(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, path, line, detail): imports (path, line, specifier, confidence, method) of forbidden modules.

    rules: (rule_id, path_regex, forbidden); the theta condition is a containment, the list is short.
    """
    trusted = imports.where(F.coalesce(F.col("confidence"), F.lit("medium")).isin("certain", "high", "medium") | F.col("method").isNull())
    hit = trusted.join(listed(rules), F.expr("path rlike path_regex AND contains(specifier, forbidden)"))
    return hit.select("rule_id", "path", "line", F.concat(F.lit("import of "), "specifier").alias("detail")).distinct()


def required_tests(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, path): files in a rule's scope (rule_id, path_regex) without a test file of their stem."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", ""), r"(?i)[._-]?(test|spec)$", "")
    tests = paths.where(F.col("path").rlike(r"(?i)(\.(test|spec)\.|/__tests__/|/tests?/|Test\.php$)")).select(stem.alias("stem")).distinct()
    scoped = paths.where(~F.col("path").rlike(r"(?i)(\.(test|spec)\.|/__tests__/|/tests?/|Test\.php$)")).join(listed(rules), F.expr("path rlike path_regex"))
    return scoped.withColumn("stem", stem).join(tests, "stem", "left_anti").select("rule_id", "path")


def missing_abstraction(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, path): files in scope whose text has none of the rule's required names (array)."""
    scoped = files.join(listed(rules), F.expr("path rlike path_regex"))
    return scoped.where(~F.exists("required", lambda r: F.col("text").contains(r))).select("rule_id", "path")


def naming(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, path): base names in scope that miss (or, with must_match false, meet) the rule's pattern."""
    name = F.element_at(F.split("path", "/"), -1)
    scoped = paths.withColumn("base", name).join(listed(rules), F.expr("path rlike path_regex"))
    return scoped.where(F.expr("(base rlike naming_pattern) <> must_match")).select("rule_id", "path")


def line_pattern(files: DataFrame, rule_id: str, pattern: str, first_only: bool = False) -> DataFrame:
    """(rule_id, path, line, detail): lines outside comments that a pattern meets (database access, environment variables)."""
    rows = files.where(F.col("text").rlike(pattern)).select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    rows = rows.where(F.col("raw").rlike(pattern) & ~F.col("raw").rlike(r"^\s*(//|#|\*|/\*)"))
    rows = rows.select(F.lit(rule_id).alias("rule_id"), "path", (F.col("n") + 1).alias("line"), evidence(F.col("raw")).alias("detail"))
    if first_only:
        rows = rows.groupBy("rule_id", "path").agg(F.min_by(F.struct("line", "detail"), "line").alias("x")).select("rule_id", "path", "x.line", "x.detail")
    return rows


def without_ignored(hits: DataFrame, ignores: DataFrame) -> DataFrame:
    """Hits (rule_id, path) that no ignore (rule_id, path; a null path covers the rule) covers: two anti joins."""
    whole = ignores.where("path IS NULL").select("rule_id")
    return hits.join(whole, "rule_id", "left_anti").join(ignores.where("path IS NOT NULL").select("rule_id", "path"), ["rule_id", "path"], "left_anti")


def conflict_groups(hits: DataFrame) -> DataFrame:
    """(rule_id, files, n_files, confidence): hits (rule_id, path, confidence) by rule; high if all are, medium if some are, else low."""
    return hits.groupBy("rule_id").agg(
        F.sort_array(F.collect_set("path")).alias("files"),
        F.count_distinct("path").alias("n_files"),
        F.when(F.every(F.col("confidence") == "high"), "high").when(F.some(F.col("confidence") == "high"), "medium").otherwise("low").alias("confidence"),
    )


def conflict_report(groups: DataFrame) -> DataFrame:
    """(rule_id, section): groups (rule_id, files, n_files, confidence) as Markdown sections."""
    title = F.concat(F.lit("## "), "rule_id", F.lit("\n\n"), F.col("n_files").cast("string"), F.when(F.col("n_files") == 1, " file").otherwise(" files"), F.lit(", confidence "), "confidence", F.lit("\n\n"))
    items = F.array_join(F.transform("files", lambda f: F.concat(F.lit("- `"), f, F.lit("`"))), "\n")
    return groups.select("rule_id", F.concat(title, items, F.lit("\n")).alias("section"))


# ------------------------------------------------------------------ conflict rules as JSON

CONFLICT_RULE = "id string, description string, detector string, appliesTo array<string>, forbiddenImports array<string>, forbiddenDirectories array<string>, databaseAccessPatterns array<string>, environmentPatterns array<string>, requiredTests array<string>, requiredAbstractions array<string>, namingPattern string, enabled boolean, userConfirmed boolean"


def conflict_rules(raw: DataFrame) -> DataFrame:
    """Rules of JSON rows (value), with their detector: the one named, else the one whose field is filled. Disabled and undetectable ones go."""
    r = raw.select(F.from_json("value", CONFLICT_RULE).alias("r"))
    own = r.select("r.*").where("id IS NOT NULL AND coalesce(enabled, true)")
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    inferred = (
        F.when(filled("databaseAccessPatterns"), "direct_database_access")
        .when(filled("forbiddenDirectories"), "forbidden_directory_dependency")
        .when(filled("forbiddenImports"), "forbidden_imports")
        .when(filled("environmentPatterns"), "environment_access")
        .when(filled("requiredTests"), "required_tests")
        .when(filled("requiredAbstractions"), "required_abstraction")
        .when(F.coalesce("namingPattern", F.lit("")) != "", "naming_convention")
    )
    return own.withColumn("detector", F.coalesce("detector", inferred)).where("detector IS NOT NULL")


def activated(extracted: DataFrame) -> DataFrame:
    """Extracted rules (id, status, ambiguous, detector, applies_to) that count: confirmed or edited by a person, clear, with a detector and a scope."""
    return extracted.where(F.col("status").isin("confirmed", "edited") & ~F.col("ambiguous") & F.col("detector").isNotNull() & (F.size("applies_to") > 0))


def configured_first(configured: DataFrame, extracted: DataFrame) -> DataFrame:
    """Both rule sets, a configured rule hiding an extracted one of its id."""
    return configured.unionByName(extracted.join(configured.select("id"), "id", "left_anti"), allowMissingColumns=True)
