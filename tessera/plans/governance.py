"""Queries on rules, policy and instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy, rules
from ..operators.rules import Rule
from ..sources.bindings import FILES_SQL, LINKS_SQL, PROJECT_SQL, TARGETS_SQL, files, page_links, page_targets, project_paths, table

RULES = (
    Rule("text.shouting", "style", "warning", "Shouted line", (r"[A-Z]{4,}!!",)),
    Rule("text.table", "layout", "info", "Table row", (r" \| [a-z]+ \| ",), languages=("en", "fr")),
    Rule("secret.token", "security", "critical", "Token in text", (r"token = \"[0-9a-f]{16}", r"AKIA[A-Z0-9]{8}"), negative=(r"revoked",)),
    Rule("personal.mail", "privacy", "error", "Mail address", (r"[a-z0-9.]+@[a-z0-9]+\.[a-z]{2,}",), path_excludes=("src7/",)),
    Rule("noise.signs", "quality", "warning", "Trailing signs", (r"[a-z](%%%|&&&|\$\$\$|###)",), path_includes=("src1", "src2", "src3")),
    Rule("stack.react", "framework", "info", "Component", (r"useState",), signals=("react",)),
)


def active_rules() -> list[Rule]:
    return rules.for_profile(rules.assembled(list(RULES)), {"typescript"})


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(files(spark, sf_dir), active_rules(), None).select("rule_id", "severity", "path", "line", F.length("evidence").alias("chars"))


def rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.roll_up(rules.scan(files(spark, sf_dir), active_rules(), None))


def rule_cap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(files(spark, sf_dir), active_rules(), 50).select("rule_id", "path", "line")


def _findings_sql() -> str:
    parts = []
    for r in active_rules():
        quoted = [p.replace("'", "''") for p in r.patterns]
        line = " OR ".join(f"regexp_matches(x, '{p}')" for p in quoted)
        tests = ["true", *(f"NOT regexp_matches(text, '(?m){p}')" for p in r.negative), *(f"NOT contains(path, '{p}')" for p in r.path_excludes)]
        if "*" not in r.languages:
            tests.append(f"language IN {r.languages}")
        if r.path_includes:
            tests.append("(" + " OR ".join(f"contains(path, '{p}')" for p in r.path_includes) + ")")
        parts.append(f"SELECT '{r.id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, path, CAST(i AS INTEGER) AS line, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS e FROM (SELECT path, l[i] AS x, i FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM ({FILES_SQL}) WHERE {' AND '.join(tests)}))) WHERE {line}")
    return " UNION ALL ".join(parts)


def privacy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = policy.rules_frame(spark, [*policy.DEFAULT_RULES, ("src/**", "local_only", "workspace", ["fr"]), ("*.pem", "never_send_to_model", "global"), ("vendor/src1/**", "never_index", "gitignore"), ("config/*/*.json", "normal", "workspace")])
    overrides = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.concat(F.lit("legacy/"), "source", F.lit("/"), "doc_id", F.lit(".php")).alias("path"), F.lit("normal").alias("classification"))
    return policy.privacy_decisions(project_paths(spark, sf_dir), own, overrides)


def privacy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.for_model(project_paths(spark, sf_dir), policy.privacy_decisions(project_paths(spark, sf_dir), policy.rules_frame(spark, policy.DEFAULT_RULES)))
    return kept.groupBy("language").agg(F.count("*").alias("files"))


IGNORES = (("", 1, "*.pem", False), ("", 2, "generated/", False), ("src", 1, "*.md", False), ("src", 2, "src1/*.md", True), ("config", 1, "src1*/", False), ("config/src1", 1, "*.json", True))


def nested_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spark.createDataFrame([(d, n, policy.ignore_regex(p), neg) for d, n, p, neg in IGNORES], "dir string, rule_no int, pattern_regex string, negated boolean")
    return policy.ignored(project_paths(spark, sf_dir), layers).where("ignored").select("path", "layer")


# path, type, scope, binding, status, globs, user configured
DOCS = (
    ("ROOT.md", "instruction", "", "binding", None, None, False),
    ("fr/RULES.md", "instruction", "fr", "binding", None, None, False),
    ("en/RULES.md", "instruction", "en", "binding", None, None, False),
    ("numbers.mdc", "instruction", "", "binding", None, policy.glob_regex("{fr,de}/1*"), False),
    ("README.md", "documentation", "", "contextual", None, None, False),
    ("team.md", "documentation", "es", "binding", None, None, True),
    ("memory/old.md", "generated_memory", "", "generated", "stale", None, False),
    ("memory/new.md", "generated_memory", "", "generated", "approved", None, False),
)


def scope_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(DOCS, "doc_path string, doc_type string, scope string, binding string, status string, globs string, user_configured boolean")
    return policy.applicable(page_targets(spark, sf_dir).select("target").distinct(), docs).select("target", "doc_path", "precedence")


def governing_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([d for d in DOCS if not d[6]], "doc_path string, doc_type string, scope string, binding string, status string, globs string, user_configured boolean")
    return policy.governing(page_targets(spark, sf_dir).select("target").distinct(), docs)


def instruction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("target"), (F.col("n_chars") % 5 * 100).cast("int").alias("precedence"), F.col("source").alias("file"), F.replace(F.replace("text", F.lit(" inea "), F.lit(" must ")), F.lit(" edes "), F.lit(" never ")).alias("text"))
    return policy.instruction_conflicts(own)


def forbidden_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("no-en", "^page/1", "/en"), ("no-the", "^page/", "The"), ("no-http", "^page/", "http")], "rule_id string, path_regex string, forbidden string")
    return rules.forbidden_imports(page_links(spark, sf_dir), own).select("rule_id", "path", "line")


def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("no-the", "^page/", "The"), ("no-ing", "^page/2", "ing")], "rule_id string, path_regex string, forbidden string")
    hits = rules.forbidden_imports(page_links(spark, sf_dir), own).select("rule_id", "path", F.when(F.col("line") < 5, "high").otherwise("low").alias("confidence"))
    ignores = spark.createDataFrame([("no-the", "page/1")], "rule_id string, path string")
    return rules.conflict_groups(rules.without_ignored(hits, ignores)).select("rule_id", "n_files", "confidence", F.sha2(F.array_join("files", ","), 256).alias("files"))


def required_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five sources as code, those of another five as its tests."""
    paths = table(spark, sf_dir, "documents").select(F.when(F.col("source").isin("src1", "src2", "src3"), F.concat(F.lit("app/tests/"), F.col("n_chars"), F.lit(".test.ts"))).otherwise(F.concat(F.lit("app/code/"), F.col("n_chars"), F.lit(".ts"))).alias("path")).distinct()
    own = spark.createDataFrame([("tested", "^app/code/")], "rule_id string, path_regex string")
    return rules.required_tests(paths, own)


QUERIES = {f.__name__: f for f in (rule_findings, rule_rollup, rule_cap50, privacy_decision, privacy_evidence, nested_ignores, scope_precedence, governing_instruction, instruction_conflicts, forbidden_imports, conflict_groups, required_tests)}

_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
_PRIVACY_RULES = ", ".join(f"('{p}', '{c}', 'default', NULL, '{policy.ignore_regex(p)}')" for p, c in policy.DEFAULT_RULES)
_MORE = ", ".join(f"('{p}', '{c}', '{s}', {lang}, '{policy.ignore_regex(p)}')" for p, c, s, lang in (("src/**", "local_only", "workspace", "'fr'"), ("*.pem", "never_send_to_model", "global", "NULL"), ("vendor/src1/**", "never_index", "gitignore", "NULL"), ("config/*/*.json", "normal", "workspace", "NULL")))
_STRENGTH = "CASE classification WHEN 'never_index' THEN 5 WHEN 'never_send_to_model' THEN 4 WHEN 'metadata_only' THEN 3 WHEN 'local_only' THEN 2 ELSE 1 END"
_SOURCE = "CASE source WHEN 'global' THEN 1 WHEN 'workspace' THEN 2 WHEN 'gitignore' THEN 4 ELSE 6 END"
_APPLICABLE = f"""t AS (SELECT DISTINCT target, CASE WHEN contains(target, '/') THEN regexp_replace(target, '/[^/]*$', '') ELSE '' END AS folder FROM ({TARGETS_SQL})),
a AS (SELECT target, 'ROOT.md' AS doc_path, 700 AS precedence FROM t
UNION ALL SELECT target, s || '/RULES.md', CASE WHEN folder = s THEN 901 WHEN starts_with(target, s || '/') THEN 801 ELSE 700 END FROM t, (VALUES ('fr'), ('en')) v(s) WHERE target = s OR starts_with(target, s || '/')
UNION ALL SELECT target, 'numbers.mdc', 600 FROM t WHERE regexp_matches(target, '^(fr|de)/1[^/]*$')
UNION ALL SELECT target, 'README.md', 400 FROM t UNION ALL SELECT target, 'memory/new.md', 250 FROM t)"""
_IGNORE_ROWS = ", ".join(f"('{d}', {n}, '{policy.ignore_regex(p)}', {neg})" for d, n, p, neg in IGNORES)

ORACLES = {
    "rule_findings": f"SELECT rule_id, severity, path, line, CAST(least(length(e), 240) AS INTEGER) AS chars FROM ({_findings_sql()})",
    "rule_rollup": f"SELECT category, count(*) AS findings, count(DISTINCT path) AS files, arg_max(severity, {_RANK}) AS worst FROM ({_findings_sql()}) GROUP BY category",
    "rule_cap50": f"SELECT rule_id, path, line FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path, line) AS n FROM ({_findings_sql()})) WHERE n <= 50",
    "privacy_decision": f"""WITH p AS ({PROJECT_SQL}), r(pattern, classification, source, lang, regex) AS (VALUES {_PRIVACY_RULES}, {_MORE}),
m AS (SELECT path, classification, source, pattern, row_number() OVER (PARTITION BY path ORDER BY {_STRENGTH} DESC, {_SOURCE}, pattern DESC) AS n FROM p JOIN r ON regexp_matches(path, regex) AND (r.lang IS NULL OR r.lang = p.language)),
o AS (SELECT 'legacy/' || source || '/' || doc_id || '.php' AS path FROM documents WHERE lang = 'es'),
d AS (SELECT p.path, CASE WHEN o.path IS NOT NULL THEN 'normal' ELSE coalesce(classification, 'normal') END AS classification, CASE WHEN o.path IS NOT NULL THEN 'override' ELSE coalesce(source, 'default') END AS rule_source, CASE WHEN o.path IS NULL THEN pattern END AS pattern
  FROM (SELECT DISTINCT path FROM p) p LEFT JOIN m ON m.path = p.path AND n = 1 LEFT JOIN o ON o.path = p.path)
SELECT *, classification <> 'never_index' AS allows_retrieval, classification = 'normal' AS allows_model, classification IN ('normal', 'local_only', 'never_send_to_model') AS allows_content FROM d""",
    "privacy_evidence": f"WITH p AS ({PROJECT_SQL}), r(pattern, classification, source, lang, regex) AS (VALUES {_PRIVACY_RULES}) SELECT language, count(*) AS files FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE regexp_matches(path, regex) AND classification <> 'normal') GROUP BY language",
    "nested_ignores": f"""WITH p AS ({PROJECT_SQL}), r(dir, n, regex, negated) AS (VALUES {_IGNORE_ROWS}),
h AS (SELECT path, dir, negated, row_number() OVER (PARTITION BY path, dir ORDER BY n DESC) AS k FROM p JOIN r ON (dir = '' OR starts_with(path, dir || '/')) AND regexp_matches(CASE WHEN dir = '' THEN path ELSE substr(path, length(dir) + 2) END, regex))
SELECT path, arg_min(dir, length(dir)) AS layer FROM h WHERE k = 1 AND NOT negated GROUP BY path""",
    "scope_precedence": f"WITH {_APPLICABLE} SELECT target, doc_path, CAST(precedence AS INTEGER) AS precedence FROM a UNION ALL SELECT target, 'team.md', 1000 FROM t",
    "governing_instruction": f"WITH {_APPLICABLE} SELECT target, doc_path, CAST(precedence AS INTEGER) AS precedence FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY precedence DESC, doc_path DESC) AS n FROM a) WHERE n = 1",
    "instruction_conflicts": r"""SELECT lang AS target, CAST(n_chars % 5 * 100 AS INTEGER) AS precedence, count(DISTINCT source) AS files, bool_or(regexp_matches(t, '\b(must|always|shall)\b')) AND bool_or(regexp_matches(t, '\b(must not|never|do not|don''t)\b')) AS opposed
FROM (SELECT *, lower(replace(replace(text, ' inea ', ' must '), ' edes ', ' never ')) AS t FROM documents) GROUP BY ALL HAVING count(DISTINCT source) >= 2""",
    "forbidden_imports": f"WITH l AS ({LINKS_SQL}), r(rule_id, regex, f) AS (VALUES ('no-en', '^page/1', '/en'), ('no-the', '^page/', 'The'), ('no-http', '^page/', 'http')) SELECT DISTINCT rule_id, path, line FROM l JOIN r ON regexp_matches(path, regex) AND contains(specifier, f) WHERE confidence <> 'low'",
    "conflict_groups": f"""WITH l AS ({LINKS_SQL}), r(rule_id, regex, f) AS (VALUES ('no-the', '^page/', 'The'), ('no-ing', '^page/2', 'ing')),
h AS (SELECT rule_id, path, line < 5 AS high FROM l JOIN r ON regexp_matches(path, regex) AND contains(specifier, f) WHERE confidence <> 'low' AND NOT (rule_id = 'no-the' AND path = 'page/1'))
SELECT rule_id, count(DISTINCT path) AS n_files, CASE WHEN bool_and(high) THEN 'high' WHEN bool_or(high) THEN 'medium' ELSE 'low' END AS confidence, sha256(string_agg(DISTINCT path, ',' ORDER BY path)) AS files FROM h GROUP BY rule_id""",
    "required_tests": "SELECT DISTINCT 'tested' AS rule_id, 'app/code/' || n_chars || '.ts' AS path FROM documents d WHERE source NOT IN ('src1', 'src2', 'src3') AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.n_chars = d.n_chars AND t.source IN ('src1', 'src2', 'src3'))",
}
