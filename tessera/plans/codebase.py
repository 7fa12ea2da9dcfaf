"""Queries on code: gates, names, symbols, links between files, rules against code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import stem_of
from ..operators import chunks, context, conventions, extract, graph, hybrid, policy, rules, store
from ..operators.risk_rules import BUILTIN, SCAN_LANGUAGES
from ..sources import workspace
from ..sources.bindings import EDGES_SQL, FILES_SQL, HITS_SQL, PROJECT_SQL, files, key_edges, line_hits, project_paths, table

# What lines of prose become where they stand for code: a pattern and its line.
CODE_MARKS = (
    (r"^The (\w+)", "export class $1"),
    (r"^And (\w+)", "function $1("),
    (r"^Is (\w+)", "export interface $1"),
    (r"^It (\w+)", "type $1 ="),
    (r"^Was (\w+)", "enum $1"),
    (r"^For (\w+)", "// class $1"),
    (r"^Of (\w+)", "import './$1';"),
    (r"^From (\w+)", "const x = require('$1')"),
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents as scripts; some of their lines declare or import something."""
    body = F.regexp_replace("text", r"[{}'\"`;()]", " ")
    for pattern, line in CODE_MARKS:
        body = F.regexp_replace(body, "(?m)" + pattern, line)
    return files(spark, sf_dir).select(F.regexp_replace("path", r"\.md$", ".ts").alias("path"), body.alias("text"))


def _code_sql() -> str:
    body = "regexp_replace(text, '[{}''\"`;()]', ' ', 'g')"
    for pattern, line in CODE_MARKS:
        body = f"regexp_replace({body}, '(?m){pattern}', '{line.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')"
    return f"SELECT path, l[i] AS x, CAST(i AS INTEGER) AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT replace(path, '.md', '.ts') AS path, string_split_regex({body}, '\\r?\\n') AS l FROM ({FILES_SQL})))"


def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols(code_files(spark, sf_dir)).select("id", "name", "kind", "start_line", "exported")


def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.edges(code_files(spark, sf_dir)).select("path", "id", "kind", "specifier", "to_path", "line")


# The same for the built-in risk rules.
RISK_MARKS = (
    (r"^The (\w+)", "setInterval($1, 5);"),
    (r"^And (\w+)", "console.log('token', $1);"),
    (r"^Of (\w+)", "Retry(1,\n  allowed_methods=['POST'])"),
    (r"^Is (\w+)", "try: x()\nexcept Exception:\n    pass"),
    (r"^It (\w+)", "dump($1)"),
)
RISK_ENDINGS = ("ts", "php", "py", "go")


def risky_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text): documents as files of four languages; some lines show a production risk."""
    body = F.regexp_replace("text", r"[{}'\"`;()]", " ")
    for pattern, line in RISK_MARKS:
        body = F.regexp_replace(body, "(?m)" + pattern, line)
    ending = F.element_at(F.array(*map(F.lit, RISK_ENDINGS)), (F.col("id") % 4 + 1).cast("int"))
    language = F.element_at(F.array(*[F.lit(SCAN_LANGUAGES[e]) for e in RISK_ENDINGS]), (F.col("id") % 4 + 1).cast("int"))
    return files(spark, sf_dir).select(F.concat(F.regexp_replace("path", r"md$", ""), ending).alias("path"), language.alias("language"), body.alias("text"))


def risk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the built-in rules that a project of these stacks takes."""
    own = rules.for_profile(list(BUILTIN), {"path:artisan", "react", "php:composer"})
    return rules.scan(risky_files(spark, sf_dir), own, None).select("rule_id", "severity", "path", "line")


def risk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules.for_profile(list(BUILTIN), {"path:artisan"})
    return rules.roll_up(rules.scan(risky_files(spark, sf_dir), own, None))


def _risk_sql() -> str:
    body = "regexp_replace(text, '[{}''\"`;()]', ' ', 'g')"
    for pattern, line in RISK_MARKS:
        new = line.replace("'", "''").replace("$1", chr(92) + "1").replace("\n", "' || chr(10) || '")
        body = f"regexp_replace({body}, '(?m){pattern}', '{new}', 'g')"
    lines = f"SELECT path, k, l[i] AS x, CAST(i AS INTEGER) AS line FROM (SELECT path, k, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT regexp_replace(path, 'md$', '') || {list(RISK_ENDINGS)}[id % 4 + 1] AS path, id % 4 AS k, string_split({body}, chr(10)) AS l FROM ({FILES_SQL})))"
    shown = (("ts:leak:setinterval-no-clear", "memory-leaks", "warning", "k = 0", "setInterval("), ("any:log:secret-logged", "weak-logging", "error", "true", "console.log("), ("py:retry:requests-retry-post", "retry-duplication", "warning", "k = 2", "Retry("), ("py:log:bare-except-pass", "weak-logging", "error", "k = 2", "except Exception:"), ("any:log:print-in-production", "weak-logging", "hint", "k IN (1, 2)", "dump("))
    return f"WITH x AS ({lines}) " + " UNION ALL ".join(f"SELECT '{i}' AS rule_id, '{c}' AS category, '{s}' AS severity, path, line FROM x WHERE {test} AND starts_with(x, '{begin}')" for i, c, s, test, begin in shown)


def php_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents as PHP files of one class whose lines are methods, each in one line."""
    body = F.concat(F.lit("<?php\nclass Doc"), F.col("id").cast("string"), F.lit("\n{\n"), F.regexp_replace(F.regexp_replace("text", r"[{}'\"`;()#*/\\$]", " "), r"(?m)^(\w+)", "public function $1() { return 1; } //"), F.lit("\n}\n"))
    return files(spark, sf_dir).select(F.regexp_replace("path", r"\.md$", ".php").alias("path"), body.alias("text"))


def php_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.php_chunks(php_source(spark, sf_dir)).select("path", "symbol", "start_line", "end_line", "weight")


def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project paths, some temporary, binary or too large, through the gate that says why a file isn't indexed."""
    n = F.regexp_extract("path", r"/(\d+)\.", 1).cast("long")
    ending = F.element_at(F.array(*map(F.lit, ("", ".tmp", ".png", ".exe", "", "~"))), (n % 6 + 1).cast("int"))
    own = project_paths(spark, sf_dir).select(F.concat("path", ending).alias("path"), (n * 7919 % 800_000).alias("size"), (n % 11 == 0).alias("nul"))
    reason = workspace.exclusion(F.col("path"), F.col("size"), F.col("nul"))
    return own.select("path", reason.alias("reason"), workspace.priority(F.col("path")).alias("priority"))


def path_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths say: tests, entry points, generated files, outside services."""
    folder = F.element_at(F.array(*map(F.lit, ("a/tests/", "a/__tests__/", "a/Controllers/", "a/api/", "a/b/", "dist/"))), (F.length("path") % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("x.spec.ts", "index.ts", "Stripe.php", "app.min.js", "main.php"))), (F.ascii(F.reverse(F.split_part("path", F.lit("."), F.lit(1)))) % 5 + 1).cast("int"))
    own = project_paths(spark, sf_dir).select("path", F.concat(folder, name).alias("p"))
    return own.select("path", text.test_path(F.col("p")).alias("test"), text.entry_point(F.col("p")).alias("entry"), text.generated_path(F.col("p")).alias("generated"), text.integration(F.col("p")).alias("service"))


def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tests of customers: those of even keys name the customer, the others its file only."""
    edges = key_edges(spark, sf_dir).where("kind = 'call'").withColumn("kind", F.lit("likelyTestCoverage"))
    edges = edges.withColumn("to_symbol", F.when(F.length("id") % 2 == 0, F.col("to_symbol")))
    symbols = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.concat(F.lit("customer/"), "c_custkey").alias("path"))
    return graph.related_tests(edges, symbols).groupBy("symbol").agg(F.count("*").alias("tests"), F.min("id").alias("first"))


def test_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by size; those of one source are tests that import the file of their size or only share its name."""
    own = table(spark, sf_dir, "documents").select(F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("app/tests/"), "lang", "n_chars", F.lit(".test.ts"))).otherwise(F.concat(F.lit("app/"), "lang", "n_chars", F.lit(".ts"))).alias("path"), "n_chars", "lang").distinct()
    imports = own.where("path LIKE 'app/tests/%' AND n_chars % 2 = 0").select("path", F.concat(F.lit("e:"), "path").alias("id"), F.lit("import").alias("kind"), F.concat(F.lit("app/"), "lang", "n_chars").alias("to_path"))
    return extract.test_coverage(imports, own.select("path"))


def route_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page as a PHP route of its first link, all pages as scripts that quote their links."""
    first = F.regexp_extract("html", 'href="/?([\\w/{}.-]+)"', 1)
    found = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.concat(F.lit("r"), "page_id").alias("id"), F.concat(F.lit("routes/"), "page_id", F.lit(".php")).alias("path"), F.concat(F.lit("route:GET /"), first).alias("specifier"))
    scripts = table(spark, sf_dir, "pages").select(F.concat(F.lit("ui/"), "page_id", F.lit(".ts")).alias("path"), F.col("html").alias("text"))
    return extract.route_links(found.where("specifier <> 'route:GET /'"), scripts)


def namespace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("\\", F.when(F.col("c_nationkey") % 2 == 0, F.lit("App")).otherwise(F.lit("Lib")), F.when(F.col("c_nationkey") % 3 == 0, F.lit("Models")).otherwise(F.lit("Http")), "c_mktsegment", F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.namespace_path(name, {"App\\": "app/", "App\\Models\\": "domain"}).alias("path"))


def annotate_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of their supplier, lines of small quantity as symbols."""
    lines = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 400).cast("int")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cut = lines.select(key.alias("id"), F.col("l_suppkey").cast("string").alias("path"), start.alias("start_line"), (start + 5).alias("end_line"), F.lit("config").alias("kind"))
    symbols = lines.where("l_quantity <= 3").select(key.alias("id"), F.concat(F.lit("s"), key).alias("name"), F.col("l_suppkey").cast("string").alias("path"), start.alias("start_line"), (start + 9).alias("end_line"))
    return chunks.annotate_with_symbols(cut, symbols).select("id", "symbol", "kind")


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a word outside comments; lines that begin with Of are comments here."""
    own = files(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?m)^Of ", "// Of "))
    return rules.line_pattern(own, "word", r"\b(inea|edes|of)\b").select("path", "line")


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_pattern(files(spark, sf_dir), "the", r"\bthe\b", first_only=True).select("path", "line")


def required_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("uses-the", "^src[1-4]/", ["the ", "die "]), ("uses-la", "/(fr|es)/", [" la "])], "rule_id string, path_regex string, required array<string>")
    return rules.missing_abstraction(files(spark, sf_dir), own)


def naming_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("ts-names", "^src/", r"^\d+\.ts$", True), ("no-pem", "^(src|legacy)/", r"\.pem$", False)], "rule_id string, path_regex string, naming_pattern string, must_match boolean")
    return rules.naming(project_paths(spark, sf_dir), own)


def worst_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first 100 findings, by severity, path, line and rule."""
    from .governance import active_rules

    found = rules.scan(files(spark, sf_dir), active_rules(), None)
    return rules.ordered(found).limit(100).select("rule_id", "severity", "path", "line")


def visible_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on project paths without those that an ignore file or a privacy class hides."""
    own = project_paths(spark, sf_dir)
    decisions = policy.privacy_decisions(own, policy.rules_frame(spark, policy.DEFAULT_RULES))
    ignored = own.where(F.col("path").endswith(".json")).select("path")
    return policy.for_model(policy.without_ignored(own.select("path"), ignored), decisions)


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, policy.STRENGTH)), (F.col("id") % 5 + 1).cast("int"))
    return files(spark, sf_dir).select("id", F.sha2(policy.redacted(F.col("text"), kinds), 256).alias("hash"))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, policy.STRENGTH)), (F.col("id") % 5 + 1).cast("int"))
    source = F.element_at(F.array(*map(F.lit, ("global", "workspace", "gitignore", "default"))), (F.col("id") % 4 + 1).cast("int"))
    return policy.full_capabilities(files(spark, sf_dir).select("path", kinds.alias("classification"), source.alias("rule_source"), (F.col("id") % 3 == 0).alias("language_scoped")))


def rules_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index would do with project paths: the gate's reason first, then the privacy class."""
    own = project_paths(spark, sf_dir)
    decisions = policy.privacy_decisions(own, policy.rules_frame(spark, policy.DEFAULT_RULES))
    gated = own.select("path", workspace.exclusion(F.col("path"), F.length("path").cast("long"), F.lit(False)).alias("reason"))
    return policy.preview(gated, decisions).groupBy("outcome", "reason").agg(F.count("*").alias("files"))


def setting_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as settings, orders' statuses as a person's changes of them; open ones take a setting back."""
    stored = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("value"))
    return policy.overridden(stored, own.withColumn("value", F.when(F.col("value") != "O", F.col("value"))), ["key"])


def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.conflict_candidates(project_paths(spark, sf_dir)).select("path")


def fragment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.containing(project_paths(spark, sf_dir), ["src1", "/9", "nothing"]).select("path")


def memory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as root files under names of varying case, and as notes of the memory folder."""
    name = F.element_at(F.array(*map(F.lit, ("README.md", "readme.md", "Agents.MD", "other.md", "AGILE.md"))), (F.col("id") % 5 + 1).cast("int"))
    path = F.when(F.col("id") % 3 == 0, name).when(F.col("id") % 3 == 1, F.concat(F.lit(".memory/"), "path")).otherwise(F.concat(F.lit(".memory/rag/"), "path"))
    return workspace.memory_files(files(spark, sf_dir).select(path.alias("path")).distinct())


def glob_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.glob_candidates(project_paths(spark, sf_dir).distinct(), ["src/**/*.ts", "**/src1/*.md", "config/*/1?.json"], 80)


def pattern_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern's first two lines of a file, and no more than fifty findings a rule."""
    own = [rules.Rule("two", "c", "info", "t", ("of", "die "))]
    return rules.scan(files(spark, sf_dir).where("language IN ('en', 'de')"), own, 50, per_pattern=2).select("path", "line")


def symbol_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("symbol"))
    return graph.symbol_walk(key_edges(spark, sf_dir), seeds, 2, "incoming").groupBy("seed", "depth").agg(F.count("*").alias("symbols"), F.min("symbol").alias("first"))


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hits: those of even keys are symbols."""
    even = F.col("c_custkey") % 2 == 0
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("id"), F.when(even, "symbol").otherwise("chunk").alias("result_type"), F.col("c_name").alias("path"), F.when(even, F.concat(F.lit("s"), "c_custkey")).alias("symbol_id"), (F.col("c_custkey") % 97).cast("double").alias("score"), F.when(F.col("c_nationkey") < 5, "high").when(F.col("c_nationkey") < 12, "medium").otherwise("low").alias("confidence"))


def relevant_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.relevant_symbols(ranked_hits(spark, sf_dir), 30).select("id", "score")


def definition_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of a symbol's context, and its definition, which isn't among them."""
    symbols = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.col("c_name").alias("path"), F.lit(3).alias("start_line"), F.lit(9).alias("end_line"))
    hits = hybrid.relevant_symbols(ranked_hits(spark, sf_dir), 20)
    return hybrid.with_definition(hits, symbols, "s3").select("id", "path", "score", "confidence")


def pack_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = context.pack_confidence(ranked_hits(spark, sf_dir).withColumn("bucket", F.col("score").cast("int")), "bucket")
    return got.select("bucket", F.round("confidence", 6).alias("confidence"))


def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("path", F.sha2("text", 256).alias("hash"), "id")
    cut = own.where("id % 3 > 0").select("path", F.substring("hash", 1, 8).alias("file_hash"))
    return store.with_parents(own.where("id % 2 = 0").select("path", "hash"), cut.unionByName(cut))


def php_test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PHP tests that import a class named by their first word; every fifth describes one."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    body = F.concat(F.lit("<?php\nuse App\\"), word, F.lit(";\nuse Tests\\Base;\n"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("describe('"), word, F.lit("', fn() => test('x'));\n"))).otherwise(F.lit("")))
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("tests/"), "id", F.lit("Test.php"))).otherwise(F.concat(F.lit("app/"), "id", F.lit(".php")))
    own = files(spark, sf_dir).where(word != "").select(path.alias("path"), body.alias("text"))
    return extract.php_test_edges(extract.edges(own), own, {"App\\": "app/", "Tests\\": "tests/"})


def php_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.when(F.col("id") % 2 == 0, "<?php\n").otherwise(""), F.when(F.col("id") % 3 == 0, "app('mailer');").otherwise("$x = 1;"))
    return extract.php_diagnostics(files(spark, sf_dir).select(F.regexp_replace("path", r"\.md$", ".php").alias("path"), body.alias("text")))


def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = line_hits(spark, sf_dir).withColumn("result_type", F.when(F.col("start_line") % 2 == 0, "symbol").otherwise("chunk"))
    return hybrid.best_files(hits, 10)


def hit_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with the text of the first chunk that overlaps it: windows of documents, hits at every seventh line."""
    cut = chunks.window_chunks(files(spark, sf_dir), 20, 5).withColumn("id", F.concat_ws(":", "path", "start_line"))
    hits = cut.where("start_line % 7 = 1").select(F.concat(F.lit("h"), "id").alias("id"), "path", (F.col("start_line") + 16).alias("start_line"), (F.col("start_line") + 18).alias("end_line"))
    return context.excerpts(hits, cut).select("id", F.sha2("excerpt", 256).alias("hash"))


def architecture_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("a/controllers/", "a/services/", "a/models/", "a/database/", "a/"))), (F.length("path") % 5 + 1).cast("int"))
    hits = project_paths(spark, sf_dir).select(F.concat(folder, "path").alias("path"), F.length("path").cast("double").alias("score"))
    return context.architecture(hits).groupBy("layer").agg(F.count("*").alias("files"), F.max("score").alias("best"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diffs: their first words name the files that change."""
    body = F.concat(F.lit("--- a/x\n+++ b/"), F.regexp_extract("text", r"(\w+)", 1), F.lit(".ts\n@@\n"), F.regexp_replace("text", r"(?m)^The (\w+)", "+++ b/$1.php\n+++ /dev/null\n"))
    return context.diff_paths(files(spark, sf_dir).select("id", body.alias("diff")))


def related_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands beside changed customers, a change for each nation: that (imported) and their orders (importers)."""
    edges = key_edges(spark, sf_dir)
    changed = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("customer/"), "c_custkey").alias("path"))
    known = edges.select(F.explode(F.array("from_path", "to_path")).alias("path"))
    return context.related_candidates(changed, known, edges).groupBy("reason", "priority").agg(F.count("*").alias("files"), F.min("path").alias("first"))


def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as conflict hits of their segment's rule, reported by rule."""
    hits = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("rule_id"), F.col("c_name").alias("path"), F.when(F.col("c_nationkey") < 12, "high").otherwise("low").alias("confidence"))
    return rules.conflict_report(rules.conflict_groups(hits)).select("rule_id", F.sha2("section", 256).alias("hash"), F.length("section").alias("chars"))


def related_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as related files of their order, suppliers as reasons."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("part/"), "l_partkey", F.lit("-"), "l_linenumber").alias("path"), F.when(F.col("l_suppkey") % 2 == 0, "test").otherwise("imported").alias("reason"), F.when(F.col("l_suppkey") % 2 == 0, 90).otherwise(80).alias("priority"))
    return context.related_digest(found).select("id", F.sha2("digest", 256).alias("hash"))


def project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("app/Actions/", "app/Services/", "src/domain/", "tests/a.spec.", "app/Repositories/", "x/"))), (F.length("path") % 6 + 1).cast("int"))
    signals = table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"))
    got = conventions.profile(project_paths(spark, sf_dir).select(F.concat(folder, "path").alias("path")), signals)
    return got.select("fingerprint", F.array_join("conventions", ",").alias("conventions"))


def test_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return project_paths(spark, sf_dir).groupBy(text.normal_path(F.concat(F.lit("./"), F.regexp_replace(path, "/", "\\\\"))).alias("path")).agg(F.min(stem_of(path)).alias("stem"), F.min(text.language(path)).alias("language"))


QUERIES = {
    f.__name__: f
    for f in (
        conflict_report, related_digest, project_profile, risk_findings, risk_categories, extract_symbols, extract_edges, php_chunks, index_gate, path_marks, related_tests, test_coverage, route_links, namespace_files, annotate_symbols, comment_lines, first_occurrences, required_abstraction, naming_rule,
        rules_preview, setting_overrides, conflict_candidates, fragment_listing, memory_files, glob_candidates, pattern_cap, symbol_walk, relevant_symbols, definition_context, pack_confidence, chunk_parents, php_test_edges, php_diagnostics,
        worst_findings, visible_hits, redacted_text, capabilities, best_files, hit_excerpts, architecture_layers, changed_paths, related_candidates, test_stems,
    )
}


def _case(values: tuple[str, ...], index: str) -> str:
    return f"{list(values)}[{index}]"


_IGNORE = ", ".join(f"('{p}', '{c}', '{policy.ignore_regex(p)}')" for p, c in policy.DEFAULT_RULES)
_CLASSES = list(policy.STRENGTH)
_N = "CAST(regexp_extract(path, '/(\\d+)\\.', 1) AS BIGINT)"
_TEST = "regexp_matches(p, '(?i)\\.(test|spec)\\.|/__tests__/|/tests?/')"
_RULE_SEVERITY = "CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"


def _convention_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS id, count(*) AS files, CASE WHEN count(*) >= {high} THEN 'high' WHEN count(*) >= {medium} THEN 'medium' END AS confidence FROM p WHERE regexp_matches(path, '{pattern}') HAVING count(*) >= {medium}" for i, _, pattern, high, medium in conventions.PATH_CONVENTIONS
    )


def _oracles() -> dict[str, str]:
    from .governance import _findings_sql

    lines = _code_sql()
    return {
        "conflict_report": """WITH h AS (SELECT DISTINCT c_mktsegment AS r, c_name AS p, c_nationkey < 12 AS high FROM customer),
g AS (SELECT r, count(DISTINCT p) AS n, CASE WHEN bool_and(high) THEN 'high' WHEN bool_or(high) THEN 'medium' ELSE 'low' END AS c, string_agg(DISTINCT '- `' || p || '`', chr(10) ORDER BY '- `' || p || '`') AS items FROM h GROUP BY r),
s AS (SELECT r, '## ' || r || chr(10) || chr(10) || n || CASE WHEN n = 1 THEN ' file' ELSE ' files' END || ', confidence ' || c || chr(10) || chr(10) || items || chr(10) AS section FROM g)
SELECT r AS rule_id, sha256(section) AS hash, CAST(length(section) AS INTEGER) AS chars FROM s""",
        "related_digest": "SELECT l_orderkey AS id, sha256(string_agg('- part/' || l_partkey || '-' || l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN ' (test)' ELSE ' (imported)' END, chr(10) ORDER BY l_suppkey % 2, 'part/' || l_partkey || '-' || l_linenumber)) AS hash FROM lineitem GROUP BY l_orderkey",
        "project_profile": f"""WITH p AS (SELECT ['app/Actions/', 'app/Services/', 'src/domain/', 'tests/a.spec.', 'app/Repositories/', 'x/'][length(path) % 6 + 1] || path AS path FROM ({PROJECT_SQL})), c AS ({_convention_sql()}),
r AS (SELECT *, files * CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS strength, id IN {conventions.RIVALS} AS rival FROM c),
w AS (SELECT *, max(strength) FILTER (rival) OVER () AS top, first_value(id) OVER (ORDER BY rival DESC, strength DESC, id) AS best FROM r)
SELECT (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events) AS fingerprint, string_agg(id || '@' || confidence, ',' ORDER BY id || '@' || confidence) AS conventions FROM w WHERE NOT rival OR id = best OR strength >= 0.8 * top""",
        "risk_findings": f"SELECT rule_id, severity, path, line FROM ({_risk_sql()})",
        "risk_categories": f"SELECT category, count(*) AS findings, count(DISTINCT path) AS files, arg_max(severity, {_RULE_SEVERITY}) AS worst FROM ({_risk_sql()}) GROUP BY category",
        "extract_symbols": f"""WITH x AS ({lines}), k AS (SELECT path, line, x, CASE WHEN regexp_matches(x, '^export class \\w') THEN 'class' WHEN regexp_matches(x, '^function \\w') THEN 'function' WHEN regexp_matches(x, '^export interface \\w') THEN 'interface' WHEN regexp_matches(x, '^type \\w+ =') THEN 'type' WHEN regexp_matches(x, '^enum \\w') THEN 'enum' END AS kind FROM x),
n AS (SELECT *, regexp_extract(x, '^(?:export )?(?:class|function|interface|type|enum) ([A-Za-z_]\\w*)', 1) AS name FROM k WHERE kind IS NOT NULL)
SELECT 'typescript:' || path || ':' || name || ':' || line AS id, name, kind, line AS start_line, starts_with(x, 'export') AS exported FROM n WHERE name <> ''""",
        "extract_edges": f"""WITH x AS ({lines}), e AS (SELECT path, line, CASE WHEN starts_with(x, 'import ') THEN 'import' ELSE 'require' END AS kind, coalesce(nullif(regexp_extract(x, '^import ''([^'']+)''', 1), ''), regexp_extract(x, 'require\\(''([^'']+)''\\)', 1)) AS spec FROM x WHERE regexp_matches(x, '^import ''\\.') OR regexp_matches(x, 'require\\('''))
SELECT path, 'edge:' || substr(sha256(path || '|' || kind || '|' || spec || '|' || line), 1, 24) AS id, kind, spec AS specifier, CASE WHEN starts_with(spec, './') THEN regexp_replace(path, '[^/]*$', '') || substr(spec, 3) ELSE spec END AS to_path, line FROM e WHERE spec <> ''""",
        "php_chunks": f"""WITH d AS (SELECT replace(path, '.md', '.php') AS path, id, string_split_regex(regexp_replace(text, '[{{}}''"`;()#*/\\\\$]', ' ', 'g'), '\\r?\\n') AS l FROM ({FILES_SQL})),
m AS (SELECT path, id, i, regexp_extract(l[i], '^([0-9A-Za-z_]+)', 1) AS name FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d))
SELECT path, 'Doc' || id AS symbol, 2 AS start_line, CAST(4 + len(l) AS INTEGER) AS end_line, 1.0::DOUBLE AS weight FROM d UNION ALL SELECT path, 'Doc' || id || '::' || name, CAST(3 + i AS INTEGER), CAST(3 + i AS INTEGER), 1.1 FROM m WHERE regexp_matches(name, '^[A-Za-z_]')""",
        "index_gate": f"""WITH p AS (SELECT path || ['', '.tmp', '.png', '.exe', '', '~'][{_N} % 6 + 1] AS path, {_N} * 7919 % 800000 AS size, {_N} % 11 = 0 AS nul FROM ({PROJECT_SQL})),
e AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p)
SELECT path, CASE WHEN contains('/' || path, '/vendor/') THEN 'excluded-folder' WHEN regexp_matches(path, '~$|\\.tmp$') THEN 'temporary' WHEN ext IN ('png', 'exe') THEN 'binary' WHEN ext NOT IN ('ts', 'php', 'md', 'json') THEN 'unsupported' WHEN size > 400000 THEN 'too-large' WHEN nul THEN 'binary' END AS reason,
CASE WHEN ext IN ('ts', 'php') THEN 1 ELSE 0 END AS priority FROM e""",
        "path_marks": f"""WITH q AS (SELECT path, ['a/tests/', 'a/__tests__/', 'a/Controllers/', 'a/api/', 'a/b/', 'dist/'][length(path) % 6 + 1] || ['x.spec.ts', 'index.ts', 'Stripe.php', 'app.min.js', 'main.php'][ascii(reverse(split_part(path, '.', 1))) % 5 + 1] AS p FROM ({PROJECT_SQL}))
SELECT path, {_TEST} AS test, regexp_matches(p, '(?i)/(controllers?|routes?|http|handlers?|api)/') OR regexp_matches(p, '(?i)/(main|index|app|server)\\.(ts|js|php)$') AS entry, regexp_matches(p, '(^|/)dist/') OR contains(p, '.min.') AS generated, contains(lower(p), 'stripe') AS service FROM q""",
        "related_tests": f"""WITH e AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN to_symbol END AS sym, to_path FROM ({EDGES_SQL}) WHERE kind = 'call'), s AS (SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_nationkey < 10)
SELECT c AS symbol, count(*) AS tests, min(id) AS first FROM e JOIN s ON coalesce(sym, to_path) = c GROUP BY c""",
        "test_coverage": """WITH f AS (SELECT DISTINCT source IN ('src1', 'src2') AS t, lang, n_chars FROM documents), t AS (SELECT 'app/tests/' || lang || n_chars || '.test.ts' AS a, lang, n_chars FROM f WHERE t), c AS (SELECT 'app/' || lang || n_chars || '.ts' AS b, lang, n_chars FROM f WHERE NOT t)
SELECT a AS from_path, b AS to_path, CASE WHEN n_chars % 2 = 0 THEN 'high' ELSE 'heuristic' END AS confidence FROM t JOIN c USING (lang, n_chars)""",
        "route_links": """WITH r AS (SELECT 'r' || page_id AS route_id, 'routes/' || page_id || '.php' AS to_path, regexp_extract(html, 'href="/?([0-9A-Za-z_/{}.-]+)"', 1) AS route FROM pages WHERE page_id % 3 = 0),
q AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[''"`]/?([0-9A-Za-z_/{}.-]+)[''"`]', 1)) AS route FROM pages)
SELECT route_id, 'ui/' || page_id || '.ts' AS from_path, to_path FROM r JOIN q USING (route) WHERE route <> ''""",
        "namespace_files": "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 THEN 'domain/' || c_mktsegment || '/' || c_custkey || '.php' WHEN c_nationkey % 2 = 0 THEN 'app/Http/' || c_mktsegment || '/' || c_custkey || '.php' END AS path FROM customer",
        "annotate_symbols": """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_suppkey AS p, l_partkey % 400 AS a, l_quantity FROM lineitem),
f AS (SELECT c.id, arg_min('s' || s.id, (s.a, s.id)) AS symbol FROM l c JOIN l s ON s.l_quantity <= 3 AND s.p = c.p AND c.a <= s.a + 9 AND s.a <= c.a + 5 GROUP BY c.id)
SELECT id, symbol, CASE WHEN symbol IS NULL THEN 'config' ELSE 'source' END AS kind FROM l LEFT JOIN f USING (id)""",
        "comment_lines": f"SELECT path, CAST(i AS INTEGER) AS line FROM (SELECT path, l[i] AS x, i FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM ({FILES_SQL})))) WHERE regexp_matches(x, '\\b(inea|edes|of)\\b') AND NOT starts_with(x, 'Of ') AND NOT regexp_matches(x, '^\\s*(//|#|\\*)')",
        "first_occurrences": f"SELECT path, CAST(min(i) AS INTEGER) AS line FROM (SELECT path, l[i] AS x, i FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM ({FILES_SQL})))) WHERE regexp_matches(x, '\\bthe\\b') AND NOT regexp_matches(x, '^\\s*(//|#|\\*)') GROUP BY path",
        "required_abstraction": f"SELECT 'uses-the' AS rule_id, path FROM ({FILES_SQL}) WHERE regexp_matches(path, '^src[1-4]/') AND NOT contains(text, 'the ') AND NOT contains(text, 'die ') UNION ALL SELECT 'uses-la', path FROM ({FILES_SQL}) WHERE regexp_matches(path, '/(fr|es)/') AND NOT contains(text, ' la ')",
        "naming_rule": f"SELECT 'ts-names' AS rule_id, path FROM ({PROJECT_SQL}) WHERE starts_with(path, 'src/') AND NOT regexp_matches(path, '/\\d+\\.ts$') UNION ALL SELECT 'no-pem', path FROM ({PROJECT_SQL}) WHERE regexp_matches(path, '^(src|legacy)/.*\\.pem$')",
        "worst_findings": f"SELECT rule_id, severity, path, line FROM ({_findings_sql()}) ORDER BY {_RULE_SEVERITY} DESC, path, line, rule_id LIMIT 100",
        "visible_hits": f"WITH p AS ({PROJECT_SQL}), r(pattern, classification, regex) AS (VALUES {_IGNORE}) SELECT path FROM p WHERE NOT ends_with(path, '.json') AND NOT EXISTS (SELECT 1 FROM r WHERE regexp_matches(path, regex) AND classification <> 'normal')",
        "redacted_text": f"SELECT id, sha256(CASE {_case(tuple(_CLASSES), 'id % 5 + 1')} WHEN 'never_index' THEN '' WHEN 'metadata_only' THEN '' WHEN 'normal' THEN text ELSE '[redacted]' END) AS hash FROM ({FILES_SQL})",
        "capabilities": f"""SELECT path, c AS classification, s AS rule_source, k AS language_scoped, c <> 'never_index' AS allows_retrieval, c = 'normal' AS allows_model, c IN ('normal', 'local_only', 'never_send_to_model') AS allows_content, c <> 'never_index' AS allows_symbols, c <> 'never_index' AS included,
CASE WHEN c = 'never_index' THEN CASE s WHEN 'global' THEN 'global-exclusion' WHEN 'workspace' THEN 'workspace-exclusion' WHEN 'gitignore' THEN 'gitignore' ELSE 'privacy-rule' END WHEN c = 'normal' THEN NULL WHEN k THEN 'language-exclusion' WHEN s = 'global' THEN 'global-exclusion' WHEN s = 'workspace' THEN 'workspace-exclusion' ELSE 'privacy-rule' END AS exclusion_reason
FROM (SELECT path, {_case(tuple(_CLASSES), 'id % 5 + 1')} AS c, ['global', 'workspace', 'gitignore', 'default'][id % 4 + 1] AS s, id % 3 = 0 AS k FROM ({FILES_SQL}))""",
        "rules_preview": f"""WITH p AS ({PROJECT_SQL}), r(pattern, classification, regex) AS (VALUES {_IGNORE}),
c AS (SELECT path, arg_max(classification, CASE classification WHEN 'never_index' THEN 5 WHEN 'never_send_to_model' THEN 4 WHEN 'metadata_only' THEN 3 WHEN 'local_only' THEN 2 ELSE 1 END) AS c FROM p JOIN r ON regexp_matches(path, regex) GROUP BY path),
g AS (SELECT p.path, coalesce(c, 'normal') AS c, CASE WHEN starts_with(p.path, 'vendor/') THEN 'excluded-folder' WHEN ends_with(p.path, '.pem') THEN 'unsupported' END AS reason FROM p LEFT JOIN c USING (path))
SELECT CASE WHEN reason IS NOT NULL OR c = 'never_index' THEN 'excluded' WHEN c <> 'normal' THEN 'restricted' ELSE 'included' END AS outcome, coalesce(reason, nullif(c, 'normal')) AS reason, count(*) AS files FROM g GROUP BY ALL""",
        "setting_overrides": """WITH o AS (SELECT o_custkey AS key, nullif(max(o_orderstatus), 'O') AS value FROM orders GROUP BY 1)
SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT key FROM o) UNION ALL SELECT key, value FROM o WHERE value IS NOT NULL""",
        "conflict_candidates": f"SELECT path FROM ({PROJECT_SQL}) WHERE regexp_matches(path, '\\.(ts|php)$') AND NOT starts_with(path, 'vendor/')",
        "fragment_listing": f"SELECT path FROM ({PROJECT_SQL}) WHERE contains(path, 'src1') OR contains(path, '/9') OR contains(path, 'nothing')",
        "memory_files": f"""WITH n AS (SELECT id, path, ['README.md', 'readme.md', 'Agents.MD', 'other.md', 'AGILE.md'][id % 5 + 1] AS name FROM ({FILES_SQL})), r AS (SELECT DISTINCT name FROM n WHERE id % 3 = 0 AND name <> 'other.md')
SELECT '.memory/' || path AS path FROM n WHERE id % 3 = 1 UNION ALL SELECT arg_min(name, (name <> lower(name), name)) FROM r GROUP BY lower(name)""",
        "glob_candidates": f"""WITH p AS (SELECT DISTINCT path FROM ({PROJECT_SQL})), g AS (SELECT 'src/**/*.ts' AS pattern, path FROM p WHERE regexp_matches(path, '^src/.*\\.ts$') UNION ALL SELECT '**/src1/*.md', path FROM p WHERE regexp_matches(path, '^(.*/)?src1/[^/]*\\.md$') UNION ALL SELECT 'config/*/1?.json', path FROM p WHERE regexp_matches(path, '^config/[^/]*/1[^/]\\.json$'))
SELECT pattern, path FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY path) AS n FROM g) WHERE n <= 80""",
        "pattern_cap": f"""WITH x AS (SELECT path, l[i] AS t, i FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM ({FILES_SQL}) WHERE language IN ('en', 'de')))),
m AS (SELECT path, i, row_number() OVER (PARTITION BY path ORDER BY i) AS n FROM x WHERE contains(t, 'of') UNION ALL SELECT path, i, row_number() OVER (PARTITION BY path ORDER BY i) FROM x WHERE contains(t, 'die ')),
d AS (SELECT DISTINCT path, i FROM m WHERE n <= 2)
SELECT path, CAST(i AS INTEGER) AS line FROM (SELECT *, row_number() OVER (ORDER BY path, i) AS k FROM d) WHERE k <= 50""",
        "symbol_walk": f"""WITH RECURSIVE e AS ({EDGES_SQL}), r(seed, symbol, depth) AS (SELECT 'region/' || r_regionkey, 'region/' || r_regionkey, 0 FROM region UNION ALL SELECT seed, from_symbol, depth + 1 FROM r JOIN e ON to_symbol = symbol WHERE depth < 2)
SELECT seed, depth, count(DISTINCT symbol) AS symbols, min(symbol) AS first FROM r GROUP BY seed, depth""",
        "relevant_symbols": "SELECT 'h' || c_custkey AS id, (c_custkey % 97)::DOUBLE AS score FROM customer WHERE c_custkey % 2 = 0 ORDER BY c_custkey % 97 DESC, 'h' || c_custkey LIMIT 30",
        "definition_context": """(SELECT 'h' || c_custkey AS id, c_name AS path, (c_custkey % 97)::DOUBLE AS score, CASE WHEN c_nationkey < 5 THEN 'high' WHEN c_nationkey < 12 THEN 'medium' ELSE 'low' END AS confidence FROM customer WHERE c_custkey % 2 = 0 ORDER BY c_custkey % 97 DESC, 'h' || c_custkey LIMIT 20)
UNION ALL SELECT 'sym:s3', c_name, 200.0, 'high' FROM customer WHERE c_custkey = 3""",
        "pack_confidence": """SELECT CAST(c_custkey % 97 AS INTEGER) AS bucket, round(greatest(0.1, least(0.95, 0.25 + least(0.55, count(*) / 20) + count(*) FILTER (c_nationkey < 5) * 0.03 + count(*) FILTER (c_nationkey BETWEEN 5 AND 11) * 0.015)), 6) AS confidence FROM customer GROUP BY 1""",
        "chunk_parents": f"SELECT path, CASE WHEN id % 2 = 0 THEN sha256(text) ELSE substr(sha256(text), 1, 8) END AS hash, id % 2 = 1 AS implicit FROM ({FILES_SQL}) WHERE id % 2 = 0 OR id % 3 > 0",
        "php_test_edges": f"""WITH w AS (SELECT id, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM ({FILES_SQL}) WHERE id % 2 = 0)
SELECT 'tests/' || id || 'Test.php' AS from_path, 'App\\' || w AS specifier, 'app/' || w || '.php' AS to_path, CASE WHEN id % 5 = 0 THEN 'pest-test' ELSE 'phpunit-test' END AS evidence FROM w WHERE w <> '' UNION ALL SELECT 'tests/' || id || 'Test.php', w, 'app/' || w || '.php', 'pest-describe' FROM w WHERE w <> '' AND id % 5 = 0""",
        "php_diagnostics": f"SELECT replace(path, '.md', '.php') AS path, 'php-missing-open-tag' AS code FROM ({FILES_SQL}) WHERE id % 2 = 1 UNION ALL SELECT replace(path, '.md', '.php'), 'php-container-runtime' FROM ({FILES_SQL}) WHERE id % 3 = 0",
        "best_files": f"WITH h AS ({HITS_SQL}) SELECT path, max(score) AS score, arg_max(CASE WHEN start_line % 2 = 0 THEN 'symbol' ELSE 'chunk' END, (score, id)) AS result_type FROM h GROUP BY path ORDER BY max(score) DESC, path LIMIT 10",
        "hit_excerpts": f"""WITH c AS (SELECT path, s + 1 AS a, least(s + 20, len(l)) AS b, trim(array_to_string(l[s + 1:s + 20], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (SELECT path, l, unnest(list_filter(range(0, len(l), 15), lambda s: s = 0 OR s + 5 < len(l))) AS s FROM (SELECT path, string_split_regex(text, '\\r?\\n') AS l FROM ({FILES_SQL})))),
w AS (SELECT * FROM c WHERE t <> ''), h AS (SELECT 'h' || path || ':' || a AS id, path, a + 16 AS x, a + 18 AS y FROM w WHERE a % 7 = 1)
SELECT id, sha256(arg_min(t, (a, w.path || ':' || a))) AS hash FROM h LEFT JOIN w ON h.path = w.path AND a <= y AND x <= b GROUP BY id""",
        "architecture_layers": f"""WITH p AS (SELECT DISTINCT length(path) % 5 AS k, path, length(path)::DOUBLE AS s FROM ({PROJECT_SQL}))
SELECT CASE k WHEN 0 THEN 'entry' WHEN 1 THEN 'application' WHEN 2 THEN 'domain' WHEN 3 THEN 'storage' ELSE CASE WHEN ends_with(path, '.md') THEN 'documentation' ELSE 'other' END END AS layer, count(*) AS files, max(s) AS best FROM p GROUP BY 1""",
        "changed_paths": f"""WITH d AS (SELECT id, regexp_extract(text, '([0-9A-Za-z_]+)', 1) || '.ts' AS first, regexp_extract_all(text, '(?m)^The ([0-9A-Za-z_]+)', 1) AS more FROM ({FILES_SQL}))
SELECT DISTINCT id, unnest(list_prepend(first, list_transform(more, lambda m: m || '.php'))) AS path FROM d""",
        "related_candidates": f"""WITH e AS ({EDGES_SQL}), c AS (SELECT 'customer/' || c_custkey AS p FROM customer),
r AS (SELECT 'imported' AS reason, 80 AS priority, to_path AS path FROM e JOIN c ON from_path = p UNION SELECT 'importer', 70, from_path FROM e JOIN c ON to_path = p)
SELECT reason, priority, count(DISTINCT path) AS files, min(path) AS first FROM r GROUP BY ALL""",
        "test_stems": f"SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, CASE regexp_extract(path, '([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'php' THEN 'php' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' ELSE 'other' END AS language FROM (SELECT DISTINCT path FROM ({PROJECT_SQL}))",
    }


ORACLES = _oracles()
