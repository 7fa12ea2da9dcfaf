"""Policy: privacy classes, ignore layers, globs, scoped instructions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import listed

# Strength of privacy classes, precedence of rule sources (0 first), precedence bands of instructions.
STRENGTH = {"never_index": 5, "never_send_to_model": 4, "metadata_only": 3, "local_only": 2, "normal": 1}
SOURCE_RANK = {"override": 0, "global": 1, "workspace": 2, "toolignore": 3, "gitignore": 4, "editor": 5, "default": 6}
PRECEDENCE = {"user_configured": 1000, "closest_scope": 900, "parent_scope": 800, "root_scope": 700, "glob_rule": 600, "contextual": 400, "approved_memory": 250, "reviewed_memory": 150, "generated_memory": 100}
# Classes of well-known private paths.
DEFAULT_RULES = (
    ("secrets/**", "never_index"),
    ("*.pem", "never_index"),
    (".env", "never_send_to_model"),
    (".env.*", "never_send_to_model"),
    ("customer-data/**", "never_send_to_model"),
    ("generated/**", "metadata_only"),
    ("fixtures/private/**", "local_only"),
    ("vendor/**", "never_index"),
    ("legacy/**", "never_index"),
    ("node_modules/**", "never_index"),
)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored, case-insensitive regular expression: ** any path, * and ? within a part, {a,b} either."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return f"(?i)^{''.join(out)}$"


def ignore_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over paths relative to its folder.

    A pattern with an inner or leading slash is anchored, another fits at any depth; what
    fits a folder covers all below it.
    """
    body = pattern.strip().rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    core = glob_regex(body).removeprefix("(?i)^").removesuffix("$")
    return f"^{'' if anchored else '(?:.*/)?'}{core}(?:/.*)?$"


def strength(classification: Column) -> Column:
    out = F.lit(1)
    for name, rank in STRENGTH.items():
        out = F.when(classification == name, F.lit(rank)).otherwise(out)
    return out


def source_rank(source: Column) -> Column:
    out = F.lit(6)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def rules_frame(spark, rules) -> DataFrame:
    """Rule rows (pattern, classification, source, languages) with compiled regex."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "default", list(r[3]) if len(r) > 3 else [], ignore_regex(r[0])) for r in rules]
    return spark.createDataFrame(rows, "pattern string, classification string, source string, languages array<string>, regex string")


def privacy_decisions(paths: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(path, classification, rule_source, pattern and capability flags) for paths (path, language).

    The strongest matching class wins, then the earlier source, then the pattern. An
    override (path, classification) decides alone. Rules are a list that people write, so
    they are broadcast; each path's best match is a partial aggregate.
    """
    match = paths.join(listed(rules), F.expr("path rlike regex AND (size(languages) = 0 OR array_contains(languages, language))"))
    order = F.struct(strength(F.col("classification")), -source_rank(F.col("source")), "pattern")
    best = match.groupBy("path").agg(F.max_by(F.struct("classification", "source", "pattern"), order).alias("r"))
    decided = paths.select("path").distinct().join(best, "path", "left")
    if overrides is not None:
        decided = decided.join(overrides.select("path", F.col("classification").alias("own")), "path", "left")
    else:
        decided = decided.withColumn("own", F.lit(None).cast("string"))
    named = decided.select(
        "path",
        F.coalesce("own", "r.classification", F.lit("normal")).alias("classification"),
        F.when(F.col("own").isNotNull(), "override").otherwise(F.coalesce("r.source", F.lit("default"))).alias("rule_source"),
        F.when(F.col("own").isNull(), F.col("r.pattern")).alias("pattern"),
    )
    return with_capabilities(named)


def with_capabilities(decisions: DataFrame) -> DataFrame:
    c = F.col("classification")
    return decisions.withColumns({"allows_retrieval": c != "never_index", "allows_model": c == "normal", "allows_content": c.isin("normal", "local_only", "never_send_to_model")})


def full_capabilities(decisions: DataFrame) -> DataFrame:
    """Decisions (classification, rule_source, language_scoped) with all flags and why a path is held back, if it is."""
    c, source = F.col("classification"), F.col("rule_source")
    by_source = F.when(source == "global", "global-exclusion").when(source == "workspace", "workspace-exclusion")
    hidden = F.coalesce(by_source, F.when(source.isin("toolignore", "gitignore"), source), F.lit("privacy-rule"))
    reason = F.when(c == "never_index", hidden).when(F.col("language_scoped") & (c != "normal"), "language-exclusion").when(c != "normal", F.coalesce(by_source, F.lit("privacy-rule")))
    return with_capabilities(decisions).withColumns({"allows_symbols": c != "never_index", "included": c != "never_index", "exclusion_reason": reason})


def preview(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """(path, outcome, reason): what an index would do with files (path, reason the gate gives, or null) under decisions: included, restricted or excluded."""
    both = files.join(decisions.select("path", "classification"), "path", "left").withColumn("classification", F.coalesce("classification", F.lit("normal")))
    gone, c = F.col("reason").isNotNull(), F.col("classification")
    outcome = F.when(gone | (c == "never_index"), "excluded").when(c != "normal", "restricted").otherwise("included")
    return both.select("path", outcome.alias("outcome"), F.coalesce("reason", F.when(c != "normal", c)).alias("reason"))


def overridden(stored: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """Settings (privacy overrides, conflict ignores, statuses) with a person's new ones by key; a null value takes one back."""
    value = [c for c in stored.columns if c not in key]
    kept = stored.join(own.select(*key), key, "left_anti")
    return kept.unionByName(own.where(" AND ".join(f"`{c}` IS NOT NULL" for c in value)))


def for_model(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items (path, ...) that may go to a model; paths without a decision pass."""
    return items.join(decisions.select("path", "allows_model"), "path", "left").where(F.coalesce("allows_model", F.lit(True))).drop("allows_model")


def without_ignored(items: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """Items (path, ...) that no ignore file hides (path)."""
    return items.join(ignored_paths.select("path").distinct(), "path", "left_anti")


def redacted(text: Column, classification: Column) -> Column:
    return F.when(classification.isin("never_index", "metadata_only"), F.lit("")).when(classification.isin("never_send_to_model", "local_only"), F.lit("[redacted]")).otherwise(text)


def ignored(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """(path, ignored, layer): nested ignore files.

    layers: (dir, rule_no, pattern_regex, negated); within a folder the last matching
    pattern decides, and the first folder from the root down that ignores a path settles it.
    """
    below = (F.col("dir") == "") | F.expr("startswith(path, concat(dir, '/'))")
    rel = F.expr("if(dir = '', path, substring(path, length(dir) + 2))")
    hit = paths.select("path").join(listed(layers), below).withColumn("rel", rel).where(F.expr("rel rlike pattern_regex"))
    per_dir = hit.groupBy("path", "dir").agg(F.max_by("negated", "rule_no").alias("negated"))
    first = per_dir.where("NOT negated").groupBy("path").agg(F.min_by("dir", F.struct(F.length("dir"), "dir")).alias("layer"))
    return paths.select("path").join(first, "path", "left").select("path", F.col("layer").isNotNull().alias("ignored"), "layer")


# ------------------------------------------------------------------ scoped instructions


def precedence(doc_type: Column, scope: Column, target: Column, binding: Column, status: Column, has_globs: Column, user_configured: Column) -> Column:
    """Precedence band of a document for a target path."""
    p = {k: F.lit(v) for k, v in PRECEDENCE.items()}
    folder = F.when(target.contains("/"), F.regexp_replace(target, "/[^/]*$", "")).otherwise(F.lit(""))
    depth = F.size(F.split(scope, "/"))
    scoped = F.when(scope == "", p["root_scope"]).when(scope == folder, p["closest_scope"] + depth).when(target.startswith(F.concat(scope, F.lit("/"))), p["parent_scope"] + depth).otherwise(p["root_scope"])
    memory = F.when(status == "approved", p["approved_memory"]).when(status == "reviewed", p["reviewed_memory"]).otherwise(p["generated_memory"])
    return F.when(doc_type == "generated_memory", memory).when(user_configured, p["user_configured"]).when(binding == "contextual", p["contextual"]).when(has_globs, p["glob_rule"]).when(doc_type == "instruction", scoped).otherwise(p["contextual"])


def applicable(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """(target, doc_path, precedence) of documents that apply, for targets (target).

    docs: (doc_path, doc_type, scope, binding, status, globs regex or null, user_configured),
    a list of a project's instruction files, so broadcast.
    """
    t, scope = F.col("target"), F.col("scope")
    live = (F.col("doc_type") != "generated_memory") | ~F.coalesce(F.col("status"), F.lit("generated")).isin("rejected", "stale")
    under = (scope == "") | (t == scope) | F.expr("startswith(target, concat(scope, '/'))")
    fits = F.when(F.col("doc_type") == "generated_memory", F.lit(True)).when(F.col("globs").isNotNull(), F.expr("target rlike globs")).when(F.col("user_configured") | (F.col("binding") == "contextual"), F.lit(True)).otherwise(under)
    found = targets.join(listed(docs.where(live)), fits)
    rank = precedence(F.col("doc_type"), scope, t, F.col("binding"), F.col("status"), F.col("globs").isNotNull(), F.col("user_configured"))
    return found.select("target", "doc_path", "binding", rank.alias("precedence"))


def governing(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """(target, doc_path, precedence): the document that counts most for each target."""
    best = applicable(targets, docs).groupBy("target").agg(F.max_by(F.struct("doc_path", "precedence"), F.struct("precedence", "doc_path")).alias("b"))
    return best.select("target", "b.doc_path", "b.precedence")


def instruction_conflicts(rules: DataFrame) -> DataFrame:
    """(target, precedence, files, opposed): binding rules (target, precedence, file, text) of one precedence from several files; opposed if one demands and another forbids."""
    low = F.lower("text")
    return (
        rules.groupBy("target", "precedence")
        .agg(
            F.count_distinct("file").alias("files"),
            (F.some(low.rlike(r"\b(must|always|shall)\b")) & F.some(low.rlike(r"\b(must not|never|do not|don't)\b"))).alias("opposed"),
        )
        .where("files >= 2")
    )
