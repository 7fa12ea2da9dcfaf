"""Ranking, confidence and severity scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LARGE_FILE_BYTES, base_name, entry_point, generated_path, identifier_tokens, integration, normal_path, once, query_tokens, repetition, test_path, tokens

# Ranks of edge confidence; an unknown one counts as medium.
CONFIDENCE = {"certain": 5, "high": 4, "medium": 3, "low": 2, "heuristic": 1}
DETERMINISTIC_METHODS = ("compiler", "ast", "typescript-checker", "typescript-ast", "path-alias", "import-graph")
# Penalties of review findings by severity, and what the two score buckets hold.
SEVERITY_PENALTY = {"info": 0.15, "hint": 0.25, "warning": 0.55, "error": 0.85, "critical": 1.2}
FUNCTIONALITY_CATEGORIES = ("security", "correctness", "reliability", "operability", "data")
SIGNALS = ("exact_symbol", "symbol_alias", "lexical", "path_relevance", "import_distance", "call_graph", "test_relation", "instruction_scope", "architecture", "recency", "user_selected", "generated_penalty")


def js_round(x: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(x + 0.5)


def rank_of(value: Column, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, rank in ranks.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    return rank_of(confidence, CONFIDENCE, 3)


def deterministic(confidence: Column, method: Column) -> Column:
    by_method = F.coalesce(method.isin(*DETERMINISTIC_METHODS), F.lit(False))
    by_confidence = F.when(confidence.isin("certain", "high"), True).when(confidence.isin("heuristic", "low"), False)
    return F.when(by_method, True).otherwise(F.coalesce(by_confidence, ~F.coalesce(method, F.lit("")).isin("heuristic", "unresolved")))


def path_score(query: str, path: Column) -> Column:
    """0 to 50: share of query terms in the path."""
    terms = query_tokens(query)
    if not terms:
        return F.lit(0)
    norm = F.lower(normal_path(path))
    parts = F.flatten(F.transform(F.split(norm, "/"), identifier_tokens))
    hits = sum(((F.array_contains(parts, t) | norm.contains(t)).cast("int") for t in terms), F.lit(0))
    return F.least(F.lit(50), js_round(hits / len(terms) * 50))


def overlap_score(query: str, text: Column) -> Column:
    """0 to 40: share of query terms in the text."""
    return overlap_of(query, F.array_distinct(tokens(text)))


def overlap_of(query: str, found: Column) -> Column:
    """The same by the text's terms."""
    terms = query_tokens(query)
    if not terms:
        return F.lit(0)
    hits = sum((F.array_contains(found, t).cast("int") for t in terms), F.lit(0))
    return F.coalesce(F.least(F.lit(40), js_round(hits / len(terms) * 40)), F.lit(0))


def symbol_scores(query: str, name: Column) -> tuple[Column, Column]:
    """(exact 100 or 0, alias by share of the query's terms in the name)."""
    import re

    wanted = query.strip()
    spaced = re.sub("[_./:-]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", wanted)).lower().split()
    terms = list(dict.fromkeys([*query_tokens(wanted), *(t for t in spaced if len(t) > 1)]))
    low = F.lower(F.trim(name))
    exact = F.when(low == wanted.lower(), F.lit(100)).otherwise(F.lit(0)) if wanted else F.lit(0)
    if not terms:
        return exact, F.lit(0)
    parts = identifier_tokens(name)
    ratio = sum(((F.array_contains(parts, t) | low.contains(t)).cast("int") for t in terms), F.lit(0)) / len(terms)
    alias = F.when(exact > 0, F.lit(0)).otherwise(js_round(F.when(ratio >= 0.6, ratio * 55).otherwise(ratio * 30)))
    return F.coalesce(exact, F.lit(0)), F.coalesce(alias, F.lit(0))


def path_boost(path: Column, hint: str | None) -> Column:
    if not hint:
        return F.lit(1.0)
    hint = hint.replace("\\", "/")
    here, folder = normal_path(path), hint.rpartition("/")[0]
    role = r"(?i)(Controller|Service|Job|Model|Request|Policy|Listener|Event|Provider|Middleware)\.php$"
    import re

    same_role = here.rlike(role) if re.search(role, hint) else F.lit(False)
    same_folder = (F.regexp_replace(here, "/[^/]*$", "") == folder) & here.contains("/") if folder else F.lit(False)
    return F.when(here == hint, F.lit(1.35)).when(same_folder, F.lit(1.2)).when(same_role, F.lit(1.1)).otherwise(F.lit(1.0))


def memory_boost(kind: Column, weight: Column, prefer_memory: bool) -> Column:
    return F.when(kind == "memory", F.lit(1.45 if prefer_memory else 1.25)).otherwise(weight)


def generated_penalty(path: Column, size: Column | None = None, text: Column | None = None) -> Column:
    out = F.when(generated_path(path), F.lit(40)).otherwise(F.lit(0))
    if size is not None:
        out = out + F.when(F.coalesce(size, F.lit(0)) > LARGE_FILE_BYTES, F.lit(25)).otherwise(F.lit(0))
    return out if text is None else out + repetition_penalty(text)


def repetition_penalty(text: Column) -> Column:
    """What a text's repeated parts count against it."""
    share = F.coalesce(repetition(text), F.lit(0.0))
    return once(share, lambda s: F.when(s > 0.45, js_round(s * 30)).otherwise(F.lit(0)))


def total(signals: dict[str, Column] | None = None) -> Column:
    """Sum of the twelve signals, the penalty subtracted; nulls count as 0."""
    value = signals or {s: F.col(s) for s in SIGNALS}
    return sum((F.coalesce(value[s].cast("double"), F.lit(0.0)) * (-1 if s == "generated_penalty" else 1) for s in SIGNALS if s in value), F.lit(0.0))


def confidence_band(score: Column, is_deterministic: Column) -> Column:
    return F.when(score >= 80, F.when(is_deterministic, F.lit("high")).otherwise(F.lit("medium"))).when(score >= 45, F.lit("medium")).when(score >= 20, F.lit("low")).otherwise(F.lit("uncertain"))


def hub_damping(degree: Column) -> Column:
    return 1 / F.log2(2 + F.greatest(degree, F.lit(0)))


def import_distance_score(distance: Column, degree: Column) -> Column:
    return F.greatest(F.lit(1), js_round(F.greatest(F.lit(5), 35 - (distance - 1) * 12) * hub_damping(degree)))


def recency(mtime: Column, oldest: Column, newest: Column) -> Column:
    """0 to 8 between the oldest and the newest file."""
    return F.when(mtime.isNull() | (newest <= oldest), F.lit(0)).otherwise(js_round((mtime - oldest) / F.nullif(newest - oldest, F.lit(0)) * 8))


def effective_kind(kind: Column, specifier: Column) -> Column:
    spec = F.coalesce(specifier, F.lit(""))
    return F.when(spec.startswith("route:"), F.lit("route")).when(kind.isin("import", "require") & integration(spec), F.lit("integration")).otherwise(kind)


def edge_priority(kind: Column, specifier: Column, confidence: Column, method: Column) -> Column:
    """How early an edge is followed: resolved and confident ones, routes and calls first."""
    sure = F.when(deterministic(confidence, method), F.lit(50)).otherwise(F.lit(0))
    trust = F.when(confidence == "certain", F.lit(20)).when(confidence == "high", F.lit(15)).when(confidence == "medium", F.lit(8)).when(confidence == "heuristic", F.lit(-20)).otherwise(F.lit(0))
    own = effective_kind(kind, specifier)
    by_kind = F.when(own == "route", F.lit(14)).when(own == "call", F.lit(12)).when(own == "likelyTestCoverage", F.lit(10)).when(own.isin("extends", "implements", "typeUsage"), F.lit(8)).when(own.isin("import", "require"), F.lit(6)).otherwise(F.lit(0))
    return sure + trust + by_kind


def relation_score(paths: Column, names: Column, kinds: Column, specifiers: Column, confidences: Column, all_deterministic: Column, closes_cycle: Column) -> Column:
    """Rank of a relationship path. paths and names have one entry a node, the others one an edge."""
    hops = F.size(kinds)
    worst = F.array_min(F.transform(confidences, confidence_rank))
    nodes = F.arrays_zip(paths.alias("p"), names.alias("n"))
    has_entry = F.exists(nodes, lambda x: entry_point(x["p"], x["n"]))
    has_route = F.exists(F.arrays_zip(kinds.alias("k"), specifiers.alias("s")), lambda x: (x["k"] == "route") | F.coalesce(x["s"].startswith("route:"), F.lit(False)))
    has_test = F.exists(paths, test_path) | F.array_contains(kinds, "likelyTestCoverage")
    has_integration = F.array_contains(kinds, "integration") | F.exists(F.filter(specifiers, lambda s: s.isNotNull()), integration)
    bonus = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0))
    return 100 - hops * 8 + F.when(all_deterministic, F.lit(40)).otherwise(F.lit(-25)) + F.coalesce(worst, F.lit(0)) * 4 + bonus(has_entry, 18) + bonus(has_route, 16) + bonus(has_test, 22) + bonus(has_integration, 14) + bonus(closes_cycle, -10)


def severity_penalty(severity: Column) -> Column:
    out = F.lit(0.25)
    for name, points in SEVERITY_PENALTY.items():
        out = F.when(severity == name, F.lit(points)).otherwise(out)
    return out


def review_score(penalty: Column) -> Column:
    """10 less the penalty, between 0 and 10, two decimals."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - penalty)), 2)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")
