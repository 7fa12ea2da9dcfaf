"""Queries on usage, scores, conventions and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, comment_audit, conventions, metrics
from ..sources.bindings import EVENTS_SQL, FILES_SQL, PROJECT_SQL, files, project_paths, table, usage_events


def usage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.usage_totals(usage_events(spark, sf_dir))
    return got.select("kind", "uses", F.round("latency_sum", 3).alias("latency_sum"), "latency_count", "latency_avg")


def last64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_by_kind(usage_events(spark, sf_dir), 64).select("kind", "id", "nth")


def frequent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frequent_sources(usage_events(spark, sf_dir))


def severity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as review findings of their order."""
    severity = F.element_at(F.array(*map(F.lit, ("info", "hint", "warning", "error", "critical"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("security", "naming", "Data", "architecture"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", severity.alias("severity"), category.alias("category"))
    got = metrics.scored_findings(found, "l_orderkey")
    return got.select("l_orderkey", *[F.round(c, 4).alias(c) for c in ("functionality_penalty", "style_penalty", "score")])


def convention_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("app/Actions/", "app/Services/", "src/domain/", "tests/a.spec.", "app/Repositories/", "x/"))), (F.length("path") % 6 + 1).cast("int"))
    return conventions.path_conventions(project_paths(spark, sf_dir).select(F.concat(folder, "path").alias("path")))


def rival_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' market segments by nation as rival conventions, orders as their evidence."""
    ids = F.element_at(F.array(*map(F.lit, conventions.RIVALS)), (F.ascii("c_mktsegment") % 3 + 1).cast("int"))
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey", ids.alias("id")).agg(F.count("*").alias("evidence"))
    rated = counted.withColumn("confidence", F.when(F.col("evidence") % 3 == 0, "high").when(F.col("evidence") % 3 == 1, "medium").otherwise("low"))
    got = conventions.resolved_rivals(rated, group="c_nationkey")
    return got.select("c_nationkey", "id", "strength", "active", "dominated_by")


def convention_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rated = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.when(F.col("value") > 50, "high").when(F.col("value") > 20, "medium").otherwise("low").alias("confidence"))
    return conventions.deduplicated(rated).select("id", "ordinal", "confidence")


def signal_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("signal"))
    return conventions.signal_fingerprint(seen, "user_id")


# What comments say, weak and strong, and why; a turn takes one of each by its number.
COMMENTS = (
    "It might be a good idea to split it", "It may be worth a look here", "You may wish to rename it", "Might want to cache it", "Think about retries here", "Try to name the target", "Consider the retry budget", "Maybe split this method", "Might split this method", "Could split this method",
    "Perhaps split it in two", "Possibly split it", "consider", "Fix it", "This needs some work now", "The loop is not ideal", "It is a bit messy in here", "The loop could be nicer", "A sub-optimal query plan", "Make the names cleaner", "Make it cleaner than before", "refactor this.", "Needs a refactor",
    "The handler silently drops rows", "A silent fallback hides it", "It works under the hood", "The name shadows another", "Has a hidden mutation inside", "An implicit cast of the key", "It has side-effects", "It mutates global settings", "It swallows exceptions", "It suppresses warnings", "A monkey-patched client",
    "A non-obvious dependency", "It unexpectedly returns", "A gotcha for all", "It leaks memory", "Rename total to grand_total",
)
REASONS = (
    None, "Short.", "this may cause issues", "It can be risky, and that is why nobody should ever want to keep it as it is now", "Every caller that retries sees the old total and writes it back, and that is data loss", "Not good practice, whatever else the callers of this method might say about its name",
    "When another request comes between, the lock is held by both and neither ends: a deadlock", "Rename total to grand_total", "The total is read twice and that is slow for long orders, whatever the size of the cache", "One should follow best practices",
)


def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as review results of one finding, with comments and reasons that are weak in all ways: what is objected to, and the rewritten comment."""
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))
    comment, reason = pick(COMMENTS, F.col("conv_id") * 3 + F.col("turn")), pick(REASONS, F.col("conv_id") + F.col("turn") * 7)
    severity = pick(("critical", "hint", "warning", "odd"), F.col("conv_id") + F.col("turn"))
    finding = F.struct(F.lit("f").alias("id"), severity.alias("severity"), F.substring("text", 1, 30).alias("title"), comment.alias("message"), reason.alias("whyItMatters"), reason.alias("fixHint"))
    raw = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.to_json(F.struct(F.array(finding).alias("findings"))).alias("raw"))
    found = comment_audit.enforced(raw)
    kinds = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["field"], F.lit("="), x["kind"])), ",")
    return found.select("id", "message", "side_effect", kinds("strength").alias("strength"), kinds("teaching").alias("teaching"), audit.should_escalate(F.size("teaching"), F.col("n").cast("double"), 0).alias("escalate"))


def convention_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("id"), F.when(F.col("value") > 50, "high").otherwise("low").alias("confidence"))
    got = audit.convention_digest(rated, "user_id")
    return got.select("user_id", "digest", audit.cache_key(F.col("user_id").cast("string"), F.col("digest")).alias("cache_key"))


def task_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(F.replace("text", F.lit(" inea "), F.lit(" invoice ")), F.lit(" edes "), F.lit(" fetchAll "))
    risks = metrics.task_risks(body, F.length("text") % 20, F.length("text") % 2)
    return files(spark, sf_dir).select("id", F.array_join(risks, ",").alias("risks"))


def seniority_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews of their line items, by the band of their score."""
    scored = severity_score(spark, sf_dir)
    return scored.groupBy(metrics.seniority(F.col("score")).alias("band")).agg(F.count("*").alias("reviews"))


def demo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews with the first three line items as findings; those of even keys have none."""
    severity = F.element_at(F.array(*map(F.lit, ("info", "hint", "warning", "error", "critical"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), severity.alias("severity"))
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("seed"))
    return metrics.demo_score(found, reviews, 3)


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two short hashes of paths."""
    return files(spark, sf_dir).select("path", text.fnv1a(F.col("path")).alias("fnv"), text.short_hash(F.col("path")).alias("short"))


def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, line items as their chunks, seen on a day."""
    seen = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("mtime"))
    got = metrics.index_health(seen, table(spark, sf_dir, "lineitem"), F.lit("2024-02-20 00:00:00").cast("timestamp"))
    return got.select("files", "chunks", "incomplete", "possibly_stale")


def parser_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = project_paths(spark, sf_dir).select("path", F.when(F.col("path").endswith(".php"), "error").otherwise("ok").alias("parse_status"))
    return metrics.parser_failures(own.distinct(), 40)


def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two event types of each user, summed key by key."""
    events = table(spark, sf_dir, "events").select("user_id", F.create_map(F.col("event_type"), F.lit(1)).alias("a"), F.create_map(F.lit("all"), F.lit(1), F.lit("click"), F.lit(2)).alias("b"), "event_id")
    merged = events.select("event_id", metrics.added_counts(F.col("a"), F.col("b")).alias("m"))
    return merged.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("counts"))


QUERIES = {f.__name__: f for f in (seniority_bands, demo_scores, text_hashes, index_health, parser_failures, merged_counts, usage_fold, last64, frequent_sources, severity_score, convention_tiers, rival_resolution, convention_dedupe, signal_fingerprint, review_audit, convention_digest, task_risks)}

_POINTS = "CASE l_partkey % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.25 WHEN 2 THEN 0.55 WHEN 3 THEN 0.85 ELSE 1.2 END::DOUBLE"


def _list(options) -> str:
    return "[" + ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options) + "]"


def _any(text: str, patterns) -> str:
    """Whether one of the patterns is met; DuckDB's have no look-ahead, so the one that has it is met in a text without what it forbids."""
    ahead = "(?! (?:than|version|shape|form))"
    each = [f"regexp_matches(regexp_replace({text}, '(?i)\\bcleaner (than|version|shape|form)', '', 'g'), '(?i){p.replace(ahead, '')}')" if ahead in p else f"regexp_matches({text}, '(?i){p}')" for p in patterns]
    return "(" + " OR ".join(each) + ")"


def _audit_sql() -> str:
    cut = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '(?i)^{o}') THEN ltrim(regexp_replace({{0}}, '(?i)^{o}', ''))" for o in comment_audit.OPENINGS) + " END"
    bare = lambda c: f"(SELECT CASE WHEN r IS NULL THEN {c} WHEN r = '' THEN {c} ELSE upper(r[1]) || r[2:] END FROM (SELECT {cut.format(c)} AS r))"
    plain = lambda c: f"trim(regexp_replace(lower({c}), '[\\s.,;:!?\"''`()\\[\\]]+', ' ', 'g'))"
    openings = [f"^{o}" for o in comment_audit.OPENINGS]
    field = lambda name, c: f"CASE WHEN {_any(c, openings)} THEN '{name}=hedged-opening' END, CASE WHEN {_any(c, comment_audit.VERDICTS)} THEN '{name}=empty-verdict' END"
    sign = "CASE " + " ".join(f"WHEN regexp_matches(prose, '(?i){p}') THEN lower(trim(regexp_extract(prose, '(?i)({p})', 1)))" for p in comment_audit.SIDE_EFFECTS) + " END"
    return f"""WITH a AS (SELECT conv_id || ':' || turn AS id, substr(text, 1, 30) AS title, {_list(COMMENTS)}[(conv_id * 3 + turn) % {len(COMMENTS)} + 1] AS m, {_list(REASONS)}[(conv_id + turn * 7) % {len(REASONS)} + 1] AS w, ['critical', 'hint', 'warning', 'odd'][(conv_id + turn) % 4 + 1] AS severity FROM conversations),
b AS (SELECT id, title, severity, {bare("m")} AS message, coalesce({bare("w")}, '') AS why FROM a),
c AS (SELECT *, trim(title, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || message || chr(10) AS prose, {plain("why")} AS wn, {plain("title")} AS tn, {plain("message")} AS mn FROM b),
d AS (SELECT *, {sign} AS side_effect FROM c)
SELECT id, message, side_effect,
coalesce(array_to_string(list_filter([CASE WHEN length(message) < 12 THEN 'message=too-short' END, {field("message", "message")}, {field("whyItMatters", "why")}, {field("fixHint", "why")}], lambda x: x IS NOT NULL), ','), '') AS strength,
coalesce(array_to_string(list_filter([CASE WHEN why = '' AND severity IN ('critical', 'warning') THEN 'missing-why' END, CASE WHEN why <> '' AND length(why) < 60 THEN 'shallow-why' END,
  CASE WHEN wn <> '' AND CASE WHEN tn <> '' AND (contains(tn, wn) OR contains(wn, tn)) THEN length(wn) < length(tn) + 40 ELSE wn = mn END THEN 'restates-title' END, CASE WHEN why <> '' AND {_any("why", comment_audit.VAGUE_RISKS)} THEN 'unspecified-risk' END,
  CASE WHEN why <> '' AND side_effect IS NOT NULL AND NOT {_any("why", comment_audit.COSTS)} THEN 'undisclosed-side-effect' END], lambda x: x IS NOT NULL).list_transform(lambda x: 'whyItMatters=' || x), ','), '') AS teaching, teaching <> '' AS escalate FROM d"""


_AUDIT = _audit_sql()
_FOLDERS = "['app/Actions/', 'app/Services/', 'src/domain/', 'tests/a.spec.', 'app/Repositories/', 'x/']"
_CONVENTIONS = " UNION ALL ".join(
    f"SELECT '{i}' AS id, '{label}' AS label, count(*) AS files, CASE WHEN count(*) >= {high} THEN 'high' WHEN count(*) >= {medium} THEN 'medium' END AS confidence FROM p WHERE regexp_matches(path, '{pattern}') HAVING count(*) >= {medium}"
    for i, label, pattern, high, medium in conventions.PATH_CONVENTIONS
)
_RISK_LIST = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{name}' END" for name, p in metrics.RISKS.items())

_SCORES = f"SELECT l_orderkey, round(greatest(0, least(10, 10 - sum({_POINTS}))), 2) AS score FROM lineitem GROUP BY l_orderkey"

ORACLES = {
    "seniority_bands": f"SELECT CASE WHEN score >= 9 THEN 'Senior' WHEN score >= 7.5 THEN 'Mid-level' WHEN score >= 6 THEN 'Junior' ELSE 'Novice' END AS band, count(*) AS reviews FROM ({_SCORES}) GROUP BY 1",
    "demo_scores": f"""WITH p AS (SELECT l_orderkey AS id, sum({_POINTS}) AS penalty FROM lineitem WHERE l_orderkey % 2 = 1 AND l_linenumber <= 3 GROUP BY 1),
h AS (SELECT DISTINCT o_orderpriority AS seed, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(o_orderpriority, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296) AS h FROM orders)
SELECT o_orderkey AS id, round(least(10.0, greatest(3.0, coalesce(10 - penalty, 10 + ((h % 10000) / 10000 - 0.5) * 0.2))), 2) AS score FROM orders JOIN h ON seed = o_orderpriority LEFT JOIN p ON id = o_orderkey""",
    "text_hashes": f"""WITH c AS (SELECT path, list_transform(string_split(path, ''), lambda c: ascii(c)::UBIGINT) AS c FROM ({FILES_SQL})),
h AS (SELECT path, list_reduce(list_prepend(2166136261::UBIGINT, c), lambda a, x: (xor(a, x) * 16777619) % 4294967296) AS fnv, list_reduce(list_prepend(0::UBIGINT, c), lambda a, x: (a * 31 + x) % 4294967296)::BIGINT AS p FROM c)
SELECT path, fnv::BIGINT AS fnv, lower(to_hex(CASE WHEN p >= 2147483648 THEN 4294967296 - p ELSE p END)) AS short FROM h""",
    "index_health": "SELECT (SELECT count(*) FROM events) AS files, (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM lineitem) = 0 AS incomplete, (SELECT epoch(TIMESTAMP '2024-02-20 00:00:00') - epoch(max(ts)) > 14 * 86400 FROM events) AS possibly_stale",
    "parser_failures": f"SELECT DISTINCT path, 'parseStatus=error' AS message FROM ({PROJECT_SQL}) WHERE ends_with(path, '.php') ORDER BY path LIMIT 40",
    "merged_counts": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'all=1,click=3' ELSE array_to_string(list_sort(['all=1', 'click=2', event_type || '=1']), ',') END AS counts FROM events",
    "usage_fold": f"SELECT kind, sum(greatest(coalesce(n, 1), 1))::BIGINT AS uses, round(coalesce(sum(latency), 0), 3) AS latency_sum, count(latency) AS latency_count, CAST(floor(sum(latency) / count(latency) + 0.5) AS BIGINT) AS latency_avg FROM ({EVENTS_SQL}) GROUP BY kind",
    "last64": f"SELECT kind, id, CAST(n AS INTEGER) AS nth FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY happened DESC, id DESC) AS n FROM ({EVENTS_SQL})) WHERE n <= 64",
    "frequent_sources": f"SELECT path_hash, sum(greatest(coalesce(n, 1), 1))::BIGINT AS uses FROM ({EVENTS_SQL}) GROUP BY path_hash",
    "severity_score": f"""WITH s AS (SELECT l_orderkey, coalesce(sum({_POINTS}) FILTER (l_suppkey % 4 IN (0, 2)), 0) AS f, coalesce(sum({_POINTS}) FILTER (l_suppkey % 4 NOT IN (0, 2)), 0) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(f, 4) AS functionality_penalty, round(s, 4) AS style_penalty, round(greatest(0, least(10, 10 - (f + s))), 2) AS score FROM s""",
    "convention_tiers": f"WITH p AS (SELECT {_FOLDERS}[length(path) % 6 + 1] || path AS path FROM ({PROJECT_SQL})) {_CONVENTIONS}",
    "rival_resolution": f"""WITH c AS (SELECT c_nationkey, {list(conventions.RIVALS)}[ascii(c_mktsegment) % 3 + 1] AS id, count(*) AS evidence FROM customer GROUP BY ALL),
s AS (SELECT *, evidence * CASE evidence % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS strength, evidence % 3 < 2 AS solid FROM c),
w AS (SELECT *, first_value(id) OVER o AS best, first_value(strength) OVER o AS top, first_value(solid) OVER o AS top_solid FROM s WINDOW o AS (PARTITION BY c_nationkey ORDER BY strength DESC, id)),
a AS (SELECT *, id = best OR (strength >= 0.8 * top AND solid AND top_solid) AS active FROM w)
SELECT c_nationkey, id, strength, active, CASE WHEN NOT active THEN best END AS dominated_by FROM a""",
    "convention_dedupe": "SELECT id, ordinal, confidence FROM (SELECT user_id AS id, event_id AS ordinal, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 3 WHEN value > 20 THEN 2 ELSE 1 END DESC, event_id) AS n FROM events) WHERE n = 1",
    "signal_fingerprint": "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS fingerprint FROM events GROUP BY user_id",
    "review_audit": _AUDIT,
    "convention_digest": "SELECT user_id, digest, sha256(user_id || '|' || digest) AS cache_key FROM (SELECT user_id, string_agg(DISTINCT event_type || '@' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END, ',' ORDER BY event_type || '@' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END) AS digest FROM events GROUP BY user_id)",
    "task_risks": f"""SELECT id, coalesce(array_to_string(list_filter([{_RISK_LIST}, CASE WHEN length(text) % 20 >= 12 THEN 'high-callers' END, CASE WHEN length(text) % 2 = 0 THEN 'no-tests' END], lambda v: v IS NOT NULL)[1:8], ','), '') AS risks
FROM (SELECT *, replace(replace(text, ' inea ', ' invoice '), ' edes ', ' fetchAll ') AS t FROM ({FILES_SQL}))""",
}
