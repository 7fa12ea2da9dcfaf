"""Project profile: convention tiers, rivals, de-duplication, signal fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import listed

# Rival answers to where domain work lives, weights of confidence, and path conventions with their tiers.
RIVALS = ("arch:actions-pattern", "layering:services-over-helpers", "arch:commands-and-handlers")
WEIGHT = {"high": 3, "medium": 2, "low": 1}
PATH_CONVENTIONS = (
    # id, label, path pattern, files for high, files for medium
    ("arch:actions-pattern", "Single-action classes", r"(?i)(^|/)actions/", 5, 2),
    ("layering:services-over-helpers", "Services hold domain work", r"(?i)(^|/)services/", 5, 2),
    ("arch:commands-and-handlers", "Commands with handlers", r"(?i)(^|/)(commands|handlers)/", 5, 2),
    ("data:repositories", "Repositories", r"(?i)(^|/)repositories/", 4, 1),
    ("data:dtos", "Data transfer objects", r"(?i)(^|/)(dto|dtos|data)/", 4, 1),
    ("layout:domain", "Domain folders", r"(?i)(^|/)(domain|domains|modules)/", 4, 1),
    ("testing:specs", "Spec files", r"(?i)\.(spec|test)\.", 6, 1),
)


def tier(count: Column, high: int, medium: int = 1) -> Column:
    return F.when(count >= high, "high").when(count >= medium, "medium")


def path_conventions(files: DataFrame, conventions=PATH_CONVENTIONS) -> DataFrame:
    """(id, label, files, confidence) of conventions that paths show: all counts in one pass and one row."""
    counts = files.agg(*[F.count_if(F.col("path").rlike(pattern)).alias(f"c{i}") for i, (_, _, pattern, _, _) in enumerate(conventions)])
    rows = F.array(*[F.struct(F.lit(c[0]).alias("id"), F.lit(c[1]).alias("label"), F.col(f"c{i}").alias("files"), tier(F.col(f"c{i}"), c[3], c[4]).alias("confidence")) for i, c in enumerate(conventions)])
    return counts.select(F.explode(rows).alias("c")).select("c.*").where("confidence IS NOT NULL")


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def deduplicated(conventions: DataFrame) -> DataFrame:
    """One row an id (id, ordinal, confidence, ...): the most confident, the first of equals."""
    w = Window.partitionBy("id").orderBy(F.desc(confidence_weight(F.col("confidence"))), "ordinal")
    return conventions.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def resolved_rivals(conventions: DataFrame, rivals: tuple[str, ...] = RIVALS, group: str | None = None) -> DataFrame:
    """Conventions (id, evidence, confidence) with strength, active and dominated_by.

    Of the rivals (of each ``group``) the strongest wins, the smaller id of equals; another stays active with at
    least 0.8 of the winner's strength while both are at least medium.
    """
    own = conventions.withColumn("strength", F.when(F.col("id").isin(*rivals), F.col("evidence") * confidence_weight(F.col("confidence"))))
    rank = F.when(F.col("strength").isNotNull(), F.struct(-F.col("strength"), "id", "confidence"))
    best = F.min(rank).over(Window.partitionBy(*([group] if group else [])))
    solid = F.col("confidence").isin("medium", "high") & best["confidence"].isin("medium", "high")
    close = (F.col("strength") >= 0.8 * -best["col1"]) & solid & (best["col1"] < 0)
    active = F.col("strength").isNull() | (F.col("id") == best["id"]) | close
    return own.select("*", active.alias("active"), F.when(~active, best["id"]).alias("dominated_by"))


def signal_fingerprint(signals: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint): distinct signals (by, signal), sorted and joined."""
    return signals.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("signal")), "|").alias("fingerprint"))


def manifest_signals(manifests: DataFrame) -> DataFrame:
    """(path, signal): frameworks that package manifests (path, text as JSON) depend on."""
    # Dependencies that name a stack.
    known = {"react": "react", "vue": "vue", "next": "next", "typescript": "typescript", "vitest": "vitest", "jest": "jest", "express": "express", "laravel/framework": "laravel", "pestphp/pest": "pest", "phpunit/phpunit": "phpunit", "livewire/livewire": "livewire"}
    fields = ("dependencies", "devDependencies", "require", "require-dev")
    parsed = manifests.select("path", F.from_json("text", "struct<dependencies:map<string,string>,devDependencies:map<string,string>,require:map<string,string>,`require-dev`:map<string,string>>").alias("m"))
    names = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(F.col("m")[f]), F.array().cast("array<string>")) for f in fields])))
    mapping = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return parsed.select("path", F.explode(names).alias("name")).select("path", F.get(F.array(mapping[F.col("name")]), F.lit(0)).alias("signal")).where("signal IS NOT NULL").distinct()


def profile(files: DataFrame, signals: DataFrame) -> DataFrame:
    """One row (fingerprint, conventions): a project's distinct signals (signal), joined, and the active conventions of its paths as id@confidence, sorted."""
    active = resolved_rivals(path_conventions(files).withColumnRenamed("files", "evidence")).where("active")
    names = active.agg(F.array_sort(F.collect_list(F.concat_ws("@", "id", "confidence"))).alias("conventions"))
    print_ = signals.agg(F.array_join(F.array_sort(F.collect_set("signal")), "|").alias("fingerprint"))
    return print_.crossJoin(names)  # one row each


def declared(spark: SparkSession, path: str) -> DataFrame:
    """Conventions that a project declares in JSON: (id, label, confidence, category)."""
    rows = spark.read.json(path, multiLine=True, schema="conventions array<struct<id:string,label:string,confidence:string,category:string>>")
    return rows.select(F.explode("conventions").alias("c")).select("c.*").where("id IS NOT NULL AND label IS NOT NULL")


# A convention, the paths it speaks about, and text or paths that depart from it.
DIVERGENCES = (
    ("arch:actions-pattern", r"(?i)/services?/", r"(?i)class\s+\w+Service\b", "domain work in a service while actions dominate"),
    ("layering:services-over-helpers", r"(?i)/helpers?/", r"(?i)function\s+\w+", "domain work in a helper while services dominate"),
    ("testing:specs", r"(?i)/tests?/", r"(?i)class\s+\w+Test\b", "test class where spec files are the style"),
    ("typing:strict", r"(?i)\.tsx?$", r":\s*any\b", "untyped value under strict typing"),
)


def divergences(files: DataFrame, active: DataFrame, rules=DIVERGENCES) -> DataFrame:
    """(convention, path, reason): files (path, text) that depart from an active convention (id). One pass over the files; the conventions are a short list."""
    tests = [F.when(F.col("path").rlike(where) & F.col("text").rlike(what), F.struct(F.lit(i).alias("convention"), F.lit(why).alias("reason"))) for i, where, what, why in rules]
    found = files.select("path", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("d")).select("d.convention", "path", "d.reason")
    return found.join(listed(active.select(F.col("id").alias("convention")).distinct()), "convention", "left_semi")
