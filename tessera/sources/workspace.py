"""File trees as DataFrames: which files are indexed, and what they are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension, language
from ..operators.policy import glob_regex, ignore_regex
from .markers import exists
from .trees import HIDDEN_KEPT, IGNORE_FILE, SKIP_FOLDERS, read_tree

# Files and types to index, and types that aren't text.
INDEX_NAMES = ("dockerfile", "makefile", ".env.example", ".cursorrules", ".editorconfig", "composer.json", "package.json")
INDEX_TYPES = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "php", "md", "mdx", "mdc", "json", "yml", "yaml", "css", "scss", "html", "sql", "toml", "xml", "graphql", "prisma", "vue", "py")
BINARY_TYPES = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "woff", "woff2", "ttf", "mp4", "mp3", "exe", "dll", "so", "wasm", "sqlite", "db")
MAX_BYTES = 400_000
TEMPORARY = r"(?i)(~$|\.tmp$|\.tmp\.|\.swp$|\.swo$|\.bak$|(^|/)\.#|(^|/)~\$)"


def workspace(spark: SparkSession, root: str, max_bytes: int | None = MAX_BYTES, ignore: str = IGNORE_FILE) -> DataFrame:
    """FILE rows below a root that driver and executors share, without what ignore files exclude; texts of files up to max_bytes (None: of all)."""
    return read_tree(spark, root, max_bytes=max_bytes, ignore=ignore).where("reason IS NULL").drop("reason")


def exclusion(path: Column, size: Column, has_nul: Column, max_bytes: int | None = MAX_BYTES) -> Column:
    """Why a file isn't indexed, the first reason that holds; null for one that is."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    hidden = lambda p: p.startswith(".") & ~p.isin(*HIDDEN_KEPT)
    above = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    folder = F.exists(F.split(path, "/"), lambda p: p.isin(*SKIP_FOLDERS)) | F.exists(above, hidden)
    known = name.isin(*INDEX_NAMES) | extension(path).isin(*INDEX_TYPES)
    return (
        F.when(folder, "excluded-folder")
        .when(path.rlike(TEMPORARY), "temporary")
        .when(extension(path).isin(*BINARY_TYPES), "binary")
        .when(~known, "unsupported")
        .when(F.lit(False) if max_bytes is None else size > max_bytes, "too-large")
        .when(has_nul, "binary")
    )


def priority(path: Column) -> Column:
    """Order of indexing: steering documents, manifests, sources, the rest."""
    return F.when(path.rlike(r"(?i)(^|/)(agents|claude|architecture|conventions|contributing|readme)\.md$"), 3).when(path.rlike(r"(^|/)(package|composer)\.json$"), 2).when(language(path).isin("typescript", "javascript", "php", "python"), 1).otherwise(0)


def scanned(files: DataFrame, limit: int | None = 12_000, max_bytes: int | None = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(indexed files by priority and path, at most ``limit``, all with None; excluded files with reason)."""
    tagged = files.withColumn("reason", exclusion(F.col("path"), F.col("size"), F.coalesce("has_nul", F.lit(False)), max_bytes))
    kept = tagged.where("reason IS NULL").drop("reason").withColumns({"language": language(F.col("path")), "priority": priority(F.col("path"))})
    kept = kept if limit is None else kept.orderBy(F.desc("priority"), "path").limit(limit)
    return kept, tagged.where("reason IS NOT NULL").select("path", "reason")


def conflict_candidates(files: DataFrame) -> DataFrame:
    """Files whose code conflict rules are held against."""
    folder = F.exists(F.split("path", "/"), lambda p: p.isin(*SKIP_FOLDERS))
    return files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|php)$") & ~folder)


def containing(files: DataFrame, fragments: list[str], limit: int | None = None) -> DataFrame:
    """Files whose paths contain one of the fragments, in order; ``limit`` keeps the first (a listing's limit)."""
    found = files.where(F.exists(F.array(*map(F.lit, fragments)), lambda f: F.col("path").contains(f)))
    return found if limit is None else found.orderBy("path").limit(limit)


def memory_files(files: DataFrame, folder: str = ".memory") -> DataFrame:
    """(path, kept files' columns): the root's steering documents, one a name whatever its case (as written first), and the Markdown files of the memory folder outside its index."""
    from ..operators.chunks import PRIORITY_MEMORY

    low = F.lower("path")
    root = files.where(low.isin(*PRIORITY_MEMORY)).withColumn("nth", F.row_number().over(Window.partitionBy(low).orderBy(F.desc(F.col("path") == low), "path"))).where("nth = 1").drop("nth")
    below = files.where(F.col("path").startswith(f"{folder}/") & F.col("path").endswith(".md") & ~F.col("path").contains("/rag/"))
    return root.unionByName(below)


def glob_candidates(files: DataFrame, globs: list[str], most: int = 80) -> DataFrame:
    """(pattern, path): the first paths that each glob fits (a proposal's limit); globs are compiled into one pass."""
    fits = F.filter(F.array(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in globs]), lambda g: g.isNotNull())
    w = Window.partitionBy("pattern").orderBy("path")
    return files.select("path", F.explode(fits).alias("pattern")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("pattern", "path")


def ignore_layers(spark: SparkSession, files: DataFrame, names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """(dir, rule_no, pattern_regex, negated) of a tree's ignore files, for operators.policy.ignored."""
    rows = []
    for f in files.where(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path", "text").collect():
        for n, line in enumerate((f.text or "").splitlines()):
            rule = line.strip()
            if rule and not rule.startswith("#"):
                rows.append((f.path.rpartition("/")[0], n, ignore_regex(rule.lstrip("!")), rule.startswith("!")))
    return spark.createDataFrame(rows, "dir string, rule_no int, pattern_regex string, negated boolean")


def rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON packs (id, category, severity, title, patterns, negativePatterns, languages); malformed ones are dropped."""
    item = "struct<id:string,category:string,severity:string,title:string,patterns:array<string>,negativePatterns:array<string>,languages:array<string>>"
    rows = spark.read.json(path, multiLine=True, schema=f"rules array<{item}>").select(F.explode("rules").alias("r")).select("r.*")
    return rows.where("id IS NOT NULL AND category IS NOT NULL AND size(patterns) > 0")


def as_rules(rows: DataFrame) -> list:
    """Rule objects of a pack's rows; patterns that don't compile are dropped."""
    from ..operators.rules import Rule

    out = []
    for r in rows.collect():
        good = []
        for p in r.patterns:
            try:
                re.compile(p)
                good.append(p)
            except re.error:
                continue
        if good:
            out.append(Rule(r.id, r.category, r.severity or "warning", r.title or r.id, tuple(good), tuple(r.negativePatterns or ()), tuple(r.languages or ("*",)), origin="pack"))
    return out


#: Rows of an older index: its tables, and the columns that this engine gives them.
OLD_FILE = "path:string,hash:string,language:string,byteLength:bigint,privacy:string"
OLD_CHUNK = "id:string,path:string,text:string,startLine:int,endLine:int,kind:string,weight:double,fileHash:string"
OLD_SYMBOL = "id:string,name:string,kind:string,path:string,startLine:int,endLine:int,language:string,exported:boolean"
OLD_EDGE = "id:string,fromPath:string,toPath:string,kind:string,specifier:string,fromSymbol:string,toSymbol:string,startLine:int,confidence:string,resolutionMethod:string"
OLD_INDEX = f"version int, files map<string,struct<{OLD_FILE}>>, chunks map<string,struct<{OLD_CHUNK}>>, symbols map<string,struct<{OLD_SYMBOL}>>, edges array<struct<{OLD_EDGE}>>, explanations map<string,string>"
OLD_VERSIONS = (1, 4)


def snake(name: str) -> str:
    return re.sub("([A-Z])", r"_\1", name).lower()


def old_indexes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """OLD_INDEX rows of JSON indexes (a file each, or one a line) of the versions that are understood and have chunks; what can't be read isn't one."""
    rows = spark.read.json(path, schema=OLD_INDEX, multiLine=not lines)
    return rows.where(F.col("version").between(*OLD_VERSIONS) & F.col("chunks").isNotNull())


def old_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """files, chunks, symbols, edges and explanations of OLD_INDEX rows; what an older version lacks is empty, its columns null."""
    out = {}
    for name in ("files", "chunks", "symbols"):
        fields = [f.split(":")[0] for f in {"files": OLD_FILE, "chunks": OLD_CHUNK, "symbols": OLD_SYMBOL}[name].split(",")]
        key = "path" if name == "files" else "id"
        own = rows.select(F.explode(name).alias("k", "v"))
        out[name] = own.select(*[(F.coalesce("v." + f, "k") if f == key else F.col("v." + f)).alias({"byteLength": "size"}.get(f, snake(f))) for f in fields])
    out["edges"] = rows.select(F.explode("edges").alias("v")).select(*[F.col("v." + f.split(":")[0]).alias({"resolutionMethod": "method"}.get(f.split(":")[0], snake(f.split(":")[0]))) for f in OLD_EDGE.split(",")])
    out["explanations"] = rows.select(F.explode("explanations").alias("id", "text"))
    return out


def old_index(spark: SparkSession, path: str) -> DataFrame:
    """Files of a JSON index of versions 1 to 4: (path, hash, language, size, privacy); later columns are null in older ones."""
    return old_tables(old_indexes(spark, path))["files"]


def recovered(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame]]:
    """Where an old index was found (whole, temporary, empty), and its tables: the file itself, else the one that a writer left beside it, else nothing."""
    for state, candidate in (("whole", path), ("temporary", f"{path}.tmp")):
        if exists(spark, candidate):
            rows = old_indexes(spark, candidate)
            if rows.head(1):
                return state, old_tables(rows)
    return "empty", old_tables(spark.createDataFrame([], OLD_INDEX))


def context_documents(files: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(path, doc_type, authored, confidence, binding, scope, user_configured, text): steering and documentation files of a tree, each once; configured ones (path) count as such wherever they lie."""
    from ..operators.context_paths import context_class

    known = F.lower("path").rlike(r"\.(md|mdx|mdc)$|(^|/)\.(cursor|windsurf)rules$")
    marked = files.withColumn("user_configured", F.lit(False)) if configured is None else files.join(configured.select("path", F.lit(True).alias("__own")).distinct(), "path", "left").withColumn("user_configured", F.coalesce("__own", F.lit(False)))
    rows = marked.where(known | F.col("user_configured")).withColumn("c", context_class(F.col("path"), F.col("user_configured")))
    return rows.where((F.col("c.confidence") != "low") | F.col("user_configured")).select("path", "c.*", "user_configured", "text")


def instruction_documents(documents: DataFrame) -> DataFrame:
    """(path, rules): each context document's list items that read as instructions, in order."""
    from ..operators.chunks import bullets, looks_like_instruction

    found = bullets(documents).where(looks_like_instruction(F.col("text")))
    return found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("rules"))
