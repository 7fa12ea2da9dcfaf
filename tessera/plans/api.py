"""One handle on a project's index: build or refresh it from a file tree, and query it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language
from ..operators import chunks, context, extract, graph, hybrid, metrics, paths, policy, rules, store
from ..sources import workspace


class QueryError(Exception):
    """A query that can't be answered, with a code: empty_index, not_found, ambiguous, outside_workspace."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class ProjectIndex:
    """Files, chunks, symbols and edges of a tree, as versioned Parquet tables below ``storage``."""

    def __init__(self, spark: SparkSession, root: str, storage: str, privacy: DataFrame | None = None):
        self.spark, self.root, self.store = spark, root, store.IndexStore(spark, storage)
        self.privacy = privacy if privacy is not None else policy.rules_frame(spark, policy.DEFAULT_RULES)

    def refresh(self, limit: int | None = 12_000, max_bytes: int | None = workspace.MAX_BYTES) -> int:
        """Index new and changed files, prune gone ones, publish a version; unchanged files are neither cut nor parsed again.

        ``limit`` and ``max_bytes`` are an editor's limits on files and their size; None lifts them.
        """
        kept, _ = workspace.scanned(workspace.workspace(self.spark, self.root, max_bytes), limit, max_bytes)
        decided = policy.privacy_decisions(kept.select("path", "language"), self.privacy)
        now = kept.join(decided.select("path", F.col("classification").alias("privacy")), "path").where("privacy <> 'never_index'")
        now = now.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).persist()
        versions = self.store.versions()
        if versions:
            fresh = store.changed(now, self.store.read("files"))
        else:
            fresh = now
        open_files = fresh.where(F.col("privacy").isin("normal", "local_only", "never_send_to_model"))
        new = {"chunks": chunks.chunk_files(open_files.select("path", "text")), "symbols": extract.symbols(open_files), "edges": self._edges(open_files, now)}
        readable = F.when(F.col("privacy").isin("normal", "local_only", "never_send_to_model"), F.col("text"))
        tables = {"files": now.select("path", "size", "mtime", "language", "hash", "privacy", readable.alias("text"))}
        for name, df in new.items():
            if versions:
                old = store.pruned(store.removed(self.store.read(name), fresh.select("path")), now)
                df = old.unionByName(df)
            tables[name] = df
        try:
            return self.store.publish(tables)
        finally:
            now.unpersist()

    def _edges(self, files: DataFrame, known: DataFrame) -> DataFrame:
        found = extract.with_extensions(extract.edges(files), known)
        return found.select("path", "id", F.col("path").alias("from_path"), F.coalesce("resolved_path", "to_path").alias("to_path"), "kind", "specifier", "from_symbol", "to_symbol", "line", "confidence", "method")

    def table(self, name: str) -> DataFrame:
        if not self.store.versions():
            raise QueryError("empty_index", "nothing is indexed yet: call refresh()")
        return self.store.read(name)

    def search(self, query: str, k: int = 20, for_model: bool = False, **options) -> DataFrame:
        files = self.table("files")
        decisions = policy.with_capabilities(files.select("path", F.col("privacy").alias("classification"))) if for_model else None
        rows = files.select("path", "size", F.unix_millis("mtime").alias("mtime"))
        return hybrid.search(self.table("chunks"), rows, self.table("symbols"), self.table("edges"), query, k, decisions, **options)

    def symbol(self, name: str, path: str | None = None) -> DataFrame:
        """The symbol of this name (its last part counts), with its callers; ambiguous without a path if several files have it."""
        own = self.table("symbols").where((F.lower("name") == name.lower()) | F.lower("name").endswith(f"::{name.lower()}"))
        own = own.where(F.col("path") == path) if path else own
        found = own.limit(2).collect()
        if not found:
            raise QueryError("not_found", f"no symbol {name}")
        if len(found) > 1 and not path:
            raise QueryError("ambiguous", f"{name} is in several places: name a path")
        return own.limit(1).withColumn("callers", F.lit(graph.callers(self.table("edges"), found[0].id).count()))

    def impact(self, path: str, budget: paths.Budget | None = None) -> DataFrame:
        return paths.change_impact(self.table("edges"), self.spark.createDataFrame([(path,)], "node string"), budget)

    def related(self, path: str, query: str, k: int = 20) -> DataFrame:
        seeds = self.spark.createDataFrame([(path,)], "node string")
        return hybrid.related_files(paths.relationship_paths(self.table("edges"), seeds), self.search(query), k)

    def risks(self, own: list[rules.Rule]) -> DataFrame:
        """Findings over the indexed files, best first."""
        texts = self.table("files").where("text IS NOT NULL").select("path", language(F.col("path")).alias("language"), "text")
        return rules.ordered(rules.scan(texts, own))

    def status(self) -> DataFrame:
        """(files, chunks, symbols, edges, freshness)."""
        counts = self.store.counts() if self.store.versions() else {}
        newest = self.table("files").agg(F.max("mtime").alias("at"))
        return newest.select(*[F.lit(counts.get(n, 0)).alias(n) for n in ("files", "chunks", "symbols", "edges")], metrics.freshness(F.col("at"), F.current_timestamp(), 14).alias("freshness"))

    def context_pack(self, task: str, template: str | None = None, own: dict[str, str] | None = None) -> context.Pack:
        plan = context.resolve_template(template, own)
        return context.assemble(task, self.search(task, for_model=True, depth=plan.dependency_depth), self.table("chunks"), self.table("edges"), None, plan)
