"""Index tables: change detection, replacement, removal, pruning, and a Parquet store that publishes whole snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.markers import file_system, make_once, read_text


def changed(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned files (path, hash, privacy) that are new or differ in hash or privacy class."""
    old = stored.select("path", F.col("hash").alias("old_hash"), F.col("privacy").alias("old_privacy"))
    both = scanned.join(old, "path", "left")
    return both.where(~(F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("privacy").eqNullSafe(F.col("old_privacy")))).drop("old_hash", "old_privacy")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows, all of a fresh key's replaced by its fresh rows."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def pruned(stored: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(present.select(key).distinct(), key, "left_semi")


def removed(stored: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def replaced_edges(edges: DataFrame, fresh: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges after files were indexed anew: those from the paths go, as do those whose named target symbol is gone; fresh ones come, the first of an id stays."""
    kept = edges.join(paths.select(F.col("path").alias("from_path")).distinct(), "from_path", "left_anti")
    ids = symbols.select(F.col("id").alias("to_symbol")).distinct()
    kept = kept.where("to_symbol IS NULL").unionByName(kept.where("to_symbol IS NOT NULL").join(ids, "to_symbol", "left_semi"))
    return appended(kept, fresh)


def removed_file_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that neither start nor end in a removed file."""
    for end in ("from_path", "to_path"):
        edges = edges.join(gone.select(F.col("path").alias(end)).distinct(), end, "left_anti")
    return edges


def appended(edges: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Edges and those fresh ones whose id is new."""
    return edges.unionByName(fresh.dropDuplicates([key]).join(edges.select(key), key, "left_anti"))


def merged_status(fresh: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Extracted rows with the status and edits that people gave stored ones; stored rows that a person settled stay."""
    old = stored.select(key, F.col("status").alias("old_status"), F.col("text").alias("old_text"))
    both = fresh.join(old, key, "full_outer")
    settled = F.col("old_status").isin("confirmed", "edited", "rejected")
    kept = both.where(F.col("text").isNotNull() | settled)
    return kept.select(key, F.when(F.col("old_status") == "edited", F.col("old_text")).otherwise(F.coalesce("text", "old_text")).alias("text"), F.coalesce("old_status", "status").alias("status"))


def apply_changes(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored (path, hash, text) after changes (seq, type, path, new_path, hash, text): the last change of each path counts; a rename removes the old and adds the new path."""
    moved = changes.where("type = 'rename'")
    rows = changes.where("type <> 'rename'").select("seq", "path", (F.col("type") != "delete").alias("lives"), "hash", "text")
    rows = rows.unionByName(moved.select("seq", "path", F.lit(False).alias("lives"), "hash", "text")).unionByName(moved.select("seq", F.col("new_path").alias("path"), F.lit(True).alias("lives"), "hash", "text"))
    last = rows.groupBy("path").agg(F.max_by(F.struct("lives", "hash", "text"), F.struct("seq", "lives")).alias("r")).select("path", "r.*")
    return removed(stored, last).unionByName(last.where("lives").select("path", "hash", "text"))


def with_parents(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files (path, hash) and one for each path that only chunks (path, file_hash) name."""
    named = chunks.groupBy("path").agg(F.min("file_hash").alias("file_hash"))
    return files.join(named, "path", "full_outer").select("path", F.coalesce("hash", "file_hash").alias("hash"), F.col("hash").isNull().alias("implicit"))


class VersionTaken(RuntimeError):
    """Somebody else published the version that was to be published; read again and start from there."""


class IndexStore:
    """Tables of one index as Parquet below a root folder, each dealt into hash buckets of its key.

    A version is one marker file, which can be made only once and says for each table and bucket
    which folder holds it. A publish writes the buckets that it changes, each attempt in folders of
    its own, and takes the others over from the version before; then it makes the marker. So readers
    see whole versions, a small change rewrites few buckets, of two publishers of one version one
    fails with VersionTaken, and what a lost one left is never read.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.root}/versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def marker(self, version: int | None = None) -> dict:
        """What a version (the last one) says: tables, their keys, schemas and buckets, and notes."""
        found = version or max(self.versions(), default=0)
        if not found:
            raise FileNotFoundError(f"no published version below {self.root}")
        return json.loads(read_text(self.spark, f"{self.root}/versions/{found}"))

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str = "path") -> list[int]:
        """Buckets that hold these keys; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(column)).alias("b")).distinct().collect())

    def publish(self, tables: dict[str, DataFrame], only: dict[str, list[int]] | None = None, notes: dict | None = None, base: int | None = None) -> int:
        """Make the version after ``base`` (the last one) of these tables.

        Tables that ``only`` names hold the new rows of those buckets alone, and all their other
        buckets stay; so do tables that aren't given, while ``only`` is.
        """
        before = max(self.versions(), default=0) if base is None else base
        held = self.marker(before) if before else {"tables": {}, "notes": {}}
        out = {"tables": dict(held["tables"]) if only is not None else {}, "notes": {**held["notes"], **(notes or {})}}
        for name, df in tables.items():
            key = "path" if "path" in df.columns else df.columns[0]
            folder = f"{name}/{uuid.uuid4().hex}"
            # one task a bucket, or several where it is large
            dealt = df.withColumn("bucket", self.bucket_of(F.col(key))).repartition("bucket", F.pmod(F.hash(*df.columns), F.lit(4)))
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            fs, at = file_system(self.spark, f"{self.root}/{folder}")
            new = {p.split("=")[1]: folder for p in (s.getPath().getName() for s in fs.listStatus(at)) if p.startswith("bucket=")}
            if only is not None and name in only:
                new |= {b: f for b, f in held["tables"][name]["buckets"].items() if int(b) not in only[name]}
            out["tables"][name] = {"key": key, "schema": df.schema.jsonValue(), "buckets": new}
        if not make_once(self.spark, f"{self.root}/versions/{before + 1}", json.dumps(out)):
            raise VersionTaken(f"version {before + 1} below {self.root}")
        return before + 1

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version (the last one), or some of its buckets."""
        held = self.marker(version)["tables"][name]
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in held["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def wipe(self) -> int:
        """Publish a version in which every table is empty; older versions stay readable by number."""
        return self.publish({name: self.read(name).limit(0) for name in self.marker()["tables"]})

    def counts(self) -> dict[str, int]:
        return {name: self.read(name).count() for name in self.marker()["tables"]}

    def clean(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions reads, and older markers; how many went. Not while somebody publishes."""
        kept = self.versions()[-keep:]
        used = {f for v in kept for t in self.marker(v)["tables"].values() for f in t["buckets"].values()}
        fs, root = file_system(self.spark, self.root)
        gone = 0
        for table in fs.listStatus(root):
            name = table.getPath().getName()
            for entry in fs.listStatus(table.getPath()):
                own = entry.getPath().getName()
                if own not in map(str, kept) if name == "versions" else f"{name}/{own}" not in used:
                    gone += fs.delete(entry.getPath(), True)
        return gone


def migrated(old: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows of an older schema with defaults for columns that they lack."""
    return old.withColumns({c: default for c, default in columns.items() if c not in old.columns})
