"""URL filters by a Bloom filter cascade: exact membership without joins, DataFrame functions only.

The universe is every key that the corpus's URLs can be judged by: host suffixes with as
many labels as some rule has, joined with path prefixes as long as some rule's. Level 1
encodes the listed keys of the universe, level 2 the other keys that level 1 takes for
listed, level 3 the listed ones that level 2 takes for those, and so on until none is
left; the first level that rejects a key tells its side. A key's side is so exact for the
whole universe. One cascade tells listed keys, a second one which of them block.

Building scans the distinct keys once a level and collects only a level's non-zero bytes, as
Arrow columns. Their number is bounded by the listed keys (``max_listed``, checked before; a
longer list is refused and belongs in a semi join): a level takes at most 43 bits a key, so 27
MB at the default, and stands once in the plan. Judging is a projection of the URL column:
no join, no shuffle.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule;
repeated rows are judged alike; a URL that no rule fits takes the default verdict; empty
tables give no rows; extra columns stay unless a result takes their name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, set_aside, table

# The contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


@dataclass
class Level:
    bits: int
    hashes: int
    data: bytes

    def positions(self, key: Column, number: int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)])

    def takes(self, key: Column, number: int) -> Column:
        """Whether all of the key's bits are set."""
        data = F.lit(self.data)

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1

        return F.forall(self.positions(key, number), is_set)


@dataclass
class BloomCascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            out = F.when(self.levels[number - 1].takes(key, number), out).otherwise(F.lit(number % 2 == 0))
        return out


def sized(n: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and hashes for n keys against so many others: about as many false positives as keys at first, then one half."""
    rate = min(0.5, max(1e-9, n / max(1, others))) if first else 0.5
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 8) * 8, max(1, round(bits / max(1, n) * math.log(2)))


def encode(keys: DataFrame, bits: int, hashes: int, number: int) -> Level:
    level = Level(bits, min(hashes, 24), b"")
    at = F.explode(level.positions(F.col("key"), number)).alias("at")
    found = keys.select(at).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("mask")).toArrow()
    level.data = filled(bits // 8, found["byte"].to_pylist(), found["mask"].to_pylist())
    return level


def filled(size: int, at: list[int], values: list[int]) -> bytes:
    """``size`` bytes with values at some places, else 0."""
    data = bytearray(size)
    for k, value in zip(at, values, strict=True):
        data[k] = value
    return bytes(data)


def build(universe: DataFrame, listed: DataFrame, max_listed: int = 5_000_000, max_levels: int = 64) -> BloomCascade:
    """Cascade that tells which keys of ``universe`` are in ``listed`` (one string column ``key`` each)."""
    tagged = universe.select("key", F.lit(0).alias("side")).unionByName(listed.select("key", F.lit(2).alias("side")))
    tagged = tagged.groupBy("key").agg(F.max("side").alias("top"), F.min("side").alias("low")).where("low = 0")
    tagged = materialise(tagged.select("key", (F.col("top") == 2).alias("listed")), "cascade-keys")
    sides = {row["listed"]: row["count"] for row in tagged.groupBy("listed").count().collect()}
    if sides.get(True, 0) > max_listed:
        raise ValueError(f"{sides[True]} listed keys: more than max_listed; mark them with a join")
    cascade, left, size = BloomCascade(), tagged, sides.get(True, 0)
    while size:
        number = len(cascade.levels) + 1
        own = number % 2 == 1
        bits, hashes = sized(size, sides.get(False, 0), number == 1)
        level = encode(left.where(F.col("listed") == own), bits, hashes, number)
        cascade.levels.append(level)
        # the other side's keys that this level takes, and this side's, go on
        left = left.where((F.col("listed") == own) | level.takes(F.col("key"), number))
        size = left.where(F.col("listed") != own).count()
        if number == max_levels:
            raise ValueError("the cascade doesn't end")
    return cascade


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def candidates(rules) -> Column:
    """Keys that a URL can be judged by, longest first."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    parts = F.split("host", r"\.")
    suffix = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: F.size(parts) >= n), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefix = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length("path") >= n), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffix, lambda s: F.transform(prefix, lambda p: F.concat(s, p))))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.length(b) - F.length(a))


def judge(df: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (the longest that fits, else null) and verdict."""
    spark = df.sparkSession
    own, back = set_aside(df, ["__keys"])
    split = split_url(own, url_col).withColumn("__keys", candidates(rules))
    universe = split.select(F.explode("__keys").alias("key")).distinct()
    listed = spark.createDataFrame([(h + p, v) for v, h, p in rules], "key string, verdict string")
    rule_cascade = build(universe, listed)
    block_cascade = build(listed.select("key"), listed.where("verdict = 'block'"))
    found = split.withColumn("rule", F.get(F.filter("__keys", rule_cascade.contains), F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(block_cascade.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", verdict).drop("__keys").withColumnsRenamed(back)


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

SQL = f"""
WITH rules(verdict, rh, rp) AS (VALUES {_RULE_ROWS}),
r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

QUERIES = {"op6_url_cascade": op6_url_cascade}
ORACLES = {"op6_url_cascade": SQL}
