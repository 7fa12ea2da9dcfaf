"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document's set holds its shingles: the 64-bit hashes of all five consecutive words (of
all its words, where it has fewer). Equal sets are one set, with the number of its copies.

Forest: each of ``trees`` trees gives a set a label of eight MinHash values, one byte
each, so that labels in order are the leaves of a prefix trie and the first d bytes name
its node at depth d. The search begins at full length, where only very similar sets share
a node, and shortens the matched prefix in all trees together. After each level the links
found so far are counted by similarity. A link of similarity s is found at depth d with
probability ``p = 1 - (1 - s**d)**trees``, so each stands for ``1 / p`` links that exist
(Horvitz-Thompson); ``doubt`` adds a share of links right at the threshold, for those of
which nothing was seen. The search ends when the estimate says that the target recall is
reached; else it goes on at the longest prefix for which it promises that. It ends at the
latest at the depth at which a pair at the threshold itself meets with the target
probability.

Verification: sets that share nodes form components (each node links its members to its
smallest, so a node of n members gives n - 1 links, not all pairs), dealt by size and a hash
into blocks of bounded size. Each pair of a component's blocks whose sizes can reach the
threshold is one task's work, once for all trees: a sparse-to-dense matrix product that
counts common shingles. It returns each set's number of links and a spanning forest of them,
never the pairs, so a group of thousands of near copies is dealt over many tasks and gives
rows in proportion to its members and blocks. A shorter prefix is searched anew: it holds
the longer one's candidates, and links are counted once.

Result: one row a document with class_id (the smallest document id of its class, the sets
that chains of links join; its own where it is alone) and n_links (documents, copies
included, whose sets have Jaccard similarity of the threshold or more with its own, itself
left out).

Defined cases: null or wordless texts and rows without id have no set, are alone and have
no links; copies link to each other; rows that share an id are documents of their own,
whether their texts are equal or not, and n_links counts rows; empty tables give no rows;
extra columns aren't read.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, document_windows, map_text, materialise, mix, set_aside, slices, table, utf8, words

#: Says after each level where the search stands, and so at which prefix and recall it ended.
LOG = logging.getLogger(__name__)
SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 8
#: Links at the threshold that the recall estimate supposes for each link found.
DOUBT = 0.01
#: Shingles and documents of one block at most, unless one document has more.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 256
#: Parts into which a join deals the rows of one key.
SALTS = 16
#: Sizes of a band differ by less than this factor.
BAND = 1.25
VERIFIED = "set binary, links long, to binary, bins array<long>"
#: Classes of similarity between threshold and 1 by which links are counted.
BINS = 20


def found_share(similarity: float, depth: int, trees: int) -> float:
    """The probability that a pair shares a node at this depth in some tree; one-byte values also agree by chance."""
    agree = similarity + (1 - similarity) / 256
    return 1 - (1 - agree**depth) ** trees


def guaranteed_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold itself meets with the target probability."""
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(links: list[int], depth: int, at: int, trees: int, threshold: float, doubt: float) -> float:
    """Recall at depth ``at`` by the links found at ``depth``, counted by similarity class from the threshold up: each stands for 1 / p links."""
    classes = [threshold + (1 - threshold) * k / BINS for k in range(BINS)]
    exist = [n / found_share(s, depth, trees) for n, s in zip(links, classes, strict=True)]
    exist[0] += 1 + doubt * sum(links)
    return sum(n * found_share(s, at, trees) for n, s in zip(exist, classes, strict=True)) / sum(exist)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of consecutive documents, and their n+1 offsets."""
    n = len(offsets) - 1
    hashed, _, _, at = words(raw, offsets, ALNUM)
    key, doc, _ = document_windows(hashed, at, SHINGLE)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(n + 1))


def forest_labels(key: np.ndarray, rows: np.ndarray, trees: int) -> np.ndarray:
    """The label of each document with shingles in each tree: eight MinHash values of one byte, the first on top."""
    low, high = (key & U64(0xFFFFFFFF)).astype(np.uint32), (key >> U64(32)).astype(np.uint32)
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 32, (trees, DEPTH, 2), dtype=np.uint32) | np.uint32(1)
    out = np.zeros((len(rows) - 1, trees), U64)
    value = np.empty_like(low)
    for t in range(trees):
        for d in range(DEPTH):
            np.multiply(low, factors[t, d, 0], out=value)
            value ^= value >> np.uint32(15)
            value += high
            value *= factors[t, d, 1]
            least = np.minimum.reduceat(value, rows[:-1]).astype(U64)
            out[:, t] = out[:, t] << U64(8) | mix(least) >> U64(56)
    return out


def digest_of(key: np.ndarray, rows: np.ndarray) -> list[bytes | None]:
    """What identifies each document's set (two sums of its mixed shingles, and their number); none for an empty one."""
    count = np.diff(rows)
    some = np.flatnonzero(count)
    sums = np.zeros((len(count), 2), U64)
    if len(some):
        sums[some, 0] = np.add.reduceat(key, rows[:-1][some])
        sums[some, 1] = np.add.reduceat(mix(key ^ U64(0x5DEECE66D)), rows[:-1][some])
    return [sums[d].tobytes() + int(count[d]).to_bytes(4, "little") if count[d] else None for d in range(len(count))]


def signatures(docs: DataFrame, trees: int, keep: list[str], text_col: str) -> DataFrame:
    """Docs' columns ``keep`` with set (its digest; none without words), n_shingles and labels."""

    def make():
        def work(column):
            raw, offs = utf8(column)
            digest, size, labels = [], [], []
            for a, b in slices(offs):
                key, rows = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1])
                count = np.diff(rows)
                some = np.flatnonzero(count)
                size += count.tolist()
                digest += digest_of(key, rows)
                own = np.zeros((b - a, trees), U64)
                if len(some):
                    own[some] = forest_labels(key, np.append(rows[:-1][some], len(key)), trees)
                labels += [own[d].view(np.int64) if count[d] else None for d in range(b - a)]
            return pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(labels, pa.list_(pa.int64()))

        return work

    return map_text(docs, "set binary, n_shingles long, labels array<long>", make, text_col, keep)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): each component's smallest node, by hooking and contraction.

    In a round every node hooks to its smallest neighbour, pointer jumping takes it to the end of
    its chain, and edges between what is left are all that the next round reads. Of the nodes that
    have an edge at most half are left, most often none, so all rounds together read little more
    than the edges once. Tables of each round are written to the shared folder.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(edges.where("a <> b").select(low, high).distinct(), f"{name}-edges")
    member = None
    while member is None or edges.head(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        label = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), f"{name}-hooks")
        while True:
            above = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
            label = materialise(label.join(above, "root").select("node", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), f"{name}-jumps")
            moved, label = bool(label.where("moved").head(1)), label.select("node", "root")
            if not moved:
                break
        if member is None:
            member = label
        else:
            top = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
            member = materialise(member.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-members")
        to = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        left = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
        edges = materialise(left.select(low, high).distinct(), f"{name}-edges")
    return member


def links_in(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs with Jaccard similarity of the threshold or more, and that: within left (i < j), or of left with right."""
    rest = left if right is None else right
    sizes, other = np.array([len(x) for x in left]), np.array([len(x) for x in rest])
    keys = np.concatenate(left if right is None else left + right)
    owner = np.repeat(np.arange(len(left) + (0 if right is None else len(rest))), np.concatenate([sizes] if right is None else [sizes, other]))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    column = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    times = np.bincount(column)
    shared = times[column] > 1
    renumber = np.cumsum(times > 1) - 1
    column, owner, n_columns = renumber[column[shared]], owner[shared], int((times > 1).sum())
    common = np.zeros((len(left), len(rest)), np.float32)
    for at in range(0, n_columns, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((owner.max() + 1 if right is None else len(left) + len(rest), 4096), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        x = dense[: len(left)]
        y = x if right is None else dense[len(left) :]
        common[: len(x), : len(y)] += x @ y.T
    union = sizes[:, None] + other[None, :] - common
    linked = common >= threshold * union - 1e-6
    if right is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    return i, j, common[i, j] / union[i, j]


def verify(threshold: float):
    """applyInArrow function: the sets of one or two blocks to links per set, a spanning forest, and links by similarity."""

    def work(group: pa.Table) -> pa.Table:
        ids = group["set"].to_pylist()
        block = group["block"].to_numpy()
        copies = group["copies"].to_numpy()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sets = [x.values.to_numpy().view(U64) for x in group["shingles"]]
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        count = np.zeros(len(ids), np.int64)
        to = list(ids)
        bins: list = [None] * len(ids)
        if len(a) and len(b) and not (low == high and len(a) == 1):
            i, j, similarity = links_in([sets[k] for k in a], None if low == high else [sets[k] for k in b], threshold)
            i, j = a[i], (a if low == high else b)[j]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            level = np.clip((similarity - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(np.int64) if threshold < 1 else np.full(len(i), BINS - 1)
            bins[0] = np.bincount(level, minlength=BINS).tolist()
            root = list(range(len(ids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    p, q = (p, q) if ids[p] < ids[q] else (q, p)
                    root[q] = p
                    to[q] = ids[p]
        return pa.table({"set": pa.array(ids, pa.binary()), "links": pa.array(count, pa.int64()), "to": pa.array(to, pa.binary()), "bins": pa.array(bins, pa.list_(pa.int64()))})

    return work


def shingles_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, shingles) of the sets in wanted (set, id, text_hash)."""

    def make():
        def work(column):
            raw, offs = utf8(column)
            digest, out = [], []
            for a, b in slices(offs):
                key, rows = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1])
                digest += digest_of(key, rows)
                out += np.split(key.view(np.int64), rows[1:-1])
            return [pa.array(digest, pa.binary()), pa.array(out, pa.list_(pa.int64()))]

        return work

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("body"))
    texts = texts.join(wanted.select("id", "text_hash"), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    return map_text(texts, "set binary, shingles array<long>", make, "body", [])


def blocks_at(leaves: DataFrame, sizes: DataFrame, depth: int) -> DataFrame:
    """(set, copies, n_shingles, root, block): the components that nodes at this depth make, dealt by size and a hash into blocks of bounded size."""
    cut = leaves.withColumn("prefix", F.shiftrightunsigned("label", 8 * (DEPTH - depth)))
    smallest = cut.groupBy("tree", "prefix").agg(F.min("set").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = cut.join(smallest, ["tree", "prefix"]).where("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()
    member = components(edges, "candidates")
    sized = sizes.join(member.withColumnRenamed("node", "set"), "set").withColumn("band", F.floor(F.log("n_shingles") / math.log(BAND)))
    sized = materialise(sized.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")), "candidate-sets")
    cells = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    bands = sized.groupBy("root", "band").agg(cells.alias("cells")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cell = F.pmod(F.xxhash64("set", F.lit(1)), F.col("cells"))
    return sized.join(bands, ["root", "band", "salt"]).select("set", "copies", "n_shingles", "root", (F.shiftleft(F.col("band"), 32) + cell).alias("block"))


def verified_at(leaves: DataFrame, sizes: DataFrame, sets: DataFrame, depth: int, threshold: float) -> DataFrame:
    """VERIFIED rows of the candidates that share a node at this depth: pairs of a component's blocks whose sizes can reach the threshold."""
    blocked = materialise(blocks_at(leaves, sizes, depth), f"blocks-{depth}")
    ranges = blocked.groupBy("root", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    other = ranges.select("root", F.col("block").alias("high"), F.col("least").alias("high_least"), F.col("most").alias("high_most"))
    near = (F.col("most") >= threshold * F.col("high_least") - 1e-6) & (F.col("high_most") >= threshold * F.col("least") - 1e-6)
    pairs = ranges.join(other, "root").where((F.col("block") <= F.col("high")) & near).select("root", F.col("block").alias("low"), "high")
    sides = pairs.select("root", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    work = blocked.join(sides, ["root", "block"]).join(sets, "set").select("root", "low", "high", "set", "copies", "block", "shingles")
    return materialise(work.groupBy("root", "low", "high").applyInArrow(verify(threshold), VERIFIED), f"verified-{depth}")


def links_of(docs: DataFrame, reps: DataFrame, threshold: float, recall: float, trees: int, doubt: float, id_col: str, text_col: str) -> DataFrame:
    """(set, links, to) of the verified candidates at the longest prefix that reaches the target recall."""
    shortest = guaranteed_depth(trees, DEPTH, threshold, recall)
    leaves = reps.select("set", F.posexplode("labels").alias("tree", "label"))
    end = leaves.withColumn("end", F.shiftrightunsigned("label", 8 * (DEPTH - shortest)))
    common = end.groupBy("tree", "end").agg(F.count("*").alias("n")).where("n > 1").select("tree", "end")
    leaves = materialise(end.join(common, ["tree", "end"]).drop("end"), "forest-leaves")
    sizes = materialise(reps.join(leaves.select("set").distinct(), "set", "left_semi").select("set", "copies", "n_shingles", "first.id", "first.text_hash"), "forest-sizes")
    sets = materialise(shingles_of(docs, sizes, id_col, text_col), "sets")
    sizes, depth = sizes.select("set", "copies", "n_shingles"), DEPTH
    while True:
        found = verified_at(leaves, sizes, sets, depth, threshold)
        counts = [0] * BINS
        for row in found.select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
            counts[row["k"]] += row["n"]
        reached = estimated_recall(counts, depth, depth, trees, threshold, doubt)
        LOG.info("prefixes of %d of %d values: %d links between different sets, estimated recall %.6f", depth, DEPTH, sum(counts), reached)
        if depth == shortest or reached >= recall:
            return found.select("set", "links", "to")
        depth = next((d for d in range(depth - 1, shortest, -1) if estimated_recall(counts, depth, d, trees, threshold, doubt) >= recall), shortest)


def classes_of(docs: DataFrame, threshold: float, recall: float, trees: int, doubt: float, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, wordless, first: id and text_hash of the class's first document, n_links), one row a document."""
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("body"))
    signed = signatures(hashed, trees, ["id", "text_hash"], "body")
    signed = materialise(signed.withColumn("set", F.when(F.col("id").isNotNull(), F.col("set"))), "forest")
    reps = signed.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    reps = materialise(reps, "forest-sets")
    found = links_of(docs, reps, threshold, recall, trees, doubt, id_col, text_col)
    counted = found.groupBy("set").agg(F.sum("links").alias("links"))
    member = components(found.where("set <> to").select(F.col("set").alias("a"), F.col("to").alias("b")), "classes")
    member = materialise(member.join(reps.select(F.col("set").alias("node"), "first"), "node"), "class-members")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    smallest = member.groupBy("root").agg(F.min("first").alias("smallest")).select("root", "smallest", salts)
    named = member.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(smallest, ["root", "salt"]).select(F.col("node").alias("set"), "smallest")
    final = reps.select("set", "first", "copies").join(counted, "set", "left").join(named, "set", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    final = materialise(final.select("set", "copies", "first", F.coalesce("smallest", "first").alias("smallest"), links), "classes-of-sets")
    once = final.where("copies = 1").select("first.id", "first.text_hash", F.lit(False).alias("wordless"), F.col("smallest").alias("first"), "n_links")
    copied = final.where("copies > 1").select("set", F.col("smallest").alias("first"), "n_links", salts)
    dealt = signed.select("id", "text_hash", "set", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    more = dealt.where("set IS NOT NULL").join(copied, ["set", "salt"]).select("id", "text_hash", F.lit(False).alias("wordless"), "first", "n_links")
    alone = signed.where("set IS NULL").select("id", "text_hash", F.lit(True).alias("wordless"), F.struct("id", "text_hash").alias("first"), F.lit(0).cast("long").alias("n_links"))
    return once.unionByName(more).unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, doubt: float = DOUBT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links), one row a document; see the module."""
    found = classes_of(docs, threshold, recall, trees, doubt, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, doubt: float = DOUBT) -> DataFrame:
    """One document of each class, the one with the smallest id; wordless documents and those without id all stay; columns as they were."""
    own, back = set_aside(docs, ["__text_hash"])
    found = materialise(classes_of(docs, threshold, recall, trees, doubt, "doc_id", "text").where("NOT wordless"), "kept-classes")
    is_first = (F.col("id") == F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    key = [F.col("id").alias("doc_id"), F.col("text_hash").alias("__text_hash")]
    gone = found.where(~is_first).select(*key).distinct()
    kept = own.withColumn("__text_hash", F.xxhash64("text")).join(gone, ["doc_id", "__text_hash"], "left_anti")
    often = found.where(is_first).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if often.head(1):  # equal rows: one of them stays
        on = ["doc_id", "__text_hash"]
        kept = kept.join(often, on, "left_anti").unionByName(kept.join(often, on, "left_semi").dropDuplicates(on))
    return kept.drop("__text_hash").withColumnsRenamed(back).select(*[f"`{c}`" for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN len(w) || ' ' ELSE '' END || array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 0.000001),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id,
  CAST((SELECT count(*) FROM l WHERE l.a = doc_id) AS BIGINT) AS n_links FROM d
"""

QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES = {"op2_ngram_join": SQL}
