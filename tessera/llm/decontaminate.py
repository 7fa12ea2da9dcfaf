"""Benchmark decontamination by suffix arrays of the training text.

Each Arrow slice of documents is a shard. Its words become numbers (those of the
benchmark's words; compared by their bytes), and the suffixes of its documents are sorted
by prefix doubling: the order of the first 1, 2, 4, ... words from each position, until it
covers the longest item. Every suffix of every item is binary-searched in that order, block
of words by block, which narrows the range of training suffixes that begin alike. At 13
words the range holds a window's occurrences; ranges are marked as such, so a word that is
repeated a million times costs as much as a million words. Going on as long as a range
stays gives each test suffix's longest verbatim match; neighbours in the order share it as
far as they begin alike, which gives each document's longest match with its place in the
document and in the item.

A document where no ``shortest`` words in a row are the benchmark's (a filter by hash tells
most) has no match of that length, and its suffixes aren't sorted.

Only the benchmark leaves its executors: it is read in blocks of at most ``block_words``
words, and each block is broadcast for one pass over the documents, so what is broadcast
has a bound that doesn't depend on either table. The documents are never shuffled. Suffix
arrays aren't stored: they are several times as long as the text, and sorting the few
documents that need it is cheaper than reading them.

Defined cases: a null or empty text has no words, no hits and isn't contaminated; an
item without words is in nothing; repeated rows are each judged by themselves; items of
one id are named once, whatever the number of blocks; ``longest`` is null below
``shortest`` words and names one of several equal ones; empty tables give no rows, or rows
without hits; input columns whose names the results take are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, map_text, owners, set_aside, slices, string_lists, table, utf8, windows, words

WINDOW, SHORTEST = 13, 5
SHARD_BYTES = 4 << 20
LONGEST = "struct<words:int,start:int,item:string,item_start:int>"
FIELDS = f"n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, items array<string>, longest {LONGEST}"
RESULTS = ["n_words", "n_hit", "hit_spans", "items", "longest"]
#: Pairs of document and item that are listed at a time.
PAIRS = 2_000_000


def same_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether words of equal hash have equal bytes; up to 8 bytes, equal hash and length say so."""
    same = end - start == other_end - other_start
    for k in np.flatnonzero(same & (end - start > 8)).tolist():
        same[k] = np.array_equal(raw[start[k] : end[k]], other[other_start[k] : other_end[k]])
    return same


class Block:
    """Items of a part of the benchmark as numbered words; a 0 ends each item."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, shortest: int = SHORTEST):
        self.ids, self.window = ids, window
        raw, offs = utf8(pa.array(texts, pa.string()))
        hashed, start, end, at = words(raw, offs, ALNUM)
        self.letters = ALNUM[raw]
        self.hashes, first, number = np.unique(hashed, return_index=True, return_inverse=True)
        self.start, self.end = start[first], end[first]
        # of two words with one hash, the second has no number and is never found
        number = np.where(same_words(self.letters, start, end, self.letters, self.start[number], self.end[number]), number + 1, -1)
        count = np.diff(at)
        self.item = owners(at)
        self.words = np.zeros(len(hashed) + len(ids), np.int64)
        self.place = np.arange(len(hashed)) + self.item
        self.words[self.place] = number
        self.left = at[1:][self.item] - np.arange(len(hashed))  # words to the item's end
        self.first = np.arange(len(hashed)) == at[:-1][self.item]
        self.count = count[self.item]
        self.item_start = at[:-1]
        self.longest = int(count.max(initial=0))
        lengths = count[(count > 0) & (count < window)]
        self.shortest = shortest
        self.probe = min(shortest, int(lengths.min(initial=window)))
        some = np.flatnonzero(self.left >= self.probe)
        self.probes = np.unique(windows(hashed, self.probe)[some]) if self.longest >= self.probe else np.zeros(0, np.uint64)

    def numbers(self, raw: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of a shard's words, 0 for words that the benchmark hasn't."""
        at = np.minimum(np.searchsorted(self.hashes, hashed), max(0, len(self.hashes) - 1))
        found = np.flatnonzero(self.hashes[at] == hashed)
        found = found[same_words(ALNUM[raw], start[found], end[found], self.letters, self.start[at[found]], self.end[at[found]])]
        out = np.zeros(len(hashed), np.int64)
        out[found] = at[found] + 1
        return out

    def touches(self, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Documents in which some window of ``probe`` words has the hash of one of the benchmark's."""
        key = windows(hashed, self.probe)
        if not len(key) or not len(self.probes):
            return np.zeros(0, np.int64)
        bits = np.zeros(1 << 20, bool)
        bits[(self.probes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(bits[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.probes, key[maybe]), len(self.probes) - 1)
        return np.unique(np.searchsorted(at, maybe[self.probes[near] == key[maybe]], "right") - 1)


class SuffixArray:
    """Suffixes of numbered words in order; a suffix ends before the next 0."""

    def __init__(self, numbers: np.ndarray, depth: int):
        self.levels, self.tables = [numbers], []
        rank, ended, h = numbers, numbers == 0, 1
        while h < depth:
            after = np.zeros_like(rank)
            after[:-h] = rank[h:]
            after[ended] = 0
            factor = int(rank.max(initial=0)) + 1
            keys, rank = np.unique(rank * factor + after, return_inverse=True)
            ended[:-h] |= ended[h:].copy()
            ended[-h:] = True
            self.tables.append((factor, keys))
            self.levels.append(rank)
            h *= 2
        order = np.argsort(rank, kind="stable")
        self.order = order[numbers[order] > 0]

    def ranks(self, tests: np.ndarray) -> list[np.ndarray]:
        """For each level, the rank of the block of 2**level words from each position of tests; -1 where the shard hasn't it."""
        out, h = [np.where(tests > 0, tests, -1)], 1
        for factor, keys in self.tables:
            rank = out[-1]
            after = np.full_like(rank, -1)
            after[:-h] = rank[h:]
            some = np.flatnonzero((rank >= 0) & (after >= 0) & (rank < factor) & (after < factor))
            key = rank[some] * factor + after[some]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            rank = np.full_like(rank, -1)
            rank[some[hit]] = at[hit]
            out.append(rank)
            h *= 2
        return out

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, level: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges (whose suffixes share ``depth`` words) in which the block after those has the rank wanted."""
        rank, order = self.levels[level], self.order
        out = []
        for after in (False, True):
            a, b = lo.copy(), hi.copy()
            active = np.flatnonzero(a < b)
            while len(active):
                mid = (a[active] + b[active]) >> 1
                value = rank[order[mid] + depth[active]]
                right = value <= want[active] if after else value < want[active]
                a[active[right]] = mid[right] + 1
                b[active[~right]] = mid[~right]
                active = active[a[active] < b[active]]
            out.append(a)
        return out[0], out[1]

    def ranges(self, ranks: list[np.ndarray], tests: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test, low, high) of the tests whose first ``depth`` words occur."""
        lo, hi, done = np.zeros(len(tests), np.int64), np.full(len(tests), len(self.order)), 0
        for level in range(len(self.levels) - 1, -1, -1):
            if depth >> level & 1:
                want = ranks[level][tests + done]
                some = want >= 0
                tests, lo, hi, want = tests[some], lo[some], hi[some], want[some]
                lo, hi = self.narrow(lo, hi, np.full(len(tests), done), level, want)
                some = lo < hi
                tests, lo, hi = tests[some], lo[some], hi[some]
                done += 1 << level
        return tests, lo, hi

    def longest(self, ranks: list[np.ndarray], tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each test suffix's longest match in words, and the first place in the order that has it."""
        lo, hi, done = np.zeros(len(tests), np.int64), np.full(len(tests), len(self.order)), np.zeros(len(tests), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            at = np.minimum(tests + done, len(ranks[level]) - 1)
            want = ranks[level][at]
            some = np.flatnonzero((want >= 0) & (lo < hi))
            a, b = self.narrow(lo[some], hi[some], done[some], level, want[some])
            hit = a < b
            some = some[hit]
            lo[some], hi[some] = a[hit], b[hit]
            done[some] += 1 << level
        return done, lo

    def common(self) -> np.ndarray:
        """Words that each suffix in order shares with the one before it."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        numbers, out = self.levels[0], np.zeros(len(self.order), np.int64)
        zero = np.append(np.flatnonzero(numbers == 0), len(numbers))
        end = zero[np.searchsorted(zero, b)]
        end_a = zero[np.searchsorted(zero, a)]
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            some = np.flatnonzero((a + step <= end_a) & (b + step <= end))
            some = some[rank[a[some]] == rank[b[some]]]
            a[some] += step
            b[some] += step
            out[1:][some] += step
        return out


def spread(seed: np.ndarray, who: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best match of each place in the order: seeds reach others as far as all between them share words; those below least are left out."""
    best, name = seed.copy(), who.copy()
    for back in (False, True):
        x, n = seed.copy(), who.copy()
        shared = common.copy()
        if back:
            x, n, shared = x[::-1].copy(), n[::-1].copy(), np.append(0, common[:0:-1])
        h = 1
        while h < len(x) and shared.max(initial=0) >= least:
            reach = np.minimum(x[:-h], shared[h:])
            better = np.flatnonzero(reach > x[h:]) + h
            value, source = reach[better - h], n[better - h]
            x[better], n[better] = value, source
            shared[h:] = np.minimum(shared[h:], shared[:-h].copy())
            shared[:h] = 0
            h *= 2
        if back:
            x, n = x[::-1], n[::-1]
        better = x > best
        best[better], name[better] = x[better], n[better]
    return best, name


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of ranges, and the range of each."""
    n = hi - lo
    own = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own], own


def named_items(doc: np.ndarray, doc_range: np.ndarray, item: np.ndarray, item_range: np.ndarray, n_items: int) -> np.ndarray:
    """Distinct pairs (document * n_items + item) that share a range."""
    docs = np.unique(np.stack([doc_range, doc]), axis=1)
    items = np.unique(np.stack([item_range, item]), axis=1)
    begin, end = np.searchsorted(items[0], docs[0]), np.searchsorted(items[0], docs[0], "right")
    out, at = np.zeros(0, np.int64), 0
    total = np.cumsum(end - begin)
    while at < docs.shape[1]:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        member, own = expand(begin[at:stop], end[at:stop])
        out = np.unique(np.concatenate([out, docs[1, at:stop][own] * n_items + items[1, member]]))
        at = stop
    return out


def search(block: Block, hashed: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray):
    """For the documents of a shard that may have matches: document, hit words, items and the longest match; None where there is none."""
    docs = block.touches(hashed, at)
    if not len(docs):
        return None
    n = at[docs + 1] - at[docs]
    take, own = expand(at[docs], at[docs + 1])
    numbers = np.zeros(len(take) + len(docs), np.int64)  # a 0 ends each document
    place = np.arange(len(take)) + own
    numbers[place] = block.numbers(raw, hashed[take], start[take], end[take])
    shard = SuffixArray(numbers, block.longest)
    ranks = shard.ranks(block.words)
    begin = np.cumsum(n + 1) - (n + 1)
    owner = np.searchsorted(begin, shard.order, "right") - 1
    delta = np.zeros(len(numbers) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for k in np.unique(np.minimum(block.count, block.window)).tolist():
        own_words = np.flatnonzero(block.left >= k if k == block.window else block.first & (block.count == k))
        tests, lo, hi = shard.ranges(ranks, block.place[own_words], k)
        if not len(tests):
            continue
        low, first, number = np.unique(lo, return_index=True, return_inverse=True)
        member, window = expand(low, hi[first])
        position = shard.order[member]
        np.add.at(delta, position, 1)
        np.add.at(delta, position + k, -1)
        item = block.item[np.searchsorted(block.place, tests)]
        pairs.append(named_items(owner[member], window, item, number, len(block.ids)))
    hit = (np.cumsum(delta[:-1]) > 0)[place]
    length, where = shard.longest(ranks, block.place)
    seed, who = np.zeros(len(shard.order), np.int64), np.full(len(shard.order), -1)
    some = np.flatnonzero(length >= block.shortest)
    some = some[np.lexsort((-some, length[some]))]  # the longest, then the first, is written last
    seed[where[some]], who[where[some]] = length[some], some
    best, name = spread(seed, who, shard.common(), block.shortest)
    order = np.lexsort((-shard.order, best, owner))
    last = np.append(owner[order][1:] != owner[order][:-1], True) if len(order) else np.zeros(0, bool)
    longest = {}
    for k in order[last].tolist():
        if best[k] >= block.shortest:
            word = int(name[k])
            longest[int(owner[k])] = {"words": int(best[k]), "start": int(shard.order[k] - begin[owner[k]]), "item": block.ids[block.item[word]], "item_start": int(word - block.item_start[block.item[word]])}
    return docs, np.append(0, np.cumsum(n)), hit, np.unique(np.concatenate(pairs)), longest


def scan(block: Block):
    """Results of one shard after another, for map_text."""

    def work(column):
        raw, offs = utf8(column)
        n_words, n_hit, spans, items, longest = [], [], [], [], []
        for a, b in slices(offs, SHARD_BYTES):
            part = raw[offs[a] : offs[b]]
            hashed, start, end, at = words(part, offs[a : b + 1], ALNUM)
            n_words += np.diff(at).tolist()
            hits, own_spans, own_items, own_longest = [0] * (b - a), [[] for _ in range(b - a)], [[] for _ in range(b - a)], [None] * (b - a)
            found = search(block, hashed, part, start, end, at)
            if found:
                docs, cut, hit, pairs, best = found
                for k, d in enumerate(docs.tolist()):
                    x = hit[cut[k] : cut[k + 1]]
                    hits[d] = int(x.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
                    own_spans[d] = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                    own_longest[d] = best.get(k)
                for code in pairs.tolist():
                    own_items[docs[code // len(block.ids)]].append(block.ids[code % len(block.ids)])
            n_hit += hits
            spans += own_spans
            items += [sorted(set(x)) for x in own_items]
            longest += own_longest
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        best = pa.struct([("words", pa.int32()), ("start", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())])
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), string_lists(items), pa.array(longest, best)]

    return work


def benchmark_blocks(bench: DataFrame, text_col: str, id_col: str, block_words: int) -> Iterator[Block]:
    """Items in blocks of at most about block_words words, one at a time on the driver; one empty block if there are none."""
    ids: list[str] = []
    texts: list[str] = []
    size, given = 0, False
    for row in bench.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if row[1] is None:
            continue
        ids.append(row[0] or "")
        texts.append(row[1])
        size += len(row[1]) // 4
        if size >= block_words:
            yield Block(ids, texts)
            ids, texts, size, given = [], [], 0, True
    if ids or not given:
        yield Block(ids, texts)


MERGE = """aggregate(array_sort(concat(hit_spans, old_spans)), cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
    if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),
       concat(acc, array(x))))"""


def find_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", bench_text: str = "text", bench_id: str = "item_id", keep: list[str] | None = None, block_words: int = 4_000_000) -> DataFrame:
    """Docs with n_words, n_hit, hit_spans (word ranges), items (whose windows occur, sorted) and longest (match)."""
    sc = docs.sparkSession.sparkContext
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    out, text, own = None, text_col, docs
    for block in benchmark_blocks(bench, bench_text, bench_id, block_words):
        shared = sc.broadcast(block)
        make = lambda shared=shared: scan(shared.value)
        if out is None:
            first = make
            out = map_text(own, FIELDS, make, text, kept)
            continue
        if own is docs and text_col not in kept:  # the next passes read the text; it goes at the end
            text, own = "__passes_text", docs.withColumn("__passes_text", F.col(f"`{text_col}`"))
            out = map_text(own, FIELDS, first, text, [*kept, text])
        renamed = out.withColumnsRenamed({"hit_spans": "old_spans", "items": "old_items", "longest": "old_longest"})
        out = map_text(renamed, FIELDS, make, text)
        out = out.withColumn("hit_spans", F.expr(MERGE)).withColumn("items", F.array_sort(F.array_distinct(F.concat("items", "old_items"))))
        out = out.withColumn("longest", F.expr("CASE WHEN longest.words > old_longest.words OR old_longest IS NULL THEN longest ELSE old_longest END")).drop("old_spans", "old_items", "old_longest")
        out = out.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (n, x) -> n + x.end - x.start)"))
    return out if own is docs else out.drop(text)


def contaminated(share: float = 0.05):
    """The contract's rule: some word is hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, share: float = 0.05) -> DataFrame:
    """Docs without those that the benchmark contaminates; columns as they were."""
    own, back = set_aside(docs, RESULTS)
    return find_matches(own, bench).where(~contaminated(share)).drop(*RESULTS).withColumnsRenamed(back).select(*[f"`{c}`" for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
lengths AS (SELECT DISTINCT n FROM k),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, x.n, i, item_id FROM doc_windows x JOIN item_windows y ON x.n = y.n AND x.win = y.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": SQL}
