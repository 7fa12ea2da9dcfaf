"""Repeated-string removal by prefix-free parsing.

A rolling hash of 32 bytes triggers where it is 0 modulo 128; a *phrase* is the text from
behind one trigger to the next, with the bytes that follow as far as a 200-byte window that
begins in it reaches. Whether a place triggers depends on its 32 bytes alone, so equal
windows are parsed alike wherever they are. (A window without a trigger takes its smallest
32 bytes, the leftmost of equals, for one.) The *dictionary* holds the distinct phrases with
the number of their occurrences, the *parse* where they occur; a phrase that follows itself,
as in a run of one letter, is one row with its times.

1. Triggers are counted over the corpus; those that occur once need no further look. A
   bitmap of fixed size, of the repeated ones, thins the second pass.
2. Phrases of repeated triggers make the parse; summed by phrase (partial sums before the
   shuffle) they make the dictionary. A phrase that occurs twice has only repeated windows,
   wherever it occurs: highly repetitive text ends here, at one row for a phrase. (Phrases
   are told apart by 64 bits beside their trigger's 64.)
3. Other phrases, and one occurrence of each phrase that shares their trigger, fetch their
   bytes. Trigger by trigger, what stands before the trigger is sorted from its end (the
   dictionary's suffixes: equal endings stand together), and what follows it from its
   beginning (the parse's suffixes, to the 200 bytes that a window can see). For every
   distance between a window's start and the trigger the two orders are combined into corpus
   order: windows are equal where both orders' neighbours share enough bytes. This is exact,
   by the bytes themselves. The phrases of a trigger with more than ``hot`` are sorted in
   groups that share the bytes behind it (for windows that begin near it) or before it (for
   the others). If one of these groups still has more than ``most``, the trigger's windows
   are counted one by one, by hash, in a shuffle with partial sums.
4. Repeated windows of each document meet its text, which loses the bytes they cover.

Texts are shuffled compressed, and only those that step 3 or 4 needs (a bitmap of fixed
size tells most others; it only saves work). Long texts are handled in pieces.

Defined cases: null and empty texts and texts below 200 bytes lose nothing; repeated rows
are documents of their own; a string may overlap its own repeat; cuts are at bytes, so
``kept`` is binary; empty tables give no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialise, mix, slices, table, utf8

LENGTH, GRAM, MODULUS, HALF = 200, 32, 128, 84
SPAN = LENGTH - GRAM + 1
PIECE = 1 << 19
BITMAP_BITS = 27
#: Multipliers for sums of mixed 8-byte words, odd and fixed.
ODD = np.random.default_rng(3).integers(0, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
TOP = U64(0xFFFFFFFFFF000000)


def mixed_eights(raw: np.ndarray) -> np.ndarray:
    """A mixed 64-bit value of the eight bytes from each position."""
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = raw
    return mix(np.ndarray((len(raw),), "<u8", buffer=data, strides=(1,)).copy())


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, at least n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, PIECE + 4 * LENGTH)
        up, down = np.full(size, U64(base)), np.full(size, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def next_trigger(gram: np.ndarray, windows: int) -> np.ndarray:
    """For each window's start, the place of its trigger: the first gram of it that is 0 modulo MODULUS, else the leftmost of its smallest."""
    m = len(gram)
    place = np.where(gram & U64(MODULUS - 1) == 0, np.arange(m), 2 * m + SPAN)
    out = np.minimum.accumulate(place[::-1])[::-1][:windows]
    without = np.flatnonzero(out - np.arange(windows) >= SPAN)
    if len(without):
        # running minima over blocks of the window's length, from both ends
        ranked = np.full(-(-m // SPAN) * SPAN + SPAN, U64(0xFFFFFFFFFFFFFFFF))
        ranked[:m] = (gram & TOP) | np.arange(m).astype(U64)
        blocks = ranked.reshape(-1, SPAN)
        fore = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        out[without] = (np.minimum(back[without], fore[SPAN - 1 + without]) & ~TOP).astype(np.int64)
    return out


def phrases(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of consecutive documents: document, first window (from its start), windows, trigger's distance, trigger, phrase hash, times it follows itself."""
    offsets = offsets - offsets[0]
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64, np.int64))
    n = len(raw)
    if n < LENGTH:
        return empty
    last = np.repeat(offsets[1:], np.diff(offsets))[: n - LENGTH + 1]
    fits = np.arange(n - LENGTH + 1) + LENGTH <= last
    if not fits.any():
        return empty
    eights = mixed_eights(raw)
    m = n - GRAM + 1
    gram = eights[:m] * ODD[0]
    for j in range(1, GRAM // 8):
        gram += eights[8 * j : 8 * j + m] * ODD[j]
    gram = mix(gram)
    trigger = next_trigger(gram, n - LENGTH + 1)
    changes = (trigger[1:] != trigger[:-1]) | (last[1:] != last[:-1])
    lo = np.flatnonzero(np.append(True, changes | ~fits[:-1]) & fits)
    hi = np.flatnonzero(np.append(changes | ~fits[1:], True) & fits)
    run = hi - lo + 1
    at = trigger[lo]
    up, down = powers(n)
    total = np.append(U64(0), np.cumsum(gram * up[:m]))
    phrase = (total[hi + SPAN] - total[lo]) * down[lo]
    phrase = mix(phrase ^ (run * 1024 + (at - lo)).astype(U64) * U64(0x9E3779B97F4A7C15))
    new = np.append(True, (phrase[1:] != phrase[:-1]) | (lo[1:] != lo[:-1] + run[:-1]) | (last[lo[1:]] != last[lo[:-1]]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(lo)))
    lo, run, at, phrase = lo[first], run[first], at[first], phrase[first]
    doc = np.searchsorted(offsets, lo, "right") - 1
    return doc, lo - offsets[doc], run, at - lo, gram[at], phrase, times


def pieces(raw: np.ndarray, offs: np.ndarray):
    """(first document, base, bytes, offsets) of slices; a long document comes in overlapping pieces."""
    for a, b in slices(offs, PIECE):
        s, e = offs[a], offs[b]
        if b - a > 1 or e - s <= PIECE + LENGTH:
            yield a, 0, raw[s:e], offs[a : b + 1]
            continue
        for p in range(0, int(e - s) - LENGTH + 1, PIECE):
            q = min(int(e - s), p + PIECE + LENGTH - 1)
            yield a, p, raw[s + p : s + q], np.array([0, q - p])


def window_hashes(raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first counts[i] 200-byte windows of each byte string, and the string of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(offsets[:-1] - offsets[0], counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    eights = mixed_eights(raw)
    out = np.zeros(len(start), U64)
    for j in range(LENGTH // 8):
        out += eights[start + 8 * j] * ODD[32 + j]
    return mix(out), owner


# ------------------------------------------------------------------ bitmaps that save work


def bitmap(spark: SparkSession, values: DataFrame, column: str):
    """Broadcast bitmap of fixed size with the bit of each value set."""
    bit = F.expr(f"`{column}` & {(1 << BITMAP_BITS) - 1}L")
    words = values.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))").alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return spark.sparkContext.broadcast(out.view(np.uint8))


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(U64) & U64((1 << BITMAP_BITS) - 1)
    return (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


# ------------------------------------------------------------------ the steps


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, body): the key tells rows apart by id and text."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), body).alias("key"), F.col(id_col).alias("id"), body.alias("body"))


def parse(docs: DataFrame, repeated=None) -> DataFrame:
    """Without ``repeated``: (trigger, n), counted in each batch. With it: (key, place, trigger, phrase, times) of the phrases whose triggers it has.

    place packs first window, windows and the trigger's distance.
    """

    def run(batches):
        bits = repeated.value if repeated is not None else None
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for first, base, part, part_offs in pieces(raw, offs):
                doc, lo, count, distance, trigger, phrase, times = phrases(part, part_offs)
                if bits is None:
                    trigger, which = np.unique(trigger, return_inverse=True)
                    n = np.bincount(which, times, len(trigger)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(n)], names=["trigger", "n"])
                    continue
                some = in_bitmap(bits, trigger)
                place = (lo[some] + base) << 20 | count[some] << 10 | distance[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first + doc[some]]), pa.array(place), pa.array(trigger[some].view(np.int64)), pa.array(phrase[some].view(np.int64)), pa.array(times[some])],
                    names=["key", "place", "trigger", "phrase", "times"],
                )

    fields = "trigger long, n long" if repeated is None else "key long, place long, trigger long, phrase long, times long"
    return docs.select("key", "body").mapInArrow(run, fields)


def packed(docs: DataFrame, wanted, inside: bool = True) -> DataFrame:
    """(key, id, compressed body) of documents whose key the bitmap has (or hasn't)."""

    def run(batches):
        import zstandard

        bits, press = wanted.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_bitmap(bits, key) == inside))
            raw, offs = utf8(batch.column(2))
            body = [press.compress(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())], names=["key", "id", "packed"])

    schema = docs.select("key", "id").schema.add("packed", "binary")
    return docs.select("key", "id", "body").mapInArrow(run, schema)


def contexts(parse_rows: DataFrame, docs: DataFrame, wanted) -> DataFrame:
    """(trigger, key, place, n, bytes): the bytes that the windows of each place cover."""
    places = parse_rows.groupBy("key").agg(F.collect_list(F.struct("place", "trigger", "n")).alias("places"))
    both = packed(docs, wanted).drop("id").dropDuplicates(["key"]).join(places, "key")

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, bodies, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for at in range(batch.num_rows):
                body = unpress.decompress(bodies[at].as_py())
                rows = lists[at].values
                place = rows.field(0).to_numpy(zero_copy_only=False)
                lo, count = place >> 20, place >> 10 & 1023
                cut = [body[s:e] for s, e in zip(lo.tolist(), (lo + count + LENGTH - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.field(1), pa.array(np.full(len(place), keys[at], np.int64)), rows.field(0), rows.field(2), pa.array(cut, pa.binary())], names=["trigger", "key", "place", "n", "bytes"])

    return both.select("key", "packed", "places").mapInArrow(run, "trigger long, key long, place long, n long, bytes binary")


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def in_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of byte rows within their groups, and how many bytes each shares with the one before it (-1: another group)."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    keys = wide.view(">u8").astype(U64)
    order = np.lexsort((*[keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)], group))
    rows, group = rows[order], group[order]
    shared = np.full(n, -1)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[1:][group[1:] != group[:-1]] = -1
    return order, shared


def repeated_windows(raw: np.ndarray, offs: np.ndarray, group: np.ndarray, count: np.ndarray, distance: np.ndarray, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, offset) of the windows that another window of the same group equals.

    Phrases are byte strings with their trigger's distance and number of windows. Where
    ``far`` is given, a phrase stands for its windows that begin more than HALF bytes before
    the trigger (1), or for the others (0).
    """
    n, padded = len(count), np.append(raw, np.zeros(2 * LENGTH, np.uint8))
    trigger = offs[:-1] + distance
    right = padded[np.minimum(trigger[:, None] + np.arange(LENGTH), len(padded) - 1)]
    right[np.arange(LENGTH) >= (offs[1:] - trigger)[:, None]] = 0
    before = np.arange(1, SPAN)
    left = padded[np.maximum(trigger[:, None] - before, 0)]
    left[before > distance[:, None]] = 0
    right_order, right_shared = in_order(right, group)
    left_order, left_shared = in_order(left, group)
    ending, following = np.empty(n, np.int64), np.empty(n, np.int64)
    rows, steps = [], []
    for back in range(int(distance.max(initial=-1)) + 1):
        has = (back <= distance) & (back > distance - count)
        has = np.flatnonzero(has if far is None else has & (far == (back > HALF)))
        if len(has) < 2:
            continue
        # left contexts that are too short share less than ``back`` bytes with all others, so they stand apart
        ending[left_order] = np.cumsum(left_shared < back)
        following[right_order] = np.cumsum(right_shared < LENGTH - back)
        key = ending[has] * (n + 1) + following[has]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(has), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        rows.append(has[twice])
        steps.append(distance[has[twice]] - back)
    return (np.concatenate(rows), np.concatenate(steps)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sorted_suffixes(rows: DataFrame) -> DataFrame:
    """(key, place, repeated windows as start, end): a trigger's (or half's) phrases stand together and are put in corpus order."""

    def work(batch: pa.RecordBatch):
        raw, offs = binary(batch.column(4))
        place = batch.column(2).to_numpy(zero_copy_only=False)
        single = batch.column(3).to_numpy(zero_copy_only=False) == 1
        _, group = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
        far = batch.column(5).to_numpy(zero_copy_only=False) if batch.num_columns > 5 else None
        row, step = repeated_windows(raw, offs, group, place >> 10 & 1023, place & 1023, far)
        row, step = row[single[row]], step[single[row]]
        order = np.lexsort((step, row))
        row, start = row[order], (place >> 20)[row[order]] + step[order]
        new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        key = batch.column(1).to_numpy(zero_copy_only=False)[row[first]]
        end = start[np.append(first[1:], len(row)) - 1] + 1 if len(row) else start
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start[first]), pa.array(end)], names=["key", "start", "end"])

    def run(batches):
        left = None
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            trigger = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(trigger, trigger[-1])) if len(trigger) else 0
            left = batch.slice(cut)
            for a in chunks(trigger[:cut]):
                yield work(batch.slice(a[0], a[1] - a[0]))
        if left is not None and left.num_rows:
            yield work(left)

    def chunks(trigger: np.ndarray, size: int = 8192):
        """Ranges of about size rows that don't part a trigger."""
        at = 0
        while at < len(trigger):
            end = min(len(trigger), at + size)
            end = int(np.searchsorted(trigger, trigger[end - 1], "right"))
            yield at, end
            at = end

    return rows.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, "key long, start long, end long")


def halves(rows: DataFrame) -> DataFrame:
    """The rows of triggers with many phrases, in smaller groups (group in place of trigger, own: the trigger).

    Equal windows that begin at most HALF bytes before the trigger share the bytes from it on
    that all such windows hold; others share the bytes before it. A phrase stands in one
    group for its windows of the first kind, in another for those of the second.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            count, distance = place >> 10 & 1023, place & 1023
            body = batch.column(4).to_pylist()
            trigger = batch.column(0).to_pylist()
            for far, some in ((0, distance - count + 1 <= HALF), (1, distance > HALF)):
                at = np.flatnonzero(some)
                cut = [body[k][distance[k] : distance[k] + LENGTH - HALF] if not far else body[k][distance[k] - HALF - 1 : distance[k]] for k in at]
                group = np.array([xxhash.xxh3_64_intdigest(c, trigger[k] % 2**63 * 2 + far) for c, k in zip(cut, at.tolist(), strict=True)], U64).view(np.int64)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(group), *part.columns[1:], pa.array(np.full(len(at), far)), part.column(0)], names=["trigger", "key", "place", "n", "bytes", "far", "own"])

    return rows.mapInArrow(run, "trigger long, key long, place long, n long, bytes binary, far long, own long")


def counted_suffixes(rows: DataFrame) -> DataFrame:
    """The same for triggers with very many phrases: every suffix is a row of a grouped count."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                raw, offs = binary(part.column(4))
                place = part.column(2).to_numpy(zero_copy_only=False)
                counts = place >> 10 & 1023
                hashed, owner = window_hashes(raw, offs, counts)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), pa.array((place >> 20)[owner] + step), part.column(3).take(pa.array(owner)), pa.array(hashed.view(np.int64))], names=["trigger", "key", "start", "n", "hash"])

    suffixes = materialise(rows.mapInArrow(run, "trigger long, key long, start long, n long, hash long"), "hot-suffixes")
    twice = suffixes.groupBy("trigger", "hash").count().where("count > 1").select("trigger", "hash")
    return suffixes.where("n = 1").join(twice, ["trigger", "hash"]).select("key", "start", (F.col("start") + 1).alias("end"))


def cut_out(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, removed runs) for windows that begin in [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order] + LENGTH - 1)
    new = np.append(True, starts[1:] > ends[:-1])
    s, e = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
    kept = b"".join(body[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(body)], strict=True))
    return kept, int((e - s).sum()), len(s)


RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000, most: int = 200_000, with_kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row: its text without repeated 200-byte strings."""
    spark = docs.sparkSession
    source = keyed(docs, id_col, text_col)
    repeated = bitmap(spark, parse(source).groupBy("trigger").agg(F.sum("n").alias("n")).where("n > 1"), "trigger")
    occurs = materialise(parse(source, repeated), "parse")
    dictionary = materialise(occurs.groupBy("trigger", "phrase").agg(F.sum("times").alias("n"), F.min(F.struct("key", "place")).alias("at")), "dictionary")
    by_trigger = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases"), F.min("n").alias("least")).where("phrases > 1 AND least = 1")
    look = dictionary.join(by_trigger, "trigger").select("trigger", "n", "at.key", "at.place", "phrases")
    look = materialise(look, "unsettled")
    cut = contexts(look.select("trigger", "n", "key", "place"), source, bitmap(spark, look, "key"))
    many = look.where(F.col("phrases") > hot).select("trigger").distinct()
    if many.head(1):
        cut = materialise(cut, "contexts")
        dense = cut.join(many, "trigger", "left_semi").select("trigger", "key", "place", "n", "bytes")
        split = materialise(halves(dense), "halves")
        over = split.groupBy("own", "trigger").count().where(F.col("count") > most).select("own").distinct()
        partial = sorted_suffixes(cut.join(many, "trigger", "left_anti").select("trigger", "key", "place", "n", "bytes"))
        partial = partial.unionByName(sorted_suffixes(split.join(over, "own", "left_anti").select("trigger", "key", "place", "n", "bytes", "far")))
        if over.head(1):
            partial = partial.unionByName(counted_suffixes(dense.join(over.withColumnRenamed("own", "trigger"), "trigger", "left_semi")))
    else:
        partial = sorted_suffixes(cut)
    whole = occurs.join(dictionary.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"])
    lo = F.shiftright("place", 20)
    whole = whole.select("key", lo.alias("start"), (lo + F.shiftright("place", 10).bitwiseAND(F.lit(1023)) * F.col("times")).alias("end"))
    flags = whole.unionByName(partial).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    flags = materialise(flags, "repeated-windows")
    flagged = bitmap(spark, flags, "key")

    schema = source.select("id").schema
    names = [n for n, _ in RESULT if with_kept or n != "kept"]
    for name, kind in zip(names, ("long", "long", "long", "string", "binary"), strict=False):
        schema = schema.add(name, kind)

    def finish(ids, found):
        columns = [pa.array(x, t) for x, (_, t) in zip(zip(*found, strict=True), RESULT[: len(names)], strict=False)]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])

    def digest(body: bytes, kept: bytes, removed: int, spans: int):
        return len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept

    def untouched(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(~in_bitmap(flagged.value, key)))
            if batch.num_rows:
                raw, offs = utf8(batch.column(2))
                bodies = (raw[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True))
                yield finish(batch.column(1), [digest(x, x, 0, 0) for x in bodies])

    def shortened(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = unpress.decompress(body.as_py())
                if spans.is_valid:
                    rows = spans.values
                    found.append(digest(body, *cut_out(body, rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False))))
                else:
                    found.append(digest(body, body, 0, 0))
            if found:
                yield finish(batch.column(0), found)

    plain = source.select("key", "id", "body").mapInArrow(untouched, schema)
    joined = packed(source, flagged).join(flags, "key", "left").select("id", "packed", "spans").mapInArrow(shortened, schema)
    return plain.unionByName(joined).withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict = {}
