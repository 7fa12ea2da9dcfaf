"""What the operators share: tables, scratch tables in shared storage, and vectorised work on UTF-8 bytes.

The byte helpers run inside Arrow tasks. They view a text column's Arrow buffers as
NumPy arrays, so no Python string is made for a document, and they work on slices of
a batch so that a task's memory follows its largest document, not its batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that the helpers handle at a time, unless one document is longer.
SLICE_BYTES = 1 << 20
PART_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ bytes of a text column


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # pyarrow keeps zero chunks apart
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer document stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def byte_table(word: str) -> np.ndarray:
    """Lower-casing table (A-Z only) that maps every byte outside a word to 0.

    ``word`` is "alnum" (0-9, a-z and all bytes from 0x80 on) or "space" (all but
    0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``).
    """
    keep = np.arange(256, dtype=np.uint8)
    low = keep.copy()
    low[65:91] += 32
    if word == "space":
        low[[0x20, *range(0x09, 0x0E)]] = 0
        return low
    inside = (keep >= 128) | ((low >= 48) & (low < 58)) | ((low >= 97) & (low < 123))
    return np.where(inside, low, 0).astype(np.uint8)


ALNUM = byte_table("alnum")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; x is overwritten."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(raw: np.ndarray, offsets: np.ndarray, lut: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive documents: 64-bit hash, start, end (bytes in raw) and the n+1 word offsets of the documents.

    A byte that ``lut`` maps to 0 separates words; no word spans two documents. Words
    of up to 8 bytes hash without collisions of their own.
    """
    n = len(raw)
    low = np.zeros(n + 9, np.uint8)
    np.take(lut, raw, out=low[:n])
    inside = np.zeros(n + 2, bool)
    np.not_equal(low[:n], 0, out=inside[1 : n + 1])
    start = np.flatnonzero(inside[1 : n + 1] & ~inside[:n])
    end = np.flatnonzero(inside[1 : n + 1] & ~inside[2:]) + 1
    cuts = offsets[1:-1] - offsets[0]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a document ends and the next begins inside a run
    if len(cuts):
        start = np.sort(np.concatenate([start, cuts]))
        end = np.sort(np.concatenate([end, cuts]))
    eights = np.ndarray((n + 2,), "<u8", buffer=low, strides=(1,))
    length = end - start
    hashed = length.astype(U64) * U64(0x9E3779B97F4A7C15)
    at, left, to = start, length, slice(None)
    while True:
        part = eights[at]
        short = np.minimum(left, 8).astype(U64)
        part &= U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - short) * U64(8))
        part += hashed[to]
        hashed[to] = mix(part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        to = more if isinstance(to, slice) else to[more]
        at, left = at[more] + 8, left[more] - 8
    return hashed, start, end, np.searchsorted(start, offsets - offsets[0])


def windows(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word (the last k-1 have none)."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashed[:n].copy()
    for j in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashed[j : j + n]
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each item, from n+1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def document_windows(hashed: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of k words that lie in one document: hash, document, first word.

    A document of fewer words, but not none, is one window of all its words.
    """
    count = np.diff(word_offsets)
    whole = windows(hashed, k)
    doc = owners(word_offsets)
    first = np.flatnonzero(np.arange(len(whole)) + k <= word_offsets[1:][doc[: len(whole)]]) if len(whole) else np.zeros(0, np.int64)
    hs, ds, fs = [whole[first]], [doc[first]], [first]
    for short in np.flatnonzero((count > 0) & (count < k)):
        a, b = word_offsets[short], word_offsets[short + 1]
        hs.append(windows(hashed[a:b], int(b - a)) ^ U64(b - a))
        ds.append(np.array([short]))
        fs.append(np.array([a]))
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(fs)


# ------------------------------------------------------------------ Arrow pass over a text column


def map_text(docs: DataFrame, fields: str, make, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Pass over every row's whole text in Arrow batches; no shuffle.

    ``fields`` is the DDL of the added columns. ``make()`` runs once in each task and
    returns a function from a text column to the list of added Arrow arrays, one value
    a row. ``keep`` names the input columns to return (all but those whose names the
    added columns take, by default). Batches of large values are worked on in parts of
    about PART_BYTES, unless one value is longer.
    """
    spark = docs.sparkSession
    added = spark.createDataFrame([], fields).schema
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.fieldNames()]
    at = kept.index(text_col) if text_col in kept else len(kept)
    source = docs.select(*[f"`{c}`" for c in kept], *([] if at < len(kept) else [docs[text_col].alias("__text")]))
    schema = source.select(*[f"`{c}`" for c in kept]).schema
    for field in added:
        schema = schema.add(field)
    names = schema.fieldNames()

    def run(batches):
        work = make()
        for batch in batches:
            rows = max(1, batch.num_rows * PART_BYTES // max(PART_BYTES, batch.column(at).nbytes))
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                columns = [part.column(i) for i in range(len(kept))] + list(work(part.column(at)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Docs with columns of these names renamed, and the renaming that undoes it."""
    moved = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def string_lists(values: list[list[str]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.string()))


# ------------------------------------------------------------------ labelled rows


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null ids have fold -1."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, text, label) of at most max_rows labelled training rows, the first by a hash of the id.

    The chosen labels, and so what is broadcast, are at most max_rows rows of two
    numbers; only the sample's texts are shuffled. A document labelled twice takes the
    larger label; of rows with one id, the smallest text counts, so an id is one row.
    """
    from pyspark.sql import functions as F

    once = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("__label"))
    chosen = once.where(fold_of(id_col, folds) != held_out).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col)
    return rows.groupBy(id_col).agg(F.min("text").alias("text"), F.max("__label").alias("__label"))
