"""Secret scans: fixed patterns, and credential values whose guess cost is high.

Three base patterns (assignments, access keys, hex runs) give base spans. Beyond them,
every value in a credential context (a name such as ``pwd`` or ``auth_token`` with a
separator, a connection string's password) is segmented at minimum guess cost into
dictionary words, dates, repeats, sequences, keyboard walks and brute-force characters by
dynamic programming over its characters. Runs count as far as they go, or one or two
characters (one block, for repeats) less, so the work is in proportion to the value's
length, however long it is. The dictionary is a short list of common passwords and
placeholders, and the corpus's ordinary words (``common_words``): those written as words are,
outside all credential values, in at least a ``share`` of the documents. A word costs the
more the fewer documents hold it, so neither entry nor cost depends on the corpus's size, and
a secret isn't in the dictionary for standing in credentials, however often. What the driver
collects is bounded by the mean number of distinct words a document over ``share``. A value
that takes at least ``10 ** min_log_guesses`` guesses is a secret, also one of letters alone;
placeholders such as ``changeme2024`` aren't. A value in which another context starts is judged, and so is
that context's value, so guess spans may lie inside each other.

Scanning is one pass over all whole texts without a shuffle; offsets are code points, ends
exclusive.

Defined cases: null and empty texts have no spans; repeated rows get the same spans;
input columns whose names the results take are replaced; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Names that make what follows a credential. A name goes on to the end of its run of letters, digits,
# _ and -, so AWS_SECRET_ACCESS_KEY and passwordHash are names; ordinary words (author, passenger, secretary) aren't.
CONTEXT_NAMES = ("pass", "pwd", "secret", "token", "api_key", "apikey", "api-key", "auth", "credential", "private", "access", "bearer", "://", "\u017f")
NAME = re.compile(r"""(?:pass(?!age|eng|ion|iv|port)|pwd|secret(?!ar|e|i|ly)|token(?!i[sz])|api[_-]?key|auth(?!or(?!i[sz])|entic(?!at))|credential|(?:private|access)[_-]?key|bearer)[A-Za-z0-9_-]*+""", re.IGNORECASE)
SEPARATOR = re.compile(r"""["']?\s*(?:=>|:=|[:=]|\bis\b)\s*["']?""", re.IGNORECASE)
BEARER = re.compile(r"""["']?\s+["']?""")
VALUE = re.compile(r"""[^\s"'<>,;]+""")
LEAST = 6
URL_PASSWORD = re.compile(r"://[^\s:/@]*:([^\s/@]{6,})@")
# Words that people and placeholders use, most frequent first.
COMMON = (
    "password pass word qwerty admin welcome login letmein secret token key api test user root master dragon monkey "
    "shadow sunshine princess football baseball iloveyou love hello freedom whatever trustno superman batman changeme "
    "change example sample default dummy placeholder insert replace your my the here value string text demo guest "
    "public private local host server client database backup temp temporary none null undefined true false access "
    "auth bearer credential credentials phrase code pin abc xxx foo bar baz name email account service system prod "
    "production dev development staging summer winter spring autumn january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")


def neighbours() -> dict[str, set[str]]:
    """Keys beside each other on a staggered keyboard: those within one row and one and a half key widths."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b for b, q in place.items() if a != b and abs(p[1] - q[1]) <= 1 and abs(p[0] - q[0]) < 1.1} for a, p in place.items()}


BESIDE = neighbours()
#: Share of the documents that hold an ordinary word, at least; guesses for a word that every document holds.
SHARE, EVERYWHERE = 1 / 2000, 30
ORDINARY = re.compile(r"(?<!\w)(?:[A-Za-z][a-z]{2,23}|[A-Z]{3,24})(?!\w)")


class Words:
    """A dictionary: words to log10 of the guesses for them, by rank for listed ones, by share of the documents for others."""

    def __init__(self, words: list[str], shares: dict[str, float] | None = None):
        self.costs: dict[str, float] = {}
        for rank, word in enumerate([*COMMON, *words], 1):
            self.costs.setdefault(word, math.log10(rank + 1))
        for word, share in (shares or {}).items():
            self.costs[word] = min(self.costs.get(word, math.inf), math.log10(EVERYWHERE / share))
        self.longest = max(map(len, self.costs))


DEFAULT = Words([])


def ordinary_words(text: str) -> set[str]:
    """Words of text outside its credential values, in lower case; runs of mixed case or with digits are none."""
    out, at = [], 0
    for _, start, end in sorted((begin, start, end) for begin, start, end, _ in values(text)):
        out.append(text[at:start])
        at = max(at, end)
    return {w.lower() for w in ORDINARY.findall(" ".join([*out, text[at:]]))}


def common_words(docs: DataFrame, share: float = SHARE, text_col: str = "text") -> Words:
    """The dictionary with the words that at least ``share`` of all documents hold outside credential values."""
    n = docs.count()

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                if text := value.as_py():
                    found.update(ordinary_words(text))
            if len(found) > 100_000:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return Words([], {r["word"]: r["n"] / n for r in counted.where(F.col("n") >= share * n).collect()})


def runs(value: str, same) -> list[int]:
    """For each position, the length of the run from it in which each neighbouring pair is ``same``."""
    out = [1] * len(value)
    for i in range(len(value) - 2, -1, -1):
        if same(value[i], value[i + 1]):
            out[i] = out[i + 1] + 1
    return out


def suffix_costs(value: str, words: Words) -> list[float]:
    """For each position, log10 of the guesses for the cheapest segmentation of value from there on; 0 at its end."""
    n, low = len(value), "".join(x if len(x := c.lower()) == 1 else c for c in value)
    costs, longest = words.costs, words.longest
    plain = low.translate(LEET)
    up = runs(low, lambda a, b: ord(b) - ord(a) == 1 and (a + b).isalnum())
    down = runs(low, lambda a, b: ord(a) - ord(b) == 1 and (a + b).isalnum())
    walk = runs(low, lambda a, b: b in BESIDE.get(a, ()))
    again = [0] * 9  # by block size: how far the text from here on equals that one block further
    best = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least = 1.0 + best[i + 1]  # one brute-force character: ten guesses
        for j in range(i + 2, min(n, i + longest) + 1):
            word = low[i:j]
            cost = costs.get(word)
            if cost is None and plain[i:j] in costs:
                cost = costs[plain[i:j]] + math.log10(4)
            if cost is not None:
                least = min(least, best[j] + cost + (0 if value[i:j] == word else math.log10(2)) + 0.3)
        for length, base in ((up[i], 26), (down[i], 52), (walk[i], 47 * 4)):
            for size in range(max(3, length - 2), length + 1):
                least = min(least, best[i + size] + math.log10(base * size))
        for size in range(1, 9):
            if i + size < n and low[i] == low[i + size]:
                again[size] += 1
                times = again[size] // size + 1
                for t in range(max(3 if size == 1 else 2, times - 1), times + 1):
                    least = min(least, best[i + t * size] + size + math.log10(t))
            else:
                again[size] = 0
        if low[i].isdigit():
            for pattern, guesses in ((DATE, 365 * 120), (YEAR, 120)):
                if m := pattern.match(low, i):
                    least = min(least, best[m.end()] + math.log10(guesses))
        best[i] = least
    return best


def log_guesses(value: str, words: Words | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of value; 0 for an empty one."""
    return suffix_costs(value, words or DEFAULT)[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS) or not low.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def values(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Credential values: start of their run (another value may start inside it), own start, run's end, own end without closing signs."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_NAMES):
        return
    begin = end = last = 0
    for name in NAME.finditer(text):
        m = SEPARATOR.match(text, name.end()) or (BEARER.match(text, name.end()) if name[0].lower().endswith("bearer") else None)
        if not m:
            continue
        start = m.end()
        if start >= end:  # else inside the last value: one that ends where that ends
            run = VALUE.match(text, start)
            if not run:
                continue
            begin, end = start, run.end()
            last = start + len(run[0].rstrip(".)]}!?"))
        yield begin, start, end, last
    for m in URL_PASSWORD.finditer(text):
        yield m.start(1), m.start(1), m.end(1), m.end(1)


def guess_spans(text: str, min_log_guesses: float, words: Words = DEFAULT) -> list[tuple[int, int, int]]:
    """(start, kind, end) of credential values that take at least 10 ** min_log_guesses guesses."""
    found = set()
    of, first, costs = (-1, -1), 0, [0.0]
    for begin, start, end, last in values(text):
        if end - start < LEAST or last - start < min_log_guesses:  # no character takes more than ten guesses
            continue
        if of != (begin, last):  # values inside one run share its costs
            of, first, costs = (begin, last), start, suffix_costs(text[start:last], words)
        if costs[start - first] >= min_log_guesses:
            found.add((start, 3, last))
    return sorted(found)


def find_spans(text: str | None, min_log_guesses: float = 10.0, words: Words = DEFAULT) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + guess_spans(text, min_log_guesses, words)) if text else []


def scan(docs: DataFrame, min_log_guesses: float = 10.0, text_col: str = "text", keep: list[str] | None = None, words: Words = DEFAULT) -> DataFrame:
    """Docs with secrets: array of (kind, start, end), by start, then kind as in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(column):
            return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, min_log_guesses, shared.value)] for t in column.to_pylist()], kind)]

        return work

    return map_text(docs, "secrets array<struct<kind:string,start:int,end:int>>", make, text_col, keep)


def redact(docs: DataFrame, mark: str = "[SECRET]", min_log_guesses: float = 10.0, words: Words = DEFAULT) -> DataFrame:
    """Docs with every secret in text replaced by mark, and n_chars (if there) set anew; all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        def work(column):
            texts = []
            for text in column.to_pylist():
                out, at = [], 0
                for start, _, end in find_spans(text, min_log_guesses, shared.value):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                texts.append(text if not at else "".join([*out, text[at:]]))
            return [pa.array(texts, pa.string())]

        return work

    out = map_text(docs.withColumnRenamed("text", "__original"), "text string", make, "__original", [c for c in docs.columns if c != "text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, keep=["doc_id"], words=common_words(docs))
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(secrets, s -> s.kind = '{}')) as long)"
    return found.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(listed.format("filter(secrets, s -> s.kind <> 'guess')")), 256).alias("base_sha256"),
        F.expr(listed.format("secrets")).alias("spans"),
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict = {}
