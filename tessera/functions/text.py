"""Column expressions over paths and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query or a text.
STOP_WORDS = (
    "a an the and or to of in on for is are was were be this that with as by from at it its into "
    "function class public private protected return void string int bool array null true false use namespace"
).split()
# Languages by file extension.
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "php": ("php",),
    "markdown": ("md", "mdx", "mdc"),
    "json": ("json",),
    "yaml": ("yml", "yaml"),
    "python": ("py",),
    "css": ("css", "scss"),
    "html": ("html",),
    "sql": ("sql",),
}
# Folders and names of generated files, and the size from which a file is large.
GENERATED_PATH = r"(?i)(^|/)(generated|gen|\.generated|__generated__|dist|build|out|coverage|\.next)(/|$)"
GENERATED_NAME = r"(?i)\.(generated|min|bundle|chunk)\.[a-z0-9]+$"
LARGE_FILE_BYTES = 200_000


def tokens(text: Column) -> Column:
    """Lower-case terms of two characters or more that aren't stop words; splits at everything but a-z, 0-9 and _."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), 0), lambda t: ~t.isin(*STOP_WORDS))


def query_tokens(query: str) -> list[str]:
    """The same for a query that is known on the driver."""
    import re

    return [t for t in re.split("[^a-z0-9_]+", query.lower()) if len(t) > 1 and t not in STOP_WORDS]


def search_terms(text: Column, most: int = 12) -> Column:
    """Terms of a full-text expression: at most ``most``, stop words stay."""
    return F.slice(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 1), 1, most)


def identifier_tokens(name: Column) -> Column:
    """Distinct lower-case parts of an identifier or path: at case changes and at . _ / : -"""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_./:-]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: F.length(t) > 1))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its extension; ``other`` where none fits."""
    found = F.when(F.lower(path).endswith(".blade.php"), F.lit("blade"))
    for name, endings in LANGUAGES.items():
        found = found.when(extension(path).isin(*endings), F.lit(name))
    return found.otherwise(F.lit("other"))


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    return F.size(F.split(F.substring(text, F.lit(1), position - 1), "\n", -1))


def column_of(text: Column, position: Column) -> Column:
    """1-based column of a 1-based character position."""
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), position - 1), "\n", -1), -1)) + 1


def evidence(text: Column, most: int = 240) -> Column:
    """One line of evidence: white space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def repetition(text: Column, chars: int | None = None, line_chars: int | None = None) -> Column:
    """Share of repeated non-empty trimmed lines; below eight lines, of repeated 8-grams, every fourth; 0 below 200 characters.

    ``chars`` and ``line_chars`` (4000 and 120 in an interactive search) bound the text
    read for 8-grams and what counts of a line; by default all of both does.
    """
    full = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    repeated = lambda a: (F.size(a) - F.size(F.array_distinct(a))) / F.size(a)
    last = (F.length(text) if chars is None else F.least(F.length(text), F.lit(chars))) - 7
    count = F.floor((F.greatest(last, F.lit(1)) - 1) / 4).cast("int") + 1
    # Two neighbours of the parts of four characters make an 8-gram; a substring at each place would read the text from its start.
    grams = lambda q: F.slice(F.zip_with(q, F.slice(q, 2, F.size(q)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), 1, count)
    by_gram = once(F.regexp_extract_all(text, F.lit("(?s).{1,4}"), 0), lambda q: once(grams(q), repeated))
    keys = lambda k: k if line_chars is None else F.transform(k, lambda x: F.substring(x, 1, line_chars))
    of_lines = once(full, lambda k: F.when(F.size(k) < 8, by_gram).otherwise(once(keys(k), repeated)))
    return F.when(F.length(text) < 200, F.lit(0.0)).otherwise(of_lines)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def generated_path(path: Column) -> Column:
    return path.rlike(GENERATED_PATH) | path.rlike(GENERATED_NAME)


# Folders and names of tests, of places where requests enter, and outside services.
TEST_PATH = r"(?i)\.(test|spec)\.|/__tests__/|/tests?/"
TEST_FILE = r"(?i)\.(test|spec)\.|/__tests__/|/tests?/|Test\.php$"
ENTRY_FOLDERS = ("controller", "controllers", "route", "routes", "http", "handler", "handlers", "api")
ENTRY_FILES = ("main", "index", "app", "server")
ENTRY_ENDINGS = ("ts", "js", "php")
ENTRY_NAMES = ("Controller", "Handler", "Route")
SERVICES = ("stripe", "twilio", "sendgrid", "openai", "anthropic", "aws-sdk", "paypal", "braintree", "sentry", "segment")


def test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def entry_point(path: Column, name: Column | None = None) -> Column:
    """Whether a path (below some folder) lies in a folder of entry points or is named as one; or a symbol's name ends like one."""
    parts = F.split(F.lower(path), "/")
    folders, file = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.element_at(parts, -1)
    in_folder = F.arrays_overlap(folders, F.array(*map(F.lit, ENTRY_FOLDERS)))
    as_file = (F.size(parts) > 1) & file.isin(*[f"{f}.{e}" for f in ENTRY_FILES for e in ENTRY_ENDINGS])
    by_path = in_folder | as_file
    return by_path if name is None else by_path | F.coalesce(F.greatest(*[F.endswith(name, F.lit(e)) for e in ENTRY_NAMES]), F.lit(False))


def is_entry(path: str) -> bool:
    """The same for one path in a task."""
    parts = path.lower().split("/")
    return bool(set(parts[1:-1]) & set(ENTRY_FOLDERS)) or (len(parts) > 1 and parts[-1] in {f"{f}.{e}" for f in ENTRY_FILES for e in ENTRY_ENDINGS})


def integration(specifier: Column) -> Column:
    """Whether an imported specifier names an outside service."""
    low = F.lower(specifier)
    named = F.exists(F.array(*map(F.lit, SERVICES)), lambda s: low.contains(s))
    return named | low.startswith("http://") | low.startswith("https://")


def slug(text: Column, most: int = 48) -> Column:
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(flat, "^-+|-+$", ""), 1, most), "-+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(*parts: Column, size: int, separator: str = ":") -> Column:
    """The first ``size`` hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256), 1, size)


def chunk_id(path: Column, start: Column, end: Column, symbol: Column) -> Column:
    return short_id(path, start, end, F.coalesce(symbol, F.lit("")), size=24)


def edge_id(*parts: Column) -> Column:
    return F.concat(F.lit("edge:"), short_id(*parts, size=32, separator="|"))


def query_fingerprint(query: Column) -> Column:
    return short_id(F.lower(F.trim(query)), size=32)


def fnv1a_32(text: str) -> str:
    """FNV-1a of a short driver-side string, eight hex digits (rule-set fingerprints)."""
    value = 0x811C9DC5
    for byte in text.encode():
        value = (value ^ byte) * 0x01000193 & 0xFFFFFFFF
    return f"{value:08x}"


def code_units(text: Column) -> Column:
    """The code points of a text, as numbers."""
    return F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over a column's code points, as a number."""
    return F.aggregate(code_units(text), F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def short_hash(text: Column) -> Column:
    """The 31-polynomial of a text's code points in 32 signed bits: its absolute value, at most eight hex digits."""
    value = F.aggregate(code_units(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
    return F.substring(F.lower(F.hex(F.abs(signed))), 1, 8)


def strip_trailing_blanks(text: Column) -> Column:
    """A diff without blanks at line ends, so that equal changes share a cache key."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "(?m)[ \t]+$", "")


def approximate_tokens(chars: Column) -> Column:
    return F.ceil(chars / 4)


def excerpt_around(text: Column, terms: list[str], radius: int = 850, most: int = 3500) -> Column:
    """The text around the first term found, or its beginning."""
    low = F.lower(text)
    found = [F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())) for t in terms]
    first = F.least(*found) if len(found) > 1 else (found[0] if found else F.lit(None).cast("int"))
    start = F.greatest(F.coalesce(first, F.lit(1)) - radius, F.lit(1))
    return F.substring(text, start, F.lit(min(most, 2 * radius)))


# Names that read as an instruction to a model.
PROMPT_INJECTION = r"(?i)(ignore (all |any )?(previous|prior|above) instructions|disregard (the )?(system|previous)|you are now|system prompt|reveal (your|the) (prompt|instructions))"


def flag_injection(text: Column) -> Column:
    """Lines that address the model are replaced by a note."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(PROMPT_INJECTION), F.lit("[line omitted: instruction-like text]")).otherwise(x)), "\n")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def plural(name: Column) -> Column:
    """A regular English plural: y to ies, es after a hiss, else s."""
    return F.when(name.rlike("[^aeiou]y$"), F.regexp_replace(name, "y$", "ies")).when(name.rlike("(s|x|z|ch|sh)$"), F.concat(name, F.lit("es"))).otherwise(F.concat(name, F.lit("s")))


def without_role(name: Column) -> Column:
    """A class name without its role."""
    return F.regexp_replace(name, r"(Controller|Service|Job|Model|Request|Policy|Listener|Event|Provider|Middleware|Repository|Test)$", "")
