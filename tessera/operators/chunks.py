"""Text to rows: line windows, sections, heading ancestry, bullets, frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, chunk_id, extension, lines
from .ranges import binned

WINDOW_LINES, OVERLAP = 80, 12
BLANKS = " \t\n\r"
# Names of files that steer tools, which weigh most.
#: A line that declares a type or a function.
PHP_BLOCK = r"(?m)^\s*(?:(?:abstract|final|readonly|public|protected|private|static)\s+)*(?:(?:class|interface|trait|enum)\s+\w|function\s+&?\s*\w+\s*\()"
PRIORITY_MEMORY = ("readme.md", "architecture.md", "decisions.md", "agents.md", "contributing.md", "coding-standards.md", "agile.md", ".cursorrules")


def not_blank(text: Column) -> Column:
    """Whether a text has more than blanks; it is read up to there only."""
    return F.ltrim(text, F.lit(BLANKS)) != ""


def window_chunks(files: DataFrame, size: int = WINDOW_LINES, overlap: int = OVERLAP, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, start_line, end_line, text, columns ``keep``): windows of ``size`` lines that overlap; blank windows are left out.

    A window after the first begins only while lines beyond the previous window's overlap are left.
    """
    step = size - overlap
    whole = F.concat(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))
    own = files.select(F.col(path_col).alias("path"), *keep, F.regexp_extract_all(whole, F.lit(r"(?:[^\n]*+\n){1,%d}+" % step), 0).alias("blocks"))
    # A window is a block of ``step`` lines and what follows of the next ones, so that no row carries all lines.
    window = lambda b, k: F.substring_index(F.concat(b, *[F.coalesce(F.get("blocks", k + j), F.lit("")) for j in range(1, -(-overlap // step) + 1)]), "\n", size)
    last = F.element_at("blocks", -1)
    count = (F.size("blocks") - 1) * step + F.length(last) - F.length(F.replace(last, F.lit("\n"), F.lit("")))
    # Windows are made where they are exploded: of a column of its own Spark would first ask that it isn't empty, and so cut the text again for each window.
    cut = own.select("path", *keep, count.alias("n"), "blocks").select("path", *keep, "n", F.posexplode(F.transform("blocks", window)).alias("k", "text"))
    start = F.col("k") * step
    rows = cut.where(((F.col("k") == 0) | (start + overlap < F.col("n"))) & not_blank(F.col("text")))
    return rows.select("path", (start + 1).alias("start_line"), F.least(start + size, F.col("n")).alias("end_line"), F.trim("text", F.lit(BLANKS)).alias("text"), *keep)


def section_chunks(files: DataFrame, weight: float = 1.5, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, section, title, start_line, end_line, text, weight, columns ``keep``): text cut before headings of level 1 to 3, inside each row by array functions, so no file is shuffled."""
    body = F.col(text_col)
    own = files.select(F.col(path_col).alias("path"), *keep, lines(body).alias("l"), F.split(body, r"\n(?=#{1,3}[^\S\n]+\S)", -1).alias("parts"))
    heading = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.element_at(F.col("l"), i).rlike(r"^#{1,3}\s+\S"))
    own = own.select("path", *keep, "parts", F.size("l").alias("n"), F.array_distinct(F.concat(F.array(F.lit(1)), heading)).alias("h"))
    # A section's text comes by the cut at the same headings, so that no row carries all lines.
    ends = F.concat(F.slice("h", 2, F.size("h")), F.array(F.col("n") + 1)).alias("e")
    cut = own.select("path", *keep, F.posexplode(F.arrays_zip("parts", "h", ends)).alias("section", "p"))
    text = F.trim(F.replace("p.parts", F.lit("\r\n"), F.lit("\n")), F.lit(BLANKS))
    title = F.regexp_extract(F.substring_index("p.parts", "\n", 1), r"^#{1,3}\s+(.*?)\s*$", 1)
    return cut.where(not_blank(F.col("p.parts"))).select("path", "section", title.alias("title"), F.col("p.h").alias("start_line"), (F.col("p.e") - 1).alias("end_line"), text.alias("text"), F.lit(weight).alias("weight"), *keep)


def heading_sections(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, level, title, ancestry): headings of level 1 to 6 with the titles above them.

    The fold keeps, for each heading, the nearest earlier headings of smaller levels.
    """
    own = files.select(F.col(path_col).alias("path"), lines(F.col(text_col)).alias("l"))
    found = F.filter(
        F.transform("l", lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.*?)\s*$", 1).alias("title"))),
        lambda h: h["level"] > 0,
    )
    each = own.withColumn("h", found).select("path", "h", F.explode("h").alias("own"))
    above = F.filter("h", lambda x: (x["line"] < F.col("own.line")) & (x["level"] < F.col("own.level")) & ~F.exists("h", lambda y: (y["line"] > x["line"]) & (y["line"] < F.col("own.line")) & (y["level"] <= x["level"])))
    return each.select("path", "own.line", "own.level", "own.title", F.transform(above, lambda x: x["title"]).alias("ancestry"))


def bullets(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, text) of list items of four characters or more."""
    own = files.select(F.col(path_col).alias("path"), F.posexplode(lines(F.col(text_col))).alias("n", "raw"))
    item = F.regexp_extract("raw", r"^\s*(?:[-*+]|\d+[.)])\s+(.+?)\s*$", 1)
    return own.select("path", (F.col("n") + 1).alias("line"), item.alias("text")).where("length(text) >= 4")


def looks_like_instruction(text: Column) -> Column:
    """Modal or imperative text; any other of eight characters with a letter passes as well."""
    modal = text.rlike(r"(?i)\b(must|should|never|always|do not|don't|avoid|prefer|use|ensure|require[sd]?|shall|only)\b")
    return (F.length(text) >= 4) & (modal | text.rlike(r"(?i)^(add|keep|write|run|follow|name|place|put|return|throw|validate)\b") | ((F.length(text) >= 8) & text.rlike("[A-Za-z]")))


def frontmatter(text: Column) -> Column:
    """Map of the key: value lines between leading --- lines; null without them."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)
    pairs = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*)\s*:", 1))
    values = F.transform(pairs, lambda x: F.regexp_replace(F.regexp_extract(x, r"^[^:]+:\s*(.*?)\s*$", 1), "^[\"']|[\"']$", ""))
    last = F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull()))
    return F.when(block != "", last)


def chunk_files(files: DataFrame) -> DataFrame:
    """(id, path, symbol, start_line, end_line, text, kind, weight, file_hash) by file type: sections of Markdown, types and functions of PHP (windows where it has none), line windows of the rest."""
    from .extract import php_chunks

    keyed = files.select("path", "text", F.sha2("text", 256).alias("file_hash"))
    is_doc, is_php = extension(F.col("path")).isin("md", "mdx", "mdc", "markdown"), F.col("path").endswith(".php")
    priority = F.lower(base_name(F.col("path"))).isin(*PRIORITY_MEMORY)
    none = F.lit(None).cast("string").alias("symbol")
    row = lambda symbol, kind, weight: ("path", symbol, "start_line", "end_line", "text", F.lit(kind).alias("kind"), weight.alias("weight"), "file_hash")
    sections = section_chunks(keyed.where(is_doc), keep=("file_hash",)).select(*row(none, "memory", F.when(priority, F.lit(2.0)).otherwise(F.lit(1.4))))
    blocks = php_chunks(keyed, keep=("file_hash",)).select(*row(F.col("symbol"), "source", F.col("weight")))
    # Other texts count as null, which no window comes of; as a filter the test would have Spark make a derived text twice.
    whole = keyed.where(is_php).withColumn("text", F.when(~F.col("text").rlike(PHP_BLOCK), F.col("text")))
    plain = window_chunks(whole, keep=("file_hash",)).select(*row(none, "source", F.lit(1.0)))
    rest = window_chunks(keyed.where(~is_doc & ~is_php), keep=("file_hash",)).select(*row(none, "config", F.lit(0.9)))
    both = sections.unionByName(blocks).unionByName(plain).unionByName(rest)
    return both.select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.coalesce("symbol", F.lit(""))).alias("id"), "*")


def annotate_with_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with the first symbol (by line, then id) that overlaps them; kind becomes source then."""
    c, s = binned(chunks.select("id", "path", "start_line", "end_line")).alias("c"), binned(symbols.select("id", "name", "path", "start_line", "end_line")).alias("s")
    over = c.join(s, (F.col("c.path") == F.col("s.path")) & (F.col("c.bin") == F.col("s.bin")) & (F.col("c.start_line") <= F.col("s.end_line")) & (F.col("s.start_line") <= F.col("c.end_line")))
    first = over.groupBy("c.id").agg(F.min_by("s.name", F.struct("s.start_line", "s.id")).alias("symbol"))
    return chunks.drop("symbol").join(first, "id", "left").withColumn("kind", F.when(F.col("symbol").isNotNull(), F.lit("source")).otherwise(F.col("kind")))


def running_sections(line_rows: DataFrame) -> DataFrame:
    """The same cut for texts that are stored one line a row (path, line, raw): a running count of headings numbers the sections."""
    w = Window.partitionBy("path").orderBy("line")
    return line_rows.withColumn("section", F.sum(F.col("raw").rlike(r"^#{1,3}\s+\S").cast("int")).over(w))


def document_name(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")
