"""Context packs: budgeted evidence for a task, by template, as Markdown with frontmatter."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence
from . import graph, metrics
from .ranges import binned

# What a pack may hold at most, and by depth.
CEILINGS = {"max_files": 40, "max_symbols": 60, "max_chars": 120_000, "dependency_depth": 4}
DEPTHS = {"quick": (6, 10, 12_000, 1), "standard": (12, 20, 24_000, 2), "deep": (24, 40, 60_000, 3)}
SECTIONS = {
    "task": "Task", "files": "Relevant files", "symbols": "Key symbols", "evidence": "Evidence", "instructions": "Applicable instructions",
    "dependencies": "Dependencies", "tests": "Related tests", "risks": "Risk indicators", "open_questions": "Open questions",
}
FORBIDDEN = ("api_key", "token", "secret", "password", "command", "shell", "exec")


@dataclass(frozen=True)
class Template:
    """Sections and limits of a pack."""

    id: str
    name: str
    sections: tuple[str, ...] = tuple(SECTIONS)
    depth: str = "standard"
    max_files: int = 12
    max_symbols: int = 20
    max_chars: int = 24_000
    dependency_depth: int = 2
    extra: dict = field(default_factory=dict)

    def clamped(self) -> Template:
        """Limits at their ceilings, known sections only, at least the task."""
        limits = {k: max(1, min(getattr(self, k), most)) for k, most in CEILINGS.items()}
        return replace(self, sections=tuple(s for s in dict.fromkeys(("task", *self.sections)) if s in SECTIONS), **limits)


BUILTIN = {
    t.id: t
    for t in (
        Template("default", "Default"),
        Template("bug-fix", "Bug fix", ("task", "evidence", "symbols", "tests", "risks")),
        Template("feature", "Feature", ("task", "files", "symbols", "instructions", "dependencies", "tests", "open_questions"), "deep", 24, 40, 60_000, 3),
        Template("review", "Review", ("task", "files", "instructions", "risks", "tests")),
        Template("refactor", "Refactor", ("task", "symbols", "dependencies", "tests", "risks"), "deep", 24, 40, 60_000, 3),
        Template("onboarding", "Onboarding", ("task", "files", "instructions", "dependencies"), "quick", 6, 10, 12_000, 1),
    )
}


def for_depth(base: Template, depth: str) -> Template:
    files, symbols, chars, hops = DEPTHS.get(depth, DEPTHS["standard"])
    return replace(base, depth=depth if depth in DEPTHS else "standard", max_files=files, max_symbols=symbols, max_chars=chars, dependency_depth=hops)


def parse_frontmatter(markdown: str) -> tuple[dict, str]:
    """(fields, body): key: value lines and - lists between leading --- lines."""
    m = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|$)", markdown, re.S)
    if not m:
        return {}, markdown
    fields: dict = {}
    key = None
    for line in m[1].splitlines():
        if item := re.match(r"\s+-\s+(.*)$", line):
            if isinstance(fields.get(key), list):
                fields[key].append(item[1].strip().strip("'\""))
        elif pair := re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line):
            key, value = pair[1], pair[2].strip().strip("'\"")
            fields[key] = value if value else []
    return fields, markdown[m.end() :]


def parse_template(markdown: str, identifier: str) -> Template:
    """A template from Markdown: unknown sections and forbidden fields are left out, limits clamped, the rest inherited from ``base``."""
    fields, _ = parse_frontmatter(markdown)
    fields = {k: v for k, v in fields.items() if not any(word in k.lower() for word in FORBIDDEN)}
    base = BUILTIN.get(str(fields.get("base", "default")), BUILTIN["default"])
    if "depth" in fields:
        base = for_depth(base, str(fields["depth"]))
    numbers = {k: int(fields[k]) for k in CEILINGS if str(fields.get(k, "")).isdigit()}
    sections = tuple(fields["sections"]) if isinstance(fields.get("sections"), list) and fields["sections"] else base.sections
    return replace(base, id=identifier, name=str(fields.get("name", identifier)), sections=sections, **numbers).clamped()


def resolve_template(identifier: str | None, own: dict[str, str] | None = None) -> Template:
    """A project's own template of this id, else the built-in one, else the default."""
    if identifier and own and identifier in own:
        return parse_template(own[identifier], identifier)
    return BUILTIN.get(identifier or "default", BUILTIN["default"]).clamped()


def excerpts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (id, path, start_line, end_line) with the text of the first chunk that overlaps each."""
    h, c = binned(hits.select("id", "path", "start_line", "end_line")).alias("h"), binned(chunks.select("id", "path", "start_line", "end_line", "text")).alias("c")
    over = h.join(c, (F.col("h.path") == F.col("c.path")) & (F.col("h.bin") == F.col("c.bin")) & (F.col("c.start_line") <= F.col("h.end_line")) & (F.col("h.start_line") <= F.col("c.end_line")))
    first = over.groupBy("h.id").agg(F.min_by("c.text", F.struct("c.start_line", "c.id")).alias("excerpt"))
    return hits.join(first, "id", "left")


def pack_confidence(hits: DataFrame, by: str | None = None) -> DataFrame:
    """(by, confidence) of each pack's hits (confidence): more hits and surer ones count, between 0.1 and 0.95; 0.15 without any."""
    n, sure, medium = F.count("confidence"), F.count_if(F.col("confidence") == "high"), F.count_if(F.col("confidence") == "medium")
    score = 0.25 + F.least(F.lit(0.55), n / 20) + sure * 0.03 + medium * 0.015
    return hits.groupBy(*([by] if by else [])).agg(F.when(n == 0, 0.15).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.95), score))).alias("confidence"))


def architecture(hits: DataFrame) -> DataFrame:
    """(layer, path, score): a search's files by the layer that their paths name."""
    layer = (
        F.when(F.col("path").rlike(r"(?i)/(controllers?|routes?|handlers?|http|api)/"), "entry")
        .when(F.col("path").rlike(r"(?i)/(services?|actions?|jobs?|commands?)/"), "application")
        .when(F.col("path").rlike(r"(?i)/(models?|entities|domain)/"), "domain")
        .when(F.col("path").rlike(r"(?i)/(repositories|database|migrations)/"), "storage")
        .when(F.col("path").rlike(r"(?i)\.md$"), "documentation")
        .otherwise("other")
    )
    return hits.groupBy(layer.alias("layer"), "path").agg(F.max("score").alias("score"))


@dataclass
class Pack:
    """Bullets by section, and what they came from."""

    template: Template
    task: str
    sections: dict[str, list[str]]
    truncated: bool = False

    def markdown(self, at: str) -> str:
        """Frontmatter, title and non-empty sections; a pack beyond its characters loses bullets from the end, sections stay."""
        left = self.template.max_chars
        parts = []
        for name in self.template.sections:
            lines = []
            for bullet in self.sections.get(name, []):
                if len(bullet) + 3 > left:
                    self.truncated = True
                    break
                left -= len(bullet) + 3
                lines.append(f"- {bullet}")
            parts.append(f"## {SECTIONS[name]}\n\n" + ("\n".join(lines) or "_none found_"))
        head = {"task": self.task.replace("\n", " "), "template": self.template.id, "generated_at": at, "truncated": str(self.truncated).lower()}
        return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + f"---\n\n# {self.task}\n\n" + "\n\n".join(parts) + "\n"


def has_sections(markdown: str, template: Template) -> bool:
    return all(f"## {SECTIONS[s]}" in markdown for s in template.sections)


def assemble(task: str, hits: DataFrame, chunks: DataFrame, edges: DataFrame, instructions: DataFrame | None = None, template: Template | None = None) -> Pack:
    """A pack from a search's hits, which are few (a budget chose them); graph and excerpts are joined in Spark before they come to the driver."""
    plan = (template or BUILTIN["default"]).clamped()
    few = hits.persist()
    found = excerpts(few.select("id", "path", "start_line", "end_line", "score", "result_type", "symbol_id"), chunks)
    rows = found.withColumn("excerpt", evidence(F.coalesce("excerpt", F.lit("")))).orderBy(F.desc("score"), "path", "id").limit(plan.max_files + plan.max_symbols).collect()
    near = graph.incident(edges, few.select(F.col("path").alias("node")).distinct()).select("node", "kind", "from_path", "to_path").orderBy("node", "kind", "from_path", "to_path").limit(100).collect()
    files = list(dict.fromkeys(r.path for r in rows))[: plan.max_files]
    symbols = [r for r in rows if r.result_type == "symbol"][: plan.max_symbols]
    tests = [e.from_path for e in near if e.kind == "likelyTestCoverage"]
    blob = " ".join([task, *(r.excerpt for r in rows)])
    risk = few.sparkSession.range(1).select(metrics.task_risks(F.lit(blob), F.lit(sum(e.kind == "call" for e in near)), F.lit(len(tests))).alias("r")).first().r
    rules = [] if instructions is None else [f"{r.doc_path} ({r.precedence})" for r in instructions.orderBy(F.desc("precedence"), "doc_path").limit(20).collect()]
    bullets = {
        "task": [task],
        "files": [f"`{p}`" for p in files],
        "symbols": [f"`{r.symbol_id}` in `{r.path}`:{r.start_line}" for r in symbols],
        "evidence": [f"`{r.path}`:{r.start_line}-{r.end_line} {r.excerpt}" for r in rows if r.excerpt],
        "instructions": rules,
        "dependencies": [f"`{e.from_path}` {e.kind} `{e.to_path}`" for e in near if e.kind != "likelyTestCoverage"],
        "tests": [f"`{t}`" for t in dict.fromkeys(tests)],
        "risks": list(risk),
        "open_questions": [] if rows else ["No matching evidence in the index."],
    }
    few.unpersist()
    return Pack(plan, task, bullets)


def file_name(task: str, at: dt.datetime) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", task.lower()).strip("-")[:48].rstrip("-")
    return f"{at:%Y%m%d-%H%M%S}-{slug or 'task'}.md"


def describe(template: Template) -> dict:
    return asdict(template.clamped()) | {"titles": [SECTIONS[s] for s in template.clamped().sections]}


def related_digest(candidates: DataFrame) -> DataFrame:
    """(id, digest): related candidates (id, path, reason, priority) of each change as one text, the most urgent first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("order"), "path", "reason")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("- "), r["path"], F.lit(" ("), r["reason"], F.lit(")")))
    return candidates.groupBy("id").agg(F.array_join(lines, "\n").alias("digest"))


def diff_paths(diffs: DataFrame) -> DataFrame:
    """(id, path): files that unified diffs (id, diff) change, the new name of renamed ones."""
    lines = diffs.select("id", F.explode(F.split("diff", "\r?\n")).alias("line"))
    return lines.select("id", F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1).alias("path")).where("path NOT IN ('', '/dev/null')").distinct()


# What a related file's reason counts; the best one is told.
REASONS = {"test": 90, "imported": 80, "importer": 70, "config": 20}


def related_candidates(changed: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, reason, priority) of files beside changed ones (id, path): imports, importers, tests by stem, all manifests; each by its best reason.

    A priority tells its reason, so numbers are gathered. Rows are dealt out by their key before
    that, so that no task holds what its part of the edges makes of pairs; ``files`` may repeat paths.
    """
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", ""), r"(?i)([._-]?(test|spec))$", "")
    as_row = lambda path, reason: ("id", F.col(path).alias("path"), F.lit(REASONS[reason]).alias("priority"))
    e = edges.where("to_path IS NOT NULL")
    out = changed.join(e.select(F.col("from_path").alias("path"), "to_path"), "path").select(*as_row("to_path", "imported"))
    into = changed.join(e.select(F.col("to_path").alias("path"), "from_path"), "path").select(*as_row("from_path", "importer"))
    tests = files.where(F.col("path").rlike(r"(?i)(\.(test|spec)\.|/tests?/|Test\.php$)")).select(stem("path").alias("stem"), F.col("path").alias("other"))
    tested = changed.select("id", stem("path").alias("stem")).join(tests, "stem").select(*as_row("other", "test"))
    manifests = files.where(F.col("path").rlike(r"(^|/)(package|composer)\.json$")).select("path").distinct()
    config = changed.select("id").distinct().crossJoin(manifests).select(*as_row("path", "config"))
    own = max(REASONS.values()) + 1
    both = out.unionByName(into).unionByName(tested).unionByName(config).unionByName(changed.select("id", "path", F.lit(own).alias("priority")))
    best = both.repartition("id", "path").groupBy("id", "path").agg(F.max("priority").alias("priority")).where(F.col("priority") < own)
    reason = F.element_at(F.create_map(*[F.lit(x) for r, n in REASONS.items() for x in (n, r)]), F.col("priority"))
    return best.join(files.select("path"), "path", "left_semi").select("id", "path", reason.alias("reason"), "priority")
