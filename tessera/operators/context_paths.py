"""What a documentation file is by its place and name, and what that makes of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder that a project's memory lies in.
MEMORY = r"(?i)(^|/)\.memory/"
# What a path is, by the first row that fits. Of the path or the file's name in lower case (which), an expression; type, confidence, binding;
# whether it holds below its folder only.
OF_PATH, OF_NAME = "path", "name"
PLACES = (
    (OF_PATH, r"(?i)(^|/)\.memory/(rag|generated)/|(^|/)generated/.*\.md$", "generated_memory", "high", "generated", False),
    (OF_PATH, MEMORY + r"(.*/)?architecture\.md$", "architecture", "high", "contextual", False),
    (OF_PATH, MEMORY + r"(.*/)?conventions\.md$", "convention", "high", "contextual", False),
    (OF_PATH, MEMORY + r"(.*/)?integrations\.md$", "integration", "high", "contextual", False),
    (OF_PATH, MEMORY + r"(.*/)?glossary\.md$", "glossary", "high", "contextual", False),
    (OF_PATH, MEMORY + r"(.*/)?risks\.md$", "risk", "high", "contextual", False),
    (OF_PATH, MEMORY, "general_documentation", "medium", "contextual", False),
    (OF_NAME, r"^(agents|agent|claude)\.md$", "instruction", "high", "binding", True),
    (OF_PATH, r"(^|/)\.cursor/rules/|(?i:\.mdc$)|(^|/)(?i:\.cursorrules)$", "convention", "high", "binding", False),
    (OF_PATH, r"(^|/)adr/|(^|/)docs/adrs/|(^|/)architecture/decisions/|(^|/)(?i:adr[-_])[^/]*$|/(?i:adrs|decisions)/(.*/)?\d{3,5}-[^/]+(?i:\.md)$|^docs/adr(.*/)?\d{3,5}-[^/]+(?i:\.md)$", "decision", "high", "contextual", False),
    (OF_NAME, r"^readme(\.[a-z0-9]+)?\.md$|^readme\.", "general_documentation", "high", "contextual", True),
    (OF_NAME, r"^contributing\.md$", "convention", "high", "contextual", False),
    (OF_PATH, r"(?i)architecture.*\.md$", "architecture", "medium", "contextual", False),
    (OF_NAME, r"glossary", "glossary", "high", "contextual", False),
    (OF_NAME, r"risk|security|threat", "risk", "medium", "contextual", False),
    (OF_NAME, r"integrat", "integration", "medium", "contextual", False),
)
CONFIGURED = ("instruction", "medium", "binding")
DOCS, ELSEWHERE = r"(^|/)docs/", "general_documentation"


def context_class(path: Column, user_configured: Column | None = None) -> Column:
    """(doc_type, authored, confidence, binding, scope) of a path; what no row names is configured by the user, or general documentation."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))

    def shape(doc_type: str, confidence: str, binding: str, scope: Column) -> Column:
        authored = "generated" if binding == "generated" else "human"
        return F.struct(F.lit(doc_type).alias("doc_type"), F.lit(authored).alias("authored"), F.lit(confidence).alias("confidence"), F.lit(binding).alias("binding"), scope.alias("scope"))

    everywhere = F.lit("")
    out = F.when(path.rlike(DOCS), shape(ELSEWHERE, "medium", "contextual", everywhere)).otherwise(shape(ELSEWHERE, "low", "contextual", everywhere))
    if user_configured is not None:
        out = F.when(user_configured, shape(*CONFIGURED, everywhere)).otherwise(out)
    for which, expression, doc_type, confidence, binding, own in reversed(PLACES):
        out = F.when((path if which == OF_PATH else name).rlike(expression), shape(doc_type, confidence, binding, folder if own else everywhere)).otherwise(out)
    return out
