"""Training-data operators: token counts, near duplicates, repeats, media, toxicity, URLs, mixing, secrets, contamination, quality.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()`` gather
what the operator modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "suffix_dedup",
    "ngram_join",
    "token_rollup",
    "url_cascade",
    "source_mix",
    "quality_fm",
    "media_ts",
    "secret_scan",
    "toxicity",
    "decontaminate",
    "topk_search",
    "whitening",
    "conversation_repair",
)


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").ORACLES)
    return found
