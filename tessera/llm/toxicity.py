"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs (accented, full-width, mathematical, Cyrillic and
Greek look-alikes) and digit or sign substitutions to letters, and removes zero-width
characters. Lexicon entries are whole words or word beginnings; a match must begin at a
word's start, and one inside an exception phrase doesn't count. Weights are log-odds of
the entries in labelled documents. The sum of weights over all matches, and the same
normalised by the length in words, go through a logistic curve that is fitted on the
same labelled rows: one harmless match in a long text stays harmless.

Entries come from a bounded sample of labelled training rows (``max_fit_rows``): their
words and word beginnings are counted by class in Spark, those of at least ``min_support``
toxic rows are ranked, the best ``max_candidates`` are matched in the sample, and a greedy
cover keeps the few that explain the toxic rows, so that words which merely stand beside
them don't enter. (These bounds shape the lexicon only; scoring reads every text whole.) An entry is counted twice, for
rows that have it and for rows that have it at least two times (``entry+``): some words
are toxic only where they pile up. A small seed list takes part with
a prior weight. Scoring is one pass over all whole texts without a shuffle.

Defined cases: null and empty texts have no matches and get the curve's base score;
repeated rows are scored alike; without labels only the seed list acts; empty tables
give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, map_text, materialise, set_aside, table

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7

# Look-alikes of Latin letters, one for one.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһкмтвнгαορνικτυε", "aeopcyxijsdhkmtbhraopviktue", strict=True))
SUBSTITUTES = dict(zip("0134578@$", "oieasbbas", strict=True)) | {"7": "t", "8": "b"}
ZERO_WIDTH = "​‌‍⁠﻿­"
# Insults to start from, and harmless phrases that contain some.
SEEDS = ("idiot", "moron", "stupid", "loser", "worthless", "pathetic", "disgusting", "scum", "trash", "clown", "imbecile", "bastard")
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash talk show", "class clown award", "stupid simple", "sore loser rule")
SEED_WEIGHT = 4.0
NAME = re.compile(r"[^\W\d_]+")


def folding_table() -> dict[int, str | None]:
    """Code points to letters: whatever decomposes to one ASCII letter, look-alikes and substitutes."""
    out: dict[int, str | None] = {ord(c): None for c in ZERO_WIDTH}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)):
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        if base and base.isascii() and base.isalpha():
            out[code] = base
    out.update({ord(k): v for k, v in (LOOK_ALIKE | SUBSTITUTES).items()})
    return out


FOLD = folding_table()
SIGNS = str.maketrans({"@": " ", "$": " "})
INNER = re.compile(r"(?<=\w)[@$](?=\w)")


def fold(text: str) -> str:
    """Lower-cased, with look-alikes and substitutes as letters and single blanks; signs count as letters only inside a word."""
    low = text.lower()
    if "$" in low or "@" in low:
        low = INNER.sub(lambda m: "a" if m[0] == "@" else "s", low).translate(SIGNS)
    return " ".join(low.translate(FOLD).split())


@dataclass
class Lexicon:
    """Entries (a trailing * marks a word beginning) with weights, exception phrases and the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (1.5, 0.5, -4.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        values: dict[str, list] = {}
        for entry, weight in self.weights.items():
            stem = entry.rstrip("*")
            values.setdefault(stem, []).append((len(stem), entry, weight))
        for phrase in self.exceptions:
            values.setdefault(phrase, []).append((len(phrase), "", 0.0))
        for stem, value in values.items():
            found.add_word(stem, value)
        if values:
            found.make_automaton()
        return found if values else None


def matches(folded: str, automaton) -> list[tuple[int, int, str, float]]:
    """(start, end, entry, weight) of entries that count: at a word's start, whole where asked, outside exceptions."""
    if automaton is None:
        return []
    hits, safe, n = [], [], len(folded)
    for last, values in automaton.iter(folded):
        end = last + 1
        for length, entry, weight in values:
            start = end - length
            if start and folded[start - 1].isalnum():
                continue
            if entry[-1:] != "*" and end < n and folded[end].isalnum():
                continue
            (hits if entry else safe).append((start, end, entry, weight))
    return [h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in safe)] if safe else hits


def strength(found: list[tuple[int, int, str, float]], folded: str) -> tuple[float, float]:
    """Log of the sum of weights, as it is and for a hundred words; of entries that start together the heaviest counts."""
    best: dict[int, float] = {}
    for start, _, _, weight in found:
        best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / max(20, len(folded.split())))


def score_texts(texts: list[str | None], lexicon: Lexicon, automaton) -> tuple[list[float], list[int]]:
    scores, counts = [], []
    a, b, c = lexicon.curve
    for text in texts:
        found, x, y = [], 0.0, 0.0
        if text:
            folded = fold(text)
            if found := matches(folded, automaton):
                x, y = strength(found, folded)
        scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))))
        counts.append(len(found))
    return scores, counts


def levels(times: Counter) -> set[str]:
    return set(times) | {f"{entry}+" for entry, n in times.items() if n > 1}


def entries_of(text: str) -> set[str]:
    """A text's whole words and word beginnings of four to eight letters, folded, and again with + where they repeat."""
    times: Counter = Counter()
    for word, n in Counter(NAME.findall(fold(text))).items():
        if len(word) > 2:
            times[word] += n
        for k in range(4, min(9, len(word))):
            times[f"{word[:k]}*"] += n
    return levels(times)


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000, min_support: int = 4) -> Lexicon:
    """Learn weights and the curve from at most max_fit_rows labelled rows outside the held-out fold.

    Candidates are all entries that stand in ``min_support`` toxic rows of the sample or more and
    whose odds are surely raised; so what is collected is bounded by the sample.
    """
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, max_fit_rows).where("text IS NOT NULL")
    sample = materialise(sample.select("text", "__label"), "toxicity-sample")

    def count(batches):
        for batch in batches:
            toxic: Counter = Counter()
            clean: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(entries_of(text))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "pos": pa.array([toxic[k] for k in names], pa.int64()), "neg": pa.array([clean[k] for k in names], pa.int64())})

    counted = sample.select("text", "__label").mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = sample.agg(F.coalesce(F.sum("__label"), F.lit(0)), F.count("*")).first()
    n_pos, n_neg = int(total[0]), int(total[1] - total[0])
    odds = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    bound = F.col("odds") - 1.3 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counted.where(F.col("pos") >= min_support).withColumn("odds", odds).withColumn("bound", bound).where("bound > 1").collect()
    odds_of = {r.entry: (r.odds, r.bound, r.pos) for r in best}
    candidates = Lexicon({e.removesuffix("+"): 1.0 for e in odds_of})

    def match(batches):
        automaton = candidates.automaton()
        for batch in batches:
            found = [sorted(levels(Counter(m[2] for m in matches(fold(t), automaton)))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column(1).cast(pa.int32()), "found": pa.array(found, pa.list_(pa.string()))})

    rows = sample.select("text", "__label").mapInArrow(match, "label int, found array<string>").where("size(found) > 0 AND label = 1").collect()
    left = [{e for e in r.found if e in odds_of} for r in rows]
    weights: dict[str, float] = {}
    while left:
        # what an entry explains that no chosen one does, times how sure it is; a sure one may explain two rows only
        gain = Counter(e for found in left for e in found)
        fit_for = [e for e in gain if gain[e] >= min_support or gain[e] > 1 and odds_of[e][1] > 2.5 and odds_of[e][2] >= 10]
        entry = max(fit_for, key=lambda e: (gain[e] * odds_of[e][1], len(e), e), default=None)
        if entry is None:
            break
        name = entry.removesuffix("+")
        weights.setdefault(name, odds_of[entry][0] / (1 + (name != entry)))
        left = [found for found in left if entry not in found]
    for seed in SEEDS:
        weights.setdefault(seed, odds_of[seed][0] if seed in odds_of else SEED_WEIGHT)
    lexicon = Lexicon(weights)

    def strengths(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            texts = [fold(t) for t in batch.column(0).to_pylist()]
            x = np.array([strength(matches(t, automaton), t) for t in texts]).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"label": batch.column(1).cast(pa.int32()), "x": pa.array(x[:, 0]), "y": pa.array(x[:, 1])})

    # at most max_fit_rows rows of three numbers
    points = sample.mapInArrow(strengths, "label int, x double, y double").collect()
    lexicon.curve = curve(np.array([[p.x, p.y] for p in points]).reshape(-1, 2), np.array([p.label for p in points]))
    return lexicon


def curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Coefficients, none below 0, and offset of a lightly regularised logistic curve."""
    if (label == 1).sum() < 5 or (label == 0).sum() < 5:
        return Lexicon({}).curve
    x = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.5, -3.0])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (p - label) + 0.1 * w)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w[:2] = np.maximum(w[:2], 0)
    return tuple(w.tolist())


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Docs with score (0 to 1) and n_matches."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        own = shared.value
        automaton = own.automaton()

        def work(column):
            scores, counts = score_texts(column.to_pylist(), own, automaton)
            return pa.array(scores, pa.float64()), pa.array(counts, pa.int64())

        return work

    return map_text(docs, "score double, n_matches long", make, text_col, keep)


def remove_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Docs whose score is below the threshold; columns as they were."""
    own, back = set_aside(docs, ["score", "n_matches"])
    return score(own, lexicon).where(F.col("score") < threshold).drop("score", "n_matches").withColumnsRenamed(back).select(*[f"`{c}`" for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict = {}
