"""Licence scans by ordered signature rules.

Hundreds of patterns are matched against a text's words. Every rule has
keywords of which its matches must hold one; only the rules with a keyword that
the text has are run. Detections that lie within another of the same or a higher priority are
suppressed, of several with one place all but the first of the highest priority;
detections of the base phrases always stay.

Defined results for odd input: a null text counts as empty; a text without
detections has score 0, empty labels and null first and last words. Repeated
rows are kept, labels are distinct and sorted, columns other than doc_id and
text are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import BASE, rules

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORDS.findall(text.lower() if text.isascii() else text.translate(UPPER))


class Scanner:
    """Compiled rules and their keyword prefilter."""

    def __init__(self):
        self.rules = [(label, priority, re.compile(f"(?<= )(?:{pattern})(?= )")) for label, priority, pattern, _ in rules()]
        self.by_word: dict[str, list[int]] = {}
        for k, rule in enumerate(rules()):
            for word in rule[3]:
                self.by_word.setdefault(word, []).append(k)
        self.keywords = frozenset(self.by_word)
        self.base = [(label, phrase.split(), f" {phrase} ") for phrase, label in BASE]

    def detections(self, words: list[str], present: set[str]) -> list[tuple[int, int, str, int]]:
        """``(first word, words, label, priority)`` of what is left after suppression, in text order."""
        text = f" {' '.join(words)} "
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w) + 1
        found = []
        for k in sorted({k for w in present for k in self.by_word[w]}):
            label, priority, pattern = self.rules[k]
            for m in pattern.finditer(text):
                first = bisect_right(starts, m.start()) - 1
                found.append((first, bisect_right(starts, m.end() - 1) - first, label, priority))
        return suppress(found)

    def places(self, words: list[str]) -> list[tuple[int, str]]:
        """All places of base phrases: first word and label."""
        out = []
        for label, phrase, _ in self.base:
            n, at = len(phrase), -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    out.append((at, label))
        return sorted(out)

    def scan(self, text: str | None) -> tuple:
        """Digest of a text: words, base places, their first and last word, base labels, all labels, score."""
        words = words_of(text)
        present = self.keywords.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        base = self.places(words)
        found = self.detections(words, present)
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(f[2] for f in found)})
        score = 1.0 if base else max((f[3] for f in found), default=0) / 100
        return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score


def suppress(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections that don't lie within another of the same or a higher priority; of those with one place the first of the highest priority stays."""
    place = {f: n for n, f in reversed(list(enumerate(found)))}
    # the widest first, so that whatever a detection may lie within comes before it
    ordered = sorted(place, key=lambda f: (f[0], -f[1], -f[3], place[f]))
    kept, near = [], []  # near: those kept that reach beyond the present one's begin
    for f in ordered:
        near = [g for g in near if g[0] + g[1] > f[0]]
        if not any(g[0] + g[1] >= f[0] + f[1] and g[3] >= f[3] for g in near):
            kept.append(f)
            near.append(f)
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def detections(docs: DataFrame) -> DataFrame:
    """One row for each detection: doc_id, label, priority, first word, words."""

    @F.pandas_udf("array<struct<label: string, priority: int, first_word: bigint, n_words: bigint>>")
    def found(texts: pd.Series) -> pd.Series:
        s, out = scanner(), []
        for text in texts:
            words = words_of(text)
            present = s.keywords.intersection(words)
            rows = s.detections(words, present) if present else []
            out.append([{"label": label, "priority": priority, "first_word": first, "n_words": n} for first, n, label, priority in rows])
        return pd.Series(out)

    return docs.select("doc_id", F.explode(found(F.col("text").cast("string"))).alias("found")).select("doc_id", "found.*")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the digest of every row's text."""

    @F.pandas_udf("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double>")
    def digest(texts: pd.Series) -> pd.DataFrame:
        s = scanner()
        out = pd.DataFrame([s.scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", digest(F.col("text").cast("string")).alias("digest")).select("doc_id", "digest.*")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
