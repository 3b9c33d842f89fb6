"""Seed resources written for this library (word lists, lexicon).

The English stop-word list is Spark's own default list
(``StopWordsRemover.loadDefaultStopWords('english')``), stored as a file so
that code without a JVM (the SQL oracle) reads the very same words.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

_DIR = Path(__file__).resolve().parent


def _lines(name: str) -> tuple[str, ...]:
    text = (_DIR / name).read_text(encoding="utf-8")
    return tuple(w for w in (line.strip() for line in text.splitlines()) if w)


@lru_cache(maxsize=None)
def english_stopwords() -> tuple[str, ...]:
    return _lines("stopwords_en.txt")


@lru_cache(maxsize=None)
def negators() -> tuple[str, ...]:
    return _lines("negators_en.txt")


def _pairs(name: str) -> tuple[tuple[str, float], ...]:
    with open(_DIR / name, encoding="utf-8", newline="") as fh:
        rows = list(csv.reader(fh))
    return tuple((r[0], float(r[1])) for r in rows[1:] if r)


@lru_cache(maxsize=None)
def seed_lexicon() -> tuple[tuple[str, float], ...]:
    return _pairs("lexicon_en.csv")


@lru_cache(maxsize=None)
def degree_words() -> tuple[tuple[str, float], ...]:
    return _pairs("degree_en.csv")


def path(name: str) -> str:
    return str(_DIR / name)
