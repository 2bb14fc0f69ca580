"""Small tables with the awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "ka lo mi ru te so na vi pe du ba fo gi hu je".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def table(spark, texts, first=0, source=lambda i: f"s{i % 3}"):
    rows = [(first + i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(rng):
    """Null, empty, blank, one word, short, repeated rows, long, other scripts."""
    long = prose(rng, 4000)
    same = prose(rng, 80)
    return [None, "", " \n\t ", "word", "a b c d", same, same, same, long, long + " end", "ñ é 漢字 " * 30, "x " * 300, prose(rng, 60)]


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def rng(seed=1):
    return random.Random(seed)
