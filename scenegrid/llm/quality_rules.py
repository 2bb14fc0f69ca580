"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean column that is true where the text is to be rejected. ``plan`` estimates on a sample
what each rule costs, as it will run there, and how much it rejects, and orders the rules by rejection per cost; ``cascade``
evaluates them in that order with CASE, so a text that one rule rejects costs none of the later ones.
The order changes the speed and the named rule (``rejected_by``), never the verdict.

Null texts count as empty; empty texts fail the word count. Ties in the order fall back to the rule's name.
Repeated rows are judged alike; an empty table gives an empty result; columns of the input that have a
feature's name are replaced.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import fresh

#: White space that ends a word.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 1000
#: Each sampled row is judged so often, each rule timed so often: a rule's cost is the median, less that of a job without one.
REPEAT, TIMES = 8, 3
SAMPLE_TASKS = 8

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    cost: float = 0.0
    rejects: float = 0.0

    @property
    def rank(self) -> float:
        return self.rejects / max(self.cost, 1e-9)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window which the text has twice or more, the first included."""

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, k)).alias("h"), i.alias("i")))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, none, lambda a, s: F.struct((s + k).alias("end"), (a["n"] + k - F.greatest(F.lit(0), a["end"] - s)).alias("n")), lambda a: a["n"])

    return let(words, lambda w: F.when(F.size(w) > k, covered(w)).otherwise(0)).cast("long")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The base counts of every whole text, as long columns (see FEATURES)."""
    t = text_of(text)
    out = docs.withColumn("_words", word_list(t))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": word_chars(t), "n_symbols": symbols(t), "n_dup_lines": duplicate_lines(t), "n_repeat_words": repeated_words(F.col("_words"))})
    return out.drop("_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def standard_rules(text: str = "text", counted: bool = False) -> list[Rule]:
    """The rules of the production cascade; with ``counted`` they read the columns of ``with_features``."""
    t = text_of(text)
    words = word_list(t)
    n_words = F.col("n_words") if counted else F.size(words)
    n_symbols = F.col("n_symbols") if counted else symbols(t)
    n_dup = F.col("n_dup_lines") if counted else duplicate_lines(t)
    n_repeat = F.col("n_repeat_words") if counted else repeated_words(words)
    n_chars = F.col("word_chars") if counted else word_chars(t)
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    marks = F.length(t) - F.length(F.translate(t, "!?", ""))
    return [
        Rule("few_words", n_words < 10),
        Rule("repeated_words", 100 * n_repeat > 20 * n_words),
        Rule("symbols", 10 * n_symbols > 3 * n_words),
        Rule("duplicate_lines", 2 * n_dup > (F.length(t) - F.length(F.translate(t, "\n", "")) + 1)),
        Rule("word_length", (n_chars < 2 * n_words) | (n_chars > 20 * n_words)),
        Rule("shouting", 10 * capitals > 3 * letters),
        Rule("marks", 10 * marks > 3 * n_words),
    ]


def plan(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[Rule]:
    """The rules with their cost (seconds for the sample) and share of rejections on a random sample of about ``sample_rows``
    rows, in the order of rejection per cost. A rule has the cost of its expression over the columns of ``docs``, and of what
    ``prepare`` adds to the sample: what they hold already costs it nothing. Costs are rounded to powers of two, and not below what timing can tell from an
    empty job, so that chance doesn't decide the order of rules that cost alike. One pass over ``docs`` takes the sample."""
    scratch = Scratch(docs.sparkSession, "quality-sample")
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.where(F.rand(5) < share).repartition(SAMPLE_TASKS)
    sample = scratch.table(prepare(sample) if prepare else sample, "rows")
    n = max(1, sample.count())
    again = sample.withColumn(fresh(docs, "_again"), F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def timed(fails: Column) -> tuple[list[float], int]:
        took, hits = [], 0
        for _ in range(TIMES):
            began = time.perf_counter()
            hits = again.agg(F.count_if(fails)).first()[0]
            took.append(time.perf_counter() - began)
        return sorted(took), hits // REPEAT

    timed(F.lit(True))  # the first job also compiles and opens files
    empty, _ = timed(F.length(F.col("text")) < 0 if "text" in docs.columns else F.lit(False))
    least = max(0.1, 2 * (empty[-1] - empty[0]))
    found = []
    for rule in rules:
        took, hits = timed(rule.fails)
        cost = max(least, took[TIMES // 2] - empty[TIMES // 2])
        found.append(Rule(rule.name, rule.fails, least * 2.0 ** round(math.log2(cost / least)), hits / n))
    scratch.drop("rows")
    return sorted(found, key=lambda r: (-r.rank, r.name))


def cascade(docs: DataFrame, rules: Sequence[Rule], into: str = "rejected_by") -> DataFrame:
    """The name of the first rule that rejects, null where none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails, F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn(into, verdict)


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that every rule lets pass, without counting anything that the cascade need not."""
    order = plan(docs, rules or standard_rules(text))
    verdict = fresh(docs, "_rejected_by")
    return cascade(docs, order, verdict).where(F.col(verdict).isNull()).drop(verdict)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document. The counts are asked for, so the rules read them,
    and their costs are those of rules that do."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    order = plan(docs, standard_rules(counted=True), prepare=with_features)
    judged = cascade(with_features(docs).withColumn("base_failed", base_failed()), order)
    return judged.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))
