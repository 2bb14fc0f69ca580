"""Operators over labels: wrapping and font tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(texts: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """Greedy word wrap with one advance per character: key, line, text. A word longer than the line has its own."""
    none = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("at"))

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["at"], F.lit(" "), w)
        fits = F.length(longer) <= width
        return F.struct(F.when(a["at"].isNull() | fits, a["lines"]).otherwise(F.concat(a["lines"], F.array(a["at"]))).alias("lines"), F.when(a["at"].isNull(), w).when(fits, longer).otherwise(w).alias("at"))

    lines = F.aggregate(F.split(column, " "), none, step, lambda a: F.concat(a["lines"], F.array(a["at"])))
    return texts.select(key, F.posexplode(lines).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))


def bfchar_code(block: Column) -> Column:
    """A ToUnicode block: as many pairs as declared, each to one scalar value."""
    pairs = F.regexp_extract_all(block, F.lit(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>"), 2)
    declared = F.regexp_extract(block, r"^\s*([0-9]+)\s+beginbfchar", 1).try_cast("int")
    return F.when(declared.isNull(), "syntax").when(F.size(pairs) != declared, "count").when(F.exists(pairs, lambda u: F.length(u) != 4), "scalar").otherwise("ok")


#: No sign of more than one code point is made of these alone; only a line break of two is.
_SINGLE = re.compile("[\0-\u02ff]*")


#: Texts whose lines are one Arrow batch.
TEXTS = 500


def _wrapped(text: str, width: int) -> list[str]:
    """The lines of a text, each of ``width`` signs at most."""
    import regex

    lines: list[str] = []
    parts: list[str] = []
    used = 0
    for word in text.split(" "):
        plain = _SINGLE.fullmatch(word) and "\r\n" not in word
        signs = word if plain else regex.findall(r"\X", word)
        if used and len(signs) > width - used - 1:
            lines.append("".join(parts))
            parts, used = [], 0
        elif used:
            parts.append(" ")
            used += 1
        while len(signs) > width:
            lines.append("".join(signs[:width]))
            signs = signs[width:]
        parts.append(signs if plain else "".join(signs))
        used += len(signs)
    return [*lines, "".join(parts)]


def wrap_graphemes(texts: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """Greedy wrap that counts what a reader sees as one character as one and never cuts it: key, line, text. A word longer
    than the line is cut between characters."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # the lines of few texts at a time: a batch of texts may be large, its lines are more
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                lines = [_wrapped(t or "", width) for t in part.column(1).to_pylist()]
                of = pa.array([i for i, found in enumerate(lines) for _ in found], pa.int64())
                number = pa.array([n for found in lines for n in range(1, len(found) + 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), number, pa.array([t for found in lines for t in found], pa.string())], [key, "line", "text"])

    return texts.select(key, column).mapInArrow(run, f"`{key}` {kind}, line bigint, text string")
