"""Chains of affine matrices without rounding: six whole numbers of up to 38 digits over one power of ten."""

from __future__ import annotations

import re
from functools import lru_cache
from math import gcd

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scenegrid.functions.geometry import let

#: Fixed value: the longest text of a matrix that is read.
MAX_TEXT = 4096
#: Numbers on the way are smaller than this in size.
LIMIT = 10**38
#: Texts that a worker remembers, as files repeat their matrices.
TEXTS = 1 << 13
_NUMBER = re.compile(r"([-+]?)(?:([0-9]*)\.([0-9]+)|([0-9]+)\.?)(?:[eE]([-+]?[0-9]+))?")
#: As in Spark's expressions, a text may end with one end of line.
_ALONE = re.compile(rf"{_NUMBER.pattern}(?:\r\n|[\n\r\u0085\u2028\u2029])?")
_MATRIX = re.compile(r"\s*matrix\s*\(([^)]*)\)\s*[\u0085\u2028\u2029]?", re.ASCII)
_ELSE = re.compile(r"[^ ,\t\r\n]")
_IDENTITY = (1, 0, 0, 1, 0, 0), 0
_CHAIN = "struct<m:array<decimal(38,0)>,s:int,code:string>"


def _fits(n: int) -> int:
    if -LIMIT < n < LIMIT:
        return n
    raise OverflowError


def _power(n: int) -> int:
    """A power of ten."""
    return _fits(10 ** min(n, 40))


def _numbers(parts: list) -> tuple[list, int]:
    """Decimals (sign, digits before the point, after it, digits without a point, exponent) over one power of ten. An exponent of more than four digits isn't read."""
    if any(len(p[4].lstrip("+-")) > 4 for p in parts):
        raise ValueError
    read = [(int(sign + (before + after or alone)), len(after) - int(power or 0)) for sign, before, after, alone, power in parts]
    s = max(0, *[scale for n, scale in read if n], 0)
    return [_fits(n * 10 ** min(s - scale, 60)) if n else 0 for n, scale in read], s


@lru_cache(TEXTS)
def _matrix(text: str | None) -> tuple:
    if not text:
        return _IDENTITY
    args = _MATRIX.fullmatch(text) if len(text) <= MAX_TEXT else None
    parts = _NUMBER.findall(args[1]) if args else []
    if len(parts) != 6 or _ELSE.search(_NUMBER.sub("", args[1])):
        raise ValueError
    return _numbers(parts)


@lru_cache(TEXTS)
def _shift(dx: str | None, dy: str | None) -> tuple:
    if dx is None and dy is None:
        return _IDENTITY
    parts = [_ALONE.fullmatch(t) if t is not None and len(t) <= MAX_TEXT else None for t in (dx, dy)]
    if None in parts:
        raise ValueError
    (x, y), s = _numbers([p.groups("") for p in parts])
    return (_power(s), 0, 0, _power(s), x, y), s


def _total(*pairs: tuple[int, int]) -> int:
    n = 0
    for x, y in pairs:
        n = _fits(n + _fits(x * y))
    return n


def _times(m: tuple, s: int, k: tuple, z: int) -> tuple:
    """The product over the least power of ten."""
    (a, b, c, d, e, f), (p, q, r, t, u, v), wide = m, k, _power(z)
    if 3 * max(*m, -min(m)) * max(*k, wide, -min(k)) < LIMIT:  # no number on the way can be too long
        n = [a * p + c * q, b * p + d * q, a * r + c * t, b * r + d * t, a * u + c * v + e * wide, b * u + d * v + f * wide]
    else:
        n = [_total((a, p), (c, q)), _total((b, p), (d, q)), _total((a, r), (c, t)), _total((b, r), (d, t)), _total((a, u), (c, v), (e, wide)), _total((b, u), (d, v), (f, wide))]
    common, s = gcd(*n), s + z
    if common % 10 or not s:
        return n, s
    digits = str(common)
    cut = min(len(digits) - len(digits.rstrip("0")), s) if common else s
    ten = 10**cut
    return [x // ten for x in n], s - cut


def _chain(steps: list) -> tuple:
    """m, s and code of one chain of steps (matrix, dx, dy)."""
    m, s = _IDENTITY
    try:
        for matrix, dx, dy in steps:
            m, s = _times(m, s, *_matrix(matrix))
            shift = _shift(dx, dy)
            m, s = (m, s) if shift is _IDENTITY else _times(m, s, *shift)
    except (ValueError, OverflowError) as e:
        return None, None, "overflow" if isinstance(e, OverflowError) else "unread"
    return m, s, None


def _chains(matrix: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    steps = zip(*[c.flatten().to_pylist() for c in (matrix, dx, dy)])
    found = [_chain([next(steps) for _ in range(n or 0)]) for n in pc.list_value_length(matrix).to_pylist()]
    m, s, code = zip(*found) if found else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(m, pa.list_(pa.decimal128(38, 0))), pa.array(s, pa.int32()), pa.array(code, pa.string())], ["m", "s", "code"])


def exact_chain(steps: Column) -> Column:
    """The product of an array of steps (matrix, dx, dy: texts), each a matrix and then a translation, as ``m``, six whole numbers, over ten to the power of ``s``.

    A matrix is ``matrix(a b c d e f)``; null or empty is the identity, and so is a step without dx and dy. Nothing is rounded: decimals and exponents are
    read as they are written. ``code`` is ``unread`` if a text is anything else, ``overflow`` if a number on the way needs over 38 digits; the first one in the chain stays, and ``m`` is null then.
    An empty array is the identity, a null one gives null. The whole numbers of a chain are multiplied in Python, batch by batch: as an expression over DECIMAL(38) a step took several times as long."""
    return F.when(steps.isNotNull(), F.arrow_udf(_chains, _CHAIN)(steps["matrix"], steps["dx"], steps["dy"]))


def exact_text(number: Column, s: Column) -> Column:
    """A whole number over a power of ten as the shortest decimal text."""

    def text(t: Column) -> Column:
        digits = F.when(F.length(t) > s, t).otherwise(F.concat(F.repeat(F.lit("0"), s + 1 - F.length(t)), t))
        point = lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - s), F.lit("."), F.substring(d, F.length(d) - s + 1, s))
        return F.when(s == 0, t).otherwise(let(digits, lambda d: F.rtrim(F.rtrim(point(d), F.lit("0")), F.lit("."))))

    return F.concat(F.when(number < 0, "-").otherwise(""), let(F.abs(number).cast("string"), text))
