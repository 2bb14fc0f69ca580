"""Scalar expressions of scenes: units, colours, rounding, sites, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EMU per CSS pixel, crop units, the slack of the canvas, bend cost and Bezier circle constant.
EMU_PER_PX = 9525
CROP_UNITS = 100_000
CANVAS_SLACK = 0.001
CIRCLE = 0.5522847498

#: CSS pixels per unit of length.
UNIT_PX = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}

#: The colour names that are read.
COLOURS = {
    "black": "#000000",
    "white": "#ffffff",
    "red": "#ff0000",
    "green": "#008000",
    "blue": "#0000ff",
    "gray": "#808080",
    "grey": "#808080",
    "silver": "#c0c0c0",
    "yellow": "#ffff00",
    "orange": "#ffa500",
    "purple": "#800080",
    "navy": "#000080",
    "teal": "#008080",
    "maroon": "#800000",
    "lime": "#00ff00",
    "aqua": "#00ffff",
    "fuchsia": "#ff00ff",
    "olive": "#808000",
}


def half_up(v: Column) -> Column:
    """To the nearest integer, halves towards positive infinity."""
    return F.floor(v + 0.5)


def js_round(v: Column) -> Column:
    """As half_up, but without adding before rounding."""
    low = F.floor(v)
    return low + (v - low >= 0.5).cast("long")


def emu(px: Column) -> Column:
    return half_up(px * EMU_PER_PX)


def finite(v: Column) -> Column:
    """A number that is neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def length_px(text: Column) -> Column:
    """A length with or without unit as pixels; null where it isn't one."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*([A-Za-z]*)\s*$", 1))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_PX.items() for x in kv]), unit)
    return number.try_cast("double") * factor


def colour(text: Column) -> Column:
    """#rrggbb of a name, #rgb, #rrggbb or rgb() with numbers or percentages, which are cut to 0 and 255; ``none`` stays;
    null for anything else."""
    t = F.lower(F.trim(text))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), t)
    short = F.regexp_replace(t, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    pieces = F.split(F.trim(F.regexp_extract(t, r"^rgb\(([^)]*)\)$", 1)), r"[\s,]+")

    def channel(piece: Column) -> Column:
        number = F.rtrim(piece, F.lit("%")).try_cast("double")
        value = F.when(F.endswith(piece, F.lit("%")), number * 255 / 100).otherwise(number)
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int")

    good = (F.size(pieces) == 3) & F.forall(pieces, lambda x: x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)%?$"))
    hexed = F.concat(F.lit("#"), F.array_join(F.transform(pieces, lambda x: F.lower(F.lpad(F.hex(channel(x)), 2, "0"))), ""))
    return F.when(t == "none", "none").when(named.isNotNull(), named).when(t.rlike("^#[0-9a-f]{3}$"), short).when(t.rlike("^#[0-9a-f]{6}$"), t).when(good, hexed)


def font_name(name: Column) -> Column:
    """Without the six-letter prefix of a subset, in lower case."""
    return F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))


def style_name(name: Column) -> Column:
    """regular, bold, italic or boldItalic from a style's words."""
    t = F.lower(name)
    bold, italic = t.rlike("bold|black|heavy|semibold"), t.rlike("italic|oblique")
    return F.when(bold & italic, "boldItalic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def contain(vw: Column, vh: Column, x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """The largest box of the aspect vw:vh inside a frame, centred."""
    scale = F.least(w / vw, h / vh)
    return {"scale": scale, "fx": x + (w - vw * scale) / 2, "fy": y + (h - vh * scale) / 2, "fw": vw * scale, "fh": vh * scale}


def affine(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix a b c d e f."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


#: Names of caps in markup.
CAP_NAMES = {"butt": "flat", "round": "rnd", "square": "sq"}


def stroke_xml(width: Column, cap: Column, fill: Column) -> Column:
    """A stroke as DrawingML."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in CAP_NAMES.items() for x in kv]), cap)
    return F.concat(F.lit('<a:ln w="'), emu(width), F.lit('" cap="'), name, F.lit('"><a:solidFill><a:srgbClr val="'), F.substring(fill, 2, 6), F.lit('"/></a:solidFill></a:ln>'))


def float_enclosure(x: Column) -> tuple[Column, Column]:
    """The nearest single-precision numbers at or below and at or above a positive normal double, as doubles."""
    f = x.cast("float").cast("double")
    binade = F.pow(F.lit(2.0), F.floor(F.log2(f)))
    unit = binade * 2.0**-23
    below = F.when(f == binade, f - unit / 2).otherwise(f - unit)
    return F.when(f <= x, f).otherwise(below), F.when(f >= x, f).otherwise(f + unit)


def sqrt_upper(n: Column, bits: int) -> Column:
    """The least multiple of 2**-bits whose square isn't below an integer: a floating root put right by exact squares."""
    scaled = n * (1 << 2 * bits)
    near = F.floor(F.sqrt(scaled))
    least = F.when((near > 0) & ((near - 1) * (near - 1) >= scaled), near - 1).when(near * near >= scaled, near).otherwise(near + 1)
    return least / F.lit(float(1 << bits))
