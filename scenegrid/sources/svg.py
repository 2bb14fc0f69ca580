"""SVG files as tables of objects. Reading is strict: what isn't understood has a code and is never approximated."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.functions.scalar import colour, length_px
from scenegrid.operators import path_data
from scenegrid.operators.layout import matrix
from scenegrid.operators.tables import written

#: Limits of a file, properties and their first values, those that must keep one value, and constructs that aren't read.
MAX_BYTES, MAX_NODES = 16 << 20, 20_000
INHERITED = {
    "fill": "#000000", "stroke": "none", "stroke-width": "1", "fill-opacity": "1", "stroke-opacity": "1", "fill-rule": "nonzero", "font-size": "16", "font-weight": "normal", "font-style": "normal",
    "text-anchor": "start", "visibility": "visible", "display": "inline", "color": "#000000", "font-family": "sans-serif",
}
PLAIN = {"stroke-linecap": "butt", "stroke-linejoin": "miter", "stroke-dasharray": "none", "stroke-dashoffset": "0", "stroke-miterlimit": "4", "letter-spacing": "normal", "word-spacing": "normal", "dominant-baseline": "auto", "vector-effect": "none", "paint-order": "normal"}
EFFECTS = ("filter", "mask", "marker-start", "marker-mid", "marker-end")
FORBIDDEN = ("script", "style", "filter", "mask", "clipPath", "image", "use", "foreignObject", "animate")
SHAPES = ("path", "rect", "line", "polyline", "polygon", "circle", "ellipse")
#: Elements that hold no mark of their own.
SILENT = ("svg", "g", "title", "desc", "metadata", "defs", "tspan")
#: Pixels of a unit, and the size of a canvas that names none.
UNITS = {"": 1, "px": 1, "pt": 96 / 72, "pc": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}
CANVAS = (300.0, 150.0)

_ROWS = {
    "file": "string", "ordinal": "bigint", "kind": "string", "id": "string", "group_id": "string", "data": "string", "transform": "string", "fill": "string", "stroke": "string", "stroke_width": "string",
    "opacity": "string", "fill_opacity": "string", "stroke_opacity": "string", "color": "string", "text": "string", "x": "double", "y": "double", "width": "double", "height": "double", "font_size": "string", "font_weight": "string",
    "font_style": "string", "font_family": "string", "text_anchor": "string", "code": "string",
}

_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_LENGTH = re.compile(rf"\s*({_NUMBER})\s*([A-Za-z]*)\s*")


def _px(value: str | None, default: float | None = None) -> float:
    """A length as pixels; percentages and units relative to a font aren't read."""
    if value is None and default is not None:
        return default
    found = _LENGTH.fullmatch(value or "")
    if not found or found[2].lower() not in UNITS:
        raise ValueError(value)
    return float(found[1]) * UNITS[found[2].lower()]


def _floats(value: str) -> list[float]:
    if re.sub(_NUMBER, "", value).strip(" \t\r\n,"):
        raise ValueError(value)
    return [float(x) for x in re.findall(_NUMBER, value)]


def _shape_data(tag: str, a: dict) -> tuple[str | None, str | None]:
    """(path data, code) of a shape; corners and ellipses are arcs."""
    try:
        if tag == "path":
            return (a["d"], None) if a.get("d", "").strip() else (None, "no_geometry")
        if tag in ("polyline", "polygon"):
            points = a.get("points", "").strip()
            return (f"M{points}" + ("z" if tag == "polygon" else ""), None) if len(_floats(points)) > 3 else (None, "no_geometry")
        if tag == "line":
            return "M{} {}L{} {}".format(*(_px(a.get(k), 0.0) for k in ("x1", "y1", "x2", "y2"))), None
        if tag != "rect":
            cx, cy = _px(a.get("cx"), 0.0), _px(a.get("cy"), 0.0)
            rx, ry = (_px(a.get(k), 0.0) for k in (("r", "r") if tag == "circle" else ("rx", "ry")))
            return (f"M{cx + rx} {cy}A{rx} {ry} 0 1 1 {cx - rx} {cy}A{rx} {ry} 0 1 1 {cx + rx} {cy}Z", None) if rx > 0 and ry > 0 else (None, "no_geometry")
        x, y, w, h = (_px(a.get(k), 0.0) for k in ("x", "y", "width", "height"))
        rx = _px(a.get("rx"), _px(a.get("ry"), 0.0))
        ry = _px(a.get("ry"), rx)
    except ValueError:
        return None, "bad_number"
    if not (w > 0 and h > 0 and rx >= 0 and ry >= 0):
        return None, "no_geometry"
    rx, ry = min(rx, w / 2), min(ry, h / 2)
    if not (rx and ry):
        return f"M{x} {y}h{w}v{h}h{-w}z", None
    corner = f"a{rx} {ry} 0 0 1 "
    return f"M{x + rx} {y}h{w - 2 * rx}{corner}{rx} {ry}v{h - 2 * ry}{corner}{-rx} {ry}h{2 * rx - w}{corner}{-rx} {-ry}v{2 * ry - h}{corner}{rx} {-ry}z", None


def _canvas(root: ET.Element) -> tuple[float, float, str]:
    """Width, height and what the view box does, as a transform."""
    view = _floats(root.get("viewBox", ""))
    width, height = (_px(root.get(k), view[i] if len(view) == 4 else CANVAS[i - 2]) for i, k in ((2, "width"), (3, "height")))
    if not (width > 0 and height > 0):
        raise ValueError
    if not view:
        return width, height, ""
    x, y, w, h = view
    if not (w > 0 and h > 0):
        raise ValueError
    aspect = root.get("preserveAspectRatio", "xMidYMid").split()
    if aspect == ["none"]:
        sx, sy, ex, ey = width / w, height / h, 0.0, 0.0
    else:
        place = re.fullmatch("x(Min|Mid|Max)Y(Min|Mid|Max)", aspect[0])
        if not place or aspect[1:] not in ([], ["meet"]):
            raise ValueError
        sx = sy = min(width / w, height / h)
        ex, ey = ((room * {"Min": 0, "Mid": 0.5, "Max": 1}[p]) for room, p in ((width - w * sx, place[1]), (height - h * sy, place[2])))
    return width, height, f"matrix({sx} 0 0 {sy} {ex - x * sx} {ey - y * sy})"


def _style(node: ET.Element, above: dict) -> tuple[dict, str, str | None]:
    """The properties of an element under those above it, its own opacity, and a code."""
    inline = {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in node.get("style", "").split(";") if ":" in p)}
    own = lambda k: (inline.get(k) or node.get(k) or "").strip()
    look = {k: above[k] if own(k) in ("", "inherit") else own(k) for k in INHERITED}
    look |= {k: above.get(k, v) if own(k) in ("", "inherit") else own(k) for k, v in PLAIN.items()}
    odd = next((k for k, v in PLAIN.items() if look[k] != v and not (k.endswith("spacing") and look[k] in ("0", "0px")) and not (k == "dominant-baseline" and look[k] == "alphabetic")), None)
    code = (
        "class" if node.get("class")
        else "clip_path" if own("clip-path") not in ("", "none")
        else "effect" if any(own(k) not in ("", "none") for k in EFFECTS)
        else "even_odd" if look["fill-rule"] != "nonzero"
        else "stroke_style" if odd and odd.startswith("stroke")
        else "text_style" if odd
        else None
    )
    return look, own("opacity") or "1", code


def _spans(node: ET.Element, look: dict, opacity: str) -> list[tuple]:
    """(element, properties, opacity, text, x, y, code) of a text, or of its spans where those have places of their own."""

    def place(n: ET.Element) -> tuple[float | None, float | None, str | None]:
        try:
            return _px(n.get("x"), 0.0) + _px(n.get("dx"), 0.0), _px(n.get("y"), 0.0) + _px(n.get("dy"), 0.0), None
        except ValueError:
            return None, None, "text_position"

    odd = lambda n: "text_length" if n.get("rotate") or n.get("textLength") or n.get("lengthAdjust") else None
    children = [c for c in node if isinstance(c.tag, str)]
    placed = [c for c in children if c.get("x") is not None and c.get("y") is not None]
    if not placed:
        plain = not any(len(c.attrib) or len(c) for c in children)
        whole = "".join(node.itertext())
        kept = node.get("{http://www.w3.org/XML/1998/namespace}space") == "preserve"
        x, y, code = place(node)
        return [(node, look, opacity, whole if kept else " ".join(whole.split()), x, y, odd(node) or code or (None if plain else "text_spans"))]
    loose = (node.text or "").strip() or any((c.tail or "").strip() or len(c) for c in children) or len(placed) < len(children)
    if loose:
        return [(node, look, opacity, "".join(node.itertext()), None, None, "text_spans")]
    out = []
    for c in children:
        own, share, code = _style(c, look)
        x, y, wrong = place(c)
        try:
            share = str(float(opacity) * float(share))
        except ValueError:
            wrong = wrong or "opacity"
        out.append((c, own, share, " ".join((c.text or "").split()), x, y, odd(node) or odd(c) or ("text_spans" if c.get("transform") else None) or code or wrong))
    return out


def _walk(file: str, content: bytes) -> list[dict]:
    bad = lambda code: [{"file": file, "ordinal": 0, "code": code}]
    if len(content) > MAX_BYTES:
        return bad("too_large")
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)\b|<\?(?!xml\s)[A-Za-z]", content, re.IGNORECASE):
        return bad("forbidden_declaration")
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return bad("malformed")
    if root.tag.rpartition("}")[2] != "svg":
        return bad("no_svg")
    try:
        width, height, view = _canvas(root)
    except ValueError:
        return bad("canvas")
    rows: list[dict] = [{"file": file, "ordinal": -1, "kind": "canvas", "width": width, "height": height}]
    ids: set[str] = set()
    todo = [(root, INHERITED, view, None)]
    nodes = 0
    while todo:
        node, above, outer, group = todo.pop()
        nodes += 1
        if nodes > MAX_NODES:
            return bad("too_many_nodes")
        tag, name = node.tag.rpartition("}")[2], node.get("id")
        look, opacity, wrong = _style(node, above)
        if look["display"] == "none" or tag in ("title", "desc", "metadata"):
            continue
        whole = f"{outer} {node.get('transform', '')}".strip()
        known = tag in SHAPES or tag in SILENT or tag == "text"
        code = (
            "forbidden_element" if tag in FORBIDDEN
            else "unknown_element" if not known
            else "nested_svg" if tag == "svg" and node is not root
            else "lone_span" if tag == "tspan"
            else "repeated_id" if name in ids
            else "group_opacity" if tag in ("g", "svg") and opacity != "1"
            else wrong
        )
        if name:
            ids.add(name)
        shown = look["visibility"] == "visible"
        marks = [(node, look, opacity, None, None, None, None)] if code or tag in SHAPES else _spans(node, look, opacity) if tag == "text" else []
        for mark, own, share, text, x, y, odd in marks if shown or code else []:
            data, shapeless = _shape_data(tag, node.attrib) if tag in SHAPES and not code else (None, None)
            if tag == "text" and not code and not odd and not text:
                continue
            styled = {k.replace("-", "_"): own[k] for k in ("fill", "stroke", "stroke-width", "fill-opacity", "stroke-opacity", "color", "font-size", "font-weight", "font-style", "font-family", "text-anchor")}
            if tag == "line":
                styled["fill"] = "none"
            rows.append({"file": file, "ordinal": len(rows) - 1, "kind": "text" if tag == "text" else "path", "id": mark.get("id"), "group_id": group, "data": data, "transform": whole or None, "opacity": share, "text": text, "x": x, "y": y, "code": code or odd or shapeless} | styled)
        if not code and tag not in ("text", "defs"):
            todo += [(child, look, whole, name or group if tag == "g" else group) for child in reversed(node) if isinstance(child.tag, str)]
    return rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = _walk(file, content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in _ROWS.items()], list(_ROWS))


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_read, ", ".join(f"{c} {k}" for c, k in _ROWS.items()))


def canvases(files: DataFrame) -> DataFrame:
    """file, width and height in pixels of each file (path, content) that is read."""
    return _parsed(files).where("kind = 'canvas'").select("file", "width", "height")


def objects(files: DataFrame) -> DataFrame:
    """Objects of files (path, content) in document order: file, ordinal, kind (path or text), id, group_id, path data, the product of the view box, the transforms above it and its own
    as a matrix (null: none), normal colours, the stroke's width and the whole opacity as drawn; of texts the place of the anchor, size, bold, italic, family and alignment, a row for each span that has a
    place of its own; and a code for what isn't read. Hidden objects have no row."""
    rows = _parsed(files).where("kind IS NULL OR kind <> 'canvas'")
    number = lambda c: F.col(c).try_cast("double")
    own = lambda c: F.when(F.lower(F.trim(F.col(c))) == "currentcolor", F.col("color")).otherwise(F.col(c))
    rows = rows.withColumns({"m": F.when(F.col("transform").isNotNull(), matrix(F.col("transform"))), "fill": colour(own("fill")), "stroke": colour(own("stroke")), "wide": length_px(F.col("stroke_width"))})
    at = lambda i, d: F.coalesce(F.get("m", F.lit(i)), F.lit(d))
    a, b, c, d, e, f = (at(i, v) for i, v in enumerate((1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))
    sx, sy = F.hypot(a, b), F.hypot(c, d)
    alike = (F.abs(sx - sy) <= 1e-8 * F.greatest(sx, sy, F.lit(1.0))) & (F.abs(a * c + b * d) <= 1e-8 * F.greatest(F.lit(1.0), sx * sy))
    upright = (a > 0) & (d > 0) & (F.abs(a - d) <= 1e-8 * F.greatest(a, d)) & (F.abs(b) + F.abs(c) <= 1e-8)
    filled, drawn = F.col("fill") != "none", (F.col("stroke") != "none") & (F.col("wide") > 0)
    parts = [number(o) for o in ("opacity", "fill_opacity", "stroke_opacity")]
    text = F.col("kind") == "text"
    weight = F.col("font_weight")
    size = length_px(F.col("font_size"))
    align = F.create_map(*[F.lit(v) for v in ("start", "left", "middle", "center", "end", "right")])
    code = F.coalesce(
        F.col("code"),
        F.when(F.col("transform").isNotNull() & F.col("m").isNull(), "transform"),
        F.when(F.col("fill").isNull() | F.col("stroke").isNull(), "colour"),
        F.when(F.col("wide").isNull() | (F.col("wide") < 0), "bad_number"),
        F.when(reduce(lambda p, o: p | o.isNull() | ~o.between(0, 1), parts, F.lit(False)), "opacity"),
        F.when(filled & drawn & (F.abs(parts[1] - parts[2]) > 1e-9), "two_opacities"),
        F.when(~text & drawn & ~alike, "stroke_transform"),
        F.when(text & ~upright, "text_transform"),
        F.when(text & drawn, "text_stroke"),
        F.when(text & (size.isNull() | (size <= 0)), "font_size"),
        F.when(text & ~weight.isin("normal", "bold") & weight.try_cast("double").isNull(), "font_weight"),
        F.when(text & ~F.col("font_style").isin("normal", "italic"), "font_style"),
        F.when(text & F.try_element_at(align, F.col("text_anchor")).isNull(), "text_anchor"),
    )
    of_text = lambda v: F.when(text & F.col("code").isNull(), v)
    rows = rows.withColumn("code", code)
    return rows.select(
        "file", "ordinal", "kind", "id", "group_id", "data", F.col("m").alias("transform"), "fill", "stroke", (F.col("wide") * F.when(drawn & alike, sx).otherwise(1.0)).alias("stroke_width"),
        (parts[0] * F.when(filled, parts[1]).otherwise(parts[2])).alias("opacity"), "text", of_text(a * F.col("x") + c * F.col("y") + e).alias("x"), of_text(b * F.col("x") + d * F.col("y") + f).alias("y"), of_text(size * a).alias("font_size"),
        of_text((weight == "bold") | F.coalesce(weight.try_cast("double") >= 600, F.lit(False))).alias("bold"), of_text(F.col("font_style") == "italic").alias("italic"), of_text(F.col("font_family")).alias("family"),
        of_text(F.try_element_at(align, F.col("text_anchor"))).alias("alignment"), "code",
    )


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """``objects`` of the files under a path."""
    return objects(spark.read.format("binaryFile").load(path))


def commands(objects: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The paths of the objects read, under their transforms, as lines: path_id (file and ordinal), seq, op (M, L, Z), x, y. Curves and arcs become chords that are within
    ``tolerance`` of them. A path that isn't read has one row with a code and no points (see ``path_data``)."""
    named = objects.where("data IS NOT NULL AND code IS NULL").select(F.struct("file", "ordinal").alias("path_id"), "data", "transform")
    parsed = path_data.parse(named, "data").join(named.select("path_id", "transform"), "path_id")
    lines = path_data.transformed(path_data.arcs_as_lines(parsed, tolerance, "transform"), "transform")
    return path_data.flatten(written(lines.drop("transform")), tolerance)
