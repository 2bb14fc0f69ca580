"""Images placed in SVG files: each placement with the product of the matrices above it and the clips and masks it lies under, in the order of painting."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.functions.geometry import let
from scenegrid.operators.layout import matrix
from scenegrid.operators.tables import tasks, written
from scenegrid.sources.svg import MAX_BYTES, MAX_NODES, _px

#: Elements whose content isn't painted where it stands, and effects that must have no effect.
INNER = ("defs", "clipPath", "mask", "symbol")
SHARES, EFFECTS = ("opacity", "fill-opacity", "stroke-opacity"), ("filter", "mix-blend-mode", "isolation")
_HREF = "{http://www.w3.org/1999/xlink}href"
_ROWS = {
    "file": pa.string(), "seq": pa.int64(), "above": pa.list_(pa.int64()), "tag": pa.string(), "id": pa.string(), "transform": pa.string(), "clip": pa.string(), "mask": pa.string(), "hidden": pa.bool_(), "inner": pa.bool_(),
    "x": pa.float64(), "y": pa.float64(), "width": pa.float64(), "height": pa.float64(), "sha256": pa.string(), "code": pa.string(),
}
_SCHEMA = "file string, seq bigint, above array<bigint>, tag string, id string, transform string, clip string, mask string, hidden boolean, inner boolean, x double, y double, width double, height double, sha256 string, code string"


def _placed(node: ET.Element) -> dict:
    """Place, size and digest of an image, or a code."""
    found = re.fullmatch(r"data:image/[\w.+-]+;base64,([\s\S]+)", node.get("href", node.get(_HREF, "")))
    if not found:
        return {"code": "not_embedded"}
    try:
        data = base64.b64decode(re.sub(r"\s", "", found[1]), validate=True)
        x, y, w, h = (_px(node.get(k), 0.0) for k in ("x", "y", "width", "height"))
    except binascii.Error:
        return {"code": "bad_data"}
    except ValueError:
        return {"code": "bad_number"}
    return {"x": x, "y": y, "width": w, "height": h, "sha256": hashlib.sha256(data).hexdigest(), "code": None if w > 0 and h > 0 else "no_size"}


def _element(node: ET.Element, ids: dict) -> dict:
    """What an element adds to all that lie below it."""
    inline = {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in node.get("style", "").split(";") if ":" in p)}
    own = lambda k, d: (inline.get(k) or node.get(k) or d).strip()
    refs, code = {}, None
    for k in ("clip-path", "mask"):
        if own(k, "none") != "none":
            found = re.fullmatch(r"url\(\s*[\"']?#([^\"')]+)[\"']?\s*\)", own(k, "none"))
            refs[k] = found and found[1]
            code = code or (None if refs[k] in ids else "unresolved")
    try:
        faint = any(float(own(k, "1")) != 1 for k in SHARES)
    except ValueError:
        faint = True
    code = code or ("opacity" if faint else None) or ("effect" if any(own(k, "none") not in ("none", "normal", "auto") for k in EFFECTS) else None)
    hidden = own("display", "") == "none" or own("visibility", "") == "hidden"
    return {"id": node.get("id"), "transform": node.get("transform") or "", "clip": refs.get("clip-path"), "mask": refs.get("mask"), "hidden": hidden, "code": code}


def _walk(file: str, content: bytes) -> list[dict]:
    bad = lambda code: [{"file": file, "seq": 0, "above": [0], "tag": "file", "transform": "", "hidden": False, "inner": False, "code": code}]
    if len(content) > MAX_BYTES:
        return bad("too_large")
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        return bad("doctype")
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, ValueError, LookupError):
        return bad("not_xml")
    nodes = [n for n in root.iter() if isinstance(n.tag, str)]
    if len(nodes) > MAX_NODES:
        return bad("too_many_nodes")
    ids = {n.get("id"): n for n in nodes if n.get("id")}
    rows, todo = [], [(root, (), False)]
    while todo:
        node, above, inner = todo.pop()
        tag, seq = node.tag.rpartition("}")[2], len(rows)
        inner = inner or tag in INNER
        row = {"file": file, "seq": seq, "above": [*above, seq], "tag": tag, "inner": inner} | _element(node, ids)
        if tag == "image":
            placed = _placed(node)
            row |= placed | {"code": row["code"] or placed["code"]}
        elif tag == "use":
            target = ids.get(node.get("href", node.get(_HREF, ""))[1:])
            leads = target is None or any(isinstance(n.tag, str) and n.tag.rpartition("}")[2] in ("image", "use") for n in target.iter())
            row["code"] = "use" if leads else None
        rows.append(row)
        todo += [(child, (*above, seq), inner) for child in reversed(node) if isinstance(child.tag, str)]
    return rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = _walk(file, content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in _ROWS.items()], list(_ROWS))


def _placements(m: Column) -> Column:
    a, b, c, d, e, f = (m[i] for i in range(6))
    x, y, w, h = (F.col(n) for n in ("x", "y", "width", "height"))
    return F.array(a * w, b * w, c * h, d * h, a * x + c * y + e, b * x + d * y + f)


def occurrences(files: DataFrame) -> DataFrame:
    """Images of files (path, content): file, ordinal in the order of painting, id, transform (from the unit square, an array of six, in the user space of the file), clips and masks
    (id and the matrix of the element that names it, from the outside in), sha256 of the embedded bytes, and code.

    A code stands for what isn't read, and then there is no transform: ``not_embedded``, ``bad_data``, ``bad_number``, ``no_size``, ``transform``, ``opacity`` or ``effect`` of the image or of a group above it, ``unresolved``
    clips and masks, ``use`` of something that holds an image. A file that can't be read is one row with a code. Hidden images have no row, nor has what lies in definitions."""
    # files, and elements after them, are dealt to as many tasks as their tables need
    els = written(files.select("path", "content").repartition(tasks(files), "path").mapInArrow(_read, _SCHEMA), "elements")
    n = tasks(els)
    marks = els.where("NOT inner AND (tag IN ('image', 'file') OR tag = 'use' AND code = 'use')")
    up = marks.select("file", F.col("seq").alias("mark"), F.posexplode("above").alias("pos", "seq")).repartition(n, "file", "seq")
    each = els.select("file", "seq", "transform", "clip", "mask", "hidden", F.col("code").alias("wrong")).repartition(n, "file", "seq")
    stack = up.join(each, ["file", "seq"]).repartition(n, "file", "mark")
    level = F.struct("pos", "transform", "clip", "mask", "hidden", "wrong")
    stack = stack.groupBy("file", F.col("mark").alias("seq")).agg(F.sort_array(F.collect_list(level)).alias("levels"))
    to = lambda levels: matrix(F.array_join(F.transform(levels, lambda s: s["transform"]), " "))
    named = lambda k: F.transform(F.filter("levels", lambda s: s[k].isNotNull()), lambda s: F.struct(s[k].alias("id"), to(F.slice("levels", 1, s["pos"] + 1)).alias("transform")))
    found = marks.drop("mask", "clip", "transform", "hidden").repartition(n, "file", "seq").join(stack, ["file", "seq"]).where(~F.exists("levels", lambda s: s["hidden"]))
    wrong = F.get(F.filter(F.transform("levels", lambda s: s["wrong"]), lambda c: c.isNotNull()), F.lit(0))
    found = found.withColumns({"m": to(F.col("levels")), "clips": named("clip"), "masks": named("mask"), "wrong": wrong})
    code = F.coalesce("wrong", F.when(F.col("m").isNull(), "transform"))
    ordinal = F.row_number().over(Window.partitionBy("file").orderBy("seq")).cast("long") - 1
    return found.repartition(n, "file").select("file", ordinal.alias("ordinal"), "id", F.when(code.isNull(), let(F.col("m"), _placements)).alias("transform"), "clips", "masks", "sha256", code.alias("code"))
