"""Office packages: ZIP members as rows, and what the slides name. Files come through Spark's ``binaryFile``, so any
store that Spark reads will do; a task holds one package at a time."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest member that is read, and the XML names of slides and relationships.
MAX_MEMBER = 64 << 20
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"

_PARTS = "package string, part string, content binary, sha256 string, code string"


def name_code(name: str) -> str | None:
    """Why a member's name isn't taken, if so."""
    if name.startswith("/") or "\\" in name or ":" in name:
        return "absolute"
    steps = name.rstrip("/").split("/")
    return "unsafe" if any(s in ("", ".", "..") for s in steps) else None


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    seen = set()
                    for info in z.infolist():
                        code = name_code(info.filename) or ("duplicate" if info.filename in seen else "encrypted" if info.flag_bits & 1 else "too_large" if info.file_size > MAX_MEMBER else None)
                        seen.add(info.filename)
                        data = None if code else z.read(info)
                        rows.append((path, info.filename, data, hashlib.sha256(data).hexdigest() if data is not None else None, code))
            except zipfile.BadZipFile:
                rows = [(path, None, None, None, "not_a_package")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()), strict=True)], ["package", "part", "content", "sha256", "code"])


def members(files: DataFrame) -> DataFrame:
    """package, part, content, sha256 and a code for members that aren't read, of packages (path, content); a file that is no package has one row."""
    return files.select("path", "content").mapInArrow(_members, _PARTS)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``members`` of the files under a path."""
    return members(spark.read.format("binaryFile").load(path))


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for package, part, content in zip(*(batch.column(c).to_pylist() for c in ("package", "part", "content")), strict=True):
            try:
                for rel in ET.fromstring(content).iter(f"{PR}Relationship"):
                    rows.append((package, part, rel.get("Id"), rel.get("Type", "").rpartition("/")[2], rel.get("Target"), rel.get("TargetMode", "Internal"), None))
            except ET.ParseError:
                rows.append((package, part, None, None, None, None, "malformed"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], ["package", "source", "rid", "type", "target", "mode", "code"])


def relationships(parts: DataFrame) -> DataFrame:
    """package, source (the part that refers), rid, type, target part, mode, code."""
    rels = parts.where("part LIKE '%.rels' AND content IS NOT NULL").select("package", "part", "content")
    found = rels.mapInArrow(_relations, "package string, source string, rid string, type string, target string, mode string, code string")
    owner = F.regexp_replace(F.regexp_replace("source", "_rels/", ""), r"\.rels$", "")
    folder = F.regexp_replace(owner, "[^/]*$", "")
    up = F.regexp_replace(F.concat(F.regexp_replace(folder, "[^/]+/$", ""), F.regexp_replace("target", r"^\.\./", "")), "^/", "")
    whole = F.when(F.col("target").startswith("/"), F.substring("target", 2, 1 << 20)).when(F.col("target").startswith("../"), up).otherwise(F.concat(folder, "target"))
    return found.select("package", owner.alias("source"), "rid", "type", F.when(F.col("mode") == "Internal", whole).otherwise(F.col("target")).alias("target"), "mode", "code")


def _slides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for package, content in zip(batch.column("package").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for n, slide in enumerate(ET.fromstring(content).iter(f"{P}sldId")):
                rows.append((package, n, int(slide.get("id", "0")), slide.get(f"{R}id")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["package", "ordinal", "native_id", "rid"])


def slide_catalog(parts: DataFrame) -> DataFrame:
    """Slides of each package in order, with the part that each resolves to and a code: ``small_id``, ``repeated_id``
    or ``dangling``."""
    from pyspark.sql import Window

    deck = parts.where("part = 'ppt/presentation.xml' AND content IS NOT NULL").select("package", "content")
    slides = deck.mapInArrow(_slides, "package string, ordinal bigint, native_id bigint, rid string")
    rels = relationships(parts).where("source = 'ppt/presentation.xml'").select("package", "rid", "target")
    known = parts.select("package", F.col("part").alias("target"), F.lit(True).alias("known"))
    found = slides.join(rels, ["package", "rid"], "left").join(known, ["package", "target"], "left")
    same = F.count("*").over(Window.partitionBy("package", "native_id"))
    code = F.when(F.col("native_id") < 256, "small_id").when(same > 1, "repeated_id").when(F.col("known").isNull(), "dangling")
    return found.select("package", "ordinal", "native_id", F.col("target").alias("part"), code.alias("code"))


_SHAPES = "package string, part string, native_id string, name string, kind string, parent string, ordinal bigint, code string"


def _inventory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {f"{P}{k}": k for k in ("sp", "pic", "cxnSp", "grpSp", "graphicFrame")}
    for batch in batches:
        rows = []
        for package, part, content in zip(*(batch.column(c).to_pylist() for c in ("package", "part", "content")), strict=True):
            try:
                tree = ET.fromstring(content).find(f".//{P}spTree")
            except ET.ParseError:
                rows.append((package, part, None, None, None, None, None, "malformed"))
                continue
            todo = [(tree, None)] if tree is not None else []
            while todo:
                node, parent = todo.pop(0)
                for child in node:
                    if child.tag in kinds:
                        props = child.find(f".//{P}cNvPr")
                        name = props.get("name") if props is not None else None
                        rows.append((package, part, props.get("id") if props is not None else None, name, kinds[child.tag], parent, len(rows), None))
                        if kinds[child.tag] == "grpSp":
                            todo.append((child, name))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 6 else pa.string()) for i in range(8)], re.findall(r"(\w+) (?:string|bigint)", _SHAPES))


def shape_inventory(parts: DataFrame) -> DataFrame:
    """Shapes of all slides: native_id, name, kind, parent group, order."""
    slides = parts.where(F.col("part").rlike(r"^ppt/slides/slide[0-9]+\.xml$") & F.col("content").isNotNull())
    return slides.select("package", "part", "content").mapInArrow(_inventory, _SHAPES)
