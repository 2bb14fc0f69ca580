"""Packages written from rows, and changed in place: a member that isn't touched keeps its very bytes.

A package is one row (path, content), a change one row (path, part, content; null deletes). Changes meet their package by its path, so a task holds one package and its
changes at a time. Of the old file each untouched member's local header, compressed bytes and descriptor are copied as they are, in their order; changed ones are written in their place, new
ones behind, and only the central directory is new. A package that can't be changed keeps its content and has a code: ``not_a_package``, ``zip64``, ``unsafe`` or ``absolute`` (the name of a change), ``repeated``
(two changes of one part), ``missing`` (a part to be deleted isn't there). All or nothing: with a code, none of its changes are made.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.sources.packages import name_code

#: Members carry no time, so equal rows give equal bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)
_END, _RECORD = b"PK\x05\x06", b"PK\x01\x02"


def _zipped(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def segments(package: bytes) -> list[tuple[str, bytes, bytes]]:
    """(name, bytes from its local header to the next, its record in the directory) of each member, by place in the file."""
    end = package.rfind(_END)
    if end < 0:
        raise zipfile.BadZipFile
    size, start = struct.unpack("<II", package[end + 12 : end + 20])
    if 0xFFFFFFFF in (size, start):
        raise NotImplementedError
    records, at = [], start
    while package[at : at + 4] == _RECORD:
        n = 46 + sum(struct.unpack("<HHH", package[at + 28 : at + 34]))
        flags, length = struct.unpack("<H", package[at + 8 : at + 10])[0], struct.unpack("<H", package[at + 28 : at + 30])[0]
        name = package[at + 46 : at + 46 + length].decode("utf-8" if flags & 0x800 else "cp437")
        records.append((struct.unpack("<I", package[at + 42 : at + 46])[0], name, package[at : at + n]))
        at += n
    if len(records) != struct.unpack("<H", package[end + 10 : end + 12])[0]:
        raise zipfile.BadZipFile
    if not records:
        return []
    records.sort(key=lambda r: r[0])
    ends = [r[0] for r in records[1:]] + [start]
    return [(name, package[begin:to], record) for (begin, name, record), to in zip(records, ends, strict=True)]


def changed(package: bytes, changes: list[tuple[str, bytes | None]]) -> bytes:
    """The package after the changes."""
    wanted = dict(changes)
    out, directory = [], []
    at = 0
    here = segments(package)
    fresh = segments(_zipped([(n, c) for n, c in changes if c is not None]))
    new = {name: (data, record) for name, data, record in fresh}
    names = {name for name, _, _ in here}
    for name, data, record in [*here, *[(n, *new[n]) for n, c in changes if c is not None and n not in names]]:
        if name in wanted and wanted[name] is None:
            continue
        if name in wanted:
            data, record = new[name]
        directory.append(record[:42] + struct.pack("<I", at) + record[46:])
        out.append(data)
        at += len(data)
    whole = b"".join(directory)
    return b"".join(out) + whole + _END + struct.pack("<HHHHIIH", 0, 0, len(directory), len(directory), len(whole), at, 0)


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content, changes in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("changes").to_pylist(), strict=True):
            old = content.as_py() or b""
            todo = [(c["part"], c["content"]) for c in changes or []]
            names = [n for n, _ in todo]
            code = next((c for c in map(name_code, names) if c), None) or ("repeated" if len(set(names)) < len(names) else None)
            try:
                there = {n for n, _, _ in segments(old)}
                code = code or ("missing" if any(c is None and n not in there for n, c in todo) else None)
                rows.append((path, old if code or not todo else changed(old, todo), code))
            except zipfile.BadZipFile:
                rows.append((path, old, "not_a_package"))
            except NotImplementedError:
                rows.append((path, old, "zip64"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["path", "content", "code"])


def update_packages(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, content and code of every package after its changes."""
    per = changes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("changes"))
    return files.select("path", "content").join(per, "path", "left").mapInArrow(_update, "path string, content binary, code string")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_zipped([(m["part"], m["content"] or b"") for m in members]) for members in batch.column("members").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.binary())], ["path", "content"])


def build_packages(parts: DataFrame) -> DataFrame:
    """path and content of a package for each path of ``parts`` (path, part, content), members by name; equal rows give equal bytes."""
    per = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("members"))
    return per.select("path", "members").mapInArrow(_build, "path string, content binary")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                rows += [(path, name, hashlib.sha256(data).hexdigest()) for name, data, _ in segments(content.as_py() or b"")]
            except (zipfile.BadZipFile, NotImplementedError):
                rows.append((path, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "part", "raw_sha256"])


def raw_members(files: DataFrame) -> DataFrame:
    """path, part and a digest of the bytes that each member has in its package, header and all."""
    return files.select("path", "content").mapInArrow(_raw, "path string, part string, raw_sha256 string")
