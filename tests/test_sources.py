import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scenegrid.sources import manifests, package_sink, packages, publish, svg

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def deck(path, slides=2, extra=()):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="' + REL + '"'
    shape = '<p:sp><p:nvSpPr><p:cNvPr id="{}" name="{}"/></p:nvSpPr></p:sp>'
    with zipfile.ZipFile(path, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(slides)) + '<p:sldId id="9" r:id="rId77"/>'
        z.writestr("ppt/presentation.xml", f"<p:presentation {ns}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        rels = "".join(f'<Relationship Id="rId{i}" Type="{REL}/slide" Target="slides/slide{i + 1}.xml"/>' for i in range(slides))
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i in range(slides):
            group = "<p:grpSp><p:nvGrpSpPr><p:cNvPr id=\"5\" name=\"g\"/></p:nvGrpSpPr>" + shape.format(6, "inner") + "</p:grpSp>"
            z.writestr(f"ppt/slides/slide{i + 1}.xml", f"<p:sld {ns}><p:cSld><p:spTree>{shape.format(2, 'a')}{group}</p:spTree></p:cSld></p:sld>")
        for name in extra:
            z.writestr(name, b"x")


def test_packages(spark, tmp_path):
    deck(tmp_path / "a.pptx", extra=["../evil.xml", "/abs.xml"])
    (tmp_path / "b.pptx").write_bytes(b"no package")
    parts = packages.read_packages(spark, str(tmp_path)).cache()
    codes = {(r.part, r.code) for r in parts.where("code IS NOT NULL").collect()}
    assert codes == {("../evil.xml", "unsafe"), ("/abs.xml", "absolute"), (None, "not_a_package")}
    assert parts.where("content IS NOT NULL AND sha256 <> sha2(content, 256)").count() == 0
    slides = packages.slide_catalog(parts).orderBy("ordinal").collect()
    assert [(s.native_id, s.part, s.code) for s in slides] == [(256, "ppt/slides/slide1.xml", None), (257, "ppt/slides/slide2.xml", None), (9, None, "small_id")]
    shapes = packages.shape_inventory(parts).where("part LIKE '%slide1.xml'").orderBy("ordinal").collect()
    assert [(s.native_id, s.name, s.kind, s.parent) for s in shapes] == [("2", "a", "sp", None), ("5", "g", "grpSp", None), ("6", "inner", "sp", "g")]


def test_svg(spark, tmp_path):
    (tmp_path / "good.svg").write_text(
        '<svg xmlns="http://www.w3.org/2000/svg"><g fill="red" stroke-width="2"><rect x="1" y="2" width="10" height="5"/>'
        '<path d="m1,1 2,0 0,2z" style="fill:#abc" fill-rule="nonzero"/></g><polygon points="0,0 4,0 4,4"/><text>hi</text><use href="#a"/></svg>'
    )
    (tmp_path / "dtd.svg").write_text('<!DOCTYPE svg [<!ENTITY a "b">]><svg/>')
    (tmp_path / "bad.svg").write_text("<svg><g></svg>")
    rows = svg.read_svg(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1)).orderBy("name", "ordinal").collect()
    assert [(r.name, r.code) for r in rows if r.code] == [("bad.svg", "malformed"), ("dtd.svg", "forbidden_declaration"), ("good.svg", "forbidden_element")]
    good = [r for r in rows if r.name == "good.svg"]
    assert [(r.kind, r.fill, r.stroke_width) for r in good[:4]] == [("path", "#ff0000", 2.0), ("path", "#aabbcc", 2.0), ("path", "#000000", 1.0), ("text", "#000000", 1.0)]
    points = svg.commands(svg.read_svg(spark, str(tmp_path))).orderBy("path_id", "seq").collect()
    by = {}
    for p in points:
        by.setdefault(p.path_id.ordinal, []).append((p.op, p.x, p.y))
    assert by[0] == [("M", 1, 2), ("L", 11, 2), ("L", 11, 7), ("L", 1, 7), ("Z", 1, 2)]
    assert by[1] == [("M", 1, 1), ("L", 3, 1), ("L", 3, 3), ("Z", 1, 1)]


def test_svg_shapes_and_transforms(spark):
    body = (
        '<svg xmlns="http://www.w3.org/2000/svg"><!-- note --><title>t</title>'
        '<g transform="translate(10 20)"><rect width="4" height="2" transform="scale(2)"/></g>'
        '<circle cx="5" cy="6" r="2"/><ellipse cx="0" cy="0" rx="3" ry="1"/><rect x="1" width="8" height="4" rx="9"/>'
        '<rect width="2" height="2" clip-path="url(#a)"/><circle r="zwei"/><rect width="0" height="2"/><blob/><path d=" "/>'
        '<text>a<tspan>b</tspan></text><text>a<tspan dy="3">b</tspan></text></svg>'
    )
    files = spark.createDataFrame([("f", body.encode())], "path string, content binary")
    rows = svg.objects(files).orderBy("ordinal").collect()
    assert [r.code for r in rows] == [None, None, None, None, "clip_path", "bad_number", "no_geometry", "unknown_element", "no_geometry", None, "text_spans"]
    assert rows[0].transform == [2, 0, 0, 2, 10, 20] and rows[1].transform is None
    assert rows[1].data == "M7.0 6.0A2.0 2.0 0 1 1 3.0 6.0A2.0 2.0 0 1 1 7.0 6.0Z" and rows[3].data.startswith("M5.0 0.0h0.0a4.0 2.0 0 0 1 4.0 2.0v0.0")
    assert rows[9].text == "ab"
    points = svg.commands(svg.objects(files)).where("path_id.ordinal = 0").orderBy("seq").collect()
    assert [(p.op, p.x, p.y) for p in points] == [("M", 10, 20), ("L", 18, 20), ("L", 18, 24), ("L", 10, 24), ("Z", 10, 20)]
    assert svg.objects(files.limit(0)).collect() == []


def svg_rows(spark, body, head=""):
    files = spark.createDataFrame([("f", f'<svg xmlns="http://www.w3.org/2000/svg" {head}>{body}</svg>'.encode())], "path string, content binary")
    return svg.objects(files).orderBy("ordinal").collect(), files


def test_svg_units_view_boxes_and_transforms(spark):
    body = (
        '<line x1="10mm" x2="1in" y1="2pt" stroke="red" stroke-width="2"/><line x1="50%" stroke="red"/><rect width="1em" height="2"/>'
        '<rect width="4" height="2" transform="rotate(90 50 50)"/><rect width="4" height="2" transform="skewX(45)" stroke="red"/><rect width="4" height="2" transform="turn(3)"/>'
        '<svg x="3"/><g display="none"><rect width="9" height="9"/></g><rect width="1" height="1" visibility="hidden"/><rect width="4" height="2" fill-opacity=".5" opacity="0.5"/>'
        '<rect width="4" height="2" stroke="blue" fill-opacity=".5"/><rect width="4" height="2" stroke-dasharray="3"/><g color="lime" id="g1"><path d="M0 0L1 1" stroke="currentColor" fill="none" id="p"/><path id="p" d="M0 0"/></g>'
    )
    rows, files = svg_rows(spark, body, 'width="200" height="100" viewBox="0 0 100 100"')
    assert [r.code for r in rows] == [None, "bad_number", "bad_number", None, "stroke_transform", "transform", "nested_svg", None, "two_opacities", "stroke_style", None, "repeated_id"]
    assert rows[0].fill == "none" and rows[0].stroke_width == 2.0 and rows[0].transform == [1, 0, 0, 1, 50, 0]
    assert (rows[7].opacity, rows[10].stroke, rows[10].group_id, rows[10].id) == (0.25, "#00ff00", "g1", "p")
    assert svg.canvases(files).collect() == [("f", 200.0, 100.0)]
    got = {}
    for p in svg.commands(svg.objects(files)).orderBy("path_id", "seq").collect():
        got.setdefault(p.path_id.ordinal, []).append((p.op, round(p.x, 6), round(p.y, 6)))
    assert got[0] == [("M", round(50 + 10 * 96 / 25.4, 6), round(2 * 96 / 72, 6)), ("L", 146, 0)]
    assert got[3][:3] == [("M", 150, 0), ("L", 150, 4), ("L", 148, 4)]


def test_svg_curves_become_chords(spark):
    rows, files = svg_rows(spark, '<circle cx="5" cy="6" r="2"/><path d="M0 0C0 10 10 10 10 0Z" transform="scale(10)"/><path d="M0 0L5"/>')
    got = {}
    for p in svg.commands(svg.objects(files), tolerance=0.01).orderBy("path_id", "seq").collect():
        got.setdefault(p.path_id.ordinal, []).append(p)
    assert all(abs(((p.x - 5) ** 2 + (p.y - 6) ** 2) ** 0.5 - 2) < 1e-9 for p in got[0]) and len(got[0]) > 20
    assert max(p.y for p in got[1]) == 75 and len(got[1]) > 30 and got[1][-1].op == "Z"
    assert [(p.code, p.op) for p in got[2]] == [("count", None)]


def test_svg_texts(spark):
    body = (
        '<text x="10" y="20" dx="1" font-size="12pt" font-weight="700" text-anchor="middle"> a  b </text>'
        '<g transform="translate(5 5) scale(2)"><text x="1" y="2" font-style="italic" opacity=".5"><tspan x="3" y="4" font-size="10">one</tspan><tspan x="5" y="6" dy="1" opacity=".5">two</tspan></text></g>'
        '<text x="1 2 3" y="0">abc</text><text transform="rotate(9)">r</text><text>lead<tspan x="1" y="1">t</tspan></text><text stroke="red">s</text><text font-weight="bolder">w</text><text textLength="9">l</text><text/>'
    )
    rows, _ = svg_rows(spark, body)
    assert [r.code for r in rows] == [None, None, None, "text_position", "text_transform", "text_spans", "text_stroke", "font_weight", "text_length"]
    assert [(r.text, r.x, r.y, r.font_size, r.bold, r.italic, r.alignment, r.opacity) for r in rows[:3]] == [("a b", 11, 20, 16, True, False, "center", 1), ("one", 11, 13, 20, False, True, "left", 0.5), ("two", 15, 19, 32, False, True, "left", 0.25)]


@pytest.mark.parametrize(("head", "code"), [('viewBox="0 0 0 5"', "canvas"), ('width="0"', "canvas"), ('width="50%"', "canvas"), ('viewBox="0 0 1 1" preserveAspectRatio="xMidYMid slice"', "canvas"), ('viewBox="1 2 x 4"', "canvas")])
def test_svg_canvas_codes(spark, head, code):
    rows, files = svg_rows(spark, "<rect width='1' height='1'/>", head)
    assert [(r.code, r.kind) for r in rows] == [(code, None)] and svg.canvases(files).collect() == []


def test_manifests(spark, tmp_path):
    good = {"schema_version": 1, "id": "s", "revision": 2, "canvas": {"width": 9, "height": 9}, "objects": [{"id": "a", "kind": "path"}, {"id": "b", "kind": "text", "text": "t"}]}
    lines = [json.dumps(good), json.dumps(good | {"schema_version": 2}), json.dumps(good | {"revision": 0}), json.dumps(good | {"surprise": 1}), '{"id": "x", "id": "y"}', "[1, 2", json.dumps(good) + " x"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    found = manifests.read_manifests(spark, str(tmp_path)).cache()
    assert sorted(r.code for r in found.collect()) == sorted(["ok", "version", "revision", "unknown_key", "malformed", "malformed", "malformed"])
    assert [(o.scene_id, o.ordinal, o.id) for o in manifests.objects(found).orderBy("ordinal").collect()] == [("s", 0, "a"), ("s", 1, "b")]


def test_publish_never_overwrites(spark, tmp_path):
    receipt = publish.publish(spark.range(7), str(tmp_path), "run-0001").first()
    assert receipt.n_rows == 7 and receipt.run == "run-0001"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        publish.publish(spark.range(3), str(tmp_path), "run-0001")


def zipped(members, stream=False, comment=b""):
    out = io.BytesIO()

    class Pipe:  # a file that can't be sought: members get a descriptor behind their data
        def write(self, data):
            return out.write(data)

        def flush(self):
            pass

    with zipfile.ZipFile(Pipe() if stream else out, "w") as z:
        for i, (name, content) in enumerate(members):
            z.writestr(name, content, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.comment = comment
    return out.getvalue()


def test_changed_packages_keep_the_bytes_of_other_members(spark):
    base = [("a.txt", b"a" * 1000), ("b/ü.xml", "<ü/>".encode()), ("c.bin", bytes(range(256)) * 9), ("d.txt", b"")]
    files = {"plain": zipped(base), "stream": zipped(base, stream=True), "comment": zipped(base, comment=b"note"), "none": b"no package", "empty": zipped([]), "bad": zipped(base), "twice": zipped(base), "gone": zipped(base), "still": zipped(base)}
    schema = "path string, part string, content binary"
    changes = [(p, n, c) for p in ("plain", "stream", "comment") for n, c in (("b/ü.xml", b"<new/>"), ("d.txt", None), ("e.txt", b"more"))]
    changes += [("none", "x", b"x"), ("empty", "x", b"x"), ("bad", "../x", b"x"), ("bad", "y", b"y"), ("twice", "x", b"1"), ("twice", "x", b"2"), ("gone", "zzz", None), ("gone", "a.txt", b"-"), ("nowhere", "a", b"a")]
    before = spark.createDataFrame(list(files.items()), "path string, content binary")
    after = {r.path: r for r in package_sink.update_packages(before, spark.createDataFrame(changes, schema)).collect()}
    assert {p: r.code for p, r in after.items()} == {"none": "not_a_package", "bad": "unsafe", "twice": "repeated", "gone": "missing"} | dict.fromkeys(("plain", "stream", "comment", "empty", "still"))
    for p in ("none", "bad", "twice", "gone", "still"):
        assert bytes(after[p].content) == files[p]
    for p in ("plain", "stream", "comment"):
        with zipfile.ZipFile(io.BytesIO(after[p].content)) as z:
            assert z.testzip() is None
            assert {i.filename: z.read(i) for i in z.infolist()} == {"a.txt": base[0][1], "b/ü.xml": b"<new/>", "c.bin": base[2][1], "e.txt": b"more"}
        old, new = ({n: d for n, d, _ in package_sink.segments(bytes(b))} for b in (files[p], after[p].content))
        assert old["a.txt"] == new["a.txt"] and old["c.bin"] == new["c.bin"] and old["b/ü.xml"] != new["b/ü.xml"]
    with zipfile.ZipFile(io.BytesIO(after["empty"].content)) as z:
        assert z.namelist() == ["x"]
    again = package_sink.build_packages(spark.createDataFrame([("p", n, c) for n, c in base], schema)).first().content
    assert again == package_sink.build_packages(spark.createDataFrame([("p", n, c) for n, c in base[::-1]], schema)).first().content
    assert {m.part: bytes(m.content) for m in packages.members(spark.createDataFrame([("p", again)], "path string, content binary")).collect()} == dict(base)


def test_a_batch_with_one_bad_row_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "late"), (3, "late"), (4, "early")], "id bigint, code string")
    assert tuple(publish.publish_batch(rows, str(tmp_path), "r1").first()) == (4, 3, ["early", "late"]) and not list(tmp_path.iterdir())
    assert tuple(publish.publish_batch(rows.where("id = 1"), str(tmp_path), "r1").first()) == (1, 0, [])
    assert spark.read.parquet(str(tmp_path / "r1" / "data")).columns == ["id"]
