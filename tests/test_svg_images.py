import base64
import hashlib

from scenegrid.sources import svg_images

DATA = base64.b64encode(b"pixels").decode()
IMAGE = f'<image width="4" height="2" href="data:image/png;base64,{DATA}"'


def _read(spark, *bodies):
    rows = [(f"f{i}", body if isinstance(body, bytes) else f"<svg>{body}</svg>".encode()) for i, body in enumerate(bodies)]
    return svg_images.occurrences(spark.createDataFrame(rows, "path string, content binary")).orderBy("file", "ordinal").collect()


def test_matrices_clips_and_masks_of_groups(spark):
    clip = '<defs><clipPath id="c"/><clipPath id="k"/><mask id="m"/>' + IMAGE + "/></defs>"
    body = f'{clip}<g transform="translate(1 2)" clip-path="url(#c)">{IMAGE} id="a" x="3"/><g transform="scale(2)" style="clip-path:url(#k);mask:url(#m)">{IMAGE} id="b" y="1" transform="rotate(90)"/></g></g>{IMAGE} id="z"/>'
    a, b, z = _read(spark, body)
    assert [(r.id, r.ordinal, r.code, r.sha256) for r in (a, b, z)] == [(i, n, None, hashlib.sha256(b"pixels").hexdigest()) for n, i in enumerate("abz")]
    assert a.transform == [4, 0, 0, 2, 4, 2] and z.transform == [4, 0, 0, 2, 0, 0]
    assert [round(v, 9) for v in b.transform] == [0, 8, -4, 0, -1, 2]
    assert [(c.id, c.transform) for c in b.clips] == [("c", [1, 0, 0, 1, 1, 2]), ("k", [2, 0, 0, 2, 1, 2])]
    assert [(c.id, c.transform) for c in b.masks] == [("m", [2, 0, 0, 2, 1, 2])] and z.clips == [] and [c.id for c in a.clips] == ["c"]


def test_what_is_not_read_has_a_code(spark):
    far = '<image width="4" height="2" href="a.png"/>'
    cases = [
        far, f'<g opacity="0.5">{IMAGE}/></g>', f'{IMAGE} clip-path="url(#no)"/>', f'{IMAGE} transform="turn(1)"/>', IMAGE.replace("4", "5%", 1) + "/>", IMAGE.replace("4", "0", 1) + "/>", f'<g style="filter:url(#f)">{IMAGE}/></g>',
        f'<symbol id="s">{IMAGE}/></symbol><use href="#s"/>', '<use href="#lost"/>', IMAGE.replace(DATA, "a*b=") + "/>", b"<svg", b"", b"<!DOCTYPE svg><svg/>",
    ]
    got = {r.file: r.code for r in _read(spark, *cases)}
    want = ["not_embedded", "opacity", "unresolved", "transform", "bad_number", "no_size", "effect", "use", "use", "bad_data", "not_xml", "not_xml", "doctype"]
    assert got == {f"f{i}": c for i, c in enumerate(want)}
    assert _read(spark, f'<g display="none">{IMAGE}/></g>', f'<rect id="r"/><use href="#r"/><g visibility="hidden">{IMAGE}/></g>', "") == []
    assert svg_images.occurrences(spark.createDataFrame([], "path string, content binary")).collect() == []
