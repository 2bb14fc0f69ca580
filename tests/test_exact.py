import json
import random
from fractions import Fraction

from pyspark.sql import functions as F

from scenegrid.operators import exact, records

STEPS = "id int, steps array<struct<matrix:string,dx:string,dy:string>>"


def _run(spark, rows):
    df = spark.createDataFrame(rows, STEPS).withColumn("c", exact.exact_chain(F.col("steps")))
    return {r.id: r.c for r in df.collect()}


def _times(a, b):
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def _fractions(steps):
    m = tuple(map(Fraction, (1, 0, 0, 1, 0, 0)))
    for text, dx, dy in steps:
        if text:
            m = _times(m, tuple(map(Fraction, text[7:-1].replace(",", " ").split())))
        if dx is not None:
            m = _times(m, (1, 0, 0, 1, Fraction(dx), Fraction(dy)))
    return m


def test_chains_equal_fractions(spark):
    rng = random.Random(3)
    number = lambda: rng.choice(["{:.0f}", "{:.1f}", "{:.3f}", "{:.2f}e-1", "{:.1f}e1", "+{:.2f}"]).format(abs(rng.gauss(0, 4))) if rng.random() < 0.6 else rng.choice(["0", "1", "-1", "-.5", "2.", "-0.0", "10e2", "-3.25"])
    rows = []
    for i in range(1000):
        steps = [("matrix(" + rng.choice([" ", ","]).join(number() for _ in range(6)) + ")" if rng.random() < 0.8 else rng.choice([None, ""]), *((number(), number()) if rng.random() < 0.5 else (None, None))) for _ in range(rng.randrange(5))]
        rows.append((i, steps))
    got = _run(spark, rows)
    for i, steps in rows:
        c, want = got[i], _fractions(steps)
        assert c.code is None, (steps, c)
        assert tuple(Fraction(int(v), 10**c.s) for v in c.m) == want
        assert c.s == 0 or any(int(v) % 10 for v in c.m)


def test_what_a_chain_does_not_read(spark):
    one = lambda t, dx=None, dy=None: [(t, dx, dy)]
    big = "matrix(1e30 0 0 1 0 0)"
    rows = [
        (1, one("rotate(3)")), (2, one("matrix(1 2 3 4 5)")), (3, one("matrix(1 2 3 4 5 6) x")), (4, one("matrix(1 2 3 4 5 x6)")), (5, one(None, "1", None)), (6, one(None, "a", "1")),
        (7, one(big) + one(big)), (8, one("matrix(1e-30 0 0 1 0 0)")), (9, one("matrix(1e-50 0 0 1 0 0)")), (10, one("matrix(1 0 0 1 1e99999 0)")), (11, []), (12, None), (13, one("matrix(1-2.5.5 4 5 6)")),
        (14, one(" matrix ( 1 0\n0 1 0 0 ) ")), (15, one("matrix(" + "0" * 5000 + ")")), (16, one("rotate(3)") + one(big) + one(big)), (17, one("matrix(0e-4096 0 0 1 0 0)")), (18, one("")),
    ]
    got = {k: c and (c.code or [str(v) for v in c.m] + [c.s]) for k, c in _run(spark, rows).items()}
    whole = lambda *m: [str(v) for v in m[:-1]] + [m[-1]]
    assert got == {
        1: "unread", 2: "unread", 3: "unread", 4: "unread", 5: "unread", 6: "unread", 7: "overflow", 8: whole(1, 0, 0, 10**30, 0, 0, 30), 9: "overflow", 10: "unread", 11: whole(1, 0, 0, 1, 0, 0, 0), 12: None,
        13: whole(10, -25, 5, 40, 50, 60, 1), 14: whole(1, 0, 0, 1, 0, 0, 0), 15: "unread", 16: "unread", 17: whole(0, 0, 0, 1, 0, 0, 0), 18: whole(1, 0, 0, 1, 0, 0, 0),
    }


def test_exact_texts(spark):
    rows = spark.createDataFrame([(1250, 2), (-1250, 3), (5, 3), (0, 4), (-7, 0), (100, 2)], "n long, s int")
    assert [r[0] for r in rows.select(exact.exact_text(F.col("n"), F.col("s"))).collect()] == ["12.5", "-1.25", "0.005", "0", "-7", "1"]


def _strict(text):
    """The same by Python's reader: a text of the record, or None."""

    def pairs(items):
        if len(dict(items)) < len(items):
            raise ValueError("repeated")
        return dict(items)

    try:
        return json.dumps(json.loads(text, object_pairs_hook=pairs, parse_constant=lambda c: 1 / 0), sort_keys=True, allow_nan=False)
    except (ValueError, TypeError, ZeroDivisionError):
        return None


def test_typed_json(spark):
    texts = [
        '{"a":1,"b":[1.0,"x"]}', '{ "b" : [ 10e-1 , "\\u0078" ] , "\\u0061":1 }', '{"a":1.0,"b":[1.0,"x"]}', '{"a":"1","b":[1.0,"x"]}', '{"a":true,"b":[1.0,"x"]}', '{"b":["x",1.0],"a":1}', "1", "1.0", '"1"', '"i1"', '"s1"', '{"n":"i1"}', '{"sn":"i1"}',
        "true", "null", '"null"', "", " ", "{} {}", "[1] x", "1,2", "1] [2", '{"a":1,"a":2}', '{"a":1,"\\u0061":2}', "{'a':1}", '{"a":01}', "-0", "0", "-0.0", "0.0", "1e999", "[1,]", "{1:2}", '1"a"', '"a"1', '"', '{"a":"\\""}', '{"a":"[,]{"}', "NaN", "-", "[[],{}]", "[ [ ] , { } ]",
        "123456789012345678901234567890123456789012", "123456789012345678901234567890123456789013", '{"a":{"b":[{"c":null}]}}', '{"a":{"b":[{"c":0}]}}', '"' + "long \\\\ text " * 30000 + '"', '["' + "long \\\\ text " * 30000 + '"]', "tru1", "[1 2]", '"\\ud83d\\ude00"', '"\U0001f600"', '"a\\/b"', '"a/b"', "}{", ",",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string").withColumn("c", records.typed_json(F.col("t")))
    got = {r.i: r.c for r in df.collect()}
    assert got.pop(-1) is None
    want = [_strict(t) for t in texts]
    assert [i for i in got if (got[i] is None) != (want[i] is None)] == []
    for i, w in enumerate(want):
        for j, v in enumerate(want):
            assert w is None or v is None or (got[i] == got[j]) == (w == v), (texts[i][:60], texts[j][:60])


def test_replayed(spark):
    kept = spark.createDataFrame([("a", '{"n":1,"m":2}'), ("b", '{"n":1}'), ("c", "{}"), ("d", "{"), ("e", "{}"), ("e", "{}"), (None, "1")], "k string, r string")
    again = spark.createDataFrame([("a", '{"m":2, "n":1}'), ("b", '{"n":1.0}'), ("d", "{}"), ("e", "{}"), ("f", "{}"), (None, "1")], "k string, r string")
    got = {r.k: r.status for r in records.replayed(kept, again, "k", "r").collect()}
    assert got == {"a": "equal", "b": "differs", "c": "missing", "d": "unread", "e": "repeated", "f": "extra", None: "equal"}
    assert records.replayed(kept.limit(0), again.limit(0), "k", "r").collect() == []
    both = spark.createDataFrame([("[1]", "[1]"), ("[1]", "[1.0]"), ("[", "["), (None, None)], "l string, r string").select(records.same_json(F.col("l"), F.col("r")).alias("s")).collect()
    assert [(r.s.equal, r.s.code) for r in both] == [(True, None), (False, None), (False, "unread"), (False, "unread")]
