"""SVG path data as tables: parsing of all commands, arcs as chords, curves as chords within a tolerance, transforms.

Parsing is a segmented scan. A path's text is cut at its letters and each piece into groups of as many numbers as its command takes; those
are rows. The cursor is a pair of prefix sums for each axis: an absolute command, a closing and a moving one are anchors, relative ones add to the
last anchor; closings and relative moves stand on the start of their subpath, which is a prefix sum over subpaths of its own. A smooth cubic takes the control
point of the row before; smooth quadratics in a row mirror one another, so theirs is a sum with alternating signs. No step goes back over rows, and
all windows share one partitioning by path, so a path of n commands costs one shuffle and n log n.

All or nothing: a path of which anything can't be read has one row with a code and no points. Codes: ``empty``, ``start`` (it doesn't begin with a move),
``number`` (something is neither number nor separator nor known letter, or an arc's flags aren't 0 or 1), ``count`` (numbers left over or missing), ``range`` (not finite, or over LARGEST
in size), ``repeated_id``. Paths are told apart by their id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.functions.geometry import let
from scenegrid.operators.tables import Rounds

#: Letters and how many numbers each takes, the largest coordinate, the deepest split of a curve, the most chords of an arc.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
LARGEST = 1e9
DEEPEST = 24
MOST_CHORDS = 200_000
#: Splits of curves that one table takes in before open pieces are looked for.
SPLITS = 6

_LETTERS = "MmLlHhVvCcSsQqTtAaZz"
_NUMBER = r"(?>[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_SKIP = r"[\s,]*+"
_ARC = _SKIP.join([f"({_NUMBER})"] * 3 + ["([01])"] * 2 + [f"({_NUMBER})"] * 2)

_POINTS = ("x", "y", "x0", "y0", "x1", "y1", "x2", "y2")


def _groups(paths: DataFrame, data: str) -> DataFrame:
    """path_id, piece, i (place in its piece), op, rel, v (its numbers) and a code of each command; a path that can't begin has one row."""
    text = F.coalesce(F.col(data), F.lit(""))
    begins = text.rlike(r"^[\s,]*[Mm]")
    blank = ~text.rlike(r"[^\s,]")
    pieces = F.when(begins, F.regexp_extract_all(text, F.lit(f"[{_LETTERS}][^{_LETTERS}]*+"), 0)).otherwise(F.array(F.lit("")))
    wrong = F.when(blank, "empty").when(~begins, "start")
    # what is read of the whole text is read before it's cut, not once a piece
    rows = paths.select("path_id", wrong.alias("bad"), pieces.alias("pieces")).select("path_id", "bad", F.posexplode("pieces").alias("piece", "s"))
    rows = rows.select("path_id", "bad", "piece", F.upper(F.substring("s", 1, 1)).alias("op"), F.substring("s", 1, 1).rlike("[a-z]").alias("rel"), F.expr("substring(s, 2)").alias("args"))
    arc = F.col("op") == "A"
    number = lambda s: s.try_cast("double")
    tuples = F.transform(F.regexp_extract_all("args", F.lit(_ARC), 0), lambda t: F.array(*[number(F.regexp_extract(t, _ARC, k)) for k in range(1, 8)]))
    rows = rows.withColumns(
        {
            "n": F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in ARITY.items()], F.lit(0)),
            "flat": F.when(~arc, F.transform(F.regexp_extract_all("args", F.lit(_NUMBER), 0), number)).otherwise(F.array().cast("array<double>")),
            "tuples": F.when(arc, tuples).otherwise(F.array().cast("array<array<double>>")),
            "left": F.when(arc, F.regexp_replace("args", _ARC, "")).otherwise(F.regexp_replace("args", _NUMBER, "")),
        }
    )
    short = F.when(arc, F.size("tuples") == 0).when(F.col("n") == 0, F.size("flat") > 0).otherwise((F.size("flat") == 0) | (F.size("flat") % F.greatest(F.col("n"), F.lit(1)) != 0))
    code = F.coalesce(F.col("bad"), F.when(F.col("left").rlike(r"[^\s,]"), "number"), F.when(short, "count"))
    width = F.greatest(F.col("n"), F.lit(1))
    group = lambda f, k: F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.get(f, k * width + j))
    # bound by let: the numbers would be read anew for each group
    cut = let(F.col("flat"), lambda f: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(f) / width).cast("int") - 1)), lambda k: group(f, k)))
    one = F.array(F.array().cast("array<double>"))
    rows = rows.withColumn("code", code).select("path_id", "piece", "op", "rel", "code", F.when(F.col("code").isNotNull() | (F.col("n") == 0), one).when(arc, F.col("tuples")).otherwise(cut).alias("groups"))
    rows = rows.select("path_id", "piece", "op", "rel", "code", F.posexplode("groups").alias("i", "v"))
    far = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return rows.withColumns({"op": F.when((F.col("op") == "M") & (F.col("i") > 0), "L").otherwise(F.col("op")), "code": F.coalesce("code", F.when(far, "range"))})


def parse(paths: DataFrame, data: str) -> DataFrame:
    """The commands of ``paths`` (path_id, and path data in the column ``data``) in absolute coordinates: path_id, seq from 1, op (M, L, C, A, Z), its end x, y and its
    origin x0, y0; x1, y1, x2, y2 of cubics (quadratics are raised to cubics); rx, ry, rotation, large, sweep of arcs; and a code."""
    rows = _groups(paths, data)
    whole = Window.partitionBy("path_id")
    order = whole.orderBy("piece", "i")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    within = lambda c: Window.partitionBy("path_id", c).orderBy("piece", "i").rowsBetween(Window.unboundedPreceding, 0)
    first = (F.col("piece") == 0) & (F.col("i") == 0)
    rows = rows.withColumns({"seq": F.row_number().over(order).cast("long"), "why": F.first(F.col("code"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "heads": F.count_if(first).over(whole), "was": F.lag("op").over(order)})
    rows = rows.withColumn("why", F.coalesce(F.when(F.col("heads") > 1, "repeated_id"), "why"))
    op, rel, v = F.col("op"), F.col("rel"), lambda i: F.get("v", F.lit(i))
    last = {"H": (0, None), "V": (None, 0), "C": (4, 5), "S": (2, 3), "Q": (2, 3), "A": (5, 6)}
    moves, closes = op == "M", op == "Z"
    steps = {}
    for axis, k in (("x", 0), ("y", 1)):
        end = reduce(lambda e, kv: F.when(op == kv[0], F.lit(None).cast("double") if kv[1][k] is None else v(kv[1][k])).otherwise(e), last.items(), v(k))
        own = ~rel & end.isNotNull() & ~closes
        steps |= {f"d{axis}": F.when(closes, 0.0).otherwise(F.coalesce(end, F.lit(0.0))), f"own_{axis}": own, f"anchor_{axis}": own | closes | moves}
    rows = rows.withColumns(steps)
    counted = lambda c: F.sum(F.col(c).cast("int")).over(running)
    rows = rows.withColumns({f"part_{a}": counted(f"anchor_{a}") for a in "xy"})
    for a in "xy":
        # from the anchor, which is a place of its own, or the start of its subpath
        stand = ~F.col(f"own_{a}") & F.col(f"anchor_{a}")
        rows = rows.withColumns({f"off_{a}": F.sum(F.when(stand, 0.0).otherwise(F.col(f"d{a}"))).over(within(f"part_{a}")), f"on_start_{a}": F.first(stand).over(within(f"part_{a}"))})
    rows = rows.withColumns({f"{k}_{a}": F.lag(f"{c}_{a}").over(order) for a in "xy" for k, c in (("before", "off"), ("before_start", "on_start"))})
    for a in "xy":
        placed = moves & ~rel
        known = moves & (placed | ~F.coalesce(f"before_start_{a}", F.lit(False)))
        rows = rows.withColumns({f"run_{a}": F.sum(known.cast("int")).over(running), f"shift_{a}": F.when(placed, F.col(f"d{a}")).when(moves, F.col(f"d{a}") + F.coalesce(f"before_{a}", F.lit(0.0))).otherwise(0.0)})
    for a in "xy":
        start = F.sum(f"shift_{a}").over(within(f"run_{a}"))
        rows = rows.withColumn(a, F.when(F.col(f"on_start_{a}"), start + F.col(f"off_{a}")).otherwise(F.col(f"off_{a}")))
    rows = rows.withColumns({f"{a}0": F.coalesce(F.lag(a).over(order), F.lit(0.0)) for a in "xy"})
    at = lambda i, a: v(i) + F.when(rel, F.col(f"{a}0")).otherwise(0.0)
    rows = rows.withColumns({f"c2{a}": F.when(op == "C", at(2 + k, a)).when(op == "S", at(k, a)) for k, a in enumerate("xy")})
    follows = (op == "T") & F.col("was").isin("Q", "T")
    rows = rows.withColumn("mirror", F.sum((~follows).cast("int")).over(running))
    rows = rows.withColumn("sign", F.when(F.row_number().over(Window.partitionBy("path_id", "mirror").orderBy("piece", "i")) % 2 == 1, 1.0).otherwise(-1.0))
    for k, a in enumerate("xy"):
        origin = F.col(f"{a}0")
        rows = rows.withColumn(f"q{a}", F.col("sign") * F.sum(F.when(follows, F.col("sign") * 2 * origin).when(op == "Q", at(k, a)).otherwise(origin)).over(within("mirror")))
    smooth = F.col("was").isin("C", "S")
    curved = {}
    for k, a in enumerate("xy"):
        o, e, q, mine = F.col(f"{a}0"), F.col(a), F.col(f"q{a}"), op.isin("Q", "T")
        curved[f"{a}1"] = F.when(op == "C", at(k, a)).when(op == "S", F.when(smooth, 2 * o - F.lag(f"c2{a}").over(order)).otherwise(o)).when(mine, o + 2 * (q - o) / 3)
        curved[f"{a}2"] = F.when(mine, e + 2 * (q - e) / 3).otherwise(F.col(f"c2{a}"))
    arc = {n: F.when(op == "A", v(k)) for k, n in enumerate(("rx", "ry", "rotation", "large", "sweep"))}
    rows = rows.withColumns(curved).withColumns(arc)
    beyond = reduce(lambda p, c: p | (F.coalesce(F.abs(F.col(c)), F.lit(0.0)) > LARGEST), ("x", "y", "x1", "y1", "x2", "y2"), F.lit(False))
    rows = rows.withColumn("why", F.coalesce("why", F.when(F.max(beyond).over(whole), "range")))
    bad = F.col("why").isNotNull()
    kept = lambda c: F.when(~bad, c)
    kind = F.when(op.isin("S", "Q", "T", "C"), "C").when(op.isin("H", "V"), "L").otherwise(op)
    out = rows.where(~bad | (F.col("seq") == 1))
    return out.select("path_id", "seq", kept(kind).alias("op"), *[kept(F.col(c)).alias(c) for c in _POINTS], *[kept(F.col(c)).alias(c) for c in ("rx", "ry", "rotation")], *[kept(F.col(c).cast("int")).alias(c) for c in ("large", "sweep")], F.col("why").alias("code"))


def parse_lines(paths: DataFrame, data: str) -> DataFrame:
    """path_id, seq, op, x, y of paths of M, L, H, V and Z. A path with curves or arcs, or that isn't read, has one row with op ``unsupported`` and no points."""
    rows = parse(paths, data)
    whole = Window.partitionBy("path_id")
    odd = F.max(F.col("code").isNotNull() | F.col("op").isin("C", "A")).over(whole)
    rows = rows.withColumn("odd", odd).where(~F.col("odd") | (F.col("seq") == 1)).where("code IS NULL OR code <> 'empty'")
    sound = lambda c: F.when(~F.col("odd"), F.col(c)).alias(c)
    return rows.select("path_id", "seq", F.when(F.col("odd"), "unsupported").otherwise(F.col("op")).alias("op"), sound("x"), sound("y"))


def _centre_form(tolerance: float, m: list[Column]) -> Column:
    """The centre, the axes, the angle where an arc begins, how far it goes, and into how many chords, from its ends; null for other commands."""
    c = F.col
    named = lambda **v: F.struct(*[x.alias(k) for k, x in v.items()])
    phi = F.radians(c("rotation") % 360)
    hx, hy = (c("x0") - c("x")) / 2, (c("y0") - c("y")) / 2
    full = 2 * F.pi()

    def grow(s: Column) -> Column:
        more = F.sqrt(F.greatest(F.lit(1.0), F.coalesce(F.pow(F.try_divide(s["px"], s["ra"]), F.lit(2)) + F.pow(F.try_divide(s["py"], s["rb"]), F.lit(2)), F.lit(1.0))))
        return let(named(ra=s["ra"] * more, rb=s["rb"] * more), lambda r: centre(s, r))

    def centre(s: Column, r: Column) -> Column:
        below = r["ra"] * r["ra"] * s["py"] * s["py"] + r["rb"] * r["rb"] * s["px"] * s["px"]
        sign = F.when(c("large") == c("sweep"), -1.0).otherwise(1.0)
        f = lambda d: sign * F.coalesce(F.sqrt(F.try_divide(F.greatest(F.lit(0.0), r["ra"] * r["ra"] * r["rb"] * r["rb"] - d), d)), F.lit(0.0))
        middle = let(below, lambda d: let(f(d), lambda k: named(mx=k * F.try_divide(r["ra"] * s["py"], r["rb"]), my=-k * F.try_divide(r["rb"] * s["px"], r["ra"]))))
        return let(middle, lambda q: angles(s, r, q))

    def angles(s: Column, r: Column, q: Column) -> Column:
        ends = named(ux=F.try_divide(s["px"] - q["mx"], r["ra"]), uy=F.try_divide(s["py"] - q["my"], r["rb"]), vx=F.try_divide(-s["px"] - q["mx"], r["ra"]), vy=F.try_divide(-s["py"] - q["my"], r["rb"]))
        turn = lambda e: F.atan2(e["ux"] * e["vy"] - e["uy"] * e["vx"], e["ux"] * e["vx"] + e["uy"] * e["vy"])
        around = lambda t: F.when((c("sweep") == 0) & (t > 0), t - full).when((c("sweep") == 1) & (t < 0), t + full).otherwise(t)
        return let(ends, lambda e: let(turn(e), lambda t: let(around(t), lambda d: chorded(s, r, q, e, d))))

    def chorded(s: Column, r: Column, q: Column, e: Column, d: Column) -> Column:
        axes = [r["ra"] * s["co"], r["ra"] * s["si"], -r["rb"] * s["si"], r["rb"] * s["co"]]
        # the Frobenius norm of the axes under the matrix bounds what it does to a distance
        square = lambda x: F.pow(x, F.lit(2))
        reach = F.sqrt(sum((square(m[i] * axes[k] + m[i + 2] * axes[k + 1]) for i in (0, 1) for k in (0, 2)), F.lit(0.0)))
        step = let(reach, lambda n: F.greatest(F.lit(1e-7), F.least(F.pi() / 2, F.when(n > tolerance, 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - tolerance / n)))).otherwise(F.pi() / 2))))
        place = {"cx": s["co"] * q["mx"] - s["si"] * q["my"] + (c("x0") + c("x")) / 2, "cy": s["si"] * q["mx"] + s["co"] * q["my"] + (c("y0") + c("y")) / 2}
        return named(**place, ax=axes[0], ay=axes[1], bx=axes[2], by=axes[3], theta=F.atan2(e["uy"], e["ux"]), delta=d, chords=F.greatest(F.lit(1), F.ceil(F.abs(d) / step).cast("int")))

    ends = named(co=F.cos(phi), si=F.sin(phi), ra=F.abs("rx"), rb=F.abs("ry"))
    return let(ends, lambda a: let(named(co=a["co"], si=a["si"], ra=a["ra"], rb=a["rb"], px=a["co"] * hx + a["si"] * hy, py=-a["si"] * hx + a["co"] * hy), grow))


def arcs_as_lines(commands: DataFrame, tolerance: float, matrix: str | None = None) -> DataFrame:
    """``parse``'s commands with every arc as chords that leave it by ``tolerance`` at most, under the column ``matrix`` (an array of six, null: none) if one is named: an arc
    between equal ends vanishes, one without a radius is a line, radii that are too short grow. An arc of over MOST_CHORDS chords is one row with the code ``chords``.
    A column ``part`` orders the rows of one command."""
    c, arc = F.col, F.col("op") == "A"
    m = [F.coalesce(F.get(c(matrix), F.lit(i)), F.lit(d)) if matrix else F.lit(d) for i, d in enumerate((1.0, 0.0, 0.0, 1.0))]
    round_ = arc & (c("rx") != 0) & (c("ry") != 0)
    rows = commands.where(~F.coalesce(arc & (c("x0") == c("x")) & (c("y0") == c("y")), F.lit(False)))
    rows = rows.withColumn("arc", F.when(round_, _centre_form(tolerance, m)))
    much = F.coalesce(c("arc.chords") > MOST_CHORDS, F.lit(False))
    n = F.coalesce(F.when(~much, c("arc.chords")), F.lit(1))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), n)))
    angle = c("arc.theta") + c("arc.delta") * c("part") / c("arc.chords")
    inner = F.coalesce(c("part") < c("arc.chords"), F.lit(False))
    none = F.lit(None)
    place = {
        "x": F.when(much, none).when(inner, c("arc.cx") + c("arc.ax") * F.cos(angle) + c("arc.bx") * F.sin(angle)).otherwise(c("x")),
        "y": F.when(much, none).when(inner, c("arc.cy") + c("arc.ay") * F.cos(angle) + c("arc.by") * F.sin(angle)).otherwise(c("y")),
        "op": F.when(much, none).when(arc, "L").otherwise(c("op")),
        "code": F.coalesce("code", F.when(much, "chords")),
    }
    return rows.withColumns(place).select("path_id", "seq", "part", "op", *_POINTS, "code", *([matrix] if matrix else []))


def transformed(commands: DataFrame, matrix: str) -> DataFrame:
    """Points and control points under the column ``matrix`` (an array of six; null: as they are). Arcs must be lines before (``arcs_as_lines``)."""
    m = F.col(matrix)
    moved = {}
    for n in ("", "0", "1", "2"):
        x, y = F.col(f"x{n}"), F.col(f"y{n}")
        moved |= {f"x{n}": F.when(m.isNull(), x).otherwise(m[0] * x + m[2] * y + m[4]), f"y{n}": F.when(m.isNull(), y).otherwise(m[1] * x + m[3] * y + m[5])}
    return commands.withColumns(moved)


def _piece(t: Column, w: Column, points: list[tuple[Column, Column]]) -> Column:
    return F.struct(t.alias("t"), w.alias("w"), *[p[k].alias(f"{a}{i}") for i, p in enumerate(points) for k, a in enumerate("xy")])


def _corners(p: str = "p") -> list[tuple[Column, Column]]:
    return [(F.col(f"{p}.x{i}"), F.col(f"{p}.y{i}")) for i in range(4)]


def _apart(tolerance: float) -> Column:
    """Whether a control point is further than ``tolerance`` from the chord. The operations go in the order of the SQL, so that points at just that distance are judged alike."""
    a, b, c, d = _corners()
    dx, dy = d[0] - a[0], d[1] - a[1]

    def off(p: tuple[Column, Column]) -> Column:
        px, py = p[0] - a[0], p[1] - a[1]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
        x, y = px - t * dx, py - t * dy
        return F.sqrt(x * x + y * y)

    return F.greatest(off(b), off(c)) > tolerance


def chords(curves: DataFrame, tolerance: float, deepest: int = DEEPEST) -> DataFrame:
    """Cubics (columns x0 to y3, others are kept) as chords: rows with t (where the chord begins, as a part of the curve), its end x, y, and a code. A curve is halved until both
    control points of a piece are within ``tolerance`` of its chord. Each table takes in SPLITS halvings; pieces that are done leave it, only open ones go on. A
    piece still open after ``deepest`` halvings has the code ``depth``."""
    points = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    kept = [c for c in curves.columns if c not in {f"{a}{i}" for a in "xy" for i in range(4)}]
    tables = Rounds(curves.sparkSession, "chords")
    going = curves.select(*kept, _piece(F.lit(0.0), F.lit(1.0), points).alias("p"))
    done, depth = [], 0
    mid = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    while True:
        for _ in range(min(SPLITS, deepest - depth)):
            p0, p1, p2, p3 = _corners()
            rows = going.withColumn("open", _apart(tolerance))
            a, b, c = mid(p0, p1), mid(p1, p2), mid(p2, p3)
            rows = rows.withColumns({f"{n}{k}": v[k] for n, v in (("a", a), ("b", b), ("c", c)) for k in range(2)})
            a, b, c = [(F.col(f"{n}0"), F.col(f"{n}1")) for n in "abc"]
            d, e = mid(a, b), mid(b, c)
            m = mid(d, e)
            half = F.col("p.w") / 2
            both = F.array(_piece(F.col("p.t"), half, [p0, a, d, m]), _piece(F.col("p.t") + half, half, [m, e, c, p3]))
            going = rows.select(*kept, F.explode(F.when(F.col("open"), both).otherwise(F.array(F.col("p")))).alias("p"))
            depth += 1
        found = tables.write(going.withColumn("open", _apart(tolerance)))
        end = lambda code: [F.col("p.t").alias("t"), F.col("p.x3").alias("x"), F.col("p.y3").alias("y"), F.lit(code).cast("string").alias("code")]
        done.append(found.where("NOT open").select(*kept, *end(None)))
        going = found.where("open").select(*kept, "p")
        if depth >= deepest:
            return reduce(DataFrame.union, [*done, going.select(*kept, *end("depth"))])
        if going.isEmpty():
            return reduce(DataFrame.union, done)


def flatten(commands: DataFrame, tolerance: float, deepest: int = DEEPEST) -> DataFrame:
    """Commands without arcs as path_id, seq (renumbered from 1), op (M, L, Z), x, y and a code. A path with a curve that isn't within ``tolerance`` after ``deepest``
    halvings, or that had a code before, has one row with it and no points."""
    part = F.col("part") if "part" in commands.columns else F.lit(1)
    rows = commands.withColumn("part", part)
    curves = rows.where("op = 'C'").select("path_id", "seq", "part", "x0", "y0", "x1", "y1", "x2", "y2", F.col("x").alias("x3"), F.col("y").alias("y3"))
    lines = rows.where("op IS NULL OR op <> 'C'").select("path_id", "seq", "part", F.lit(0.0).alias("t"), "op", "x", "y", "code")
    flat = lines.unionByName(chords(curves, tolerance, deepest).withColumn("op", F.lit("L")))
    whole = Window.partitionBy("path_id")
    order = whole.orderBy("seq", "part", "t")
    flat = flat.withColumns({"at": F.row_number().over(order).cast("long"), "why": F.max("code").over(whole)})
    sound = lambda c: F.when(F.col("why").isNull(), F.col(c)).alias(c)
    return flat.where("why IS NULL OR at = 1").select("path_id", F.col("at").alias("seq"), sound("op"), sound("x"), sound("y"), F.col("why").alias("code"))
