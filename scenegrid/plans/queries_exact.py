"""Queries over exact matrices, and over JSON records that are compared with their types."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenegrid.operators import exact, records
from scenegrid.operators.tables import tasks
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.registry import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LINES = [
    "l_orderkey AS path_id",
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS seq",
    "l_linenumber % 2 = 0 AS moved",
    "CAST(l_quantity AS BIGINT) AS q",
    "CAST(round(l_discount * 100) AS BIGINT) AS d",
    "CAST(round(l_tax * 100) AS BIGINT) AS t",
]


def _decimal(v: str) -> str:
    """SQL of a whole number over a power of ten as the shortest decimal text."""
    digits = f"lpad(abs({v})::VARCHAR, greatest(2 * seq + 1, length(abs({v})::VARCHAR))::INT, '0')"
    return f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || rtrim(rtrim({digits}[:-2 * seq - 1] || '.' || right({digits}, 2 * seq::INT), '0'), '.')"


@query(
    f"""WITH RECURSIVE l AS (SELECT {", ".join(_LINES)} FROM lineitem),
k AS (SELECT path_id, seq, (100 + d)::HUGEINT AS a, t AS b, -t AS c, 100 AS d, 100 * q + CASE WHEN moved THEN (100 + d) * q - t ELSE 0 END AS e, -50 * q + CASE WHEN moved THEN t * q + 100 ELSE 0 END AS f FROM l),
r AS (SELECT path_id, seq, a::HUGEINT AS a, b::HUGEINT AS b, c::HUGEINT AS c, d::HUGEINT AS d, e::HUGEINT AS e, f::HUGEINT AS f FROM k WHERE seq = 1
UNION ALL SELECT r.path_id, k.seq, r.a * k.a + r.c * k.b, r.b * k.a + r.d * k.b, r.a * k.c + r.c * k.d, r.b * k.c + r.d * k.d, r.a * k.e + r.c * k.f + r.e * 100, r.b * k.e + r.d * k.f + r.f * 100 FROM r JOIN k ON k.path_id = r.path_id AND k.seq = r.seq + 1)
SELECT path_id, NULL::VARCHAR AS code, {", ".join(f"{_decimal(v)} AS {v}" for v in "abcdef")} FROM r WHERE (path_id, seq) IN (SELECT path_id, max(seq) FROM l GROUP BY path_id)"""
)
def exact_chains(spark, sf_dir):
    """The matrices of each order's lines, some with a translation, as one exact product."""
    lines = _table(spark, sf_dir, "lineitem")
    lines = lines.repartition(tasks(lines), "l_orderkey").selectExpr(*_LINES)
    text = F.expr("concat('matrix(1.', lpad(d, 2, '0'), ' .0', t, ',-.0', t, ' 1 ', q, ' -', q div 2, if(q % 2 = 1, '.5)', '.0)'))")
    step = F.struct("seq", F.struct(text.alias("matrix"), F.expr("if(moved, cast(q AS string), NULL)").alias("dx"), F.expr("if(moved, '10e-1', NULL)").alias("dy")).alias("step"))
    paths = lines.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: s["step"]).alias("steps"))
    found = paths.select("path_id", exact.exact_chain(F.col("steps")).alias("chain"))
    return found.select("path_id", "chain.code", *[exact.exact_text(F.col("chain.m")[i], F.col("chain.s")).alias(n) for i, n in enumerate("abcdef")])


@query(
    """SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 2, 6) THEN true WHEN doc_id % 8 = 3 THEN coalesce(n_chars = doc_id, false) ELSE false END AS equal, CASE WHEN doc_id % 8 IN (5, 7) THEN 'unread' END AS code FROM documents"""
)
def typed_equality(spark, sf_dir):
    """Each document as a JSON record against one that was written otherwise: order of keys, blanks, escapes and exponents don't count; kinds of numbers, texts for numbers, the order
    of a list do; a repeated key or a second value isn't a record."""
    d = _table(spark, sf_dir, "documents").withColumn("k", F.pmod("doc_id", F.lit(8)))
    left = F.to_json(F.struct(F.col("doc_id").alias("id"), "text", F.struct("lang", "source").alias("meta"), F.array(F.col("n_chars").cast("long"), "doc_id").alias("list"), (F.col("doc_id") * 0.5).cast("double").alias("half")))
    inside = lambda *names: F.substring(F.to_json(F.struct(*names)), F.lit(2), F.length(F.to_json(F.struct(*names))) - 2)
    number = F.col("doc_id").cast("string")
    n = F.coalesce(F.col("n_chars").cast("string"), F.lit("null"))
    half = F.when(F.col("k") == 6, F.concat((F.col("doc_id") * 5).cast("string"), F.lit("e-1"))).otherwise((F.col("doc_id") * 0.5).cast("double").cast("string"))
    of = lambda *pair: F.concat(F.lit(' "list": [ '), pair[0], F.lit(" ,"), pair[1], F.lit("]"))
    value = F.when(F.col("k") == 1, F.concat(number, F.lit(".0"))).when(F.col("k") == 4, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    key = F.when(F.col("k") == 2, '"\\u0069d"').otherwise('"id"')
    parts = [
        F.when(F.col("k") == 3, of(number, n)).otherwise(of(n, number)),
        F.concat(F.lit('"meta" :{'), F.array_join(F.array_compact(F.array(F.nullif(inside("source"), F.lit("")), F.nullif(inside("lang"), F.lit("")))), ", "), F.lit("}")),
        F.nullif(inside("text"), F.lit("")),
        F.concat(F.lit('"half":'), half),
        F.when(F.col("k") == 5, F.concat(F.lit('"id":'), number)),
        F.concat(key, F.lit("\n:"), value),
    ]
    right = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("} "), F.when(F.col("k") == 7, "1").otherwise(""))
    return d.select("doc_id", records.same_json(left, right).alias("s")).select("doc_id", "s.equal", "s.code")


@query(
    cte("boxes")
    + """, a AS (SELECT scene_id, count(*) AS n FROM boxes WHERE scene_id % 5 <> 3 GROUP BY scene_id), b AS (SELECT scene_id, count(*) AS n FROM boxes WHERE scene_id % 7 <> 2 AND NOT (scene_id % 3 = 1 AND ordinal = 0) GROUP BY scene_id)
SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n = b.n THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.scene_id = b.scene_id"""
)
def receipt_replay(spark, sf_dir):
    """Receipts of scenes against the ones computed again: some scenes lost their first box, some receipts or scenes are gone."""
    b = fixture(spark, sf_dir, "boxes")
    sums = lambda df: df.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    kept = sums(b.where("scene_id % 5 <> 3")).select("scene_id", F.to_json(F.struct("n", "width", "kinds")).alias("receipt"))
    again = sums(b.where("scene_id % 7 <> 2 AND NOT (scene_id % 3 = 1 AND ordinal = 0)")).select("scene_id", F.to_json(F.struct("kinds", "n", "width")).alias("receipt"))
    return records.replayed(kept, again, "scene_id", "receipt")
