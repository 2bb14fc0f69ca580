from pyspark.sql import functions as F

from scenegrid.operators import records


def test_ids_and_roles(spark):
    ids = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 1), ("b", None)], "deck string, id int")
    assert {(r.deck, r.id, r.code) for r in records.id_codes(ids, "deck", "id").collect()} == {("a", 1, "repeated"), ("a", 0, "not_positive"), ("b", None, "not_positive")}
    assert records.id_codes(ids.limit(0), "deck", "id").collect() == []
    seen = spark.createDataFrame([(1, "user"), (1, "assistant"), (2, "user"), (3, None)], "review int, role string")
    got = {r.review: (sorted(r.missing), r.status) for r in records.missing_roles(seen, "review", "role", ["user", "assistant"], ["user", "assistant", "system"]).collect()}
    assert got == {1: (["system"], "no_observed_issue"), 2: (["assistant", "system"], "needs_further_review"), 3: (["assistant", "system", "user"], "needs_further_review")}


def test_types_and_lists(spark):
    wanted = spark.createDataFrame([("png", "a"), ("png", "a"), ("svg", "b"), ("xml", "c"), ("xml", "d"), ("emf", "e")], "ext string, type string")
    known = spark.createDataFrame([("png", "a"), ("svg", "x")], "ext string, known string")
    assert {(r.ext, r.code) for r in records.register_types(wanted, known).collect()} == {("png", "known"), ("svg", "conflict"), ("xml", "conflict"), ("emf", "registered")}
    asked = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    allowed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(r.listed for r in records.listed(asked, allowed, ["k", "v"]).collect()) == [False, False, True]


def test_first_code_and_runs(spark):
    row = spark.createDataFrame([(1, None), (5, 1), (9, 3)], "a int, b int")
    code = records.first_code((F.col("b") > 2, "b"), (F.col("a") > 4, "a"))
    assert [r[0] for r in row.select(code).collect()] == ["ok", "a", "b"]
    runs = records.next_runs(row, "a", F.col("b")).collect()
    assert {(r.a, r.run, r.name) for r in runs} == {(1, 1, "run-0001"), (5, 2, "run-0002"), (9, 4, "run-0004")}
