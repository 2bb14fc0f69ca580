import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from scenegrid.llm import exact_dedup
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows with different ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i))
    out = []
    for t, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def test_equals_brute_force(spark):
    r = rng(3)
    long = prose(r, 3000)
    texts = awkward(r) + ["a b", "ab", "a\tb ", "ab\n", long, long.replace(" ", "  "), long[:-1] + "x", "y" + long[1:], long + long, "abc", "漢 字", "漢字", "a b", "A b"]
    found = exact_dedup.exact_duplicates(table(spark, texts), size=16)
    assert sorted(tuple(x) for x in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute(enumerate(texts))


def test_block_size_doesnt_change_the_result(spark):
    r = rng(4)
    base = [prose(r, n) for n in (1, 5, 40, 41, 200)]
    texts = base * 3 + [t + "k" for t in base] + ["".join(base)]
    docs = table(spark, texts)
    results = [sorted(map(tuple, exact_dedup.exact_duplicates(docs, size=s).collect())) for s in (1, 7, 4096)]
    assert results[0] == results[1] == results[2] == sorted(map(tuple, [(i, k, n, kept, d) for i, k, n, kept, d in brute(enumerate(texts))]))


def test_same_pieces_in_another_order_are_different(spark):
    texts = ["aaaabbbb", "bbbbaaaa", "aaaabbbbaaaa", "aaaaaaaabbbb", "aaaabbbbbbbb", "aaaabbbb" * 2, "aaaa", "aaaabbbb"]
    found = exact_dedup.exact_duplicates(table(spark, texts), size=4)
    assert {r.doc_id for r in found.where("group_size > 1").collect()} == {0, 7}


def test_one_hot_group_and_very_long_text(spark):
    big = prose(rng(5), 150_000)
    texts = ["hot passage of all"] * 300 + [big, big + " "]
    found = exact_dedup.exact_duplicates(table(spark, texts))
    assert sorted((r.group_size, r.n) for r in found.groupBy("group_size").agg(F.count_if("kept").alias("n")).collect()) == [(2, 1), (300, 1)]
    assert found.where("kept AND group_size = 2").first().doc_id == 301  # it has one code point more


def test_rows_with_the_same_or_no_id_stay_apart(spark):
    rows = [(1, "one two"), (1, "onetwo"), (1, "onetwo"), (1, "other"), (None, "other"), (None, None), (2, ""), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r.group_size for r in found) == [1, 2, 2, 2, 2, 3, 3, 3]
    assert sum(r.kept for r in found) == 4
    kept = exact_dedup.deduplicate(docs).collect()
    assert sorted(r.text or "" for r in kept) == ["", "alone", "one two", "other"]
    assert {r.doc_id for r in kept if (r.text or "") in ("", "other")} == {1, 2}  # a null id comes last


def test_clashing_columns_and_empty_tables(spark):
    docs = table(spark, ["a", "a ", "b"]).withColumns({c: F.lit(7) for c in ("uid", "name", "at", "n", "row", "level", "block", "keep_id", "a.b")})
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == [1, 2]
    assert exact_dedup.exact_duplicates(docs).count() == 3
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_no_python_worker(spark):
    plan = exact_dedup.exact_duplicates(table(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
