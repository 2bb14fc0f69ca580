import math
import re
from collections import Counter

from pyspark.sql import functions as F

from scenegrid.llm import lexical
from scenegrid.llm.store import Scratch
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score); docs and items are lists of (id, text), ids of items may repeat."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc, b, n in bags:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if b[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(docs, items, **more):
    out = lexical.search(docs, items, **more)
    assert dict(out.dtypes)["rank"] == "int" and dict(out.dtypes)["score"] == "bigint"
    return sorted(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_equals_brute_force(spark):
    r = rng(7)
    texts = awkward(r) + [prose(r, r.randint(1, 120)) for _ in range(150)] + ["Ka LO-mi_ru 12é3", "ÀÉ àé", "x\x7fy{z}~w[v]`u@t/s:r", "İstanbul ıi K"]
    items = [(i, prose(r, n)) for i, n in enumerate((1, 3, 30, 200))] + [(9, None), (10, "nowhere-word"), (11, "ka LO mi ru ÀÉ x y z w v u t s r"), (12, ""), (13, "K istanbul ıi 12é3")]
    assert found(table(spark, texts), items_of(spark, items)) == brute(list(enumerate(texts)), items)


def test_ties_go_by_id_and_null_comes_last(spark):
    rows = [(5, "same words here"), (3, "same words here"), (None, "same words here"), (4, "here same words"), (9, "nothing else")] + [(20 + i, "filler text") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert [d for _, _, d, _ in found(docs, items_of(spark, [(1, "words same")]))] == [3, 4, 5, None]
    assert [d for _, _, d, _ in found(docs, items_of(spark, [(1, "words same")]), k=2)] == [3, 4]


def test_repeated_rows_and_ids(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma delta"), (2, "gamma beta"), (3, "omega"), (4, "omega psi"), (None, "alpha")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    items = [(1, "alpha"), (1, "beta"), (None, "gamma"), (2, "omega omega")]
    assert found(docs, items_of(spark, items)) == brute(rows, items)


def test_all_ways_to_join_and_a_hot_term(spark, monkeypatch):
    r = rng(8)
    texts = ["the the " + prose(r, 20) for _ in range(200)] + [prose(r, 20) for _ in range(300)]
    items = [(i, "the " + prose(r, 10)) for i in range(20)]
    want = brute(list(enumerate(texts)), items)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lexical, "FILTER_BITS", 3)
    monkeypatch.setattr(lexical, "TASK_MATCHES", 500)
    assert found(table(spark, texts), items_of(spark, items)) == want


def test_a_whole_index_answers_other_items(spark):
    r = rng(9)
    texts = [prose(r, 30) for _ in range(60)]
    scratch = Scratch(spark, "test")
    whole = lexical.index(table(spark, texts), scratch)
    for n, seed in enumerate((1, 2)):
        items = [(i, prose(rng(seed), 15)) for i in range(3)]
        got = lexical.rank(whole, lexical.wanted_terms(items_of(spark, items), Scratch(spark, f"t{n}")), Scratch(spark, f"r{n}"), k=5)
        assert sorted(map(tuple, got.collect()), key=str) == brute(list(enumerate(texts)), items, k=5)


def test_very_long_text_empty_tables_and_other_columns(spark):
    big = prose(rng(10), 200_000)
    texts = [big, "short one", None]
    docs = table(spark, texts).withColumns({c: F.lit(1) for c in ("term", "bucket", "uid", "key", "n", "tf")})
    items = items_of(spark, [(1, "short " + big[:200])])
    assert found(docs, items.withColumn("term", F.lit("x"))) == brute(list(enumerate(texts)), [(1, "short " + big[:200])])
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []
