from pyspark.sql import functions as F

import corpus_pipeline
from scenegrid.llm import queries
from tests.llm.helpers import SCHEMA, awkward, bag, jaccard, prose, rng, table, words


def corpus(spark, path):
    """Planted cases among clean texts; ids by kind."""
    r = rng(12)
    insults = ["zonko", "blarg", "fump"]
    clean = [prose(r, r.randint(60, 200)) for _ in range(60)]
    toxic = [" ".join([prose(r, 40), r.choice(insults), prose(r, 20), r.choice(insults), prose(r, 30)]) for _ in range(60)]
    item, passage = prose(r, 40), prose(r, 70)
    base = prose(r, 150)
    near = [base, base, " ".join([*words(base)[:-1], "changed"])]
    leak = [" ".join([prose(r, 30), item, prose(r, 30)])]
    repeat = [" ".join([prose(r, 30 + i), passage, prose(r, 20 + i)]) for i in range(3)]
    texts, kinds = [], {}
    for kind, group in (("clean", clean), ("toxic", toxic), ("near", near), ("leak", leak), ("repeat", repeat)):
        kinds[kind] = range(len(texts), len(texts) + len(group))
        texts += group
    table(spark, texts).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in kinds["toxic"])) for i in [*kinds["clean"], *kinds["toxic"]]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return texts, kinds, passage


def test_each_stage_takes_what_is_planted_and_leaves_clean_texts(spark, tmp_path):
    texts, kinds, passage = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert set(docs.columns) == set(before.columns)
    ids = {name: {x.doc_id for x in rows} for name, rows in seen.items()}
    assert len(ids["toxicity"] & set(kinds["toxic"])) <= 6 and set(kinds["clean"]) <= ids["toxicity"]
    assert ids["near_duplicates"] & set(kinds["near"]) == {kinds["near"][0]}
    assert ids["toxicity"] - ids["near_duplicates"] == set(kinds["near"][1:])
    holding = [x.doc_id for x in seen["suffix_dedup"] if passage in x.text]
    assert holding == [kinds["repeat"][0]] and ids["suffix_dedup"] == ids["near_duplicates"]
    assert ids["suffix_dedup"] - ids["decontamination"] == set(kinds["leak"])
    assert ids["packing"] == ids["decontamination"]
    assert set(kinds["clean"]) <= ids["packing"]
    left, whole = corpus_pipeline.packed(spark, str(tmp_path))
    text = {x.doc_id: words(x.text) for x in left.collect()}
    assert text == {x.doc_id: words(x.text) for x in seen["decontamination"]}
    rebuilt = {}
    for x in whole.orderBy("doc_id", "piece").collect():
        piece = text[x.doc_id][x.start : x.start + x.n_words]
        assert len(piece) == x.n_words
        rebuilt.setdefault(x.doc_id, []).extend(piece)
    assert rebuilt == text
    assert {(x.doc_id, x.piece, x.n_words) for x in whole.collect()} == {(x.doc_id, x.piece, x.n_words) for x in seen["packing"]}


NAMES = "score label toxic terms node class_id bands removed spans start item_id similarity piece bin_id n_words _removed _cut _id _toxicity _item _gone id text_a x".split()


def test_stages_keep_odd_rows_and_columns_of_any_name(spark, tmp_path):
    """Null texts, ids, sources and languages, repeated rows and repeated ids; extra columns named as those used inside."""
    corpus(spark, str(tmp_path))
    r = rng(31)
    rows = table(spark, awkward(r), first=500).unionByName(table(spark, awkward(r)[-2:], first=500))
    rows = rows.union(spark.createDataFrame([(None, "no id " * 60, None, None, None), (None, None, None, None, None), (900, prose(r, 70), None, None, 5)], SCHEMA))
    docs = rows.selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(NAMES)))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/odd-{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{name}")
        if name != "packing":
            assert docs.columns == before.columns
            assert all(x[n] == i for x in docs.collect() for i, n in enumerate(NAMES))
            assert docs.where("doc_id IS NULL").count() == 2 and docs.where("doc_id = 900").count() == 1
    assert docs.where("doc_id IS NULL").count() == 2


def test_kept_texts_are_apart(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [bag(x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert not [1 for i, a in enumerate(kept) for b in kept[:i] if jaccard(a, b) >= 0.8]


def test_stages_on_an_empty_table(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered_queries_have_stable_schemas(spark):
    for name, query in queries.QUERIES.items():
        df = query(spark, "/root/testdata/sf0.001")
        assert df.schema and df.select(F.count("*")).first()[0] > 0, name
