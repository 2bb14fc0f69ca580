import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scenegrid.llm import language, quality_model, quality_rules, toxicity
from scenegrid.llm.tables import held_out, read
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table, words

SMALL = "/root/testdata/sf0.01"


def test_split_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(300).selectExpr("id AS doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)


def test_rules_equal_plain_counts(spark):
    r = rng(8)
    texts = awkward(r) + ["a b c d e " * 4, "l1 x\nl1 x\n \nl1 x", "# $ | word " * 9, "TOO LOUD " * 20] + [prose(r, 100) + "\n" + prose(r, 9)]
    df = table(spark, texts).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS _words")
    got = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        again = {p for j, x in enumerate(windows) if windows.count(x) > 1 for p in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert x.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert x.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (x.base_failed and x.kept)
    kept = {i for i, x in got.items() if x.kept}
    named = table(spark, texts).selectExpr("*", "1 AS _rejected_by", "2 AS _words")
    assert {(x.doc_id, x._rejected_by) for x in quality_rules.quality_filter(named).collect()} == {(i, 1) for i in kept}


def test_order_of_rules_never_changes_the_verdict(spark):
    df = read(spark, SMALL, "documents").limit(300)
    rules = quality_rules.standard_rules()
    plan = quality_rules.plan(df, rules)
    assert [r.rank for r in plan] == sorted((r.rank for r in plan), reverse=True)
    passed = [{x.doc_id for x in quality_rules.cascade(df, order).where("rejected_by IS NULL").collect()} for order in (plan, plan[::-1], rules)]
    assert passed[0] == passed[1] == passed[2]
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rules_are_ordered_by_what_they_cost_where_they_run(spark):
    """Equal rejections: the rule that reads a stored count comes before the same rule that counts for itself, every time."""
    docs = quality_rules.with_features(table(spark, [prose(rng(i), 900) for i in range(150)] + ["a b"] * 50))
    counted = quality_rules.Rule("z_stored", F.col("n_words") < 10)
    counting = quality_rules.Rule("a_counting", F.size(quality_rules.word_list(F.col("text"))) + quality_rules.repeated_words(quality_rules.word_list(F.col("text"))) < 10)
    never = quality_rules.Rule("never", F.col("n_words") < 0)
    for _ in range(3):
        order = quality_rules.plan(docs, [never, counting, counted])
        assert [r.name for r in order] == ["z_stored", "a_counting", "never"]
        assert [round(r.rejects, 2) for r in order] == [0.25, 0.25, 0]


def test_language_is_held_out_accurate(spark):
    docs = read(spark, SMALL, "documents")
    got = {x.doc_id: x for x in language.language(docs).collect()}
    own = [(got[x.doc_id], x.lang) for x in docs.collect()]
    held = [(x.lang_pred == lang) for x, lang in own if x.held_out]
    assert len(got) == docs.count() and np.mean(held) > 0.97
    assert all(0 <= x.score <= 1 for x, _ in own)


def plain_choice(model, text):
    """Backward elimination for one text by a plain loop, each set's proportions iterated to their end."""
    doc, ids, counts = language.grams(pa.array([text]))
    p, c = model.likelihood[ids], counts.astype(float)
    price = language.PENALTY * np.log(c.sum() + 1)

    def best(langs):
        pi = np.full(len(langs), 1 / len(langs))
        for _ in range(300):
            r = p[:, langs] * pi
            pi = (c[:, None] * r / r.sum(1, keepdims=True)).sum(0) / c.sum()
        return pi, float((c * np.log((p[:, langs] * pi).sum(1))).sum())

    langs = list(range(len(model.names)))
    pi, logs = best(langs)
    while len(langs) > 1:
        fewer = [x for k, x in enumerate(langs) if k != pi.argmin()]
        pi2, logs2 = best(fewer)
        if logs2 + price < logs:
            break
        langs, pi, logs = fewer, pi2, logs2
    return {model.names[x] for x in langs}, pi.max()


def test_language_sets_equal_a_plain_elimination(spark):
    docs = read(spark, SMALL, "documents")
    model = language.train(docs)
    by = {x.lang: x.text for x in docs.where("length(text) BETWEEN 1500 AND 4000").collect()}
    names = sorted(by)
    texts = [by[a][:n] + " " + by[b][:m] for a in names for b in names if a < b for n, m in ((900, 900), (1400, 60), (1000, 30), (300, 100), (60, 40))]
    texts += [x.text for x in docs.where("length(text) BETWEEN 20 AND 3000").limit(60).collect()]
    want = [plain_choice(model, t) for t in texts]
    pi = model.proportions(pa.array(texts))
    got = [{model.names[j] for j in np.flatnonzero(row > 0)} for row in pi]
    assert np.mean([g == w[0] for g, w in zip(got, want, strict=True)]) > 0.98
    assert np.mean([abs(row.max() - w[1]) < 0.02 for row, w in zip(pi, want, strict=True)]) > 0.98


def test_language_of_mixtures_and_nothing(spark):
    docs = read(spark, SMALL, "documents")
    model = language.train(docs)
    by = {x.lang: x.text for x in docs.where("length(text) BETWEEN 1500 AND 4000").collect()}
    mixed = by["de"][:1400] + " " + by["es"][:900]
    names, score, n = model.predict(pa.array([mixed, by["fr"], None, "", "123 %% 456", "é"]))
    assert names[0] == "de" and n[0] == 2 and 0.45 < score[0] < 0.8
    assert names[1] == "fr" and n[1] == 1
    assert names[2:5].tolist() == ["und"] * 3 and score[2:5].tolist() == [0, 0, 0]
    df = table(spark, awkward(rng(1))).selectExpr("*", "1 AS score", "2 AS lang_pred")
    assert language.predict(df, model).count() == len(awkward(rng(1)))
    nothing = language.train(spark.createDataFrame([], SCHEMA))
    assert {x.lang_pred for x in language.predict(table(spark, ["abc"]), nothing).collect()} == {"und"}
    assert language.language(spark.createDataFrame([], SCHEMA)).collect() == []


def meeting(n, seed):
    """Texts with two words, either or both or none; label 1 where both or none are there: each alone says nothing."""
    g, r = np.random.default_rng(seed), rng(seed)
    rows = []
    for i in range(n):
        a, b = g.random(2) < 0.5
        filler = r.choices([f"w{j}" for j in range(60)], k=12)
        rows.append((i, " ".join(filler[:6] + ["insult"] * int(a) + filler[6:] + ["group"] * int(b)), int(a == b)))
    return rows


def test_machine_learns_pairs_that_weights_miss(spark):
    """Through the operator as it is: no additive score separates these texts, and no term tells anything alone."""
    rows = meeting(2400, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).select("doc_id", "score", held_out().alias("held_out")).toPandas().sort_values("doc_id")
    y = np.array([x[2] for x in rows])
    held = got["held_out"].to_numpy()
    assert ((got["score"].to_numpy() > 0.5) == y)[held].mean() > 0.95
    linear = toxicity.Machine(model.slot, model.bias, model.weight, np.zeros_like(model.factor))
    plain = linear.score(pa.array([x[1] for x in rows]))
    assert ((plain > 0.5) == y)[held].mean() < 0.8


def test_pair_terms_are_those_whose_meeting_tells():
    g = np.random.default_rng(9)
    x = (g.random((4000, 40)) < 0.3).astype(np.uint8)
    chance = g.random(4000)
    additive = (chance < 0.05 + 0.2 * x[:, 0] + 0.2 * x[:, 1]).astype(float)
    assert toxicity.pair_terms(x, additive).tolist() == []
    meeting_ = (chance < 0.05 + 0.6 * (x[:, 5] & x[:, 9])).astype(float)
    assert toxicity.pair_terms(x, meeting_, pairs=1).tolist() == [5, 9]
    assert toxicity.pair_terms(x[:0], additive[:0]).tolist() == []


def test_margins_equal_the_sum_over_pairs():
    g = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(8), 0.3, g.normal(size=8), g.normal(size=(8, 3)))
    terms = [0, 3, 5, 6]
    want = 0.3 + sum(m.weight[i] for i in terms) + sum(m.factor[i] @ m.factor[j] for k, i in enumerate(terms) for j in terms[:k])
    assert np.isclose(m.margins(np.zeros(4, int), np.array(terms), 1)[0], want)


def test_toxicity_is_held_out_accurate(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = got["predicted"] == 1
    assert hit[got["toxic"] == 1].mean() > 0.87 and hit[got["toxic"] == 0].mean() < 0.02
    assert got["score"].between(0, 1).all()


def test_toxicity_of_odd_tables(spark):
    labels = "doc_id bigint, quality int, toxic int"
    odd = table(spark, awkward(rng(2))).selectExpr("*", "1 AS score", "2 AS label", "3 AS terms", "4 AS toxic")
    some = spark.createDataFrame([(1, 1, 0), (3, 1, None), (4, None, 1), (4, 1, 1), (4, 1, 1), (None, 1, 1), (99, 0, 1)], labels)
    for known in (some, spark.createDataFrame([], labels)):
        assert toxicity.toxicity(odd, known).where("score BETWEEN 0 AND 1").count() == odd.count()
        assert quality_model.quality(odd, known).where("tail_probability BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), some).collect() == []


def test_thresholds_are_in_order_and_grades_follow_the_line():
    g = np.random.default_rng(6)
    dense = np.zeros((900, quality_model.SHAPES + quality_model.EXTRA))
    dense[:, 0] = g.normal(size=900)
    y = np.digitize(dense[:, 0] + 0.1 * g.normal(size=900), [-0.7, 0.6])
    m = quality_model.fit(dense, np.zeros(0, np.int64), y, epochs=300)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(dense @ m.weight)
    assert (np.round(tails.sum(1)) == y).mean() > 0.9
    assert (np.diff(tails, axis=1) <= 0).all()


def test_grades_outside_the_scale_count_as_its_ends(spark):
    texts = ["fine words here"] * 30 + ["BAD !!! stuff"] * 30
    grades = spark.createDataFrame([(i, 7 if i < 30 else -2) for i in range(60)], "doc_id bigint, grade int")
    model = quality_model.train(table(spark, texts), grades)
    line = model.line(pa.array(["fine words here", "BAD !!! stuff"]))
    assert line[0] > line[1] and model.tails(line)[0, 1] > 0.5 > model.tails(line)[1, 0]
    rated = quality_model.graded(spark.createDataFrame([(1, 2, None), (2, 1, 1), (3, 0, 1), (4, None, 1)], "doc_id bigint, quality int, toxic int"))
    assert {x.doc_id: x.grade for x in rated.collect()} == {1: 2, 2: 1, 3: 0, 4: None}


def test_texts_of_one_id_are_learned_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (3, None), (4, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (1, 0)], "doc_id bigint, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", 10).collect()
    assert len(rows) == len({x.doc_id for x in rows}) and all(x.text == {1: "a", 3: "", 4: "x"}[x.doc_id] for x in rows)


def test_quality_is_held_out_accurate(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = quality_model.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got["selected"][got["quality"] == 1].mean() > 0.97 and got["selected"][got["quality"] == 0].mean() < 0.25
