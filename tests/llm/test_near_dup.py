import numpy as np
import pyarrow as pa
import pytest

from scenegrid.llm import near_dup, textkit
from scenegrid.llm.components import components
from scenegrid.llm.store import Scratch
from tests.llm.helpers import SCHEMA, awkward, bag, jaccard, prose, rng, table, words


def classes(texts):
    """Connected components of all pairs, by brute force."""
    bags = {i: bag(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    links = {i: set() for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in bags:
        for j in bags:
            if i < j and bags[i] and jaccard(bags[i], bags[j]) >= near_dup.THRESHOLD:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                if bags[i] != bags[j]:
                    links[i].add(j)
                    links[j].add(i)
    return {i: find(i) for i in texts}, links


def edited(r, text, share):
    return " ".join(prose(r, 1) if r.random() < share else w for w in words(text))


def test_signature_is_unbiased_for_weights():
    texts = [("a b c d e " * 30 + prose(rng(3), 60), "a b c d e " * 20 + prose(rng(3), 80)), (prose(rng(5), 90), prose(rng(5), 100)), ("w " * 500, "w " * 400)]
    left, right = (pa.array([t[i] for t in texts]) for i in range(2))
    sig = [near_dup.signatures(len(texts), *textkit.bags(*textkit.shingles(textkit.words(x))), m=8192) for x in (left, right)]
    exact = [jaccard(bag(a), bag(b)) for a, b in texts]
    assert np.allclose(near_dup.overlap(left, right)[0], exact)
    assert np.allclose((sig[0] == sig[1]).mean(1), exact, atol=0.02)


def test_classes_equal_brute_force(spark):
    r = rng(7)
    texts = awkward(r)
    for base in [prose(r, n) for n in (12, 40, 120, 300)]:
        texts += [base] + [edited(r, base, share) for share in (0.004, 0.008, 0.015, 0.03, 0.06)] * 2
    df = table(spark, texts).withColumnRenamed("n_chars", "class_id")
    got = {x.doc_id: x for x in near_dup.near_duplicates(df).collect()}
    want, _ = classes(dict(enumerate(texts)))
    assert {i: x.class_id for i, x in got.items()} == want


def test_large_bucket_keeps_links_that_pivots_miss(spark):
    """A family around a text in the middle: members link to it or to one another, not to the first or last id."""
    r = rng(11)
    base = prose(r, 100)
    far = " ".join(words(base)[:86] + words(prose(r, 14)))
    other = " ".join(words(prose(r, 14)) + words(base)[14:])
    middle = [edited(r, base, 0.01) for _ in range(12)]
    texts = [far, *middle, base, *[" ".join(words(far)[:-1] + [prose(r, 1)]) for _ in range(6)], other]
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == classes(dict(enumerate(texts)))[0]


@pytest.mark.parametrize("shared", [0, 18])
def test_large_family_of_many_classes(spark, shared):
    """Copies of one text, most of them too far from it and from one another; clusters of near ones hide among them, and a
    passage that many of them add is one very frequent shingle."""
    r = rng(13 + shared)
    base, passage = prose(r, 120), prose(r, shared)
    texts = [base]
    for k in range(110):
        one = edited(r, base, r.choice([0.03, 0.045, 0.06]))
        at = r.randrange(100)
        one = " ".join(words(one)[:at] + words(passage) + words(one)[at:])
        texts.append(one)
        if k % 4 == 0:
            texts += [edited(r, one, 0.012) for _ in range(3)]
    want, links = classes(dict(enumerate(texts)))
    assert 20 < len(set(want.values())) < len(texts) - 40
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == want


def test_family_without_its_source(spark, monkeypatch):
    """Copies of a text that isn't there itself: each pivot lacks what nearly all others hold, which must not make all of them pairs."""
    r = rng(23)
    base = words(prose(r, 150))
    texts = []
    for _ in range(240):
        one = list(base)
        for at in r.sample(range(len(one)), r.choice([1, 2, 3, 3, 4])):
            one[at] = prose(r, 1)
        texts.append(" ".join(one))
    met, verify = {}, near_dup.verify
    monkeypatch.setattr(near_dup, "verify", lambda pairs, texts, scratch, name: met.setdefault(name, verify(pairs, texts, scratch, name)))
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == classes(dict(enumerate(texts)))[0]
    assert met["second"].count() < 10 * len(texts)


def test_rows_of_one_id_are_kept_for_themselves(spark):
    r = rng(19)
    copied, alone = prose(r, 60), prose(r, 60)
    rows = [(1, copied), (2, copied), (2, alone), (3, alone + " end"), (4, None), (4, ""), (5, copied), (5, copied)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = sorted((x.doc_id, x.text or "") for x in near_dup.keep_one(df).collect())
    assert kept == sorted([(1, copied), (2, alone), (4, ""), (4, "")])


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicates(empty).collect() == []
    df = table(spark, [None, "", "a b c", "a b c"]).selectExpr("*", "1 AS sim", "2 AS node", "3 AS class_id", "4 AS bands")
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2]


@pytest.mark.parametrize("n", [2, 9, 40])
def test_components_of_chains(spark, n):
    order = list(range(n))
    rng(n).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (7000, 7000)], "a bigint, b bigint")
    got = {x.node: x.component for x in components(links, Scratch(spark, "test")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {100: 100, 101: 100}
