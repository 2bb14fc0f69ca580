from collections import defaultdict

import numpy as np
import pytest

from scenegrid.llm import suffix_dedup, textkit
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table, words


def brute(texts):
    seen = defaultdict(list)
    n = suffix_dedup.MIN_WORDS
    for i in sorted(texts):
        w = words(texts[i])
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].append((i, j))
    repeated, removed = defaultdict(set), defaultdict(set)
    for places in seen.values():
        for k, (i, j) in enumerate(places):
            if len(places) > 1:
                repeated[i].update(range(j, j + n))
            if k:
                removed[i].update(range(j, j + n))
    return repeated, removed


def covered(spans):
    return {p for s in spans for p in range(s["start"], s["end"])}


def corpus(r):
    texts = awkward(r)
    for length in (49, 50, 51, 60, 75, 140):
        passage = prose(r, length)
        for _ in range(4):
            texts.append(" ".join((prose(r, r.randint(0, 70)), passage, prose(r, r.randint(0, 70)))))
    # alternating contexts: the longer match is with another text than the neighbour in suffix order
    q, a, b, c, d = (prose(r, n) for n in (40, 12, 12, 12, 12))
    texts += [f"{a} {q} {c}", f"{b} {q} {c}", f"{a} {q} {d}"]
    return texts


def test_spans_equal_brute_force(spark):
    texts = corpus(rng(2))
    repeated, removed = brute(dict(enumerate(texts)))
    got = {x.doc_id: x for x in suffix_dedup.repeated_passages(table(spark, texts)).collect()}
    assert set(got) == set(repeated)
    for i, x in got.items():
        assert covered(x.repeated) == repeated[i]
        assert covered(x.removed) == removed.get(i, set())
        assert (x.n_repeated_words, x.n_removed_words) == (len(repeated[i]), len(removed.get(i, ())))


def test_texts_without_their_repeats(spark):
    texts = corpus(rng(4))
    _, removed = brute(dict(enumerate(texts)))
    df = table(spark, texts).selectExpr("*", "1 AS lo", "2 AS spans", "3 AS removed", "4 AS window", "CAST(NULL AS STRING) AS pos")
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    got = {x.doc_id: x for x in out.collect()}
    for i, t in enumerate(texts):
        left = [w for k, w in enumerate(words(t)) if k not in removed.get(i, ())]
        if i not in removed:
            assert got[i].text == t
        elif left:
            assert words(got[i].text) == left and got[i].n_chars == len(got[i].text)
        else:
            assert i not in got


@pytest.mark.parametrize("order", range(3))
def test_rows_that_repeat_an_id(spark, order):
    """A long and a short text of one doc_id, an equal row, and another document with the same passage."""
    r = rng(8)
    passage, long, tail = prose(r, 60), prose(r, 200), prose(r, 80)
    rows = [(1, f"{long} {passage}"), (1, "short text"), (1, f"{passage} {tail}"), (1, f"{passage} {tail}"), (2, f"{tail} {passage}"), (0, "a " * 20), (3, None)]
    rng(order).shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).coalesce(1)
    found = suffix_dedup.repeated_passages(df).collect()
    assert sorted((x.doc_id, x.n_repeated_words) for x in found) == [(1, 60), (1, 140), (2, 140)]
    assert sorted(x.n_removed_words for x in found if x.doc_id == 1) == [0, 60]
    assert [x.n_removed_words for x in found if x.doc_id == 2] == [140]
    left = sorted((x.doc_id, len(words(x.text))) for x in suffix_dedup.remove_repeats(df).collect())
    assert len(left) == 6 and (1, 2) in left and (0, 20) in left and (3, 0) in left
    texts = [x for x in left if x[0] == 1 and x[1] > 2]
    assert texts in ([(1, 80), (1, 80), (1, 260)], [(1, 140), (1, 140), (1, 200)])


def test_minimisers_cover_every_window():
    w = textkit.words(__import__("pyarrow").array([prose(rng(6), 400), "z " * 200, prose(rng(6), 49)]))
    p = suffix_dedup.minimisers(w, textkit.prefix(w.hash))
    for d in range(2):
        own = p[w.doc[p] == d] - w.first[d]
        for s in range(w.counts[d] - suffix_dedup.MIN_WORDS + 1):
            assert ((own >= s) & (own < s + suffix_dedup.REACH)).any()
    assert not (w.doc[p] == 2).any()
    assert len(np.unique(p)) == len(p)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.repeated_passages(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_neighbours_are_compared_across_batches_and_partitions():
    import pyarrow as pa

    r = rng(9)
    for _ in range(60):
        keys = sorted(r.choices(range(12), k=r.randint(1, 15)))
        cuts = sorted(r.choices(range(len(keys) + 1), k=3))
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[a:b], pa.int64()), "pos": pa.array(range(a, b), pa.int32())}) for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        got = [(x["key"], x["pos"], x["twin"], x["border"]) for b in suffix_dedup._neighbours(iter(batches)) for x in b.to_pylist()]
        assert [g[1] for g in got if g[2]] == [i for i, k in enumerate(keys) if keys.count(k) > 1]
        assert [g[1] for g in got if g[3]] == sorted({0, len(keys) - 1})
    assert list(suffix_dedup._neighbours(iter([]))) == []
