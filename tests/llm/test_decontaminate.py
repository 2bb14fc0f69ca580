from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scenegrid.llm import decontaminate as d
from scenegrid.llm import queries, textkit
from tests.llm.helpers import SCHEMA, awkward, bag, jaccard, prose, rng, table, words


def test_fingerprints_are_majorities():
    h = np.random.default_rng(1).integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    for step, size in ((1, 3), (1, 7), (4, 4), (4, 12), (4, 28), (4, 56)):
        got = d.Windows(h, step).fingerprints(size)
        for i, p in enumerate(got):
            bits = (h[i * step : i * step + size, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            want = sum(1 << b for b in range(64) if bits[:, b].sum() > size // 2)
            assert int(p) == want
        assert len(got) == max(0, len(h) // step - size // step + 1)


def test_blocks_find_all_within_the_radius():
    g = np.random.default_rng(2)
    own = g.integers(0, 2**63, 40, dtype=np.uint64)
    index = d.SizeIndex(4, 4, np.arange(40), np.zeros(40, int), own).build()
    flips = [own[i % 40] ^ np.uint64(sum(1 << int(b) for b in g.choice(64, k, replace=False))) for i, k in enumerate(list(range(12)) * 20)]
    prints = np.array(flips, np.uint64)
    at, other = index.hits(prints)
    distance = np.bitwise_count(prints[:, None] ^ own[None, :])
    assert set(zip(at.tolist(), other.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= d.RADIUS)), strict=True))


def test_every_size_has_a_window_in_step():
    for n in range(1, 400):
        size, step = d.window_size(n)
        assert size % step == 0 and n - size + 1 >= step and size >= min(n, n * 0.8 - 2 * d.STEP)


def test_planted_items_are_found_and_clean_texts_left(spark):
    r = rng(3)
    items = [prose(r, n) for n in (3, 5, 7, 8, 9, 12, 20, 31, 45, 64, 90)] + [None, "", " "]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts, want = awkward(r), set()
    for i, item in enumerate(items[:11]):
        for shift in range(5):
            want.add((len(texts), i))
            texts.append(" ".join([prose(r, 30 + shift), item, prose(r, 20)]))
        w = words(item)
        if len(w) > 40:  # one word changed at the end: still 0.8
            want.add((len(texts), i))
            texts.append(" ".join([prose(r, 11), *w[:-1], "changed", prose(r, 9)]))
    texts += [prose(r, 200) for _ in range(20)]
    df = table(spark, texts).selectExpr("*", "1 AS item_id", "2 AS similarity", "3 AS start")
    got = d.contaminated(df, bench).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    short = {(x.doc_id, x.item_id) for x in got if len(words(items[x.item_id])) < 5}
    assert want <= found and found - want <= short
    for x in got:
        n = len(words(items[x.item_id]))
        stretch = words(texts[x.doc_id])[x.start : x.start + n]
        assert abs(x.similarity - jaccard(bag(" ".join(stretch)), bag(items[x.item_id]))) < 1e-9
    clean = d.decontaminate(df, bench)
    assert clean.columns == df.columns or Counter(clean.columns) == Counter(df.columns)
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {a for a, _ in found}


def test_more_items_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEM_BLOCK", 4)
    r = rng(5)
    items = [prose(r, 20) for _ in range(11)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = d.contaminated(table(spark, [f"{prose(r, 9)} {x} {prose(r, 7)}" for x in items]), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i in range(11)}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert d.contaminated(docs, bench).collect() == []
    assert d.contaminated(table(spark, ["a b c d e f"]), bench).collect() == []
    w = textkit.words(pa.array(["", "a"]))
    assert all(len(x) == 0 for x in d.Items.of([], []).matches(w))


def by_sql(texts, items):
    """(doc_id, item_id) -> similarity as the SQL of op7 has it."""
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        frame = pa.table({key: pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())})
        con.register(name, frame)
    return {(a, b): s for a, b, s in con.sql(queries.ORACLE_SQL["op7_decontamination"]).fetchall()}


def by_items(texts, items):
    """The same by the windows."""
    best = {}
    for doc, item, _, sim in zip(*d.Items.of(list(range(len(items))), items).matches(textkit.words(pa.array(texts, pa.string()))), strict=True):
        best[int(doc), int(item)] = max(float(sim), best.get((int(doc), int(item)), 0.0))
    return best


@pytest.mark.parametrize("n", [16, 31, 40, 60, 100, 120, 200])
def test_texts_that_are_an_item_cut_short(n):
    r = rng(n)
    item = prose(r, n)
    w = words(item)
    texts = [" ".join(part) for k in range(int(0.78 * n), n + 1) for part in (w[:k], w[-k:], w[(n - k) // 2 :][:k])]
    want = by_sql(texts, [item])
    assert len(want) > 3 * (n - 0.85 * n) - 3
    assert by_items(texts, [item]) == pytest.approx(want)


def edited(n, seed=7):
    """Copies of an item of n words with words changed, added or left out in its middle, at one place or several."""
    r = rng(seed)
    vocabulary = words(prose(r, 4000))
    item = r.choices(vocabulary, k=n)
    texts = []
    for many in range(1, max(2, n // 9)):
        for _ in range(12):
            at, w = r.randrange(n // 3, max(n // 3 + 1, 2 * n // 3 - many)), list(item)
            w[at : at + many] = [f"new{i}" for i in range(many)]
            texts.append(w)
    for places in range(1, max(2, n // 36 + 1)):
        for kind in ("changed", "added", "left out"):
            for _ in range(12):
                w = list(item)
                for at in sorted(r.sample(range(4, n - 4), places), reverse=True):
                    w[at : at + (kind != "added")] = [] if kind == "left out" else ["new"]
                texts.append(w)
    return [" ".join([*r.choices(vocabulary, k=r.randrange(20)), *w, *r.choices(vocabulary, k=20)]) for w in texts], " ".join(item)


@pytest.mark.parametrize("n", [20, 45, 60, 100, 150, 200])
def test_copies_edited_in_the_middle(n):
    texts, item = edited(n)
    want = by_sql(texts, [item])
    assert by_items(texts, [item]) == pytest.approx(want)
    assert n < 45 or any(s < 0.85 for s in want.values())
