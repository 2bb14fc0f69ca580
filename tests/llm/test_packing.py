from collections import defaultdict

import pytest

from scenegrid.llm import packing
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table, words


def plain(sizes, sources, clusters, capacity):
    """Tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_full_search(seed):
    r = rng(seed)
    n = 400
    sizes = sorted((r.randint(0, 100) for _ in range(n)), reverse=True)
    sources = [r.choice([None, "hot", "hot", "a", "b", "c"]) for _ in range(n)]
    clusters = [r.choice([None, None, 1, 2, 3]) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, 100) == plain(sizes, sources, clusters, 100)


def test_bins_hold_everything_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 20)
    r = rng(9)
    texts = awkward(r) + [prose(r, r.randint(1, 700)) for _ in range(80)]
    df = table(spark, texts, source=lambda i: None if i % 7 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}")
    df = df.selectExpr("*", "1 AS piece", "2 AS cluster", "3 AS shard", "4 AS bin_id")
    out = packing.best_fit_pack(df, capacity=256).collect()
    source = {x.doc_id: x.source for x in df.collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for x in out:
        pieces[x.doc_id].append((x.start, x.n_words))
        bins[x.bin_id].append(x)
    for i, t in enumerate(texts):
        n, at = len(words(t)), 0
        for start, size in sorted(pieces[i]):
            assert start == at and size <= 256
            at += size
        assert at == n
    for rows in bins.values():
        assert sum(x.n_words for x in rows) == rows[0].bin_words <= 256
        assert sorted(x.slot for x in rows) == list(range(len(rows)))
        named = [source[x.doc_id] for x in rows if source[x.doc_id] is not None]
        assert len(named) == len(set(named))
        same = [" ".join(words(texts[x.doc_id])).lower() for x in rows]
        assert len(same) == len(set(same))


def test_equal_rows_are_dealt_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    df = spark.createDataFrame([(1, "a b c", "en", "hot", 5)] * 1000 + [(2, None, "en", None, 0)] * 3, SCHEMA)
    out = packing.best_fit_pack(df).collect()
    assert len(out) == 1003
    shards = [x.bin_id // packing.BINS for x in out if x.doc_id == 1]
    assert max(shards.count(s) for s in set(shards)) < 120
    assert len({x.bin_id for x in out if x.doc_id == 1}) == 1000  # one source: each in a bin of its own


def test_empty_table(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], SCHEMA)).collect() == []
