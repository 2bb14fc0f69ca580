import zlib
from collections import Counter

import numpy as np
import pytest

from scenegrid.llm import repair, tokens
from tests.llm.helpers import SCHEMA, awkward, prose, rng, table

HARD = ["Mixed CASE words, it's 3.14! don't--stop", "<|endoftext|> in <|startoftext|>Text", "<|ENDOFTEXT|>", "İstanbul K é é—, naïve…", "a.b,c;d!e?f:g", "'s 's'tis", "x\x0by\x0cz\xa0w v", "ΣΑΣ ς", "漢字。かな 123"]


def test_ids_equal_the_tokenizers_own():
    own = tokens.Encoder(tokens.vocabulary())
    texts = [t or "" for t in awkward(rng(1))] + HARD + [" ".join(HARD)]
    ids, lengths = own.encode(__import__("pyarrow").array(texts))
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]
    assert np.split(ids, np.cumsum(lengths)[:-1])[0].tolist() == want[0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    again, _ = own.encode(__import__("pyarrow").array(texts[::-1]))
    assert again.tolist() == [i for w in want[::-1] for i in w]


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    own = tokens.Encoder(tokens.vocabulary())
    for seed in range(3):
        text = prose(rng(seed), 200)
        ids, _ = own.encode(__import__("pyarrow").array([text]))
        assert ids.tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END]


@pytest.mark.parametrize("vocabulary", [2, 5, 300, 70_000])
def test_grammar_round_trip_and_random_access(vocabulary):
    g = np.random.default_rng(vocabulary)
    lengths = np.array([0, 1, 2, 700, 0, 3, 5000])
    ids = (g.zipf(1.3, lengths.sum()) % vocabulary).astype(np.int32)
    data = repair.encode(np.arange(7) - 3, ids, lengths, vocabulary, least=2)
    block = repair.Block.read(data)
    ends = np.cumsum(lengths)
    assert block.doc_ids.tolist() == [-3, -2, -1, 0, 1, 2, 3] and block.lengths().tolist() == lengths.tolist()
    for i in range(7):
        doc = ids[ends[i] - lengths[i] : ends[i]]
        assert np.array_equal(block.document(i), doc)
        for a, b in ((0, 0), (0, 1), (1, 2), (3, 90), (17, 18), (400, 700)):
            if b <= len(doc):
                assert np.array_equal(block.stretch(i, a, b), doc[a:b])
    if vocabulary < 10:
        assert len(block.symbols) < len(ids) / 2


def test_runs_of_one_id():
    for n in range(2, 40):
        ids = np.zeros(n, np.int32)
        assert np.array_equal(repair.Block.read(repair.encode(np.array([1]), ids, np.array([n]), 1, least=1)).document(0), ids)


def test_grammar_goes_on_until_no_pair_comes_often():
    g = np.random.default_rng(3)
    run = g.integers(0, 900, 5000)
    cases = [(np.tile(run, 30), [len(run) * 30]), (g.zipf(1.2, 40_000) % 900, [15_000, 25_000]), (np.zeros(5000, np.int64), [2500, 2500])]
    for ids, lengths in cases:
        symbols, counts, rules = repair.compress(ids, np.array(lengths), 900)
        ends = set(np.cumsum(counts).tolist())
        pairs = Counter((int(a), int(b)) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if i + 1 not in ends)
        if len(set(ids.tolist())) > 1:
            assert not pairs or max(pairs.values()) < repair.LEAST
        assert len(rules) and len(symbols) < len(ids)
        block = repair.Block.read(repair.encode(np.arange(len(lengths)), ids, np.array(lengths), 900))
        assert np.array_equal(block.expand(block.symbols), ids)


def test_numbers_of_seven_bits():
    for n in ([], [0], [127, 128, 0, 16383, 16384, 2**21, 2**28, 2**35 - 1, 5]):
        data = repair.pack(np.array(n, np.int64))
        back, read = repair.unpack(np.concatenate([data, np.array([200, 1], np.uint8)]), len(n))
        assert back.tolist() == n and read == len(data)


def test_other_tokenizers_get_whole_texts():
    path = tokens.vocabulary("byte_bpe_50k.json")
    assert tokens.by_pieces(tokens.vocabulary()) and not tokens.by_pieces(path)
    own = tokens.Encoder(path)
    texts = [t or "" for t in awkward(rng(1))[:6]] + HARD
    ids, lengths = own.encode(__import__("pyarrow").array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]


def test_files_give_back_all_ids(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 3000)
    texts = awkward(rng(3)) + HARD + [prose(rng(i), 300) for i in range(40)]
    df = table(spark, texts, first=10).selectExpr("*", "1 AS shard", "2 AS block", "3 AS start", "4 AS payload").union(table(spark, ["no id"]).selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "source", "n_chars", "1", "2", "3", "4"))
    path = f"{tokens.Scratch(spark, 'test').root}/ids"
    tokens.write(df.repartition(5), path, shard_bytes=20_000)
    assert spark.read.parquet(path).count() > 4
    got = sorted(tokens.read_back(spark, path).collect(), key=lambda x: x.doc_id)
    own, at = tokens.Encoder(tokens.vocabulary()), 0
    assert [x.doc_id for x in got] == list(range(10, 10 + len(texts)))
    for x, t in zip(got, texts, strict=True):
        ids = np.array([*own.tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    assert tokens.encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
