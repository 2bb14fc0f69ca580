from functools import cache

import numpy as np
import pytest

from scenegrid.llm import chat
from tests.llm.helpers import rng

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def cheapest(roles):
    """The least cost, by trying everything, without the operator's tables."""

    @cache
    def best(i, last):
        if i == len(roles):
            return {"assistant": 0, "user": chat.INSERT, "system": 2 * chat.INSERT, "": 0}[last]
        found = []
        for role in ("system", "user", "assistant"):
            price = 0 if role == roles[i] else chat.RELABEL
            if (last, role) in LEGAL:
                found.append(price + best(i + 1, role))
            if last == role:
                found.append(price + chat.MERGE + best(i + 1, role))
            for between in ("system", "user", "assistant"):
                if (last, between) in LEGAL and (between, role) in LEGAL:
                    found.append(price + chat.INSERT + best(i + 1, role))
        return min(found)

    return best(0, "")


def price(rows):
    total = 0
    for x in rows:
        total += chat.RELABEL * ("relabel" in x.action) + chat.MERGE * x.action.startswith("merge")
        total += chat.INSERT * len((x.inserted or "").split())
    return total


def spoken(text):
    """The roles of a rendering."""
    return [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end|>")]


def check(rows, turns):
    """rows: the output of one conversation; turns: its (role, text) in order."""
    rows = sorted(rows, key=lambda x: x.seq)
    assert [x.seq for x in rows] == list(range(len(turns)))
    text = "".join(x.segment for x in rows)
    said = ["", *spoken(text)]
    assert all(pair in LEGAL for pair in zip(said, said[1:], strict=False)) and said[-1] == "assistant"
    names = {0: None, 1: "system", 2: "user", 3: "assistant"}
    roles = [names[chat.ROLES.get((r or "").strip().lower(), 0)] for r, _ in turns]
    assert price(rows) == cheapest(tuple(roles))
    assert all((t or "") in x.segment for (_, t), x in zip(turns, rows, strict=True))
    assert text.count("<|end|>") == len(said) - 1


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repairs_are_cheapest_however_conversations_are_cut(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    r = rng(block)
    rows, by = [], {}
    for conv in range(40):
        turns = [(r.choice(["system", "user", "assistant", "User ", "bot", "tool", None]), r.choice([f"t{i}", "", None])) for i in range(r.randint(1, 12))]
        by[conv] = turns
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    by[99] = [("user", f"hot {i}") for i in range(500)]
    rows += [(99, i, role, text) for i, (role, text) in enumerate(by[99])]
    rows.append((None, 0, "user", "no conversation"))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS at", "3 AS block", "4 AS seq").repartition(3)
    got = {}
    for x in chat.format_chats(df).collect():
        got.setdefault(x.conv_id, []).append(x)
    assert set(got) == set(by)
    for conv, turns in by.items():
        check(got[conv], turns)


def test_ties_repeats_and_empty(spark):
    rows = [(1, 5, "user", "a"), (1, 5, "user", "a"), (1, None, "assistant", "b"), (2, 0, "system", "only")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = sorted((x.conv_id, x.seq, x.turn) for x in out.collect())
    assert got == [(1, 0, None), (1, 1, 5), (1, 2, 5), (2, 0, 0)]
    texts = {x.conv_id: x.text for x in chat.renderings(out).collect()}
    assert spoken(texts[2]) == ["system", "user", "assistant"]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_reduction_is_associative():
    roles = np.array([2, 2, 3, 0, 1, 3, 3, 2, 1])
    whole = chat.reduce_roles(roles)
    for cut in range(1, len(roles)):
        a, b = chat.reduce_roles(roles[:cut]), chat.reduce_roles(roles[cut:])
        assert np.array_equal(whole, np.minimum((a[:, :, None] + b[None]).min(1), chat.INF))
