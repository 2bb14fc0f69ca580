"""Chat formatting: the cheapest repair of each conversation's roles, then rendering.

Legal turns are an automaton: an optional system turn, then user and assistant in turns, the assistant last.
States are what was said last: nothing, system, user, assistant. A turn may
  * open a message in its own role (free) or in another (RELABEL),
  * be merged into the message before (MERGE, plus RELABEL if that has another role),
and before it an empty message of the missing role may be inserted (INSERT); at the end an assistant message may
be, too. Dynamic programming finds the cheapest repair; of equally cheap ones it takes the first in the
order of ``MOVES``.

A turn is a 4 x 4 matrix of costs in the (min, +) semiring, so a conversation of any length can be cut
anywhere: rows are range-partitioned and sorted by conversation and turn, each task reduces its part of a
conversation to one matrix, the few parts of each conversation fix the states at the cuts, and every task
then traces its part alone. A conversation that holds a third of all rows is spread over as many
tasks as any other third. Blocks of BLOCK rows are reduced and traced at a time; only the first and last run of
a block take part in the step over parts.

Order within a conversation is by turn (null first), then role, then text. Roles are read without case or
white space; ROLES lists the names known, any other or null role has none and costs RELABEL in each. A null
text counts as empty. Rows with a null conv_id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch

STATES = ("", "system", "user", "assistant")
ROLES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3}
MERGE, INSERT, RELABEL = 2, 3, 4
INF = 10**9
#: Rows of a block: what one task holds at once.
BLOCK = 4096
OPEN = "<|{}|>\n"
CLOSE = "\n<|end|>\n"


def _legal(a: int, b: int) -> bool:
    """May a message of role b follow state a?"""
    return b == 1 and a == 0 or b == 2 and a in (0, 1, 3) or b == 3 and a == 2


#: (from, to, role of the inserted message or 0, merged) of every move, the preferred first.
MOVES = sorted(
    [(a, b, 0, False) for a in range(4) for b in (1, 2, 3) if _legal(a, b)]
    + [(a, a, 0, True) for a in (1, 2, 3)]
    + [(a, b, i, False) for a in range(4) for i in (1, 2, 3) for b in (1, 2, 3) if _legal(a, i) and _legal(i, b)],
    key=lambda m: (m[3], m[2], m[0], m[1]),
)


def _cost(move: tuple, role: int) -> int:
    _, to, insert, merged = move
    return (0 if role == to else RELABEL) + (MERGE if merged else 0) + (INSERT if insert else 0)


def _step(role: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, move number) from each state to each state."""
    cost, which = np.full((4, 4), INF, np.int64), np.full((4, 4), -1)
    for i, move in enumerate(MOVES):
        c = _cost(move, role)
        if c < cost[move[0], move[1]]:
            cost[move[0], move[1]], which[move[0], move[1]] = c, i
    return cost, which


STEPS = [_step(r) for r in range(4)]
#: What it costs to end in a state: an assistant message is inserted after a user's; others need both or neither.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
ENDING = ("", "user assistant", "assistant", "")


def reduce_roles(roles: np.ndarray) -> np.ndarray:
    """The matrix of a run of turns, by halving: neighbours are multiplied pairwise."""
    m = np.stack([s[0] for s in STEPS])[roles]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([np.minimum((m[0 : len(m) - len(odd) : 2, :, :, None] + m[1::2, None, :, :]).min(2), INF), odd])
    return m[0]


def trace(roles: np.ndarray, start: int, end: int) -> list[int]:
    """The moves of the cheapest way from one state to another; forward costs, then back from the end."""
    forward = np.full((len(roles) + 1, 4), INF, np.int64)
    forward[0, start] = 0
    for i, r in enumerate(roles):
        forward[i + 1] = np.minimum((forward[i][:, None] + STEPS[r][0]).min(0), INF)
    moves = []
    for i in range(len(roles) - 1, -1, -1):
        cost, which = STEPS[roles[i]]
        before = int((forward[i] + cost[:, end]).argmin())
        moves.append(int(which[before, end]))
        end = before
    return moves[::-1]


def role_numbers(roles: pa.Array) -> np.ndarray:
    return np.array([ROLES.get(r.strip().lower(), 0) if r else 0 for r in roles.to_pylist()], np.int64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the partition and of the row in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n) // BLOCK), pa.array(np.arange(at, at + n) % BLOCK)], [*batch.schema.names, "part", "block", "at"])
        at += n


def _runs(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block in order, their conversations, the first row of each run, and the roles."""
    block = block.sort_by("at").combine_chunks()
    conv = block.column("conv_id").to_numpy()
    begin = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    return block, conv, begin, role_numbers(block.column("role"))


def _borders(block: pa.Table) -> pa.Table:
    """The matrices of the first and the last run of a block; only these can go on in another block."""
    block, conv, begin, roles = _runs(block)
    ends = np.append(begin[1:], len(conv))
    which = sorted({0, len(begin) - 1})
    rows = [(conv[begin[i]], block["part"][0].as_py(), block["block"][0].as_py(), begin[i], ends[i] - begin[i], reduce_roles(roles[begin[i] : ends[i]]).ravel().tolist()) for i in which]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["conv_id", "part", "block", "at", "n", "matrix"])


def _cuts(runs: pa.Table) -> pa.Table:
    """The states at both ends of each run of a conversation."""
    runs = runs.sort_by([("part", "ascending"), ("block", "ascending"), ("at", "ascending")])
    forward = [np.array([0, INF, INF, INF], np.int64)]
    matrices = [np.array(m, np.int64).reshape(4, 4) for m in runs.column("matrix").to_pylist()]
    for m in matrices:
        forward.append(np.minimum((forward[-1][:, None] + m).min(0), INF))
    states = [int((forward[-1] + END).argmin())]
    for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        states.append(int((f + m[:, states[-1]]).argmin()))
    states = states[::-1]
    n = np.array(runs.column("n").to_pylist(), np.int64)
    final = np.arange(len(n)) == len(n) - 1
    return pa.table([runs.column("conv_id"), runs.column("part"), runs.column("block"), runs.column("at"), *K.arrays(np.array(states[:-1]), np.array(states[1:]), np.cumsum(n) - n, final)], ["conv_id", "part", "block", "at", "enter", "leave", "before", "final"])


_OUT = "conv_id bigint, seq bigint, turn bigint, role string, action string, inserted string, segment string"


def _render(block: pa.Table, cuts: pa.Table) -> pa.Table:
    block, conv, begin, roles = _runs(block)
    known = {r["at"]: r for r in cuts.to_pylist()}
    texts = block.column("text").to_pylist()
    seq = np.zeros(len(conv), np.int64)
    role, action, inserted, segment = [], [], [], []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(conv)], strict=True):
        run = roles[a:b]
        cut = known.get(a)
        if cut is None:  # all of the conversation is here
            cut = {"enter": 0, "leave": int((reduce_roles(run)[0] + END).argmin()), "before": 0, "final": True}
        seq[a:b] = cut["before"] + np.arange(b - a)
        for j, number in enumerate(trace(run, cut["enter"], cut["leave"])):
            state, to, extra, merged = MOVES[number]
            text, more = texts[a + j] or "", []
            if merged:
                out = "\n" + text
            else:
                more = [STATES[extra]] if extra else []
                out = (CLOSE if state else "") + "".join(OPEN.format(x) + CLOSE for x in more) + OPEN.format(STATES[to]) + text
            if j == b - a - 1 and cut["final"]:
                last = ENDING[to].split()
                out += CLOSE + "".join(OPEN.format(x) + CLOSE for x in last)
                more = more + last
            role.append(STATES[to])
            action.append(("merge" if merged else "insert" if extra else "keep") + ("" if run[j] == to else "+relabel"))
            inserted.append(" ".join(more) or None)
            segment.append(out)
    return pa.table([block.column("conv_id"), pa.array(seq), block.column("turn"), pa.array(role, pa.string()), pa.array(action, pa.string()), pa.array(inserted, pa.string()), pa.array(segment, pa.string())], ["conv_id", "seq", "turn", "role", "action", "inserted", "segment"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq (its place), turn, the role it is rendered in, the action taken
    (keep, merge or insert, with +relabel), the roles of the empty messages inserted before it (and, at the
    last turn, after it), and its segment; the segments of a conversation in the order of seq are its rendering."""
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # equal rows are told apart only to deal them out; which comes first makes no difference
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_tie")
    numbered = scratch.table(dealt.mapInArrow(_number, "conv_id bigint, turn bigint, role string, text string, part int, block bigint, at bigint"), "numbered")
    borders = numbered.select("conv_id", "part", "block", "at", "role").groupBy("part", "block").applyInArrow(_borders, "conv_id bigint, part int, block bigint, at bigint, n bigint, matrix array<bigint>")
    cuts = scratch.table(borders.groupBy("conv_id").applyInArrow(_cuts, "conv_id bigint, part int, block bigint, at bigint, enter bigint, leave bigint, before bigint, final boolean"), "cuts")
    return numbered.groupBy("part", "block").cogroup(cuts.groupBy("part", "block")).applyInArrow(_render, _OUT)


def renderings(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole text of each conversation, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))
