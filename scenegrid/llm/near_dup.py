"""Near duplicates by BagMinHash: weighted Jaccard over multisets of five-word shingles.

Signature. Each shingle's multiplicity w is cut into dyadic levels (0,1], (1,2], (2,4], ... and each level
holds a Poisson process over time whose rate is its width times the number of components. A point has a
time, a component and a height in the level, all drawn from the hash of shingle and level; it counts
if it is below w. A component keeps its earliest point. Two multisets agree in a component with
probability sum(min w) / sum(max w), without bias. Processes stop at a time by which every component is
filled with high probability, so a text costs its shingles plus about m log m points; the few texts
with an empty component go on.

Candidates. BANDS bands of ROWS components each; texts whose band agrees meet in a bucket. Texts with
equal multisets are one node beforehand, so copies cost nothing more.

Pairs. A bucket of up to SMALL nodes takes all its pairs; a larger one compares each node with its pivot,
a node that meets the most others over all buckets: in a family of near copies, one close to
their source. Let D(u) be what a node u has beyond its pivot p and, as other tokens, what it lacks of p. Then
|u & v| = |u & p| + |v & p| - |p| + |D(u) & D(v)|, so a link needs a known number of tokens that both differences hold. Where that
is none, both are linked to p. Else the rarest token that both hold has, in each difference, as many from it on to the most frequent
one as are needed: pairs of different classes are met by such tokens only, and compared too; tokens that the same nodes hold
are one. The bounds are exact: no link between texts that share a bucket is lost up to connection. A bucket costs its nodes
and the pairs that the bounds leave open: those whose differences are nearly as alike as a link needs.

Verification. The multisets of both texts are compared exactly; a link needs THRESHOLD or more. Classes
are the connected components of the links; the class id is the smallest doc_id.

A text of 1 to 4 words has one shingle, all of it. Null texts and texts without a word are alike to
nothing and are classes of their own. Rows whose doc_id is null are left out; rows that repeat a doc_id
take part as texts of that id, each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.components import components
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import fresh

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
SMALL = 8

_LEVEL, _TIME, _PLACE, _HEIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _times(k: int, salt: np.uint64) -> np.uint64:
    return np.uint64(k * int(salt) % 2**64)


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def levels(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The dyadic levels of each weight: (row, seed, lower end, width)."""
    rows, seeds, lows, widths = [np.arange(len(h))], [K.mix(h)], [np.zeros(len(h), np.int64)], [np.ones(len(h), np.int64)]
    low = 1
    while True:
        more = np.flatnonzero(w > low)
        if not len(more):
            break
        rows.append(more)
        seeds.append(K.mix(h[more] + _times(low, _LEVEL)))
        lows.append(np.full(len(more), low))
        widths.append(np.full(len(more), low))
        low *= 2
    return np.concatenate(rows), np.concatenate(seeds), np.concatenate(lows), np.concatenate(widths)


def signatures(n: int, doc: np.ndarray, h: np.ndarray, w: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m earliest times (infinite for texts without a shingle). doc, h, w: as from ``textkit.bags``."""
    out = np.full(n * m, np.inf)
    total = np.bincount(doc, w, n)
    row, seed, low, width = levels(doc, h, w)
    d, top = doc[row], w[row]
    limit = np.full(n, np.inf)
    some = total > 0
    limit[some] = (np.log(m) + 3) / total[some]
    open_ = np.ones(len(row), bool)
    while open_.any():
        at = np.flatnonzero(open_)
        t = np.zeros(len(at))
        k = 0
        while len(at):
            k += 1
            step = seed[at] + _times(k, _TIME)
            t = t - np.log(_unit(K.mix(step))) / (width[at] * float(m))
            live = t < limit[d[at]]
            at, t, step = at[live], t[live], step[live]
            if not len(at):
                break
            height = low[at] + (_unit(K.mix(step ^ _HEIGHT)) * width[at]).astype(np.int64)
            counts = np.flatnonzero(height < top[at])
            part = (K.mix(step[counts] ^ _PLACE) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            np.minimum.at(out, d[at[counts]] * m + part.astype(np.int64), t[counts])
        short = some & np.isinf(out.reshape(n, m)).any(1)
        limit[short] *= 2
        open_ = short[d]
    return out.reshape(n, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return K.mix(key + np.arange(BANDS, dtype=np.uint64))


_SIGNED = "doc_id bigint, text_key bigint, c1 bigint, c2 bigint, n int, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch):
            n = part.num_rows
            doc, h, w = K.bags(*K.shingles(K.words(part.column("text")), SHINGLE))
            keys = bands(signatures(n, doc, h, w))
            content = np.zeros((2, n), np.uint64)
            for row, salt in zip(content, (1, 2), strict=True):
                np.add.at(row, doc, K.mix(h + K.mix(w.astype(np.uint64) + np.uint64(salt << 40))))
            total = np.bincount(doc, w, n).astype(np.int32)
            lists = K.lists(K.signed(keys.ravel()), np.full(n, BANDS), pa.int64())
            yield pa.RecordBatch.from_arrays(K.arrays(part.column("doc_id"), part.column("text_key"), K.signed(content[0]), K.signed(content[1]), total, lists), ["doc_id", "text_key", "c1", "c2", "n", "bands"])


def overlap(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row by row, of the multisets of two columns of texts: weighted Jaccard; size of the intersection and of the right one;
    (row, hash, weight) of what the left one has beyond the right one and, with all bits of the hash turned, of what it lacks."""
    n = len(a)
    sides = [K.bags(*K.shingles(K.words(x), SHINGLE)) for x in (a, b)]
    doc, h, w = (np.concatenate([s[i] for s in sides]) for i in range(3))
    left = np.arange(len(doc)) < len(sides[0][0])
    order = K._by_doc(doc, h)
    d, x, c, side = doc[order], h[order], w[order], left[order]
    pair = np.flatnonzero((x[1:] == x[:-1]) & (d[1:] == d[:-1]))
    met = np.minimum(c[pair], c[pair + 1])
    both = np.bincount(d[pair], met, n)
    rest = c.copy()
    rest[pair] -= met
    rest[pair + 1] -= met
    more = np.flatnonzero(rest > 0)
    right = np.bincount(sides[1][0], sides[1][2], n).astype(np.int64)
    return both / np.maximum(np.bincount(doc, w, n) - both, 1), both.astype(np.int64), right, (d[more], np.where(side[more], x[more], ~x[more]), rest[more])


_COMPARED = "a bigint, b bigint, sim double, common bigint, nb bigint, differ array<struct<token: bigint, w: bigint>>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch, "text_a", K.CHUNK_BYTES // 2):
            sim, common, size, (row, token, w) = overlap(part.column("text_a"), part.column("text_b"))
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(K.signed(token)), pa.array(w, pa.int64())], ["token", "w"]))
            yield pa.RecordBatch.from_arrays(K.arrays(part.column("a"), part.column("b"), sim, common, size, lists), ["a", "b", "sim", "common", "nb", "differ"])


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, sim, common, nb, differ) of the distinct pairs; nb: size of b; differ: shingles of a beyond b's and those it lacks. Texts travel by a and meet
    b's in place. Both joins shuffle both sides at every size, so many pairs of one b are split among tasks."""
    pairs = scratch.table(pairs.distinct(), f"{name}-pairs")
    half = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = half.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = scratch.table(whole.select("a", "b", "text_a", "text_b").mapInArrow(_compare, _COMPARED), f"{name}-compared")
    scratch.drop(f"{name}-pairs")
    return found


def _alike(n: str, m: str):
    """Sizes that allow the threshold."""
    return F.least(F.col(n), F.col(m)) >= THRESHOLD * F.greatest(F.col(n), F.col(m))


def classify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, its ``text_key`` (a hash of the text, which tells rows of one doc_id apart), class_id and the class's ``first``
    (doc_id, text_key) of every row."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = scratch.table(docs.mapInArrow(_sign, _SIGNED), "signed")
    # no word: the row alone tells such texts apart
    own = F.when(F.col("n") == 0, F.xxhash64("doc_id", "text_key")).otherwise(F.lit(0))
    row = F.struct("doc_id", "text_key")
    nodes = scratch.table(signed.groupBy("c1", "c2", own.alias("own")).agg(F.min(row).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    # a node is named by its content, as doc_ids may repeat
    nodes = nodes.withColumn("node", F.xxhash64("c1", "c2", "own"))
    meets = nodes.where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    sizes = scratch.table(meets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    met = scratch.table(meets.join(sizes, "band"), "met")
    large = scratch.table(_pivots(met.where(F.col("c") > SMALL), scratch), "large")

    chosen = met.select("node").distinct().join(nodes.select("node", "first.*"), "node")
    texts = docs.hint("merge").join(chosen, ["doc_id", "text_key"]).groupBy(F.col("node").alias("id")).agg(F.any_value("text").alias("text"))
    texts = scratch.table(texts, "texts")

    small = met.where(F.col("c") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("all"))
    small = small.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.node > y.node")
    small = small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    pairs = small.where(_alike("na", "nb")).select("a", "b").union(large.where("node <> p").select("node", "p"))
    first = verify(pairs, texts, scratch, "first")
    links = first.where(F.col("sim") >= THRESHOLD).select("a", "b")
    if large.limit(1).count():
        second = _rest(large, first, links, texts, scratch)
        if second is not None:
            links = scratch.table(links.union(second), "links")
    named = nodes.join(components(links, scratch), "node", "left").select("c1", "c2", "own", "first", F.coalesce("component", "node").alias("class"))
    named = scratch.table(named, "named")
    firsts = scratch.table(named.groupBy("class").agg(F.min("first").alias("first")), "firsts")
    named = scratch.table(named.drop("first").join(firsts, "class").drop("class"), "classes")
    found = signed.select("doc_id", "text_key", "c1", "c2", own.alias("own")).join(named, ["c1", "c2", "own"])
    return found.select("doc_id", "text_key", F.col("first")["doc_id"].alias("class_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document."""
    return classify(docs, Scratch(docs.sparkSession, "near-dup")).select("doc_id", "class_id")


def _pivots(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, p) for the large buckets. A node weighs as much as it meets others; each node's hub is the heaviest node
    of all its buckets, and a bucket's pivot is the hub of most of its nodes, whether or not it is in that bucket:
    buckets of one family then have one pivot, close to the family's source."""
    weights = scratch.table(met.groupBy("node").agg(F.sum("c").alias("weight")), "weights")
    large = scratch.table(met.join(weights, "node").select("band", "node", "n", "weight"), "weighed")
    heaviest = scratch.table(large.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")), "heaviest")
    hubs = scratch.table(large.join(heaviest, "band").groupBy("node").agg(F.max("top").alias("hub")), "hubs")
    voted = scratch.table(large.join(hubs, "node").select("band", "node", "n", "hub"), "voted")
    votes = voted.groupBy("band", "hub").agg(F.count("*").alias("votes"))
    chosen = scratch.table(votes.groupBy("band").agg((-F.max(F.struct("votes", "hub"))["hub"]["minus"]).alias("p")), "pivots")
    return voted.join(chosen, "band").select("node", "n", "p").distinct()


#: |u & v| needed for a link is this share of |u| + |v|.
_SHARE = THRESHOLD / (1 + THRESHOLD)


def _rest(large: DataFrame, compared: DataFrame, links: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links of large buckets between nodes that the pivots left in different classes."""
    class_of = components(links, scratch, "pivot-classes")
    members = large.where("node <> p")
    members = members.join(compared.select(F.col("a").alias("node"), F.col("b").alias("p"), "common", "nb", "differ"), ["node", "p"])
    members = scratch.table(members.join(class_of, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "classed")
    # a pivot may have a large part of all members: joins by p are between tables, and may be split
    mains = scratch.table(members.select(F.col("p").alias("node")).distinct().join(class_of, "node", "left").select(F.col("node").alias("p"), F.coalesce("component", "node").alias("main")), "mains")
    members = scratch.table(members.hint("merge").join(mains, "p").withColumn("apart", F.col("class") != F.col("main")).drop("main"), "members")
    # u and v are linked if their differences have nb + gap(u) + gap(v) in common
    members = members.withColumn("gap", _SHARE * F.col("n") - F.col("common"))
    mixed = scratch.table(members.groupBy("p").agg(F.min("gap").alias("least"), F.bool_or("apart").alias("any")).where("any").select("p", "least"), "mixed")
    members = scratch.table(members.hint("merge").join(mixed, "p"), "mixed-members")
    if not members.limit(1).count():
        return None

    tokens = scratch.table(members.select("p", "node", "class", "apart", F.inline("differ")), "tokens")
    same = [F.bit_xor(F.xxhash64("node", "w", F.lit(i))).alias(f"f{i}") for i in (1, 2)]
    telling = tokens.groupBy("p", "token").agg(F.count("*").alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bool_or("apart").alias("any"), *same).where("any AND lo <> hi")
    # shingles that the same nodes hold as often are one: they would name the same pairs again
    telling = scratch.table(telling.groupBy("p", "f1", "f2").agg(F.min("token").alias("token"), F.first("c").alias("c"), F.count("*").alias("times")).drop("f1", "f2"), "telling")
    held = scratch.table(tokens.join(telling, ["p", "token"]).select("p", "token", "node", "c", (F.col("w") * F.col("times")).alias("w")), "held-tokens")
    # from each token on to the most frequent one; the rarest token that u and v have in common leaves enough for a link in both
    frequent = Window.partitionBy("p", "node").orderBy(F.desc("c"), "token")
    gaps = members.select("p", "node", "n", "class", "apart", (F.col("nb") + F.col("gap") - 1e-6).alias("gap"), F.greatest(F.lit(1), F.col("nb") + F.col("gap") + F.col("least") - 1e-6).alias("need"), F.col("nb"))
    rare = held.withColumn("rest", F.sum("w").over(frequent)).join(gaps, ["p", "node"]).where("rest >= need")
    rare = scratch.table(rare.select("p", "token", "node", "n", "class", "apart", "rest", "gap", "nb"), "rare-tokens")
    x, y = rare.where("apart").alias("x"), rare.alias("y")
    meet = (F.col("x.p") == F.col("y.p")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & (~F.col("y.apart") | (F.col("x.node") < F.col("y.node")))
    enough = (F.least("x.rest", "y.rest") >= F.col("x.gap") + F.col("y.gap") - F.col("x.nb")) & _alike("x.n", "y.n")
    pairs = x.join(y, meet & enough).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    known = compared.select("a", "b").union(compared.select("b", "a"))
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    return verify(pairs, texts, scratch, "second").where(F.col("sim") >= THRESHOLD).select("a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each class, by doc_id and then by a hash of the text. Both sides of
    the join are shuffled; rows without a doc_id stay. Repeated rows are one document: they stay or go together."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    id_, key = fresh(docs, "_id"), fresh(docs, "_key")
    others = classify(docs, scratch).where(F.struct("doc_id", "text_key") != F.col("first"))
    gone = scratch.table(others.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "gone")
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(key))
    return docs.hint("merge").join(gone, same, "left_anti")
