"""Language by multilingual mixture inference.

Training counts hashed character n-grams (3 and 4 bytes of lower-case text, in which whatever separates words is one
blank) per language over every learned row: a map that adds up within its task, then one small aggregation. The
model is the smoothed likelihood of each bucket under each language, of fixed size per language.

A document is a mixture of languages. Expectation-maximisation on its n-gram counts estimates the
proportions, for all documents of a batch at once. From all languages, the weakest goes while the
log-likelihood, less PENALTY times log(n) for each language kept, doesn't fall. No set of several can win over one
language whose likelihood is within one price of the best mixture's; and the best mixture's is bounded at any state of the
iteration: it is concave, so it exceeds the present one by at most n times the log of its largest derivative. Rounds go on
until that bound, or the present likelihood itself, settles which texts have one language; only the rest, and any not
settled after SETTLE_ROUNDS, are eliminated step by step. The
prediction is the largest proportion of the set that is left, ties by name, and the score is that proportion.

A null text, or one without a letter, is ``und`` with score 0. Learned rows have text and language.
With no learned row every document is ``und``. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import hashed
from scenegrid.llm import textkit as K
from scenegrid.llm.tables import held_out

BITS = 15
BUCKETS = 1 << BITS
SIZES = (3, 4)
SMOOTHING = 0.5
PENALTY = 4.0
#: Rounds between two looks at the bound, the most of them, and rounds for each step of the elimination.
LOOK_ROUNDS, SETTLE_ROUNDS, ROUNDS = 4, 24, 12
UNKNOWN = "und"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the n-grams of each text, and nothing of texts without a letter."""
    lower = pc.utf8_lower(texts.fill_null(""))
    raw, off = K.buffers(lower)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    raw = np.where(K.NOT_TERM[raw] | ((raw >= 48) & (raw < 58)), np.uint8(32), raw)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    blank = raw == 32
    lettered = np.zeros(len(raw), bool)
    lettered[1:] = blank[1:] & blank[:-1]  # runs of blanks count once
    keep = np.flatnonzero(~lettered)
    raw, doc = raw[keep], doc[keep]
    values = raw.astype(np.uint64)
    keys = []
    for k in SIZES:
        n = len(raw) - k + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint64)
        for j in range(k):
            code = (code << np.uint64(8)) | values[j : j + n]
        same = doc[:n] == doc[k - 1 :]
        ids = hashed.bucket(K.mix(code[same] + np.uint64(k << 40)), BITS)
        keys.append(doc[:n][same] * BUCKETS + ids)
    if not keys:
        z = np.zeros(0, np.int64)
        return z, z, z
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, counts


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def _em(p: np.ndarray, c: np.ndarray, row: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each text after some rounds. p: likelihoods of its n-grams under each
    language; c: their counts; row: their text's number; pi: where to start, 0 for languages left out."""
    starts = np.searchsorted(row, np.arange(len(pi)))
    total = np.bincount(row, c)[:, None]
    for _ in range(rounds):
        r = p * pi[row]
        r *= (c / np.maximum(r.sum(1), 1e-300))[:, None]
        pi = np.add.reduceat(r, starts, 0) / total
    return pi, np.bincount(row, c * np.log(np.maximum((p * pi[row]).sum(1), 1e-300)))


def _choose(p: np.ndarray, c: np.ndarray, row: np.ndarray, pi: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Backward elimination: the weakest language goes while that costs less than its price."""
    n, m = pi.shape
    pi, logs = _em(p, c, row, pi, ROUNDS)
    active, open_ = np.ones((n, m), bool), np.ones(n, bool)
    for _ in range(m - 1):
        fewer = active.copy()
        fewer[np.arange(n), np.where(active, pi, np.inf).argmin(1)] = False
        start = np.where(fewer, pi + 1e-6, 0)
        pi2, logs2 = _em(p, c, row, start / start.sum(1, keepdims=True), ROUNDS)
        better = open_ & (logs2 + price >= logs)
        active[better], pi[better], logs[better] = fewer[better], pi2[better], logs2[better]
        open_ &= better
    return pi


@dataclass
class Languages:
    names: list[str]
    likelihood: np.ndarray  #: buckets x languages

    def proportions(self, texts: pa.Array) -> np.ndarray:
        """Per text, the proportions of the languages in the chosen set."""
        n, m = len(texts), len(self.names)
        doc, ids, counts = grams(texts)
        found = np.full((n, m), 1 / m)
        if not len(doc):
            return found
        p, c = self.likelihood[ids], counts.astype(float)
        some, size = np.unique(doc, return_counts=True)
        row = np.repeat(np.arange(len(some)), size)
        total = np.bincount(row, c)
        price = PENALTY * np.log(total + 1)
        mixed = np.zeros(len(some), bool)
        undecided, pi = np.arange(len(some)), found[some]
        q, d, at = p, c, row
        for rounds in range(LOOK_ROUNDS, SETTLE_ROUNDS + 1, LOOK_ROUNDS):
            now, logs = _em(q, d, at, pi[undecided], LOOK_ROUNDS)
            pi[undecided] = now
            best = now.argmax(1)
            alone = np.bincount(at, d * np.log(q[np.arange(len(q)), best[at]]))
            starts = np.searchsorted(at, np.arange(len(undecided)))
            slope = np.add.reduceat(q * (d / (q * now[at]).sum(1))[:, None], starts, 0) / total[undecided, None]
            most = logs + total[undecided] * np.log(np.maximum(slope.max(1), 1))
            several = alone + price[undecided] < logs
            single = ~several & (alone + price[undecided] >= most)
            mixed[undecided[several]] = True
            rest = ~(several | single)
            if rounds == SETTLE_ROUNDS:
                mixed[undecided[rest]] = True
            if not rest.any():
                break
            pick = rest[at]
            again = np.cumsum(rest) - 1
            q, d, at, undecided = q[pick], d[pick], again[at[pick]], undecided[rest]
        found[some] = np.arange(m) == pi.argmax(1)[:, None]
        if mixed.any():
            pick = mixed[row]
            again = np.cumsum(mixed) - 1
            found[some[mixed]] = _choose(p[pick], c[pick], again[row[pick]], pi[mixed], price[mixed])
        return found

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, number of languages in the set) per text."""
        n = len(texts)
        if not self.names:
            return np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64)
        pi = self.proportions(texts)
        known = has_letter(texts)
        names = np.array(self.names, object)[pi.argmax(1)]
        names[~known] = UNKNOWN
        return names, np.where(known, np.clip(pi.max(1), 0, 1), 0.0), np.where(known, (pi > 0).sum(1), 0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in K.chunks(batch):
            doc, ids, counts = grams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                of = (langs == lang)[doc]
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(ids[of], counts[of], BUCKETS).astype(np.int64)
    for lang, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(K.arrays(pa.array([lang] * len(at), pa.string()), at, row[at]), ["lang", "bucket", "n"])


def train(docs: DataFrame) -> Languages:
    """Counts over every document that has text and language and isn't held out."""
    learned = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "text")
    sums = learned.mapInArrow(_counts, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(sums.column("lang").to_pylist(), object)
    names = sorted(set(langs))
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    for j, name in enumerate(names):
        of = langs == name
        table[sums.column("bucket").to_numpy()[of], j] += sums.column("n").to_numpy()[of]
    return Languages(names, table / table.sum(0, keepdims=True) if names else table)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_languages for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, size=K.CHUNK_BYTES):
                lang, score, n = sent.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(K.arrays(part.column("doc_id"), pa.array(lang, pa.string()), score, n.astype(np.int64)), ["doc_id", "lang_pred", "score", "n_languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_languages bigint")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_languages")


def language(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
