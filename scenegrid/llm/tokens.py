"""Token ids of documents in a binary format: encode, write in doc_id order, read back.

Texts are encoded with a public tokenizer; every document ends in END. A range partition by doc_id makes the
shards, of about SHARD_BYTES of text each and never more than MAX_SHARDS; a shard has one Re-Pair grammar (see
``repair``), or several where it has over BLOCK_TOKENS tokens, in the binary column of a Parquet table, so any store that
Spark writes will do.

A tokenizer of words lower-cases and cuts at white space and between letters and marks, so the ids of a text are the ids of
its pieces in order; ``by_pieces`` reads that from its file. Each worker then keeps the ids of the pieces it has met (up
to CACHE pieces, then it begins anew), by a 64-bit hash, and gives the tokenizer only new ones. Any other tokenizer gets
whole texts.

Null texts count as empty and have the end id alone. Rows without a doc_id are left out. Rows that repeat a
doc_id follow one another by a hash of their text.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.repair import Block, encode
from scenegrid.llm.store import Scratch

END = 1
SHARD_BYTES = 10 << 20
MAX_SHARDS = 50_000
BLOCK_TOKENS = 6_000_000
CACHE = 1_500_000
GROUP = 1000
#: A mark that is one token and stands apart; pieces that hold it are encoded alone.
BETWEEN = ";"
TOGETHER = 500

#: 1: ASCII letter or digit, 2: mark, 0: other.
_KIND = np.array([2 if chr(b) in ".,!?;:" else b < 128 and chr(b).isalnum() for b in range(256)], np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _breaks(raw: np.ndarray) -> np.ndarray:
    """Where a mark follows a letter or digit, or the other way round."""
    kind = _KIND[raw]
    out = np.zeros(len(raw), bool)
    out[1:] = kind[1:] + kind[:-1] == 3
    return out


def by_pieces(path: str) -> bool:
    """Whether the tokenizer lower-cases and never joins what white space, or a mark beside a letter or digit, divides: then
    white space is one blank to it, words are runs of letters, single digits or runs of marks, and nothing comes before or after."""
    with open(path, encoding="utf-8") as file:
        has = json.load(file)
    cleans, cuts = (has.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    cleans, cuts = cleans.get("normalizers", [cleans]), cuts.get("pretokenizers", [cuts])
    blank = any(c.get("type") == "Replace" and c.get("pattern") == {"Regex": r"\s+"} and c.get("content") == " " for c in cleans)
    runs = any(c.get("type") == "Split" and c.get("invert") and c.get("behavior") == "Removed" and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in c.get("pattern", {}).get("Regex", "") for c in cuts)
    plain = all(c.get("type") != "ByteLevel" or not (c.get("add_prefix_space") or c.get("use_regex")) for c in cuts)
    return blank and runs and plain and any(c.get("type") == "Lowercase" for c in cleans) and not has.get("post_processor")


class Encoder:
    """A tokenizer with the ids of the pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the tokenizer's own would take the others'
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.pieces = by_pieces(path)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, w: K.Words, which: np.ndarray, place: np.ndarray) -> None:
        """The words ``which`` are new, each once and by rising hash; ``place``: where their hashes belong among the known."""
        start, size = w.start[which], w.end[which] - w.start[which]
        odd = w.raw == ord(BETWEEN)
        odd[:-1] |= (w.raw[:-1] == ord("<")) & (w.raw[1:] == ord("|"))
        seen = np.concatenate([[0], np.cumsum(odd)])
        alone = seen[start + size] > seen[start]
        # many pieces in one text, between separators, are far cheaper than as many texts
        plain = np.flatnonzero(~alone)
        glue = f" {BETWEEN} ".encode()
        bytes_, begin = size[plain], start[plain]
        ends = np.cumsum(bytes_ + len(glue))
        joined = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k, c in enumerate(glue):
            joined[ends - len(glue) + k] = c
        sums = np.cumsum(bytes_)
        at = np.arange(sums[-1] if len(sums) else 0)
        joined[at + np.repeat(ends - len(glue) - sums, bytes_)] = w.raw[at + np.repeat(begin - sums + bytes_, bytes_)]
        groups = [(i, min(i + TOGETHER, len(plain))) for i in range(0, len(plain), TOGETHER)]
        texts = [joined[ends[i - 1] if i else 0 : ends[j - 1] - len(glue)].tobytes().decode("utf-8", "replace") for i, j in groups]
        sizes, flat, order = [], [], []
        for (i, j), e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            cut = np.flatnonzero(ids == self.between[0])
            if len(self.between) == 1 and len(cut) == j - i - 1:
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                flat.append(np.delete(ids, cut))
                order.append(plain[i:j])
            else:
                alone[plain[i:j]] = True
        rest = np.flatnonzero(alone)
        single = [w.raw[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
        for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False):
            sizes.append([len(e.ids)])
            flat.append(np.array(e.ids, np.int32))
        row = np.empty(len(which), np.int64)
        row[np.concatenate([*order, rest])] = len(self.at) - 1 + np.arange(len(which))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([self.ids, *flat])
        self.keys, self.row = np.insert(self.keys, place, w.hash[which]), np.insert(self.row, place, row)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END; their numbers)."""
        if not self.pieces:
            each = [np.array([*e.ids, END], np.int32) for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64)
        raw, off = K.buffers(texts)
        if b"<|" not in raw.tobytes():  # upper case stays where it could tell a special token from a plain one
            raw = _FOLD[raw]
        folded = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(raw))
        w = K.words(folded, breaks=_breaks)
        order = np.argsort(w.hash)
        run = w.hash[order]
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        unique, first = run[new], order[new]
        back = np.empty(len(run), np.int64)
        back[order] = np.cumsum(new) - 1
        if len(self.keys) + len(unique) > CACHE:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        have = np.zeros(len(unique), bool)
        if len(self.keys):
            have = self.keys[np.minimum(place, len(self.keys) - 1)] == unique
        if not have.all():
            self._learn(w, first[~have], place[~have])
        row = self.row[np.searchsorted(self.keys, unique)][back]
        size = self.at[row + 1] - self.at[row]
        sums = np.concatenate([[0], np.cumsum(size)])
        lengths = sums[w.first[1:]] - sums[w.first[:-1]] + 1
        out = np.full(int(lengths.sum()), END, np.int32)
        at = np.arange(sums[-1])
        # one END for each earlier text
        out[at + np.repeat(w.doc, size)] = self.ids[at + np.repeat(self.at[row] - sums[:-1], size)]
        return out, lengths


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_FILE = "shard int, block int, n_docs bigint, n_tokens bigint, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode the documents into shards under ``path``. ``tokenizer``: the path of a tokenizer file on the executors; the public
    one of words, as each finds it, if None."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(-(-total // shard_bytes), MAX_SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer or vocabulary())
        shard, block = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, ids, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            payload = encode(doc_ids, ids, lengths, own.size)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for part in K.chunks(batch, size=4 * K.CHUNK_BYTES):
                ids, lengths = own.encode(part.column("text"))
                held.append((part.column("doc_id").to_numpy(), ids, lengths))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    salt = F.xxhash64("text")
    ordered = rows.repartitionByRange(shards, "doc_id", salt).sortWithinPartitions("doc_id", salt, "text")
    ordered.mapInArrow(run, _FILE).write.mode("overwrite").parquet(path)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, payload in zip(batch.column("shard"), batch.column("block"), batch.column("payload"), strict=True):
            have = Block.read(payload.as_py())
            lengths = have.lengths()
            ids = have.expand(have.symbols).astype("<u4")
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(K.arrays(np.full(n, shard.as_py(), np.int32), np.full(n, block.as_py(), np.int32), have.doc_ids, ends - lengths, lengths, pa.array(sums, pa.int64())), ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files. Starts of blocks are
    summed in two steps, so no task holds all blocks."""
    files = spark.read.schema(_FILE).parquet(path)
    sizes = files.select("shard", "block", "n_tokens").withColumn("part", F.floor(F.col("shard") / GROUP))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("shard", "block", (F.col("base") + F.col("earlier")).alias("begin"))
    docs = files.mapInArrow(_open, "shard int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(blocks, ["shard", "block"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write(docs, f"{scratch.root}/ids")
    return read_back(docs.sparkSession, f"{scratch.root}/ids")
