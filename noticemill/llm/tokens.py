"""Token files with directly addressable codes.

An id is cut into chunks, least significant first. Level k holds chunk k of every id that has one, with a bitmap that
says which of them go on to level k + 1, and a directory of the ones before each block of the bitmap. Any token is
found with one rank per level; nothing is decoded before it. A file row is one block of documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticemill.llm.tables import stage
from noticemill.llm.words import Words, slices, span_hashes, split_words

END = 2
# Bits of each chunk; the last is large enough for what is left of a 32-bit id.
WIDTHS = (8, 8, 16)
RANK_BLOCK = 512
BLOCK_BYTES = 4 << 20
# Words a worker remembers with their ids. It is a memory only: a word not in it is encoded anew.
MEMORY = 1_000_000

FILE_SCHEMA = ("part int, block int, doc_ids array<long>, nulls binary, starts array<long>, n_tokens long, "
               "level_sizes array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>")
ARROW_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("nulls", pa.binary()),
    ("starts", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("level_sizes", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())),
    ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


# ---- codes -------------------------------------------------------------------------------------------------------


def encode(ids: np.ndarray) -> dict:
    """Levels of chunks with continuation bitmaps and rank directories."""
    sizes, chunks, bitmaps, ranks = [], [], [], []
    rest = ids.astype(np.uint32)
    for k, width in enumerate(WIDTHS):
        last = k == len(WIDTHS) - 1
        sizes.append(len(rest))
        chunk = rest if last else rest & np.uint32((1 << width) - 1)
        chunks.append(chunk.astype("<u1" if width == 8 else "<u2").tobytes())
        rest = rest >> np.uint32(width)
        on = np.zeros(len(chunk), bool) if last else rest > 0
        bitmaps.append(np.packbits(on, bitorder="little").tobytes())
        padded = np.zeros(-(-len(on) // RANK_BLOCK) * RANK_BLOCK, np.int64)
        padded[:len(on)] = on
        per_block = padded.reshape(-1, RANK_BLOCK).sum(axis=1)
        ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes())
        rest = rest[on]
        if not len(rest):
            break
    return {"n_tokens": len(ids), "level_sizes": sizes, "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}


def _chunk(block: dict, level: int) -> np.ndarray:
    return np.frombuffer(block["chunks"][level], "<u1" if WIDTHS[level] == 8 else "<u2")


def decode(block: dict) -> np.ndarray:
    """All ids of a block."""
    ids = np.zeros(block["n_tokens"], np.uint32)
    at, shift = np.arange(block["n_tokens"]), 0
    for level, size in enumerate(block["level_sizes"]):
        ids[at] |= _chunk(block, level).astype(np.uint32) << np.uint32(shift)
        on = np.unpackbits(np.frombuffer(block["bitmaps"][level], np.uint8), count=size, bitorder="little").astype(bool)
        at, shift = at[on], shift + WIDTHS[level]
    return ids


def access(block: dict, position: int) -> int:
    """The id at one position of a block, read from one chunk and one rank per level."""
    if not 0 <= position < block["n_tokens"]:
        raise IndexError(position)
    value, shift, at = 0, 0, position
    for level in range(len(block["level_sizes"])):
        value |= int(_chunk(block, level)[at]) << shift
        bits = np.frombuffer(block["bitmaps"][level], np.uint8)
        if not bits[at >> 3] >> (at & 7) & 1:
            break
        begin = at // RANK_BLOCK
        before = int(np.frombuffer(block["ranks"][level], "<u4")[begin])
        within = bits[begin * RANK_BLOCK >> 3:(at >> 3) + 1]
        ones = np.unpackbits(within, bitorder="little")[:at - begin * RANK_BLOCK]
        at, shift = before + int(ones.sum()), shift + WIDTHS[level]
    return value


# ---- tokens ------------------------------------------------------------------------------------------------------

_worker: dict = {}


def _cut(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans to encode one by one: words, with a full stop or comma after an ASCII letter as a span of its own.

    The tokenizer drops white space and never joins a letter with one of these two signs, so the ids of a text are
    those of its spans, one after the other.
    """
    data, starts, ends, first = words.data, words.starts, words.ends, words.first
    mark = data[ends - 1]
    before = data[np.maximum(ends - 2, 0)] | 32
    cut = np.flatnonzero((ends - starts >= 2) & ((mark == 44) | (mark == 46)) & (before >= 97) & (before <= 122))
    more = np.concatenate([[0], np.cumsum(np.bincount(cut, minlength=len(starts)))])
    out_starts = np.insert(starts, cut + 1, ends[cut] - 1)
    out_ends = np.insert(ends, cut, ends[cut] - 1)
    return out_starts, out_ends, first + more[first]


def _encode(tokenizer, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all spans, one after the other, and their number for each; one call for all.

    A special token between spans is never joined with what stands beside it, so it cuts the ids again. Where a span
    holds that token itself, or the tokenizer has none, the tokens' places in the text cut them.
    """
    marks = [(n, token.content) for n, token in tokenizer.get_added_tokens_decoder().items() if token.special]
    if marks and not tokenizer.encode_special_tokens:
        number, mark = marks[0]
        ids = np.array(tokenizer.encode_batch_fast([mark.join(spans)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == number)
        if len(cut) == len(spans) - 1:
            edges = np.concatenate([[-1], cut, [len(ids)]])
            return np.delete(ids, cut), np.diff(edges) - 1
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in spans])])
    found = tokenizer.encode(" ".join(spans), add_special_tokens=False)
    at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
    return np.array(found.ids, np.uint32), np.diff(np.searchsorted(at, begins))


def _runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places begins[k] .. begins[k] + lengths[k] - 1 of all runs, one after the other."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(before[-1]) - np.repeat(before[:-1], lengths) + np.repeat(begins, lengths)


class _Memory:
    """Ids of distinct spans by their hash, in sorted arrays; those used longest ago are forgotten first."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.length, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)
        self.clock = 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are not known; the others count as used now."""
        self.clock += 1
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.used[at[known]] = self.clock
        return np.flatnonzero(~known)

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Ascending keys that were missing, with their ids one after the other."""
        if len(self.keys) + len(keys) > MEMORY:
            # Spans of the texts at hand stay, whatever their number.
            keep = self.used == self.clock
            late = np.argsort(self.used, kind="stable")[::-1][:MEMORY // 2]
            keep[late] = True
            self.keys, self.length, self.used, begin = self.keys[keep], self.length[keep], self.used[keep], self.begin[keep]
            self.ids = self.ids[_runs(begin, self.length)]
            self.begin = np.cumsum(self.length) - self.length
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, at, lengths)
        self.used = np.insert(self.used, at, self.clock)
        self.ids = np.concatenate([self.ids, ids])


def tokenize(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id after it, and the place where each text begins.

    Every distinct span is encoded once by the tokenizer and remembered by its hash.
    """
    # Spark has a task on every core; threads of the library's own would only compete with them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if _worker.get("path") != path:
        _worker.update(path=path, tokenizer=Tokenizer.from_file(path), memory=_Memory())
    words = split_words(column)
    starts, ends, first = _cut(words)
    distinct, sample, place = np.unique(span_hashes(words.data, starts, ends, lower=False), return_index=True, return_inverse=True)
    memory = _worker["memory"]
    new = memory.missing(distinct)
    if len(new):
        raw, parts = words.data.tobytes(), []
        for a in range(0, len(new), 20_000):
            own = sample[new[a:a + 20_000]]
            texts = [raw[b:c].decode("utf-8", "replace") for b, c in zip(starts[own].tolist(), ends[own].tolist())]
            parts.append(_encode(_worker["tokenizer"], texts))
        memory.add(distinct[new], np.concatenate([n for _, n in parts]), np.concatenate([ids for ids, _ in parts]))
    at = np.searchsorted(memory.keys, distinct)[place]
    # Ids of the words in order, with room for the end id after each text.
    count = memory.length[at]
    total = np.concatenate([[0], np.cumsum(count)])
    texts = len(first) - 1
    text_begins = total[first] + np.arange(texts + 1)
    out = np.full(total[-1] + texts, END, np.uint32)
    text_of = np.repeat(np.arange(texts), np.diff(total[first]))
    out[np.arange(total[-1]) + text_of] = memory.ids[_runs(memory.begin[at], count)]
    return out, text_begins


# ---- files -------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode the documents, write them as blocks in ascending doc_id order and return the written blocks.

    Rows are dealt to tasks by ranges of (doc_id, hash of the text), so copies of one id are spread too; null ids come
    first and repeated rows are kept. Null text is empty: its only token is the end id. A block has about BLOCK_BYTES of
    text, or one text that is longer.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    ordered = keyed.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                ids, begins = tokenize(rows.column("text"), tokenizer)
                keys = rows.column("doc_id")
                row = encode(ids) | {
                    "part": part, "block": block, "doc_ids": pc.fill_null(keys, 0).to_pylist(),
                    "nulls": np.packbits(pc.is_null(keys).to_numpy(zero_copy_only=False)).tobytes(), "starts": begins.tolist()}
                yield pa.RecordBatch.from_pylist([row], ARROW_SCHEMA)
                block += 1

    return stage(ordered.mapInArrow(run, FILE_SCHEMA), "tokens")[0]


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block and first, the number of ids in all blocks before it.

    Only sizes are read. Sums within a task come first, then sums over the tasks, whose number does not grow with the rows.
    """
    sizes = blocks.select("part", "block", "n_tokens")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    own = sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return own.join(parts, "part").select("part", "block", "n_tokens", (F.col("base") + F.col("within")).cast("long").alias("first"))


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Digest of each document from the written blocks: start, number of ids and their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, begins = decode(row).astype("<u4"), np.array(row["starts"], np.int64)
                null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(row["doc_ids"]))
                n = len(row["doc_ids"])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, begins[1:])]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64(), mask=null.astype(bool)), pa.array(np.full(n, row["part"], np.int32)),
                                       pa.array(np.full(n, row["block"], np.int32)), pa.array(begins[:-1]), pa.array(np.diff(begins)),
                                       pa.array(sums, pa.int64())], ["doc_id", "part", "block", "within", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, "doc_id long, part int, block int, within long, n_tokens long, ids_crc32 long")
    return found.join(block_starts(blocks).select("part", "block", "first"), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_at(blocks: DataFrame, position: int) -> int:
    """The id at a position of the whole corpus: one block is read, nothing in it decoded but the one id."""
    at = block_starts(blocks).where((F.col("first") <= position) & (F.col("first") + F.col("n_tokens") > position)).first()
    if at is None:
        raise IndexError(position)
    row = blocks.where((F.col("part") == at["part"]) & (F.col("block") == at["block"])).first()
    return access(row.asDict(), position - at["first"])


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer))
