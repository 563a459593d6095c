"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import stage
from noticemill.llm.tokens import tokenize
from noticemill.llm.words import slices

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# Cost of a sequence of length c: c + c**2 / ATTENTION + EACH.
ATTENTION, EACH = 65_536, 24
# Pieces packed together, on the average; a group ends with a few bins that are not full.
GROUP_PIECES = 16_384


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + EACH


def word_count(text: Column) -> Column:
    """Words of a text and one end mark; the length used where no token counts are at hand. Null and empty: 1."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _open(size: int, left: list[int], total: list[int], capacities: tuple[int, ...], policy: str) -> int:
    """Length at which a bin for an item of this size opens. left: the smaller items to come, ascending."""
    fitting = [c for c in capacities if c >= size]
    if policy == "smallest":
        return fitting[0]
    if policy == "largest":
        return fitting[-1]
    # Least cost for a token, if the bin is filled as far as the items to come can fill it.
    return min(fitting, key=lambda c: (cost(c) / min(c, size + total[bisect_right(left, c - size)]), c))


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """Bin, capacity of the bin and offset in it for each item; sizes descend and none is above the largest capacity.

    Best fit: an item goes to the open bin it leaves the least room in, the first of equals. The lengths are optimised
    jointly: each bin opens at the length of least cost for a token, or at the smallest or largest that holds its first
    item, whichever of the three makes the whole group cheapest once every bin is cut down to the smallest permitted
    length that holds its contents.
    """
    best, least = [], math.inf
    ascending = sizes[::-1]
    total = [0, *accumulate(ascending)]
    for policy in ("cheapest", "smallest", "largest"):
        room: list[tuple[int, int]] = []
        used: list[int] = []
        opened: list[int] = []
        placed = []
        for n, size in enumerate(sizes):
            k = bisect_left(room, (size, -1))
            if k < len(room):
                _, bin_ = room.pop(k)
            else:
                bin_ = len(used)
                used.append(0)
                opened.append(_open(size, ascending[:0] if policy != "cheapest" else _Head(ascending, len(sizes) - n - 1), total, capacities, policy))
            placed.append((bin_, used[bin_]))
            used[bin_] += size
            if used[bin_] < opened[bin_]:
                insort(room, (opened[bin_] - used[bin_], bin_))
        final = [capacities[bisect_left(capacities, u)] for u in used]
        price = sum(map(cost, final))
        if price < least:
            least, best = price, [(b, final[b], at) for b, at in placed]
    return best


class _Head:
    """The first `n` of a list, without a copy."""

    def __init__(self, items: list[int], n: int):
        self.items, self.n = items, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> int:
        return self.items[k]


def pack_documents(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES, seed: int = 5) -> DataFrame:
    """Pack every document into bins. lengths: doc_id, n_tokens; other columns are left behind.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. Pieces are dealt to
    groups of bounded size by chance from a fixed seed, so rows of one id, source or length are spread; a group is
    packed in one task that holds nothing but its lengths. Null or non-positive lengths take no room: capacity, offset and bin
    are null. Repeated rows are packed one by one; null ids are packed like others; an empty table gives no row.
    Returns doc_id, piece (from 0), n_tokens (of the piece), bin, capacity, offset (of the piece in its bin), fill (of the bin).
    """
    largest = capacities[-1]
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
    usable = rows.where("n > 0")
    pieces = usable.agg(F.sum(F.ceil(F.col("n") / largest))).first()[0] or 0
    groups = max(1, math.ceil(int(pieces) / group_pieces))
    cut = usable.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest).cast("int"))).alias("piece"))
    cut = cut.select("doc_id", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece").cast("long") * largest).alias("n_tokens"),
                     F.floor(F.rand(seed) * groups).cast("int").alias("group"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        found = pack([int(n) for n in frame["n_tokens"]], capacities)
        frame = frame[["doc_id", "piece", "n_tokens"]].copy()
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["bin"] = [(int(key[0]) << 32) + b for b, _, _ in found]
        frame["capacity"] = [c for _, c, _ in found]
        frame["offset"] = [at for _, _, at in found]
        frame["fill"] = frame.groupby("bin")["n_tokens"].transform("sum")
        return frame

    packed = cut.groupBy("group").applyInPandas(
        run, "doc_id long, piece int, n_tokens long, bin long, capacity int, offset int, fill long")
    rest = rows.where("n is null or n <= 0").select(
        "doc_id", F.lit(0).alias("piece"), F.col("n").alias("n_tokens"), F.lit(None).cast("long").alias("bin"),
        F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("long").alias("fill"))
    return packed.unionByName(rest)


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of every row: the tokenizer's ids of the text and one end id. Null and empty: 1.

    Texts stay in the scan. The lengths are written, since packing reads them more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                _, begins = tokenize(rows.column("text"), tokenizer)
                yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(begins), pa.int64())], ["doc_id", "n_tokens"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(keyed.mapInArrow(run, "doc_id long, n_tokens long"), "lengths")[0]


def pack_texts(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokenizer: str | None = None) -> DataFrame:
    """Packed by the tokenizer's lengths; without a tokenizer by word counts."""
    if tokenizer is not None:
        return pack_documents(token_lengths(docs, tokenizer), capacities)
    return pack_documents(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), capacities)
