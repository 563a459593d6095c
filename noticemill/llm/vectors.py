"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors of one label are projected on many random lines. Two vectors whose cosine reaches the threshold lie within a
fixed window of each other on most lines, others on few: pairs that collide often enough are verified by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import components, stage

THRESHOLD = 0.98
LINES = 24
# Window as a multiple of the distance of two unit vectors at the threshold; a pair at the threshold collides on a line
# with probability erf(WINDOW / sqrt 2).
WINDOW = 1.0
# Chance that a pair at the threshold stays below the count; likelier pairs stay below more rarely.
MISS = 1e-4
# Overlap at the cuts between cells, in the same unit: a pair further apart along a cut line has chance 6e-5.
OVERLAP = 4.0
# Vectors that a task compares with each other at once.
CELL = 2048
MOST_CUTS = 12


def least_count(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest number of collisions that a pair at the threshold reaches but for the given chance."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if below > miss:
            return max(1, c)
    return lines


def _lines(dim: int, seed: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def collisions(projected: np.ndarray, width: float, least: int, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of `left`, one of `right`) within `width` of each other on `least` lines or more.

    right None: unordered pairs within `left`. On each line the values are sorted, and the window around each query is a
    run of the sorted order; each run adds one to its pairs' counts.
    """
    a = projected[left]
    b = a if right is None else projected[right]
    counts = np.zeros(len(a) * len(b), np.uint8)
    for k in range(projected.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        values = b[order, k]
        low = np.searchsorted(values, a[:, k] - width, side="left")
        high = np.searchsorted(values, a[:, k] + width, side="right")
        n = high - low
        total = np.cumsum(n)
        where = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n) + np.repeat(low, n)
        # A pair meets once on a line, so no place is repeated.
        counts[np.repeat(np.arange(len(a)), n) * len(b) + order[where]] += 1
    found = np.flatnonzero(counts >= least)
    i, j = found // max(1, len(b)), found % max(1, len(b))
    if right is None:
        once = i < j
        return left[i[once]], left[j[once]]
    return left[i], right[j]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def representatives(vectors: DataFrame) -> DataFrame:
    """Usable vectors, equal ones of a label as one: rep (a number of its own), first (smallest vec_id), copies, label, vector.

    The number is not vec_id, which different vectors may share. It holds for one evaluation: write the table to use it.
    """
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = usable.where("label is not null and vec_id is not null and vector is not null and size(vector) > 0")
    usable = usable.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usable = usable.where(F.exists("vector", lambda x: x != 0))
    alike = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return alike.withColumn("rep", F.monotonically_increasing_id())


def _projected(reps: DataFrame, seed: int) -> DataFrame:
    """Unit vectors and their place on the cut lines. Length overflows are avoided by scaling with the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, cut = [], []
            for v in batch.column("vector").to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                x = x / math.sqrt(float(x @ x))
                unit.append(x)
                cut.append(x @ _line_cache(len(x), seed + 1, MOST_CUTS))
            yield pa.record_batch([batch.column("rep"), batch.column("copies"), batch.column("label").cast(pa.string()),
                                   pa.array([len(x) for x in unit], pa.int32()),
                                   pa.array(unit, pa.list_(pa.float64())), pa.array(cut, pa.list_(pa.float64()))],
                                  ["rep", "copies", "label", "dim", "unit", "cut"])

    return reps.select("rep", "copies", "label", "vector").mapInArrow(run, "rep long, copies long, label string, dim int, unit array<double>, cut array<double>")


_kept: dict = {}


def _line_cache(dim: int, seed: int, count: int) -> np.ndarray:
    if (dim, seed, count) not in _kept:
        _kept[dim, seed, count] = _lines(dim, seed, count)
    return _kept[dim, seed, count]


def _cells(points: DataFrame, width: float) -> DataFrame:
    """Deal the vectors of a label to cells of about CELL, by cuts at the median of further and further lines.

    code has a bit for each cut a vector lies above; near has the bits of the cuts it lies below by less than `width`.
    A vector goes to its own cell and to those with any of its near bits set too. Two vectors within `width` on all cut
    lines meet in the cell of both their codes' bits, and are compared there alone.
    """
    size = points.groupBy("label", "dim").agg(F.count("*").alias("n"), *[
        F.percentile_approx(F.col("cut")[k], 0.5, 1000).alias(f"m{k}") for k in range(MOST_CUTS)])
    cuts = size.select("label", "dim", F.array(*[f"m{k}" for k in range(MOST_CUTS)]).alias("medians"),
                       F.least(F.lit(MOST_CUTS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL)))).cast("int").alias("cuts"))
    at = points.join(cuts, ["label", "dim"])
    bits = lambda test: F.expr(
        f"aggregate(sequence(0, {MOST_CUTS - 1}), 0, (s, k) -> s + if(k < cuts and ({test}), shiftleft(1, k), 0))")
    at = at.withColumn("code", bits("cut[k] >= medians[k]")).withColumn(
        "near", bits(f"cut[k] < medians[k] and cut[k] >= medians[k] - {width}"))
    # Every subset of the near bits, by doubling.
    subsets = F.expr(f"aggregate(sequence(0, {MOST_CUTS - 1}), array(0), (s, k) -> if((near & shiftleft(1, k)) > 0, "
                     "concat(s, transform(s, x -> x + shiftleft(1, k))), s))")
    return at.select("rep", "copies", "label", "dim", "unit", "code", F.explode(subsets).alias("extra")).withColumn(
        "cell", F.col("code") + F.col("extra"))


def _tasks(cells: DataFrame) -> DataFrame:
    """Split cells beyond CELL vectors into chunks; each pair of chunks is a task, a vector goes to all with its chunk."""
    size = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("chunks"))
    dealt = cells.join(size, ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "rep", "copies", "unit", "code", "cell", "label", "dim", "chunk",
        F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))


def near_links(points: DataFrame, threshold: float = THRESHOLD, seed: int = 17) -> DataFrame:
    """For every vector that a task links: rep, the number of vectors linked, and the smallest linked within the task.

    points as of _projected(). Neither pairs nor links leave a task: a row per vector does, so a group of near copies of
    any size gives as many rows as it has vectors, times the cells and chunks each goes to.
    """
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    least = least_count()

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        rep, copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        unit = np.stack(frame["unit"].to_list())
        code, chunk = frame["code"].to_numpy(), frame["chunk"].to_numpy()
        cell, a, b = int(frame["cell"].iloc[0]), int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        projected = unit @ _line_cache(unit.shape[1], seed, LINES)
        width = WINDOW * distance
        left = np.flatnonzero(chunk == a)
        right = None if a == b else np.flatnonzero(chunk == b)
        links = np.zeros(len(rep), np.int64)
        tied_i, tied_j = [], []
        for s in range(0, len(left), 512):
            block = left[s:s + 512]
            parts = [(block, right)] if right is not None else [(block, None), (block, left[s + 512:])]
            for x, y in parts:
                i, j = collisions(projected, width, least, x, y)
                for t in range(0, len(i), 20_000):
                    p, q = i[t:t + 20_000], j[t:t + 20_000]
                    own = (code[p] | code[q]) == cell
                    p, q = p[own], q[own]
                    near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[near], q[near]
                    links += np.bincount(p, weights=copies[q], minlength=len(rep)).astype(np.int64)
                    links += np.bincount(q, weights=copies[p], minlength=len(rep)).astype(np.int64)
                    tied_i.append(p)
                    tied_j.append(q)
        order = np.argsort(rep)
        rank = np.argsort(order)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tied_i, tied_j))
        root = rep[order[_roots(len(rep), rank[i], rank[j])[rank]]]
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    width = OVERLAP * distance
    tasks = _tasks(_cells(points, width))
    return tasks.groupBy("label", "dim", "cell", "a", "b").applyInPandas(link, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 17) -> DataFrame:
    """Links and components of all vectors (vec_id, embedding, label); other columns are left behind.

    Only vectors of equal, non-null labels and equal length are compared. A vector that is null, empty, zero or holds a
    null or a number that is not finite links with nothing and is its own component; so is one with a null label. A null
    vec_id gets no links, a null component and kept null. Equal vectors are compared as one and count as links of each
    other. Rows that share a vec_id but not the vector are vectors of their own. Returns one row per input row: vec_id,
    n_links, component_id, kept.
    """
    reps, _ = stage(representatives(vectors), "representatives")
    points, _ = stage(_projected(reps, seed), "points")
    found, _ = stage(near_links(points, threshold, seed), "near")
    trees = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = reps.select("rep", "first", "copies").join(counts, "rep", "left").join(trees.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("rep", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component", "rep").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    of_rep = placed.join(smallest, "root").select("rep", "n_links", "component")
    # The representative of each vector, found again by its value.
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                           F.col("embedding").cast("array<double>").alias("vector"))
    members = keyed.join(reps.select("label", "vector", "rep"), ["label", "vector"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep"))
    return members.join(of_rep, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))
