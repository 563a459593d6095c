"""Benchmark decontamination by latent semantic retrieval.

Passages are vectors of TF-IDF weights over hashed words. A randomised SVD of the benchmark's passages, run as Spark
jobs, gives the latent space; every passage of every document is projected into it, compared by cosine with the
benchmark's passages, and the pairs found are verified by the longest common subsequence of words and by the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.words import mix, slices, split_words

BITS = 18
# Words of half a passage: passages of two halves overlap by one, so a text of up to HALF words lies whole in one.
HALF = 32
RANK, OVERSAMPLE, POWER = 128, 16, 2
# Benchmark texts worked on at a time; with the bits above, this bounds what is broadcast.
BLOCK_ITEMS = 20_000
# A candidate: cosine in the latent space, and the share of the benchmark passage's own length that the document's
# passage has in its direction. The second is about 1 for a passage held whole, whatever stands around it, so a share of
# ALONE or more needs no cosine: words of other items around a passage lower only that.
COSINE, MASS, ALONE = 0.2, 0.25, 0.6
# Least part of a benchmark passage's length that the latent space must keep; items below it get a space of their own.
KEPT = 0.25
# Weight of a word in every half passage of the corpus.
FLOOR = 0.05
# Share of a benchmark text's words that must stand in the passage in order, alone and with the answer found whole.
LCS_ALONE, LCS_WITH_ANSWER = 0.75, 0.6
# Items of fewer words have too few to be told by their share in a passage: they must stand word for word.
SHORTEST = 6
# Spaces that one scan of the documents compares with, by their size in memory; further ones take a scan more.
SCAN_BYTES = 256 << 20


def _terms(column: pa.Array):
    """Word hashes of the lower-cased texts, their feature numbers, and where each text begins."""
    words = split_words(pc.utf8_lower(pc.fill_null(column, ""))).trimmed()
    h = words.hashes()
    return h, (mix(h + np.uint64(5)) & np.uint64((1 << BITS) - 1)).astype(np.int64), words.first


def _halves(first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Word at which each half passage begins, and the first half of each text."""
    counts = -(-np.diff(first) // half)
    begins = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(begins[-1]) - np.repeat(begins[:-1], counts)
    return np.repeat(first[:-1], counts) + within * half, begins


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit per element of `a`."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _contains(part: list[int], whole: list[int]) -> bool:
    n = len(part)
    return n > 0 and any(whole[k:k + n] == part for k in range(len(whole) - n + 1))


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


@dataclass
class Space:
    row: np.ndarray  # int32: row of a hashed word in basis, or -1
    weight: np.ndarray  # float32: inverse document frequency by row
    basis: np.ndarray  # float32: rows x rank
    latent: np.ndarray  # float32: unit vectors of the benchmark's passages
    length: np.ndarray  # float32: their lengths before scaling
    owner: np.ndarray  # item of each of these
    items: list[Item]
    kept: np.ndarray  # float32: part of each passage's length that the latent space keeps

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.row, self.weight, self.basis, self.latent, self.length, self.owner, self.kept))


@dataclass
class Exact:
    """Items of fewer than SHORTEST words by the hash of their whole sequence."""
    keys: dict[int, np.ndarray]  # by number of words: hashes, ascending
    numbers: dict[int, np.ndarray]  # item of each of these
    items: list[Item]


# A verified match: (text, item, first word of the passage, cosine, common words, answer found).
Match = tuple[int, int, int, float, int, bool]


def _items(rows: list) -> list[Item]:
    """Items with a word; the answer is the item's own, or else its last sentence of at least two words."""
    made = []
    for row in rows:
        text = row["text"] or ""
        answer = row["answer"] or ""
        if not answer.strip():
            parts = [p for p in text.replace("\n", " ").replace("?", ".").split(".") if len(p.split()) >= 2]
            answer = parts[-1] if len(parts) > 1 else ""
        h, _, first = _terms(pa.array([text, answer]))
        own = h[first[0]:first[1]].tolist()
        if own:
            made.append(Item(row["item_id"], own, h[first[1]:first[2]].tolist()))
    return made


def _features(benchmark: DataFrame) -> np.ndarray:
    """Feature numbers of all words of the benchmark; at most 2**BITS come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for part in slices(batch, "text"):
                seen[_terms(part.column("text"))[1]] = True
        yield pa.record_batch([pa.array(np.flatnonzero(seen))], ["feature"])

    found = benchmark.select("text").mapInArrow(run, "feature long").distinct().toArrow()
    return np.sort(found["feature"].to_numpy())


def document_frequency(docs: DataFrame, used: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of half passages of the whole corpus with each of the features, by feature, and of all half passages."""
    size = len(used)
    row = np.full(1 << BITS, -1, np.int32)
    row[used] = np.arange(size)
    shared = docs.sparkSession.sparkContext.broadcast(row)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, term, first = _terms(part.column("text"))
                at, _ = _halves(first, HALF)
                number = np.searchsorted(at, np.arange(len(term)), side="right") - 1
                r = shared.value[term].astype(np.int64)
                known = r >= 0
                pairs = np.unique(number[known] * size + r[known])
                total[:size] += np.bincount(pairs % size, minlength=size)
                total[size] += len(at)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["row", "n"])

    # One row per feature of the benchmark, at most 2**BITS, comes back.
    found = docs.select("text").mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    counted = np.zeros(size + 1, np.int64)
    counted[found["row"].to_numpy()] = found["n"].to_numpy()
    frequency = np.zeros(1 << BITS, np.int64)
    frequency[used] = counted[:size]
    return frequency, int(counted[size])


def _passages(items: list[Item], row: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[int, int, float]], list[int], list[float]]:
    """TF-IDF entries (passage, word row, weight) of unit vectors, the item of each passage, and its length."""
    entries, owner, length = [], [], []
    for n, item in enumerate(items):
        for at in range(0, max(1, len(item.words) - HALF), HALF):
            own = np.array(item.words[at:at + 2 * HALF], np.uint64)
            r = row[(mix(own + np.uint64(5)) & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            r, tf = np.unique(r, return_counts=True)
            v = tf * weight[r]
            norm = np.sqrt((v * v).sum())
            entries += [(len(owner), int(a), float(b)) for a, b in zip(r, v / norm)]
            owner.append(n)
            length.append(float(norm))
    return entries, owner, length


def randomised_svd(entries: DataFrame, rank: int, seed: int, power: int = POWER) -> np.ndarray:
    """Right singular vectors (words x rank) of a sparse matrix given as rows (passage, word, value).

    Halko's method: the matrix times a seeded random one, a few power rounds, then the small problem. Both products
    need no join: each is one grouping by passage or by word in which the other factor is broadcast, of which the
    size is (number of distinct words or passages of a benchmark block) x rank. Only rank x rank systems and that factor
    come to the driver.
    """
    spark = entries.sparkSession
    words = int(entries.agg(F.max("word")).first()[0]) + 1
    passages = int(entries.agg(F.max("passage")).first()[0]) + 1
    entries = entries.persist()

    def product(by: str, other: str, factor: np.ndarray, size: int) -> np.ndarray:
        shared = spark.sparkContext.broadcast(factor)

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keys, place = np.unique(frame[by].to_numpy(), return_inverse=True)
                total = np.zeros((len(keys), factor.shape[1]))
                np.add.at(total, place, frame["value"].to_numpy()[:, None] * shared.value[frame[other].to_numpy()])
                yield pd.DataFrame({"key": keys, "sums": list(total)})

        sums = entries.mapInPandas(partial, "key long, sums array<double>").select("key", F.posexplode("sums"))
        rows = sums.groupBy("key", "pos").agg(F.sum("col").alias("value")).toArrow()
        out = np.zeros((size, factor.shape[1]))
        out[rows["key"].to_numpy(), rows["pos"].to_numpy()] = rows["value"].to_numpy()
        return out

    start = np.random.default_rng(seed).standard_normal((words, min(rank + OVERSAMPLE, words, passages)))
    y = product("passage", "word", start, passages)
    for _ in range(power):
        q, _ = np.linalg.qr(y)
        z, _ = np.linalg.qr(product("word", "passage", q, words))
        y = product("passage", "word", z, passages)
    q, _ = np.linalg.qr(y)
    b = product("word", "passage", q, words)  # words x l: the transpose of Q'A
    value, vector = np.linalg.eigh(b.T @ b)
    best = np.argsort(value)[::-1][:rank]
    best = best[value[best] > 1e-12 * max(value.max(), 1e-300)]
    entries.unpersist()
    return b @ vector[:, best] / np.sqrt(value[best])


def build_space(spark: SparkSession, items: list[Item], counts: tuple[np.ndarray, int], rank: int = RANK, seed: int = 3) -> Space | None:
    """Latent space of one block of the benchmark; None if it has no word. counts: see document_frequency."""
    row = np.full(1 << BITS, -1, np.int32)
    used = np.unique((mix(np.concatenate([np.array(i.words, np.uint64) for i in items]) + np.uint64(5))
                      & np.uint64((1 << BITS) - 1)).astype(np.int64)) if items else np.zeros(0, np.int64)
    row[used] = np.arange(len(used))
    if not len(used):
        return None
    frequency, total = counts[0][used], counts[1]
    # Never 0, whatever the share of the corpus a word stands in: an item of common words only is looked for too.
    weight = (np.log((total + 2) / (frequency + 1)) + FLOOR).astype(np.float32)
    entries, owner, length = _passages(items, row, weight)
    frame = spark.createDataFrame(pd.DataFrame(entries, columns=["passage", "word", "value"]))
    basis = randomised_svd(frame, rank, seed).astype(np.float32)
    latent = np.zeros((len(owner), basis.shape[1]), np.float32)
    for p, w, v in entries:
        latent[p] += np.float32(v) * basis[w]
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-6)
    return Space(row, weight, basis, latent, np.array(length, np.float32) * norm[:, 0], np.array(owner), items, norm[:, 0])


def build_spaces(spark: SparkSession, items: list[Item], counts: tuple[np.ndarray, int], rank: int = RANK, seed: int = 3) -> list[Space]:
    """Latent spaces in which every item is told apart.

    A space of few directions holds what many passages share. Items it keeps too little of are dealt to further spaces, the
    half of them at a time where that alone gains nothing; up to `rank` passages are always kept whole.
    """
    made, open_ = [], [items]
    while open_:
        own = open_.pop()
        space = build_space(spark, own, counts, rank, seed)
        if space is None:
            continue
        weak = np.zeros(len(own), bool)
        weak[space.owner[space.kept < KEPT]] = True
        few = len(space.owner) <= rank or len(own) == 1
        if few or not weak.any():
            made.append(space)
        elif weak.all():
            open_ += [own[:len(own) // 2], own[len(own) // 2:]]
        else:
            # The whole space stays: the items it holds well are found in it. The others are looked for in their own.
            made.append(_only(space, ~weak))
            open_.append([item for item, w in zip(own, weak) if w])
    return made


def _only(space: Space, items: np.ndarray) -> Space:
    """The same space with some of its items."""
    number = np.cumsum(items) - 1
    mine = items[space.owner]
    return Space(space.row, space.weight, space.basis, space.latent[mine], space.length[mine], number[space.owner[mine]],
                 [item for item, keep in zip(space.items, items) if keep], space.kept[mine])


def build_exact(items: list[Item]) -> Exact:
    keys, numbers = {}, {}
    for n in sorted({len(item.words) for item in items}):
        own = np.array([k for k, item in enumerate(items) if len(item.words) == n])
        h = np.concatenate([_sequences(np.array(items[k].words, np.uint64), n) for k in own])
        order = np.argsort(h, kind="stable")
        keys[n], numbers[n] = h[order], own[order]
    return Exact(keys, numbers, items)


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + h[k:k + len(out)] + np.uint64(k))
    return out


def search_exact(h: np.ndarray, first: np.ndarray, exact: Exact) -> list[Match]:
    """Items that stand word for word in a text, each at its first place."""
    found = []
    for n, keys in exact.keys.items():
        rolled = _sequences(h, n)
        low = np.searchsorted(keys, rolled)
        hits = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == rolled)
        text = np.searchsorted(first, hits, side="right") - 1
        whole = hits + n <= first[text + 1]
        hits, text = hits[whole], text[whole]
        _, once = np.unique(text * len(keys) + low[hits], return_index=True)
        for at, d in zip(hits[once].tolist(), text[once].tolist()):
            around = h[max(int(first[d]), at - n):min(int(first[d + 1]), at + 2 * HALF + n)].tolist()
            for k in exact.numbers[n][low[at]:np.searchsorted(keys, rolled[at], side="right")].tolist():
                found.append((d, k, at - int(first[d]), 1.0, n, _contains(exact.items[k].answer, around)))
    return found


def search(column: pa.Array, space: Space) -> list[Match]:
    """Verified matches of the texts with the items of one space."""
    return search_space(*_terms(column), space)


def search_space(h: np.ndarray, term: np.ndarray, first: np.ndarray, space: Space) -> list[Match]:
    at, begins = _halves(first, HALF)
    if not len(at):
        return []
    r = space.row[term]
    known = np.flatnonzero(r >= 0)
    half = np.searchsorted(at, known, side="right") - 1
    r = r[known]
    found = []
    live, place = np.unique(half, return_index=True)
    if not len(live):
        return []
    size = 1 << 16
    sums = np.zeros((len(live), space.basis.shape[1]), np.float32)
    edges = np.append(place, len(r))
    for a in range(0, len(live), size):
        b = min(len(live), a + size)
        # At most some thousand words at a time are looked up in the basis.
        c = a
        while c < b:
            d = max(c + 1, int(np.searchsorted(edges, edges[c] + 50_000, side="right")) - 1)
            d = min(d, b)
            own = r[edges[c]:edges[d]]
            sums[c:d] = np.add.reduceat(space.basis[own] * space.weight[own][:, None], edges[c:d] - edges[c], axis=0)
            c = d
    # A passage is a half and the next one of the same text; the last half stands alone too.
    slot = np.full(len(at) + 1, -1, np.int64)
    slot[live] = np.arange(len(live))
    last = np.zeros(len(at), bool)
    last[begins[1:][np.diff(begins) > 0] - 1] = True
    nxt = np.where(last, -1, slot[1:])
    starts = np.flatnonzero((slot[:-1] >= 0) | (nxt >= 0))
    for a in range(0, len(starts), 4096):
        own = starts[a:a + 4096]
        v = np.where((slot[own] >= 0)[:, None], sums[slot[own]], 0) + np.where((nxt[own] >= 0)[:, None], sums[nxt[own]], 0)
        norm = np.linalg.norm(v, axis=1)
        mass = v @ space.latent.T
        near = (mass >= MASS * space.length) & (mass >= COSINE * np.maximum(norm, 1e-9)[:, None])
        for p, k in zip(*np.nonzero(near | (mass >= ALONE * space.length))):
            found.append((int(own[p]), int(space.owner[k]), float(mass[p, k] / max(norm[p], 1e-9))))
    text_of = np.searchsorted(begins, np.arange(len(at)), side="right") - 1
    done = {}
    for p, k, cosine in found:
        item = space.items[k]
        d = int(text_of[p])
        # The item may begin before or end after the passage that was found.
        low, high = max(int(first[d]), int(at[p]) - len(item.words) // 2), min(int(first[d + 1]), int(at[p]) + 2 * HALF + len(item.words))
        window = h[low:high].tolist()
        # No subsequence can be longer than the words in common.
        there = set(window)
        if sum(w in there for w in item.words) < LCS_WITH_ANSWER * len(item.words):
            continue
        common = common_subsequence(item.words, window)
        share = common / len(item.words)
        answered = share >= LCS_WITH_ANSWER and _contains(item.answer, window)
        if share >= LCS_ALONE or answered:
            # The match of most common words stands for the pair; the first of equals.
            if (d, k) not in done or common > done[d, k][4]:
                done[d, k] = (d, k, int(at[p] - first[d]), round(cosine, 4), common, answered)
    return [done[key] for key in sorted(done)]


def blocks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> Iterator[tuple[list[Space], Exact]]:
    """Latent spaces and short items of the benchmark, a bounded block of items at a time.

    benchmark: item_id, text, answer (optional). The corpus is counted once for all blocks; a block is made when it is asked
    for, so the driver holds one.
    """
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer")).where("text is not null")
    count = -(-rows.count() // block)
    if not count:
        return
    counts = document_frequency(docs, _features(rows))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        items = _items(numbered.where(F.col("block") == k).orderBy("item_id", "text").collect())
        yield (build_spaces(docs.sparkSession, [i for i in items if len(i.words) >= SHORTEST], counts),
               build_exact([i for i in items if len(i.words) < SHORTEST]))


def _scans(docs: DataFrame, benchmark: DataFrame, block: int) -> Iterator[list[Broadcast]]:
    """What each scan of the documents looks for: a block's short items and spaces, up to SCAN_BYTES together or one space."""
    send = docs.sparkSession.sparkContext.broadcast
    for found, exact in blocks(docs, benchmark, block):
        own, size = [send(exact)] if exact.items else [], 0
        for space in found:
            if size and size + space.size > SCAN_BYTES:
                yield own
                own, size = [], 0
            own.append(send(space))
            size += space.size
        if own:
            yield own


def _matches(column: pa.Array, targets: list[Broadcast]) -> Iterator[tuple[list[Item], list[Match]]]:
    h, term, first = _terms(column)
    for target in targets:
        own = target.value
        yield own.items, search_exact(h, first, own) if isinstance(own, Exact) else search_space(h, term, first, own)


FOUND = "doc_id long, item_id long, passage long, cosine double, common long, item_words long, answer boolean"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), ("cosine", pa.float64()),
                         ("common", pa.int64()), ("item_words", pa.int64()), ("answer", pa.bool_())])


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs of documents and benchmark items they contain, in their words or nearly so.

    Returns doc_id, item_id, passage (first word of the best passage), cosine, common (words in common, in order),
    item_words, answer (found whole). Empty and null texts hold nothing; an item of fewer than SHORTEST words is reported
    where it stands word for word (cosine 1, at its first place); repeated rows are each reported; an empty benchmark gives no row.
    """
    found = docs.sparkSession.createDataFrame([], FOUND)
    for targets in _scans(docs, benchmark, block):

        def run(batches: Iterator[pa.RecordBatch], targets=targets) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    for items, rows in _matches(part.column("text"), targets):
                        yield pa.RecordBatch.from_pylist(
                            [{"doc_id": ids[d], "item_id": items[k].item_id, "passage": at, "cosine": c, "common": n,
                              "item_words": len(items[k].words), "answer": a} for d, k, at, c, n, a in rows], FOUND_ARROW)

        found = found.unionAll(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without a benchmark item, with all their columns, whatever these are called."""
    kept = docs
    for targets in _scans(docs, benchmark, block):

        def run(batches: Iterator[pa.RecordBatch], targets=targets) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    for _, rows in _matches(part.column("text"), targets):
                        keep[[d for d, *_ in rows]] = False
                    yield part.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
