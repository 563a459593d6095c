"""N-gram Jaccard join with a count-vector R-tree: connected groups of documents whose shingle sets are alike.

The tokens (word shingles) of a document are hashed into groups. Its counts per group are a point; the sum over groups
of the smaller of two counts bounds the overlap of two documents from above, for points and, with the corner of a box,
for all points of a tree node. Pairs the bound leaves are verified on their shingles.

A single tree over the corpus would compare everything with everything, since unlike documents lie equally far apart.
So the first level of the tree uses the groups' contents: two documents that differ in at most t shingles have the same
shingles in one of any t + 1 groups. Documents are dealt to buckets by the contents of their groups, and no link is lost;
boxes over count vectors prune inside a bucket. Pairs are bounded and verified inside a task, which merges components as it goes: what
leaves it is a row per set or a link that joins two components, never a pair for each two alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.llm.tables import components, stage
from noticemill.llm.words import mix, shingles, slices, split_words

WORDS = 5
# A link: 100 x intersection >= PERCENT x union.
PERCENT = 80
# Below this size every shingle is a group of its own.
SMALL = 16
STEP = 1.5
LEAF = 32
# Rows and shingles of a chunk; a task compares two chunks of a bucket.
BUCKET_ROWS = 2048
BUCKET_SHINGLES = 1 << 21
# Buckets of one smallest set are verified in one task if their sets have no more shingles than this together.
TASK_SHINGLES = 1 << 22
# Ids of documents whose texts are verified are broadcast up to so many (about 100 MB), and joined by a shuffle beyond.
MOST_BROADCAST = 2_000_000
TAG, GONE_ID, GONE_SET, STAYS = "__noticemill_set", "__noticemill_gone_id", "__noticemill_gone_set", "__noticemill_stays"


# ---- sizes, groups and bounds ------------------------------------------------------------------------------------


def _edges(largest: int = 1 << 40) -> np.ndarray:
    edges = [SMALL]
    while edges[-1] < largest:
        edges.append(int(np.ceil(edges[-1] * STEP)))
    return np.array(edges)


EDGES = _edges()


def most_apart(size: int) -> int:
    """Most shingles that stand in one of two linked documents only, if the smaller one has at most `size`.

    Linked sets of a <= b have a + b - 2 x overlap <= (a + b)(100 - p) / (100 + p) and b <= 100 a / p.
    """
    return size * (100 - PERCENT) // PERCENT


def _groups(level: int) -> tuple[int, int]:
    """Number of groups of a size class, and how many of them a link can touch. Some more than the least needed, so that
    it is a rare document whose untouched groups could all be empty."""
    apart = most_apart(int(EDGES[level + 1]) - 1)
    return apart + 1 + 3 + apart // 10, apart


def signatures(tokens: np.ndarray) -> np.ndarray:
    """Bucket numbers of a set: the contents of each group, for its size class and the one below if that is in reach.

    A pair meets in the class of its smaller document. Empty groups count as contents only if there are so many that all
    untouched ones could be empty; then both documents of such a pair have as many.
    """
    n = len(tokens)
    out = []
    if n < SMALL or n * PERCENT <= 100 * (SMALL - 1):
        out.append(mix(tokens ^ np.uint64(0xA5A5A5A5)))
    if n >= SMALL:
        own = int(np.searchsorted(EDGES, n, side="right")) - 1
        levels = [own]
        if own and n * PERCENT <= 100 * (int(EDGES[own]) - 1):
            levels.append(own - 1)
        mixed = mix(tokens + np.uint64(0x51ED2701))
        low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
        for level in levels:
            groups, apart = _groups(level)
            g = (tokens % np.uint64(groups)).astype(np.int64)
            counts = np.bincount(g, minlength=groups)
            total = np.bincount(g, weights=low, minlength=groups).astype(np.uint64) + (
                np.bincount(g, weights=high, minlength=groups).astype(np.uint64) << np.uint64(32))
            salted = mix(total + mix(np.arange(groups, dtype=np.uint64) + np.uint64((level + 1) << 40)))
            filled = counts > 0
            out.append(salted if groups - filled.sum() >= groups - apart else salted[filled])
    return np.concatenate(out)


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Counts per group; as many groups as the power of two from a quarter of the size, so that vectors fold."""
    size = 1 << max(4, int(max(1, len(tokens) // 4)).bit_length())
    return np.minimum(np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size), 65535).astype("<u2")


def fold(vector: np.ndarray, size: int) -> np.ndarray:
    return vector.astype(np.int32).reshape(-1, size).sum(axis=0)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    return int(np.minimum(fold(a, size), fold(b, size)).sum())


def enough(overlap, total):
    """Whether an overlap makes two sets with `total` shingles together a link."""
    return (100 + PERCENT) * overlap >= PERCENT * total


class Node:
    """Box over count vectors: its upper corner, the smallest size in it, the components in it."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.rows = rows
        self.corner = vectors[rows].max(axis=0)
        self.least = int(sizes[rows].min())
        self.most = int(sizes[rows].max())
        own = component[rows]
        self.component = int(own[0]) if (own == own[0]).all() else None
        self.parts: list[Node] = []
        if len(rows) > LEAF and not (self.least == self.most and (vectors[rows] == vectors[rows[0]]).all()):
            spread = vectors[rows].max(axis=0) - vectors[rows].min(axis=0)
            key = sizes[rows] if self.most * PERCENT > 100 * self.least else vectors[rows, int(spread.argmax())]
            order = rows[np.argsort(key, kind="stable")]
            half = len(order) // 2
            self.parts = [Node(order[:half], vectors, sizes, component), Node(order[half:], vectors, sizes, component)]


def tree_blocks(vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray, left: np.ndarray,
                right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unequal components that the summed minima leave: of `left` and `right`, or within `left`.

    A block of pairs at a time; `component` may be merged between blocks, which prunes those to come.
    """
    if not len(left) or right is not None and not len(right):
        return
    a = Node(left, vectors, sizes, component)
    stack = [(a, a if right is None else Node(right, vectors, sizes, component))]
    while stack:
        x, y = stack.pop()
        if x.component is not None and x.component == y.component:
            continue
        if 100 * x.most < PERCENT * y.least or 100 * y.most < PERCENT * x.least:
            continue
        if not enough(int(np.minimum(x.corner, y.corner).sum()), x.least + y.least):
            continue
        if x is y and x.parts:
            stack += [(x.parts[0], x.parts[0]), (x.parts[0], x.parts[1]), (x.parts[1], x.parts[1])]
        elif x.parts and (not y.parts or len(x.rows) >= len(y.rows)):
            stack += [(p, y) for p in x.parts]
        elif y.parts:
            stack += [(x, p) for p in y.parts]
        else:
            for r in range(0, len(x.rows), LEAF):
                own = x.rows[r:r + LEAF]
                for s in range(0, len(y.rows), LEAF):
                    other = y.rows[s:s + LEAF]
                    overlap = np.minimum(vectors[own][:, None], vectors[other][None]).sum(axis=2)
                    ok = enough(overlap, sizes[own][:, None] + sizes[other][None]) & (component[own][:, None] != component[other][None])
                    i, j = np.nonzero(ok)
                    i, j = own[i], other[j]
                    once = i < j if x is y else np.ones(len(i), bool)
                    if once.any():
                        yield i[once], j[once]


def tree_join(vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tree_blocks()."""
    blocks = list(tree_blocks(vectors, sizes, component, left, right))
    none = np.zeros(0, np.int64)
    return (np.concatenate([i for i, _ in blocks]), np.concatenate([j for _, j in blocks])) if blocks else (none, none)


class Verifier:
    """Sets of a task with their components; verified links merge these."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.label = np.unique(component, return_inverse=True)[1]
        distinct, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.member = np.zeros(len(distinct), np.int32)

    def joining(self, vectors: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Links that join components, as few as join all those that any link of the given sets joins."""
        label = self.label[rows]
        for i, j in tree_blocks(vectors, self.sizes[rows], label, left, right):
            for one in np.unique(i):
                others = j[(i == one) & (label[j] != label[one])]
                if not len(others):
                    continue
                own = self._shingles(rows[one])
                self.member[own] = 1
                theirs = [self._shingles(k) for k in rows[others]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in theirs])[:-1]])
                overlap = np.add.reduceat(self.member[np.concatenate(theirs)], starts)
                self.member[own] = 0
                for other in others[enough(overlap, self.sizes[rows[one]] + self.sizes[rows[others]])]:
                    if label[other] != label[one]:
                        yield int(rows[one]), int(rows[other])
                        self.label[self.label == label[other]] = label[one]
                        label[label == label[other]] = label[one]

    def _shingles(self, row: int) -> np.ndarray:
        return self.flat[self.begins[row]:self.begins[row + 1]]


# ---- tables ------------------------------------------------------------------------------------------------------


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, ascending."""
    words = split_words(column)
    values, begins = shingles(words.hashes(), words.first, WORDS)
    for d in range(len(begins) - 1):
        yield np.unique(values[begins[d]:begins[d + 1]])


def fingerprint(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set: equal sets share it; among n different sets two agree with chance n**2 / 2**65."""
    total = mix(tokens + np.uint64(0x7F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0xD6E8FEB86659FD93)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), f (its fingerprint) and counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    n, f, counts = [], [], []
                    for tokens in _sets(part.column("text")):
                        n.append(len(tokens))
                        f.append(fingerprint(tokens))
                        counts.append(count_vector(tokens).tobytes())
                    yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(counts, pa.binary())],
                                          ["doc_id", "n", "f", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, f long, counts binary")


def _bucket_rows(docs: DataFrame) -> DataFrame:
    """(bucket, f) of every document; a set met before in the same task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    buckets, owners, counts = [], [], []
                    for tokens in _sets(part.column("text")):
                        f = fingerprint(tokens) if len(tokens) else None
                        if f is None or f in met:
                            continue
                        met.add(f)
                        own = signatures(tokens)
                        buckets.append(own)
                        owners.append(f)
                        counts.append(len(own))
                    if buckets:
                        yield pa.record_batch([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), counts))],
                                              ["bucket", "f"])

    return docs.select("text").mapInArrow(run, "bucket long, f long")


def _members(rows: DataFrame) -> DataFrame:
    """Buckets with two sets or more: a row (bucket, lead, f) for each but the first, which is the lead.

    The rows of a bucket come one after the other, sorted; no bucket is ever held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, lead, last = None, None, None
        for batch in batches:
            b, f = batch.column("bucket").to_numpy(), batch.column("f").to_numpy()
            if not len(b):
                continue
            begins = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            leads = f[begins].copy()
            same = np.concatenate([[False], (b[1:] == b[:-1]) & (f[1:] == f[:-1])])
            if bucket is not None and b[0] == bucket:
                leads[0] = lead
                same[0] = f[0] == last
            own = np.repeat(leads, np.diff(np.append(begins, len(b))))
            bucket, lead, last = b[-1], own[-1], f[-1]
            keep = (f != own) & ~same
            yield pa.record_batch([pa.array(b[keep]), pa.array(own[keep]), pa.array(f[keep])], ["bucket", "lead", "f"])

    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "f")
    return ordered.mapInArrow(run, "bucket long, lead long, f long")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and summed minima allow a link."""
    side = lambda name: points.select(F.col("f").alias(name), F.col("n").alias(f"n_{name}"), F.col("counts").alias(f"c_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            sums = [bound(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"))
                    for x, y in zip(batch.column("c_a").to_pylist(), batch.column("c_b").to_pylist())]
            keep = pa.array(enough(np.array(sums, np.int64), total), pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links, by their whole texts."""
    side = lambda name: texts.select(F.col("f").alias(name), F.col("text").alias(f"t_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t_a"):
                for some in slices(part, "t_b"):
                    keep = [enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))
                            for x, y in zip(_sets(some.column("t_a")), _sets(some.column("t_b")))]
                    keep = pa.array(keep, pa.bool_())
                    yield pa.record_batch([some.column("a").filter(keep), some.column("b").filter(keep)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """One text for each fingerprint of `holders` (f, doc_id of a document that has it)."""
    side = holders.select(F.col("f").alias("own_f"), F.col("doc_id").alias("own_id"))
    if holders.count() <= MOST_BROADCAST:
        side = F.broadcast(side)
    joined = docs.join(side, F.col("doc_id").eqNullSafe(F.col("own_id"))).select("own_f", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows may share an id, so the text is checked against the fingerprint.
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    f = np.array([fingerprint(x) for x in _sets(part.column("text"))], np.int64)
                    keep = pa.array(f == part.column("own_f").to_numpy(), pa.bool_())
                    yield pa.record_batch([part.column("own_f").filter(keep), part.column("text").filter(keep)], ["f", "text"])

    found = joined.mapInArrow(run, "f long, text string")
    return found.groupBy("f").agg(F.first("text").alias("text"))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) verified first: each set with the lead it shares most buckets with, and with its smallest lead.

    Two a set at most, however large the group it belongs to.
    """
    shared = members.groupBy("lead", "f").agg(F.count("*").alias("times"))
    best = shared.groupBy("f").agg(F.min("lead").alias("low"), F.max(F.struct("times", "lead")).alias("most"))
    return best.select(F.explode(F.array_distinct(F.array("low", "most.lead"))).alias("a"), F.col("f").alias("b"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which come one after the other, as tables."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, n)):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _stacked(counts: list[bytes]) -> np.ndarray:
    vectors = [np.frombuffer(c, "<u2") for c in counts]
    size = min(map(len, vectors))
    return np.stack([fold(v, size) for v in vectors])


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows on either side of a task; None: one chunk with itself."""
    chunk, x, y = run["chunk"].to_numpy(), run["x"][0].as_py(), run["y"][0].as_py()
    return np.flatnonzero(chunk == x), None if x == y else np.flatnonzero(chunk == y)


TASK = ["bucket", "x", "y"]


def _suspects(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of buckets that the bounds leave a partner in another component: bucket, x, y, chunk, f.

    Buckets of one component, nearly all, go no further than a minimum and a maximum. Of buckets with the same sets, told
    by two 64-bit sums, one is looked at: near copies agree in most of their groups. A large bucket is cut into chunks
    by its rows and shingles; each pair of chunks is a task.
    """
    every = members.select("bucket", "f").unionAll(members.select("bucket", F.col("lead").alias("f")).distinct())
    every = every.join(placed.select("f", "n", "component"), "f")
    mixed = every.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("shingles"),
                                        F.bit_xor(F.xxhash64("f")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "f")).alias("two"))
    mixed = mixed.where("lo <> hi").groupBy("rows", "shingles", "one", "two").agg(F.min("bucket").alias("bucket"))
    mixed = mixed.select("bucket", F.ceil(F.greatest(F.col("rows") / BUCKET_ROWS, F.col("shingles") / BUCKET_SHINGLES)).cast("int").alias("chunks"))
    left, _ = stage(every.join(mixed, "bucket"), "mixed")
    dealt = left.withColumn("chunk", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("bucket", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "f", "n", "component")
    dealt = dealt.join(placed.select("f", "counts"), "f").select(*TASK, "chunk", "f", "n", "component", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, TASK):
            touched = np.zeros(len(rows), bool)
            for i, j in tree_blocks(_stacked(rows["counts"].to_pylist()), rows["n"].to_numpy(), rows["component"].to_numpy(), *_sides(rows)):
                touched[i] = touched[j] = True
            if touched.any():
                yield from rows.filter(pa.array(touched)).select([*TASK, "chunk", "f"]).combine_chunks().to_batches()

    return dealt.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(run, dealt.select(*TASK, "chunk", "f").schema)


def _shingle_table(texts: DataFrame) -> DataFrame:
    """f and the shingle hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [x.astype("<u8").tobytes() for x in _sets(part.column("text"))]
                yield pa.record_batch([part.column("f"), pa.array(sets, pa.binary())], ["f", "shingles"])

    return texts.select("f", "text").mapInArrow(run, "f long, shingles binary")


def _joining(suspects: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components, verified on the shingles of the suspects of each task.

    Buckets overlap, and those of one smallest set (lead) most. They share a task, so that a set's shingles go there once;
    where that would be too much for a task, each pair of chunks is its own.
    """
    lead = suspects.groupBy(*TASK).agg(F.min("f").alias("lead"))
    led = suspects.join(lead, TASK)
    weight = led.select("lead", "f").distinct().join(placed.select("f", "n"), "f").groupBy("lead").agg(F.sum("n").alias("shingles"))
    part = F.when(F.col("shingles") <= TASK_SHINGLES, F.lit(0)).otherwise(F.xxhash64(*TASK)).cast("long")
    led = led.join(weight, "lead").select("lead", part.alias("part"), *TASK, "chunk", "f")
    sets = _shingle_table(texts.join(suspects.select("f").distinct(), "f", "left_semi"))
    held = led.select("lead", "part", "f").distinct().join(placed.select("f", "component", "counts"), "f").join(sets, "f")
    rows = held.unionByName(led, allowMissingColumns=True).select("lead", "part", *TASK, "chunk", "f", "component", "counts", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _runs(batches, ["lead", "part"]):
            # The sets stand first, without a bucket.
            known = task.slice(0, task["bucket"].null_count)
            f, counts = known["f"].to_numpy(), known["counts"].to_pylist()
            verifier = Verifier([np.frombuffer(x, "<u8") for x in known["shingles"].to_pylist()], known["component"].to_numpy())
            order = np.argsort(f)
            a, b = [], []
            for unit in _runs(iter(task.slice(known.num_rows).select([*TASK, "chunk", "f"]).to_batches()), TASK):
                at = order[np.searchsorted(f[order], unit["f"].to_numpy())]
                if (verifier.label[at] == verifier.label[at[0]]).all():
                    continue
                for i, j in verifier.joining(_stacked([counts[k] for k in at]), at, *_sides(unit)):
                    a.append(f[i])
                    b.append(f[j])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("bucket").asc_nulls_first(), "x", "y")
    return ordered.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents joined by links. docs: doc_id, text; other columns are left behind.

    Returns doc_id, n (shingles), f (fingerprint of the set), root (fingerprint that names the group) and component
    (smallest doc_id reachable by links), one row per input row. Documents of equal sets are one node, so copies cost nothing. First every set is verified against two
    others it shares buckets with and components are formed; then the sets of a bucket that are still in different
    components are left to the bounds, and verified with those the bounds leave a partner. So a group of near copies of any size takes a few links per document.
    Texts without words are linked with nothing. Null ids: the component is the smallest id that is not null, if any.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, _ = stage(digests(rows), "digests")
    members, _ = stage(_members(_bucket_rows(rows)), "members")
    sets = table.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    stars, _ = stage(_stars(members), "stars")
    touched = members.select("f").unionAll(members.select(F.col("lead").alias("f"))).distinct()
    points, _ = stage(sets.join(touched, "f"), "points")
    texts, _ = stage(_texts(rows, points.select("f", "doc_id")), "texts")
    points = points.select("f", "n", "counts")
    links, _ = stage(_verified(_bounded(stars, points), texts), "links")
    placed = points.join(components(links).withColumnRenamed("node", "f"), "f", "left")
    placed, _ = stage(placed.withColumn("component", F.coalesce("component", "f")), "placed")
    suspects, _ = stage(_suspects(members, placed), "suspects")
    node = components(links.unionAll(_joining(suspects, placed, texts))).withColumnRenamed("node", "f")
    placed = table.select("doc_id", "n", "f").join(node, "f", "left").withColumn("root", F.coalesce("component", "f"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", "n", "f", "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component"))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return similar_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _tagged(docs: DataFrame) -> DataFrame:
    """All columns and the fingerprint of the set, null without words, under a name no table is likely to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    f = [fingerprint(x) if len(x) else None for x in _sets(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f, pa.int64())], [*part.schema.names, TAG])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(TAG, T.LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns: that of the smallest doc_id (null last, then smallest fingerprint).

    Of rows with equal doc_id and equal shingles one stays. Documents without words are all kept. What travels is the
    list of rows to drop (ids and fingerprints): broadcast up to MOST_BROADCAST of them, joined by a shuffle beyond.
    """
    groups, _ = stage(similar_groups(docs).where("n > 0").groupBy("root", "doc_id", "f").agg(F.count("*").alias("rows")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "f")
    best = groups.groupBy("root").agg(F.min(order).alias("best"))
    ranked = groups.join(best, "root").withColumn("stays", order == F.col("best"))
    listed = ranked.where("not stays or rows > 1").select(F.col("doc_id").alias(GONE_ID), F.col("f").alias(GONE_SET), F.col("stays").alias(STAYS))
    listed, _ = stage(listed, "listed")

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows

    tagged = _tagged(docs)
    same = F.col("doc_id").eqNullSafe(F.col(GONE_ID)) & (F.col(TAG) == F.col(GONE_SET))
    kept = tagged.join(side(listed), same, "left_anti")
    repeated = listed.where(F.col(STAYS))
    if not repeated.isEmpty():
        kept = kept.unionAll(tagged.join(side(repeated), same, "left_semi").dropDuplicates(["doc_id", TAG]))
    return kept.drop(TAG)
