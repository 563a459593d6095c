"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import stage
from noticemill.llm.training import bounded_sample, held_out
from noticemill.llm.words import mix, slices, split_words

BITS = 20
# Labelled rows learnt from, at most, and the rows of one learner.
TRAIN_ROWS = 48_000
ROWS_PER_LEARNER = 4_000
EPOCHS = 3
# Chosen by held-out recall on tables of 286, 2,636 and 12,000 rows to learn from; the same at every size.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 1.0
# Text bytes whose features are made at once.
PART_BYTES = 2 << 20
REJECT = 0.7


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, one per hashed feature; most are 0


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every unigram, bigram and one-word skip-gram of the lower-cased texts."""
    words = split_words(pc.utf8_lower(pc.fill_null(column, ""))).trimmed()
    h, doc = words.hashes(), words.docs
    mask = np.uint64((1 << bits) - 1)
    docs, numbers = [doc], [mix(h + np.uint64(1)) & mask]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0876A9A47)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[gap:][same])
            numbers.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same] & mask)
    return np.concatenate(docs), np.concatenate(numbers).astype(np.int64)


def _learn(own: np.ndarray, cuts: np.ndarray, labels: np.ndarray, bits: int, epochs: int) -> tuple[float, np.ndarray]:
    """FTRL-proximal over the examples in the order given; example k has the features own[cuts[k]:cuts[k + 1]].

    Every example also has the last coordinate, the bias, which is without L1.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weigh(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        l1 = np.where(x == bias, 0.0, L1)
        w = -(zx - np.sign(zx) * l1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2)
        return np.where(np.abs(zx) <= l1, 0.0, w)

    for _ in range(epochs):
        for k, label in enumerate(labels):
            x = np.append(own[cuts[k]:cuts[k + 1]], bias)
            w = weigh(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA * w
            n[x] += g * g
    w = weigh(np.arange(size))
    return float(w[bias]), w[:bias]


def _examples(texts: DataFrame, bits: int) -> DataFrame:
    """doc_id, label, stream and the distinct features of each text; the text is left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                doc, number = features(part.column("text"), bits)
                pairs = np.unique((doc << bits) | number)
                cuts = np.searchsorted(pairs >> bits, np.arange(part.num_rows + 1))
                own = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), part.column("label"), part.column("stream"), own],
                                      ["doc_id", "label", "stream", "features"])

    return texts.select("doc_id", "label", "stream", "text").mapInArrow(run, "doc_id long, label double, stream long, features array<int>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS, seed: int = 11) -> Model:
    """Learn from a bounded sample (`rows`) of labelled documents that are not held out.

    docs: doc_id, text; labels: doc_id, toxic (0, 1; null: not labelled; several rows of an id: the largest counts).
    A first job writes the features of the sample. They are dealt to streams of about ROWS_PER_LEARNER rows; each learns
    by itself and the weights are averaged by feature. L1 leaves few of the 2**bits weights, which bounds what comes to
    the driver. Examples are ordered by doc_id, so a learner that is run again ends with the same weights. Without
    labelled rows every score is 0.5.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    sample, expected = bounded_sample(usable, "doc_id", rows, seed)
    streams = max(1, -(-expected // ROWS_PER_LEARNER))

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Streams come one after the other; one is held at a time, as flat arrays.
        own, sizes, marks, stream = [], [], [], None

        def weights() -> pa.RecordBatch:
            cuts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            bias, w = _learn(np.concatenate(own), cuts, np.concatenate(marks), bits, EPOCHS)
            kept = np.flatnonzero(w)
            return pa.record_batch([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], bias))], ["feature", "weight"])

        for batch in batches:
            numbers = batch.column("stream").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(numbers))):
                if a == b:
                    continue
                if stream is not None and numbers[a] != stream:
                    yield weights()
                    own, sizes, marks = [], [], []
                stream = numbers[a]
                part = batch.slice(a, b - a)
                own.append(part.column("features").flatten().to_numpy().copy())
                sizes.append(pc.list_value_length(part.column("features")).to_numpy(zero_copy_only=False))
                marks.append(part.column("label").to_numpy().copy())
        if stream is not None:
            yield weights()

    # The sample is bounded by `rows` ids, so it may be broadcast at any size of the corpus.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.withColumn("stream", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(streams)).cast("long"))
    examples, _ = stage(_examples(texts.withColumn("doc_id", F.col("doc_id").cast("long")), bits), "toxicity-examples")
    ordered = examples.repartition(streams, "stream").sortWithinPartitions("stream", "doc_id", "features")
    learnt = ordered.mapInArrow(learner, "feature long, weight double")
    # A learner that never met a feature votes 0; the bias, met by all, says how many learners there are.
    total = learnt.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("votes")).toArrow()
    weights = np.zeros(1 << bits, np.float32)
    feature, weight, votes = (total[c].to_numpy() for c in ("feature", "weight", "votes"))
    bias = feature == -1
    if not bias.any():
        return Model(0.0, weights)
    learners = int(votes[bias][0])
    weights[feature[~bias]] = weight[~bias] / learners
    return Model(float(weight[bias][0]) / learners, weights)


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Score of each text: every feature counts once a text."""
    bits = int(len(model.weights)).bit_length() - 1
    doc, number = features(column, bits)
    known = np.flatnonzero(model.weights[number])
    pairs = np.unique((doc[known] << bits) | number[known])
    doc, number = pairs >> bits, pairs & ((1 << bits) - 1)
    total = model.bias + np.bincount(doc, weights=model.weights[number].astype(np.float64), minlength=len(column))
    return np.round(1 / (1 + np.exp(-np.clip(total, -35, 35))), 6)


def _with_scores(docs: DataFrame, model: Model, schema, make: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                yield make(part, score_texts(part.column("text"), shared.value))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; other columns are left behind. Null and empty texts get the bias alone."""
    return _with_scores(docs.select("doc_id", "text"), model, "doc_id long, score double",
                        lambda part, s: pa.record_batch([part.column("doc_id"), pa.array(s)], ["doc_id", "score"]))


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents scored below `reject`, with all their columns, whatever these are called."""
    return _with_scores(docs, model, docs.schema, lambda part, s: part.filter(pa.array(s < reject)))


def toxicity_digest(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """Score of every document by a model learnt from the labelled documents that are not held out."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= reject, 1).otherwise(0).cast("int").alias("predicted"))
