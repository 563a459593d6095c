"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn more often.

Separators are collapsed to single spaces; one overlapped scan of a regular expression with boundary lookarounds then
gives, at every word, the spans of the runs of one, two and three words that begin there, and their CRC-32 is counted by
bucket. The draw adds seeded Gumbel noise to a document's log weight and takes the highest sums, which is sampling
without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticemill.llm.tables import stage
from noticemill.llm.words import slices

BUCKETS = 10_000
SEED = 42
SHARE_PERCENT = 5
LEAST_WORDS = 20
# Sums of so many features are taken at a time, so a text of any length needs little memory beyond itself.
FLUSH = 1 << 20
# Bytes that are part of a word: digits, small letters, everything beyond ASCII. All others become one space.
SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RUNS = regex.compile(rb"(?<![^ ])([^ ]++)( [^ ]++)?+( [^ ]++)?+(?![^ ])")
STAGED = "doc_id long, n_words long, n_features long, buckets binary, counts binary"


def collapse(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and words parted by single spaces; null is empty."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().translate(SPACED).split())


def features(data: bytes) -> Iterator[list[int]]:
    """CRC-32 of every run of one to three words of a collapsed text, in lists of bounded length."""
    found: list[int] = []
    add = found.append
    for match in RUNS.finditer(data, overlapped=True):
        one, two, three = match.groups()
        code = crc32(one)
        add(code)
        if two is not None:
            code = crc32(two, code)
            add(code)
            if three is not None:
                add(crc32(three, code))
        if len(found) >= FLUSH:
            yield found
            found = []
            add = found.append
    if found:
        yield found


def counted(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of the text in each bucket."""
    total = np.zeros(buckets, np.int64)
    for codes in features(collapse(text)):
        total += np.bincount(np.array(codes, np.int64) % buckets, minlength=buckets)
    return total


def words_of(n_features: int) -> int:
    """Number of words of a text with so many features: n words have n, n - 1 and n - 2 runs."""
    return n_features if n_features < 2 else 2 if n_features == 3 else n_features // 3 + 1


def count_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the document's own buckets with their counts, packed.

    Texts never leave the scan: what is written is some six bytes for each distinct bucket of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                words, sizes, keys, counts = [], [], [], []
                for text in rows.column("text"):
                    own = counted(text.as_py(), buckets)
                    at = np.flatnonzero(own)
                    sizes.append(int(own.sum()))
                    words.append(words_of(sizes[-1]))
                    keys.append(at.astype("<u4" if buckets > 1 << 16 else "<u2").tobytes())
                    counts.append(own[at].astype("<i8" if sizes[-1] >= 1 << 32 else "<u4").tobytes())
                yield pa.record_batch(
                    [rows.column("doc_id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(counts, pa.binary())], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STAGED)


def _unpack(keys: pa.Scalar, counts: pa.Scalar, n_features: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(keys.as_py(), "<u4" if buckets > 1 << 16 else "<u2"),
            np.frombuffer(counts.as_py(), "<i8" if n_features >= 1 << 32 else "<u4").astype(np.int64))


def bucket_totals(counted_docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents in each bucket. A task gives one row a bucket; the driver holds one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for keys, counts, n in zip(batch.column("buckets"), batch.column("counts"), batch.column("n_features").to_pylist()):
                at, own = _unpack(keys, counts, n, buckets)
                total[at] += own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = counted_docs.select("buckets", "counts", "n_features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in sums.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus, of each bucket, each with one more feature a bucket."""
    n = len(corpus)
    over, under = int(corpus.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((int(t) + 1) * over / ((int(s) + 1) * under))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a standard Gumbel variable that only the seed and the id decide; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(counted_docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each counted document; the gains are one number a bucket."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for keys, counts, n in zip(batch.column("buckets"), batch.column("counts"), batch.column("n_features").to_pylist()):
                at, own = _unpack(keys, counts, n, buckets)
                weights.append(int(gain[at] @ own))
            scores = [w + noise(k, seed) for w, k in zip(weights, batch.column("doc_id").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                                   pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                                  ["doc_id", "n_words", "n_features", "weight", "score"])

    return counted_docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its weight towards the target, its score and, if drawn, its rank.

    docs: doc_id, text; target: text; other columns are left behind. Returns doc_id, n_features, weight, score, rank.
    Of the N documents with at least `least_words` words, the floor(share_percent * N / 100) highest scores are drawn and
    ranked from 1; ties go to the smaller doc_id, a null doc_id comes last, and equal rows take neighbouring ranks.
    Null and empty texts have no features, weight 0 and no rank; repeated rows each count and can each be drawn; an empty
    corpus gives an empty result, and with an empty target the corpus alone decides.

    The scan of the texts runs once. Ranks come from a sort by ranges of narrow rows: the place within a range is
    numbered as it is written, and only the sizes of the ranges are added up.
    """
    own, _ = stage(count_features(docs, buckets), "features")
    aim, _ = stage(count_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), "target")
    weighed, _ = stage(weigh(own, gains(bucket_totals(own, buckets), bucket_totals(aim, buckets)), seed).withColumn(
        "row", F.monotonically_increasing_id()), "weighed")
    fit = F.col("n_words") >= least_words
    ordered = weighed.where(fit).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ordered, _ = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    # monotonically_increasing_id holds the partition in its upper bits and the place within it in the lower 33.
    ordered = ordered.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), (F.sum("n").over(Window.partitionBy())).alias("all"))
    placed = ordered.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place") + 1)
    drawn = F.when(F.col("rank") <= F.floor(F.col("all") * share_percent / 100), F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, drawn).unionByName(weighed.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns: the rows of docs whose doc_id was drawn; null ids are left out."""
    chosen = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__noticemill_id")).distinct()
    return docs.join(chosen, docs["doc_id"] == chosen["__noticemill_id"], "left_semi")
