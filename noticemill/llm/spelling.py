"""Spelling variants by pivotal grams: words one insertion, deletion or replacement apart, and the form each stands for.

Two words are near if exactly one code point is inserted, deleted or replaced. Bigrams of a word are ordered by rarity
over all words; its gram prefix are the first three. One edit destroys at most one of two disjoint bigrams, so of two near
words one has a pivot that the other keeps, and if it has the smaller prefix, in the other's prefix. Position limits: the
edit lies on one side of the kept pivot, so on the other side both words are alike up to their end, and the pivot stands at
the same place counted from there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import stage
from noticemill.llm.words import slices

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form has at least so many times the occurrences of its word.
FORM_TIMES = 10
TYPO_MODULUS = 31
# Bigrams in a prefix: one edit touches two of them, so the third is kept.
PREFIX = 3
# Counts a task gathers before it passes them on; a word met again later gives a further row.
HELD = 200_000
# Counts grow at least tenfold along a chain of forms and are below 2**63: no chain has more than 18 steps.
DOUBLINGS = 5
# The table of bigram counts is broadcast. There are at most 90**2 bigrams of the letters that words are made of.


def document_words(text: str | None, doc_id: int | None, least_length: int = LEAST_LENGTH, modulus: int = TYPO_MODULUS) -> Counter:
    """Words of one text with their occurrences, those of fewer than least_length code points left out.

    A run is lower-cased in A-Z only. If modulus divides the CRC-32 of "<doc_id>:<run>", one code point of it is deleted,
    the same one at each of its occurrences in the document. A null id counts as empty text.
    """
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUNS.findall(lowered)).items():
        if len(run) < least_length:
            continue
        h = crc32(run.encode(), seed)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least_length:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = TYPO_MODULUS) -> DataFrame:
    """word and n, its occurrences in all documents. Texts stay in the scan; a word comes out once a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text, key in zip(part.column("text"), part.column("doc_id").to_pylist()):
                    held.update(document_words(text.as_py(), key, least_length, modulus))
                    if len(held) >= HELD:
                        yield rows()
                        held.clear()
        yield rows()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def choose_pivots(grams: list[tuple[int, str, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of a prefix with the least occurrences together.

    grams: (rarity, gram, place). Dynamic programming over the places in order: the best single bigram that ends before
    the next one begins, and the best pair so far. Three bigrams always hold two disjoint ones.
    """
    ordered = sorted((place, cost) for cost, _, place in grams)
    singles: list[tuple[int, int]] = []  # best (cost, place) among the first k bigrams
    best: tuple[int, int, int] | None = None
    for k, (place, cost) in enumerate(ordered):
        free = k
        while free and ordered[free - 1][0] > place - 2:
            free -= 1
        if free:
            before, left = singles[free - 1]
            if best is None or before + cost < best[0]:
                best = (before + cost, left, place)
        singles.append(min(singles[-1], (cost, place)) if singles else (cost, place))
    assert best is not None
    return best[1], best[2]


def place_keys(word: str, place: int, side: str) -> list[str]:
    """Keys under which a word and a near one meet if the bigram at this place is kept and the edit is not on its `side`.

    Seen from that side, both words are alike up to the end of the bigram. What follows it in the shorter word is halved:
    an edit in the second half leaves the first one alike, any other edit leaves the second one alike at the end of both.
    The shorter word is as long as this one or one code point shorter.
    """
    if side == "R":
        word, place = word[::-1], len(word) - 2 - place
    base, keys = place + 2, []
    for shorter in (len(word), len(word) - 1):
        rest = shorter - base
        if rest < 0:
            continue
        half = rest // 2
        keys.append(f"{side}1 {shorter} {place} {word[:base + half]}")
        if half:
            keys.append(f"{side}2 {shorter} {place} {word[:base]} {word[len(word) - rest + half:]}")
    return keys


def gram_keys(word: str, counts: dict[str, int]) -> tuple[str, list[str], list[str]]:
    """(last bigram of the prefix, keys of the pivots, keys of the prefix) of a word.

    The prefix holds all places of its last bigram, so equal bigrams need no order among themselves. An edit leaves the
    left pivot and all to its left alone, or else the right pivot and all to its right.
    """
    grams = sorted((counts[word[k:k + 2]], word[k:k + 2], k) for k in range(len(word) - 1))
    last = grams[PREFIX - 1][:2]
    left, right = choose_pivots(grams[:PREFIX])
    prefix = [place for cost, gram, place in grams if (cost, gram) <= last]
    return last[1], place_keys(word, left, "L") + place_keys(word, right, "R"), [
        key for place in prefix for side in "LR" for key in place_keys(word, place, side)]


def _index(words: DataFrame, grams: dict[str, int], pivots: bool) -> DataFrame:
    """A row for each key of a word's pivots or prefix: word, n, last (place of the prefix's end in the order), key."""
    ranks = {gram: k for k, (_, gram) in enumerate(sorted((n, gram) for gram, n in grams.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, keys, owner = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                end, own, prefix = gram_keys(word, grams)
                last.append(ranks[end])
                found = own if pivots else prefix
                keys += found
                owner += [k] * len(found)
            at = pa.array(owner, pa.int64())
            yield pa.record_batch([batch.column("word").take(at), batch.column("n").take(at), pa.array(last, pa.int32()).take(at),
                                   pa.array(keys, pa.string())], ["word", "n", "last", "key"])

    return words.mapInArrow(run, "word string, n long, last int, key string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all ordered pairs of near words, each once. words: word, n, each word once.

    Words that meet under a key are alike in all but half of what follows a rare bigram. They are compared inside the
    join, so only near words leave it; a pair met under several keys is one. Bigram counts, at most some eight thousand
    rows, are the only thing every task is told.
    """
    every = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), k -> substring(word, k, 2))")).alias("gram"))
    grams = {row["gram"]: row["n"] for row in every.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    own, other = (_index(words, grams, kind).withColumn("key", F.xxhash64("key")) for kind in (True, False))
    own = own.toDF("a", "n_a", "last_a", "key")
    other = other.toDF("b", "n_b", "last_b", "met")
    near = (F.col("last_a") <= F.col("last_b")) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    found = own.join(other, (F.col("key") == F.col("met")) & near)
    low, high = F.struct(F.col("a").alias("w"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("w"), F.col("n_b").alias("n"))
    once = found.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y")).distinct()
    both = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")
    return once.select(both).select(F.col("p.x.w").alias("a"), F.col("p.x.n").alias("n_a"), F.col("p.y.w").alias("b"), F.col("p.y.n").alias("n_b"))


def variant_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES,
                   modulus: int = TYPO_MODULUS) -> DataFrame:
    """Every word of at least least_length (4 or more) code points and least_count occurrences, with its form and root.

    docs: doc_id, text; other columns are left behind. Returns word, n, n_near, form, form_n, root. A word's form is its
    near word of most occurrences (ties: smallest in code-point order) if these are form_times its own or more; its root is
    the last word reached by following forms, or the word itself.
    Null and empty texts have no words; repeated rows count again; an empty table gives an empty result. Counts are summed
    map-side, so a frequent word is no hot key; what is compared is one row per distinct word.
    """
    if least_length < PREFIX + 1:
        raise ValueError("words need at least four code points to have three bigrams")
    words, _ = stage(word_counts(docs, least_length, least_count, modulus), "words")
    best = near_pairs(words).groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))).alias("top"))
    told = words.join(best, words["word"] == best["a"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.less") >= form_times * F.col("n"), F.col("top.word")).alias("form"),
        F.when(-F.col("top.less") >= form_times * F.col("n"), -F.col("top.less")).cast("long").alias("form_n"))
    told, _ = stage(told, "forms")
    # Follow the forms by doubling: after k rounds a word knows the one 2**k steps on, or its last one.
    step = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step, _ = stage(step.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return told.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
