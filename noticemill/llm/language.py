"""Language by a linear-chain conditional random field over the words of a text.

A word's features are its byte n-grams with marks at both ends (so affixes are among them) and the word itself (the
lexicon). Emission weights and transitions are learnt by gradient ascent on the likelihood; forward-backward gives
every word a distribution over languages, in code-switched text too, and a text the mean of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.training import bounded_sample, held_out
from noticemill.llm.words import Words, mix, slices, split_words

BITS = 18
TRAIN_ROWS = 2_400
LEARNERS = 4
EPOCHS, RATE, DECAY = 30, 0.3, 1e-6
LONGEST_GRAM = 4
UNKNOWN = "und"
END = 1  # a byte that no word has


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # float32: features x languages
    transition: np.ndarray  # languages x languages, logarithmic
    start: np.ndarray


def _letters(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)


@dataclass
class Vocabulary:
    """The distinct words of some texts and their features, in one run of numbers per distinct word."""

    of_word: np.ndarray  # distinct word of each word
    features: np.ndarray
    begins: np.ndarray


def _vocabulary(words: Words) -> Vocabulary:
    _, sample, of_word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    starts, ends = words.starts[sample], words.ends[sample]
    lengths = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    buffer = np.full(at[-1], END, np.uint8)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = np.arange(total[-1]) - np.repeat(total[:-1], ends - starts)
    buffer[inside + np.repeat(at[:-1] + 1, ends - starts)] = words.data[inside + np.repeat(starts, ends - starts)]
    owner = np.repeat(np.arange(len(sample)), lengths)
    mask = np.uint64((1 << BITS) - 1)
    owners, numbers = [np.arange(len(sample))], [words_hash(buffer, at) & mask]
    rolled = np.zeros(len(buffer), np.uint64)
    for k in range(LONGEST_GRAM):
        rolled = rolled[:len(buffer) - k] * np.uint64(1000003) + buffer[k:].astype(np.uint64) + np.uint64(7)
        whole = owner[:len(buffer) - k] == owner[k:]
        if k:  # a single byte tells little
            owners.append(owner[:len(buffer) - k][whole])
            numbers.append(mix(rolled[whole] + np.uint64(k << 40)) & mask)
    owners, numbers = np.concatenate(owners), np.concatenate(numbers).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    return Vocabulary(of_word, numbers[order], np.searchsorted(owners[order], np.arange(len(sample) + 1)))


def words_hash(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of each marked word of the buffer, for the lexicon."""
    weighed = (buffer.astype(np.uint64) + np.uint64(3)) * mix(np.arange(len(buffer), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64))
    return mix(np.add.reduceat(weighed, at[:-1])) if len(at) > 1 else np.zeros(0, np.uint64)


def _emissions(v: Vocabulary, emission: np.ndarray) -> np.ndarray:
    """Score of each distinct word for each language: the mean of its features' weights times their root number."""
    count = np.diff(v.begins)
    out = np.zeros((len(count), emission.shape[1]))
    step = 20_000
    for a in range(0, len(count), step):
        b = min(len(count), a + step)
        rows = emission[v.features[v.begins[a]:v.begins[b]]]
        out[a:b] = np.add.reduceat(rows, v.begins[a:b] - v.begins[a], axis=0) / np.sqrt(count[a:b])[:, None]
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution over labels of every word of every chain, and the expected number of each transition.

    All chains go forward together, a word at a time; the longest come first, so those still going are a prefix.
    """
    n, k = scores.shape
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin, length = first[:-1][order], lengths[order]
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)) if n else scores
    jump = np.exp(transition - transition.max())
    forward, backward, expected = np.zeros((n, k)), np.ones((n, k)), np.zeros((k, k))
    if not len(order):
        return forward, expected
    longest = int(length[0])
    alive = np.searchsorted(-length, -np.arange(longest), side="left")
    state = potential[begin] * np.exp(start - start.max())
    state /= state.sum(axis=1, keepdims=True)
    forward[begin] = state
    for t in range(1, longest):
        m = alive[t]
        state = (state[:m] @ jump) * potential[begin[:m] + t]
        state /= state.sum(axis=1, keepdims=True)
        forward[begin[:m] + t] = state
    for t in range(longest - 2, -1, -1):
        m = alive[t + 1]
        at = begin[:m] + t
        onward = potential[at + 1] * backward[at + 1]
        pair = forward[at][:, :, None] * jump[None] * onward[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = onward @ jump.T
        backward[at] = back / back.sum(axis=1, keepdims=True)
    marginal = forward * backward
    return marginal / marginal.sum(axis=1, keepdims=True), expected


def _prepared(column: pa.Array) -> Words:
    return split_words(pc.utf8_lower(pc.fill_null(column, ""))).trimmed()


def _learn(v: Vocabulary, first: np.ndarray, label: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient ascent with per-coordinate rates (AdaGrad) on the mean log-likelihood of the chains."""
    emission = np.zeros((1 << BITS, languages))
    transition, start = np.zeros((languages, languages)), np.zeros(languages)
    seen_e, seen_t, seen_s = np.zeros_like(emission), np.zeros_like(transition), np.zeros_like(start)
    lengths = np.diff(first)
    gold = np.repeat(label, lengths)
    gold_t = np.zeros_like(transition)
    np.add.at(gold_t, (label, label), np.maximum(lengths - 1, 0))
    words, share = max(1, len(gold)), 1 / np.sqrt(np.diff(v.begins))
    owner = np.repeat(np.arange(len(v.begins) - 1), np.diff(v.begins))
    used = np.unique(v.features)
    for _ in range(EPOCHS):
        marginal, expected = forward_backward(_emissions(v, emission)[v.of_word], first, transition, start)
        error = -marginal
        error[np.arange(len(gold)), gold] += 1
        for y in range(languages):
            per_word = np.bincount(v.of_word, weights=error[:, y], minlength=len(share)) * share
            g = np.bincount(v.features, weights=per_word[owner], minlength=1 << BITS)[used] / words - DECAY * emission[used, y]
            seen_e[used, y] += g * g
            emission[used, y] += RATE * g / (np.sqrt(seen_e[used, y]) + 1e-9)
        g = (gold_t - expected) / words
        seen_t += g * g
        transition += RATE * g / (np.sqrt(seen_t) + 1e-9)
        g = np.bincount(label[lengths > 0], minlength=languages) / max(1, len(label)) - marginal[first[:-1][lengths > 0]].sum(axis=0) / max(1, len(label))
        seen_s += g * g
        start += RATE * g / (np.sqrt(seen_s) + 1e-9)
    return emission, transition, start


def train(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 13) -> Model:
    """Learn from a bounded sample (`rows`) of the documents that have a language and are not held out.

    The sample is dealt to LEARNERS tasks; each fits a field over its whole texts and the weights are averaged. Their
    number is bounded by 2**BITS x languages, which bounds what comes to the driver. Without a usable row the model
    has no language and every prediction is `und`.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keys = usable.select("doc_id", "lang").groupBy("doc_id").agg(F.min("lang").alias("label"))
    sample, _ = bounded_sample(keys, "doc_id", rows, seed)
    languages = sorted(r[0] for r in keys.select("label").distinct().collect())
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    size = len(languages)

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        words = _prepared(rows.column("text").combine_chunks())
        label = np.array([languages.index(x) for x in rows.column("label").to_pylist()])
        emission, transition, start = _learn(_vocabulary(words), words.first, label, size) if len(words.starts) else (np.zeros((1, size)), np.zeros((size, size)), np.zeros(size))
        kept = np.flatnonzero(np.abs(emission).max(axis=1) > 1e-3)
        values = [emission[kept].ravel(), transition.ravel(), start]
        places = [np.repeat(kept, size) * size + np.tile(np.arange(size), len(kept)), -1 - np.arange(size * size), -1 - size * size - np.arange(size)]
        yield pa.record_batch([pa.array(np.concatenate(places)), pa.array(np.concatenate(values))], ["place", "value"])

    # The sample is bounded by `rows` ids, so it may be broadcast at any size of the corpus.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = texts.withColumn("stream", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(LEARNERS)))
    learnt = texts.repartition(LEARNERS, "stream").select("doc_id", "text", "label").mapInArrow(learner, "place long, value double")
    found = learnt.groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("votes")).toArrow()
    votes = max(1, int(found["votes"].to_numpy().max())) if found.num_rows else 1
    place, value = found["place"].to_numpy(), found["value"].to_numpy() / votes
    emission = np.zeros((1 << BITS) * size, np.float32)
    emission[place[place >= 0]] = value[place >= 0]
    rest = np.zeros(size * size + size)
    rest[-1 - place[place < 0]] = value[place < 0]
    return Model(languages, emission.reshape(-1, size), rest[:size * size].reshape(size, size), rest[size * size:])


def label_words(column: pa.Array, model: Model) -> tuple[Words, np.ndarray]:
    """The words of each text and the distribution of each over the languages."""
    words = _prepared(column)
    if not len(words.starts) or not model.languages:
        return words, np.zeros((len(words.starts), len(model.languages)))
    v = _vocabulary(words)
    return words, forward_backward(_emissions(v, model.emission)[v.of_word], words.first, model.transition, model.start)[0]


def predict_texts(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language of each text and its share of the words; `und` and 0 for null and texts without a letter."""
    column = pc.fill_null(column, "")
    words, marginal = label_words(column, model)
    n = len(column)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.zeros((n, len(model.languages)))
    for y in range(len(model.languages)):
        total[:, y] = np.bincount(words.docs, weights=marginal[:, y], minlength=n)
    best = total.argmax(axis=1)
    score = total[np.arange(n), best] / np.maximum(total.sum(axis=1), 1e-12)
    known = _letters(column)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.round(np.where(known, score, 0.0), 6)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document; other columns are left behind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                language, score = predict_texts(part.column("text"), shared.value)
                yield pa.record_batch([part.column("doc_id"), pa.array(language, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
