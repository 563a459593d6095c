import random
import zlib

import numpy as np
import pyarrow as pa
from llm_cases import nasty, rows, table, words
from pyspark.sql import functions as F

from noticemill.llm import toxicity

BAD = ["vilebad", "awfulest", "nastyword"]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        own = words(rng, rng.randrange(10, 120), 1500).split()
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(BAD) + rng.choice(["", ".", ","]))
        texts.append((i, " ".join(own)))
        labels.append((i, toxic))
    return texts, labels


def label_table(spark, labels):
    return spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_held_out_rows_are_told_apart(spark):
    texts, labels = corpus()
    # Labels of held-out rows are turned round: nothing may be learnt from them.
    turned = [(i, 1 - t if out(i) else t) for i, t in labels]
    found = {r.doc_id: r for r in toxicity.toxicity_digest(table(spark, rows(texts)), label_table(spark, turned)).collect()}
    truth = dict(labels)
    held = [r for r in found.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in texts if out(i)}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())


def test_model_is_sparse_and_the_same_each_time(spark):
    texts, labels = corpus(400)
    docs, known = table(spark, rows(texts)), label_table(spark, labels)
    a, b = toxicity.train(docs, known), toxicity.train(docs.repartition(5), known)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    assert 0 < (a.weights != 0).sum() < 2000


def test_features_are_those_of_a_plain_walk():
    column = pa.array(["A b, c d", None, "", "x"])
    docs, numbers = toxicity.features(column)
    assert np.bincount(docs, minlength=4).tolist() == [4 + 3 + 2, 0, 0, 1]
    again, same = toxicity.features(pa.array(["a B c. D"]))
    assert sorted(same.tolist()) == sorted(numbers[docs == 0].tolist())


def test_learner_minimises_on_separable_data():
    labels = np.arange(400) % 2.0
    own = np.stack([np.where(labels > 0, 1, 2), np.full(400, 3)], axis=1).ravel().astype(np.int32)
    bias, w = toxicity._learn(own, np.arange(0, 801, 2), labels, 20, 3)
    assert w[1] > 0.5 and w[2] < -0.5 and np.count_nonzero(w) <= 3


def test_streams_in_one_partition_learn_apart(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS_PER_LEARNER", 40)
    texts, labels = corpus(700, 8)
    docs, known = table(spark, rows(texts)), label_table(spark, labels)
    model = toxicity.train(docs, known)
    use = sorted((i, y) for i, y in labels if not out(i))
    streams = -(-len(use) // 40)
    ids = spark.createDataFrame([(i,) for i, _ in use], "doc_id long")
    dealt = dict(ids.select("doc_id", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(streams))).collect())
    total, bias = np.zeros(1 << toxicity.BITS), 0.0
    for stream in set(dealt.values()):
        own = [(i, y) for i, y in use if dealt[i] == stream]
        found = [np.unique(toxicity.features(pa.array([texts[i][1]]))[1]) for i, _ in own]
        cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        b, w = toxicity._learn(np.concatenate(found), cuts, np.array([y for _, y in own], float), toxicity.BITS, toxicity.EPOCHS)
        total, bias = total + w, bias + b
    learners = len(set(dealt.values()))
    assert np.allclose(model.weights, total / learners) and np.isclose(model.bias, bias / learners)


def test_nasty_rows_no_labels_and_empty_tables(spark):
    data = nasty()
    labels = [(1, 1), (8, 0), (2, None), (None, 1), (9, 0), (9, 1)]
    found = toxicity.toxicity_digest(table(spark, data), label_table(spark, labels)).collect()
    assert len(found) == len(data)
    assert {(r.doc_id, r.held_out) for r in found} == {(d[0], out(d[0])) for d in data}
    none = toxicity.toxicity_digest(table(spark, data), label_table(spark, [])).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert toxicity.toxicity_digest(table(spark, []), label_table(spark, labels)).collect() == []


def test_stage_keeps_clean_rows_with_all_columns(spark):
    texts, labels = corpus(600, 5)
    docs = table(spark, rows(texts) + nasty())
    model = toxicity.train(docs, label_table(spark, labels))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    scores = toxicity.score(docs, model)
    want = scores.where(F.col("score") < toxicity.REJECT).count()
    assert 0 < want < docs.count() and kept.count() == want
