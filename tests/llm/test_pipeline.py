import random

import corpus_pipeline
import public_tokenizers
from llm_cases import nasty, rows, table, words
from tokenizers import Tokenizer

from noticemill.llm import packing, secrets

BAD = ["vilebad", "awfulest", "nastyword"]


def folder(spark, path, docs, labels, items):
    table(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def planted():
    rng = random.Random(6)
    texts, toxic, labels = {}, set(), []
    for i in range(500):
        own = words(rng, rng.randrange(20, 90), 4000).split()
        bad = i % 4 == 0
        if bad:
            own[3:3] = rng.sample(BAD, 3) + rng.sample(BAD, 2)
            toxic.add(i)
        texts[i] = " ".join(own)
        labels.append((i, 1, int(bad)))
    items = [(k, words(rng, 40, 4000)) for k in range(5)]
    clean = [i for i in texts if i not in toxic]
    copies, leaks, secret = clean[:30:3], clean[60:90:3], clean[120:150:3]
    for n, i in enumerate(copies):
        texts[1000 + n] = texts[i] + ("" if n % 2 else " tail")
    for n, i in enumerate(leaks):
        texts[i] += " " + items[n % 5][1]
    for i in secret:
        texts[i] += " password=hunter2hunter2"
    return texts, labels, items, toxic, set(range(1000, 1000 + len(copies))), set(leaks), set(secret)


def test_each_stage_takes_effect_on_what_is_left(spark, tmp_path):
    texts, labels, items, toxic, copies, leaks, secret = planted()
    sf = folder(spark, tmp_path, rows(sorted(texts.items())), labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    left = set(texts)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for (name, function), gone in zip(corpus_pipeline.STAGES, (toxic, copies, leaks, set(), set())):
        out = function(spark, docs, sf)
        path = str(tmp_path / f"out-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left -= gone
        if name != "packing":
            assert docs.columns == columns, name
            assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
        if name == "secret_scan":
            found = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert all(found[i] == (texts[i].replace("password=hunter2hunter2", secrets.MARK) if i in secret else texts[i]) for i in left)
            # Lengths are the tokenizer's ids and one end id.
            want = {i: len(tokenizer.encode(found[i], add_special_tokens=False).ids) + 1 for i in left}
    packed = docs.collect()
    assert {r.doc_id: r.n_tokens for r in packed} == want
    assert all(r.fill <= r.capacity and r.capacity in packing.CAPACITIES for r in packed)


def test_run_gets_through_odd_and_empty_tables(spark, tmp_path):
    data = nasty()
    sf = folder(spark, tmp_path / "odd", data, [(1, 1, 0), (8, 0, None)], [(1, None), (2, "a short one")])
    kept = corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 10, None], key=str)
    sf = folder(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []
