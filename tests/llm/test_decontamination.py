import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import nasty, rows, table

from noticemill.llm import decontamination as dec

COMMON = ["the", "of", "and", "to", "in", "is"]


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else f"v{rng.randrange(4000)}" for _ in range(n))


def benchmark_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def planted(seed=1):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(15, 90))) for i in range(40)]
    docs, truth, near = [], set(), set()
    for d in range(300):
        text = prose(rng, rng.randrange(5, 700)).split()
        if d % 3 == 0:
            i, item = items[rng.randrange(40)]
            own = item.split()
            if d % 2:
                # A paraphrase: some words replaced, the order kept.
                for k in rng.sample(range(len(own)), len(own) // 10):
                    own[k] = f"z{rng.randrange(100)}"
                near.add((d, i))
            truth.add((d, i))
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() if d % 5 == 0 else w + ("," if rng.random() < 0.1 else "") for w in own]
        docs.append((d, " ".join(text)))
    return items, docs, truth, near


def test_planted_items_are_found_and_clean_documents_are_not(spark):
    items, docs, truth, _ = planted()
    found = dec.contaminated(table(spark, rows(docs)), benchmark_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    assert all(r.common <= r.item_words for r in found)
    kept = dec.keep_clean(table(spark, rows(docs)), benchmark_table(spark, items))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in truth}
    assert kept.columns == table(spark, []).columns


def test_blocks_of_items_give_the_same(spark):
    items, docs, truth, _ = planted(2)
    made = [space for own, _ in dec.blocks(table(spark, rows(docs)), benchmark_table(spark, items), block=15) for space in own]
    assert len(made) == 3 and sorted(i.item_id for s in made for i in s.items) == list(range(40))
    found = set()
    import pyarrow as pa
    for space in made:
        found |= {(docs[d][0], space.items[k].item_id) for d, k, *_ in dec.search(pa.array([t for _, t in docs]), space)}
    assert found == truth


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((30, 50)) * (rng.random((30, 50)) < 0.2)
    entries = [(p, w, float(dense[p, w])) for p, w in zip(*np.nonzero(dense))]
    frame = spark.createDataFrame(pd.DataFrame(entries, columns=["passage", "word", "value"]))
    basis = dec.randomised_svd(frame, 30, 3)
    size = basis.shape[0]
    want = np.linalg.svd(dense[:, :size], full_matrices=False)[2]
    k = 5
    # The same subspace: the leading vectors lie in the span, and the basis is orthonormal.
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
    assert np.allclose(np.linalg.norm(want[:k] @ basis, axis=1), 1, atol=1e-3)


@settings(max_examples=200, database=None, derandomize=True, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_common_subsequence_equals_the_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert dec.common_subsequence(a, b) == best[-1][-1]


def test_answers_decide_between_the_bounds(spark):
    rng = random.Random(4)
    item = [f"q{k}" for k in range(30)]
    answer = "deep blue answer words"
    # 22 of 34 words stand in order; with the answer that is enough, without it is not.
    docs = rows([(1, prose(rng, 40) + " " + " ".join(item[:18]) + " " + answer), (2, prose(rng, 40) + " " + " ".join(item[:22]))])
    bench = spark.createDataFrame([(7, " ".join(item) + " " + answer, answer)], "item_id long, text string, answer string")
    found = dec.contaminated(table(spark, docs), bench).collect()
    assert [(r.doc_id, r.item_id, r.answer) for r in found] == [(1, 7, True)]


def test_nasty_rows_and_empty_tables(spark):
    data = nasty()
    bench = [(1, data[0][1]), (2, None), (3, ""), (4, "one two"), (None, "some words that no document has at all here")]
    found = dec.contaminated(table(spark, data), benchmark_table(spark, bench)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.doc_id is not None) == [(1, 1), (2, 1), (2, 1), (9, 1)]
    assert [(r.doc_id, r.item_id) for r in found if r.doc_id is None] == [(None, 1)]
    assert dec.contaminated(table(spark, data), benchmark_table(spark, [])).collect() == []
    assert dec.contaminated(table(spark, []), benchmark_table(spark, bench)).collect() == []
    assert dec.keep_clean(table(spark, data), benchmark_table(spark, [])).count() == len(data)


def test_an_item_in_a_third_of_many_short_documents(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 29)) for i in range(20)]
    docs, truth = [], set()
    for d in range(3000):
        text = prose(rng, rng.randrange(5, 60)).split()
        if d % 3 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = items[0][1].split()
            truth.add((d, 0))
        docs.append((d, " ".join(text)))
    found = dec.contaminated(table(spark, rows(docs)), benchmark_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth


def test_more_items_than_the_rank_leave_none_out(spark):
    """Families of like items fill the latent space; items with words of their own and short ones of common words remain."""
    rng = random.Random(12)
    items = []
    for family in range(150):
        own = [f"f{family}x{k}" for k in range(24)]
        for _ in range(3):
            items.append((len(items), " ".join(own[:20] + [f"y{rng.randrange(3000)}" for _ in range(4)])))
    lone = [(1000 + i, " ".join(f"lone{i}x{k}" for k in range(20))) for i in range(10)]
    plain = (2000, " ".join(f"plain{k}" for k in range(8)))
    docs, truth = [], set()
    for d in range(400):
        text = " ".join(" ".join(rng.sample(items[rng.randrange(450)][1].split(), 8)) for _ in range(12)).split()
        text += [f"plain{rng.randrange(8)}" for _ in range(4)]
        rng.shuffle(text)
        if d % 4 == 0:
            i, own = lone[d // 4 % 10] if d % 8 else plain
            at = rng.randrange(len(text) + 1)
            text[at:at] = own.split()
            truth.add((d, i))
        docs.append((d, " ".join(text)))
    found = dec.contaminated(table(spark, rows(docs)), benchmark_table(spark, items + lone + [plain])).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.item_id >= 1000} == truth


def test_short_items_must_stand_word_for_word(spark):
    rng = random.Random(21)
    vocabulary = [f"s{k}" for k in range(8)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    items += [(100, "Capital of France is Paris"), (101, "capital of france is paris."), (102, prose(rng, 30))]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))) for d in range(200)]
    docs += [(300, prose(rng, 50) + ' "Capital of France is Paris", ' + prose(rng, 50)), (301, "capital of france"), (302, "is paris"),
             (303, "capital of france was paris"), (304, prose(rng, 20) + " " + items[-1][1])]

    def words(text):
        return [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()]

    want = {}
    for d, text in docs:
        own = words(text)
        for i, item in items[:-1]:
            part = words(item)
            places = [k for k in range(len(own) - len(part) + 1) if own[k:k + len(part)] == part]
            if places:
                want[d, i] = places[0]
    assert {(300, 100), (300, 101)} <= set(want)
    found = dec.contaminated(table(spark, rows(docs)), benchmark_table(spark, items)).collect()
    short = [r for r in found if r.item_id != 102]
    assert {(r.doc_id, r.item_id): r.passage for r in short} == want and len(short) == len(want)
    assert [r.doc_id for r in found if r.item_id == 102] == [304]
    kept = dec.keep_clean(table(spark, rows(docs)), benchmark_table(spark, items))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {304}


def test_scans_per_block_find_the_same_pairs(spark):
    items, docs, truth, _ = planted(5)
    bench = benchmark_table(spark, items + [(500, "the of")])
    found = dec.contaminated(table(spark, rows(docs)), bench, block=15).collect()
    short = {d for d, text in docs if "the of" in " ".join(w.strip(",") for w in text.lower().split())}
    assert {(r.doc_id, r.item_id) for r in found if r.item_id != 500} == truth
    assert short <= {r.doc_id for r in found if r.item_id == 500}
