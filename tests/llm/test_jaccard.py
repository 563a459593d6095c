import random
import re

import numpy as np
from llm_cases import nasty, plain, rows, table, words

from noticemill.llm import jaccard


def shingle_set(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def linked(a, b):
    n = len(a & b)
    return bool(a) and bool(b) and 100 * n >= 80 * (len(a) + len(b) - n)


def brute(texts):
    sets = [shingle_set(t) for _, t in texts]
    near = [[j for j in range(len(sets)) if j != i and linked(sets[i], sets[j])] for i in range(len(sets))]
    out = []
    for i, (d, _) in enumerate(texts):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((d, len(sets[i]), min((texts[j][0] for j in seen if texts[j][0] is not None), default=None)))
    return sorted(out, key=str)


def varied(seed, bases=45):
    """Texts with many pairs just above and just below the threshold, of all sizes and at the edges of size classes."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        n = rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 18, 19, 20, 22, 24, 28, 30, 40, 60, 90, 150, 260, 420])
        base = words(rng, n, 3000).split()
        texts.append(base)
        for _ in range(rng.choice([0, 2, 5, 12])):
            own = list(rng.choice([base, texts[-1]]))
            if rng.random() < 0.5:
                own = own[:max(1, len(own) - int(len(own) * rng.choice([0.05, 0.1, 0.15, 0.18, 0.2, 0.22])))]
            else:
                for _ in range(max(1, int(len(own) * rng.choice([0.005, 0.01, 0.02, 0.025, 0.03])))):
                    own[rng.randrange(len(own))] = f"w{rng.randrange(3000)}"
            texts.append(own)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_groups_equal_brute_force(spark):
    texts = varied(1)
    found = sorted(map(tuple, jaccard.jaccard_digest(plain(spark, texts).repartition(3)).collect()), key=str)
    assert found == brute(texts)


def test_second_round_finds_links_that_the_first_of_a_bucket_has_none_of(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    rng = random.Random(5)
    common = words(rng, 30)
    # Many share a passage; pairs of them are near copies of each other only.
    texts = []
    for i in range(40):
        own = common + " " + words(rng, 40, 5000)
        texts += [(3 * i, own), (3 * i + 1, own + " extra"), (3 * i + 2, common + " " + words(rng, 3, 5000))]
    found = sorted(map(tuple, jaccard.jaccard_digest(plain(spark, texts)).collect()), key=str)
    assert found == brute(texts)


def test_pairs_meet_in_a_bucket_and_pass_the_bounds():
    """No link is lost by buckets, count vectors or the tree; sets of exactly the threshold are the hardest."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(600):
        a_size = int(rng.integers(1, 400))
        total = rng.integers(0, 2**63, 2 * a_size + 10).astype(np.uint64)
        a = total[:a_size]
        drop = int(rng.integers(0, a_size // 4 + 1))
        b = np.concatenate([a[drop:], total[a_size:a_size + int(rng.integers(0, a_size // 4 + 1))]])
        if not len(b) or not jaccard.enough(len(np.intersect1d(a, b)), len(a) + len(b)):
            continue
        met += 1
        a, b = np.sort(a), np.sort(b)
        assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size
        va, vb = jaccard.count_vector(a), jaccard.count_vector(b)
        overlap = jaccard.bound(va, vb)
        assert overlap >= len(np.intersect1d(a, b)) and jaccard.enough(overlap, len(a) + len(b))
    assert met > 150


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(4)
    vectors = rng.poisson(3, (120, 16)).astype(np.int32)
    vectors[60:] = vectors[:60] + (rng.random((60, 16)) < 0.05)
    sizes = vectors.sum(axis=1)
    component = rng.integers(0, 20, 120)
    want = set()
    for i in range(120):
        for j in range(i):
            if component[i] != component[j] and jaccard.enough(int(np.minimum(vectors[i], vectors[j]).sum()), int(sizes[i] + sizes[j])):
                want.add((j, i))
    i, j = jaccard.tree_join(vectors, sizes, component, np.arange(120), None)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)
    i, j = jaccard.tree_join(vectors, sizes, component, np.arange(50), np.arange(50, 120))
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in want if a < 50 <= b}


def test_nasty_rows_and_empty_table(spark):
    data = nasty()
    found = sorted(map(tuple, jaccard.jaccard_digest(table(spark, data)).collect()), key=str)
    assert found == brute([(r[0], r[1]) for r in data])
    assert jaccard.jaccard_digest(table(spark, [])).collect() == []


def test_keep_one_keeps_all_columns_and_one_row_of_each_group(spark):
    data = nasty() + rows([(30, words(random.Random(9), 50)), (31, words(random.Random(9), 50) + " x")])
    found = jaccard.keep_one(table(spark, data))
    assert found.columns == table(spark, data).columns
    kept = found.collect()
    # 1, 2, 2, 9 and the row without an id are one group; texts without words all stay.
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 10, 30, None], key=str)
    assert all(tuple(r) in set(data) for r in kept)


def test_repeated_rows_of_the_best_document_leave_one(spark):
    data = rows([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than these are"), (2, "A b c d e f")])
    assert sorted(r.text for r in jaccard.keep_one(table(spark, data)).collect()) == ["a b c d e f", "other words than these are"]
    none = [(None, "a b c d e f g", *rows([(0, "")])[0][2:])] * 3
    assert len(jaccard.keep_one(table(spark, none)).collect()) == 1
    assert jaccard.keep_one(table(spark, [])).collect() == []
