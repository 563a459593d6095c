import math

import numpy as np

from noticemill.llm import vectors

COLUMNS = "vec_id long, embedding array<float>, label int, rep long, copies long, cell int, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 0, 0, 0, "x") for i, v, y in rows], COLUMNS)


def brute(rows):
    unit = {}
    for k, (i, v, y) in enumerate(rows):
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.sqrt(x @ x)
    near = {k: [] for k in range(len(rows))}
    for a in unit:
        for b in unit:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                near[a].append(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(near[k]), low, None if i is None else i == low))
    return sorted(out, key=str)


def noisy(rng, base, scale):
    v = base + rng.standard_normal(len(base)) * scale
    return v.astype(np.float32).tolist()


def clusters(seed, n=220, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            # Noise around the threshold: a cosine of 0.98 is a relative distance of 0.2.
            rows.append((int(1000 - len(rows)), noisy(rng, base, rng.choice([0.0, 0.05, 0.1, 0.14])), int(rng.integers(3))))
    return rows


ODD = [
    (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0),
    (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0), (9, [2.0, 2.0], 0), (10, [1.0, 1.0], 1), (11, [1.0, 1.0, 0.0], 0), (None, [1.0, 1.0], 0),
    (12, [1.0, 1.0], 0), (13, [3e38, 3e38], 0), (14, [1e-38, 1e-38], 0), (15, [-0.0, 5.0], 2), (16, [0.0, 5.0], 2),
]


def found(spark, rows):
    return sorted(map(tuple, vectors.near_duplicates(frame(spark, rows)).collect()), key=str)


def test_links_and_components_equal_brute_force(spark):
    rows = clusters(1)
    assert found(spark, rows) == brute(rows)


def test_cells_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 12)
    rows = clusters(2, 260)
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    assert found(spark, ODD) == brute(ODD)


def test_vectors_that_share_an_id_stay_apart(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a, 0), (7, b, 0), (7, a, 1), (9, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (4, c, 0), (4, c, 0), (7, b, 0)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_recall_of_the_count_at_the_threshold():
    """Pairs exactly at the threshold, the hardest ones, are candidates but for a share of MISS."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    lines = vectors._lines(64, 17, vectors.LINES)
    hits = (np.abs((a - b) @ lines) <= 0.2 * vectors.WINDOW).sum(axis=1)
    assert (hits >= vectors.least_count()).mean() >= 0.999


def test_collisions_count_windows():
    rng = np.random.default_rng(6)
    p = rng.standard_normal((60, 9))
    for left, right in ((np.arange(60), None), (np.arange(20), np.arange(20, 60))):
        i, j = vectors.collisions(p, 0.4, 3, left, right)
        want = {(a, b) for a in left for b in (left if right is None else right) if (right is not None or a < b) and (np.abs(p[a] - p[b]) <= 0.4).sum() >= 3}
        assert set(zip(i.tolist(), j.tolist())) == {(int(a), int(b)) for a, b in want} and len(i) == len(want)
