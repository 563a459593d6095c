import hashlib
import math
import random
import re
import zlib

from llm_cases import nasty, plain, table, words

from noticemill.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def codes(text):
    w = WORD.findall(lower(text))
    return len(w), [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute(docs, target, share=5, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for text in docs:
        for b in codes(text[1])[1]:
            s[b] += 1
    for text in target:
        for b in codes(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows, fit = [], []
    for k, (doc_id, text) in enumerate(docs):
        n, own = codes(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None])
        if n >= least:
            fit.append(k)
    fit.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0]))
    for rank, k in enumerate(fit[:share * len(fit) // 100], 1):
        rows[k][4] = rank
    return rows


def texts(rng, n):
    out = []
    for k in range(n):
        size = rng.choice([0, 1, 2, 5, 19, 20, 21, 60, 200])
        out.append((k, rng.choice([" ", "--", ", ", "\n"]).join(f"{rng.choice(['W', 'é', 'ß', 'x9'])}{rng.randrange(80)}" for _ in range(size)) + rng.choice(["", " ", ".", "…"])))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_features_are_all_runs_of_one_to_three_words():
    text = "The CAT sat-on  9 mats, ÉLAN vitality…ok \x7f\u00a0 End"
    found = [c for part in resampling.features(resampling.collapse(text)) for c in part]
    assert sorted(c % 10_000 for c in found) == sorted(codes(text)[1])
    for n in range(8):
        data = " ".join(f"w{k}" for k in range(n))
        assert resampling.words_of(int(resampling.counted(data).sum())) == n


def test_resampling_equals_brute_force(spark):
    rng = random.Random(5)
    docs = texts(rng, 260) + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (None, None), (900, None), (901, "")]
    target = [t for _, t in texts(rng, 12)] + [None, ""]
    found = resampling.resample(plain(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((list(r) for r in found.collect()), key=key) == sorted(brute(docs, target), key=key)


def test_the_target_is_drawn(spark):
    rng = random.Random(9)
    docs = [(k, words(rng, 60, 50) if k % 10 == 0 else " ".join(f"z{rng.randrange(500)}" for _ in range(60))) for k in range(200)]
    target = spark.createDataFrame([(words(rng, 60, 50),) for _ in range(20)], "text string")
    drawn = resampling.draw(table(spark, [(i, t, "en", "s", 1, 1, 0.5, 7, 3, 1.0, 2, "p", "b", "s", 4, 5, 6, "t") for i, t in docs]), target, share_percent=8)
    rows = drawn.collect()
    assert len(rows) == 16 and all(r["doc_id"] % 10 == 0 for r in rows)
    assert drawn.columns[:2] == ["doc_id", "text"] and "bucket" in drawn.columns


def test_nasty_and_empty_tables(spark):
    docs = nasty()
    found = resampling.resample(table(spark, docs), spark.createDataFrame([], "text string"))
    assert sorted((list(r) for r in found.collect()), key=key) == sorted(brute([d[:2] for d in docs], []), key=key)
    assert resampling.resample(table(spark, []), spark.createDataFrame([("a b",)], "text string")).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{k % 70}" for k in range(5000))
    whole = resampling.counted(text)
    monkeypatch.setattr(resampling, "FLUSH", 100)
    assert (resampling.counted(text) == whole).all() and whole.sum() == 3 * 5000 - 3
