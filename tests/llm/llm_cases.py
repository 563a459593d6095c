"""Documents that every operator must get through: nulls, empty and very long texts, repeated rows, clashing columns."""

import random

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, shard int, score double, f long, bucket long, "
           "label double, n long, path string, blob string, spans string, root long, component long, stream int, term string")
EXTRA = (1, 0.5, 7, 3, 1.0, 2, "p", "b", "s", 4, 5, 6, "t")


def words(rng, n, size=2000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows(texts, lang="en"):
    return [(i, t, lang, "src0", len(t or ""), *EXTRA) for i, t in texts]


def nasty():
    rng = random.Random(3)
    base = words(rng, 40)
    return rows([
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "Ünïcode – ünd é \U0001F600 ok"),
        (8, words(rng, 60_000)), (9, base + " tail"), (10, "..., !!"),
    ]) + [(None, base, None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]


def table(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def plain(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")
