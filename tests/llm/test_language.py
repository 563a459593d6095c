import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from llm_cases import nasty, rows, table

from noticemill.llm import language

PARTS = {"aa": ["tion", "the", "ing", "wh", "er"], "bb": ["ción", "ña", "que", "os", "ez"], "cc": ["sch", "über", "keit", "ung", "ß"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=360, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        made += rows([(i, text_of(rng, lang, rng.randrange(5, 60)))], lang)
    return made


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 4, 9])
    scores, transition, start = rng.standard_normal((9, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    marginal, expected = language.forward_backward(scores, first, transition, start)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.array([np.exp(start[p[0]] + sum(scores[a + t, y] for t, y in enumerate(p)) + sum(transition[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for t, y in enumerate(p):
                want[a + t, y] += w
            for x, y in zip(p, p[1:]):
                pairs[x, y] += w
    assert np.allclose(marginal, want) and np.allclose(expected, pairs)


def test_held_out_texts_get_their_language(spark):
    data = corpus()
    # Wrong languages on held-out rows show whether anything is learnt from them.
    turned = [(*d[:2], "bb" if out(d[0]) else d[2], *d[3:]) for d in data]
    found = {r.doc_id: r for r in language.language_digest(table(spark, turned)).collect()}
    held = [d for d in data if out(d[0])]
    assert np.mean([found[d[0]].lang_pred == d[2] for d in held]) > 0.97
    assert {i for i, r in found.items() if r.held_out} == {d[0] for d in held}


def test_words_of_switched_text_are_labelled(spark):
    model = language.train(table(spark, corpus()))
    rng = random.Random(7)
    parts = [(lang, text_of(rng, lang, 30)) for lang in ("aa", "cc", "bb")]
    words, marginal = language.label_words(pa.array([" ".join(t for _, t in parts)]), model)
    best = [model.languages[k] for k in marginal.argmax(axis=1)]
    want = [lang for lang, t in parts for _ in t.split()]
    assert len(best) == len(want) and np.mean([a == b for a, b in zip(best, want)]) > 0.93


def test_nasty_rows_no_languages_and_empty_table(spark):
    data = nasty()
    found = language.language_digest(table(spark, data + corpus(60))).collect()
    assert len(found) == len(data) + 60
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for d in data:
        letters = any(c.isalpha() for c in d[1] or "")
        if d[0] in (3, 4, 5, 10) and not any(r.lang_pred == "und" for r in by_id[d[0]]):
            raise AssertionError(d)
        if letters and d[0] == 7:
            assert any(r.lang_pred != "und" for r in by_id[7])
    without = [(*d[:2], None, *d[3:]) for d in data]
    assert {(r.lang_pred, r.score) for r in language.language_digest(table(spark, without)).collect()} == {("und", 0.0)}
    assert language.language_digest(table(spark, [])).collect() == []
