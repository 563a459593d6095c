import re

import numpy as np
import pyarrow as pa

from noticemill.llm.words import distinct_per_text, shingles, slices, split_words

TEXTS = ["Ab  c\td", None, "", "x", "é a b c d e F", "a b c d e f", " ", "a\x0bb\x0cc\rd\ne", " one two"]


def expected(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_and_hashes_follow_the_pattern():
    words = split_words(pa.array(TEXTS))
    for d, text in enumerate(TEXTS):
        own = range(words.first[d], words.first[d + 1])
        assert [words.text(i).translate({i: i + 32 for i in range(65, 91)}) for i in own] == expected(text)
    by_word = {}
    for d, text in enumerate(TEXTS):
        for word, h in zip(expected(text), words.hashes()[words.first[d]:words.first[d + 1]]):
            assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_equal_sets_of_word_runs():
    words = split_words(pa.array(TEXTS))
    values, begins = distinct_per_text(*shingles(words.hashes(), words.first, 5))
    seen = {}
    for d, text in enumerate(TEXTS):
        own = expected(text)
        runs = {tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
        mine = values[begins[d]:begins[d + 1]]
        assert len(mine) == len(runs)
        assert seen.setdefault(frozenset(runs), tuple(mine)) == tuple(mine)


def test_trimmed_drops_outer_punctuation_only():
    words = split_words(pa.array(["(don't), ... a.b! -"])).trimmed()
    assert [words.text(i) for i in range(len(words.starts))] == ["don't", "", "a.b", ""]


def test_hash_does_not_depend_on_place_or_piece():
    filler = "q" * 1000 + " "
    words = split_words(pa.array([filler * 5000 + "needle", "needle"]))
    h = words.hashes()
    assert h[words.first[1] - 1] == h[words.first[1]]
    assert len(np.unique(h)) == 2


def test_slices_keep_all_rows():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 100, 0, 7, 300, 1)]), pa.array(range(6))], ["text", "n"])
    parts = list(slices(batch, "text", 100))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 100 for p in parts)
