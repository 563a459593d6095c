import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from llm_cases import nasty, plain, table

from noticemill.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    friends = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            friends[a].append(b)
            friends[b].append(a)
    form = {}
    for w, others in friends.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, n, len(friends[w]), form[w], None if form[w] is None else words[form[w]], root))
    return sorted(rows)


def found(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def corpus(rng, size):
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    out = []
    for k in range(size):
        text = []
        for _ in range(120):
            word = base[min(int(rng.expovariate(0.12)), 59)]
            if rng.random() < 0.2:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice("abÉ×") + word[at:], word[:at] + rng.choice("abÿ") + word[at + 1:]])
            text.append(word.upper() if rng.random() < 0.1 else word)
        out.append((k, rng.choice([" ", "-", "9", "Œ", " Ā"]).join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    docs = corpus(random.Random(seed), 150)
    expected = brute(docs)
    assert len(expected) > 300 and sum(r[2] for r in expected) > 1000 and any(r[3] for r in expected)
    assert found(spelling.variant_groups(plain(spark, docs))) == expected


def test_chain_of_forms_reaches_the_last(spark):
    texts = [(3, "aaaaaaa " * 2 + "aaaaaab " * 20 + "aaaaabb " * 200 + "aaaabbb " * 2000)]
    docs = plain(spark, texts)
    rows = {r["word"]: r for r in spelling.variant_groups(docs, modulus=1 << 40).collect()}
    assert [rows[w]["form"] for w in ("aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb")] == ["aaaaaab", "aaaaabb", "aaaabbb", None]
    assert {r["root"] for r in rows.values()} == {"aaaabbb"}


def test_pivots_are_disjoint_and_rarest():
    assert spelling.choose_pivots([(1, "ab", 0), (1, "bc", 1), (9, "zz", 5)]) == (0, 5)
    assert spelling.choose_pivots([(5, "ab", 3), (1, "bc", 4), (2, "cd", 5)]) == (3, 5)
    rng = random.Random(4)
    for _ in range(300):
        grams = [(rng.randrange(9), "", p) for p in rng.sample(range(9), 3)]
        pairs = [(a[0] + b[0]) for a, b in combinations(grams, 2) if abs(a[2] - b[2]) >= 2]
        left, right = spelling.choose_pivots(grams)
        cost = {p: c for c, _, p in grams}
        assert right - left >= 2 and cost[left] + cost[right] == min(pairs)


def test_every_near_pair_shares_a_key():
    """Random words over two letters, where bigrams repeat: the pair meets under a pivot key of the word with the smaller prefix."""
    rng = random.Random(8)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(4, 9))) for _ in range(300)})
    counts = Counter(w[k:k + 2] for w in words for k in range(len(w) - 1))
    keys = {w: spelling.gram_keys(w, counts) for w in words}
    order = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    for a, b in combinations(words, 2):
        if near(a, b):
            (x, own, _), (y, _, prefix) = (keys[w] for w in sorted((a, b), key=lambda w: order[keys[w][0]]))
            other = keys[b if order[keys[a][0]] <= order[keys[b][0]] else a]
            assert set(own) & set(other[2]), (a, b)


def test_nasty_and_empty_tables(spark):
    docs = nasty() + [(20, "Straße straßen ÉLANÉLAN élanélan Élanélan " * 3, *nasty()[0][2:])]
    assert found(spelling.variant_groups(table(spark, docs))) == brute([d[:2] for d in docs])
    assert spelling.variant_groups(table(spark, [])).count() == 0
    assert spelling.variant_groups(plain(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(table(spark, []), least_length=3)
