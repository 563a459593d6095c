import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import nasty, plain, table

from noticemill.llm import tokens

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")
TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [tokens.END]


@settings(max_examples=60, database=None, derandomize=True, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip_and_give_any_token(ids):
    block = tokens.encode(np.array(ids, np.uint32))
    assert tokens.decode(block).tolist() == ids
    for k in range(0, len(ids), 37):
        assert tokens.access(block, k) == ids[k]


@settings(max_examples=200, database=None, derandomize=True, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ'.,;:-<|>0é̈́İΣσH̱ \t\n\x0b\x0c\x1c\x85\xa0 ﻿\U0001F600")), max_size=40), max_size=4))
def test_tokens_by_word_equal_those_of_the_whole_text(texts):
    ids, begins = tokens.tokenize(pa.array(texts, pa.string()), PATH)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [ids_of(t) for t in texts]


def test_special_tokens_in_a_text_are_read_as_the_library_reads_them():
    texts = ["a <|endoftext|> b", "x<|startoftext|>y, z.", "<|ENDOFTEXT|>", "it's 'tis we'll."]
    ids, begins = tokens.tokenize(pa.array(texts), PATH)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [ids_of(t) for t in texts]


def check(docs, data):
    blocks = tokens.write_tokens(docs, PATH)
    found = sorted(tokens.read_tokens(blocks).collect(), key=lambda r: r.start)
    assert len(found) == len(data)
    assert [r.doc_id for r in found] == sorted((d for d, _ in data), key=lambda i: (i is not None, i or 0))
    left = {}
    for d, t in data:
        ids = np.array(ids_of(t), "<u4")
        left.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in found:
        assert r.start == at
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    return blocks, at


def test_files_hold_every_document_in_order(spark):
    data = nasty()
    blocks, total = check(table(spark, data), [(r[0], r[1]) for r in data])
    first = [t for d, t in ((r[0], r[1]) for r in data) if d == 1][0]
    start = next(r.start for r in tokens.read_tokens(blocks).collect() if r.doc_id == 1)
    assert [tokens.token_at(blocks, start + k) for k in (0, 3, len(ids_of(first)) - 1)] == [ids_of(first)[k] for k in (0, 3, -1)]
    with pytest.raises(IndexError):
        tokens.token_at(blocks, total)


def test_shuffled_ids_and_empty_table(spark):
    rng = random.Random(2)
    data = [(rng.randrange(100), " ".join(rng.choice(["Tion,", "the", "éa.", "x1"]) for _ in range(rng.randrange(30)))) for _ in range(120)]
    check(plain(spark, data).repartition(4), data)
    assert tokens.token_digest(table(spark, []), PATH).collect() == []


def test_memory_forgets_and_special_tokens_stand_in_texts(monkeypatch):
    rng = random.Random(17)
    parts = ["a", "Bc", "'s", "é", "ß", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", ".", ",", "12", " ", "  ", "\n", " ", "漢", "\U0001F600", ""]
    monkeypatch.setattr(tokens, "MEMORY", 30)
    monkeypatch.setattr(tokens, "_worker", {})
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(40)] + [None]
        ids, begins = tokens.tokenize(pa.array(texts), PATH)
        for k, text in enumerate(texts):
            assert ids[begins[k]:begins[k + 1]].tolist() == ids_of(text)
