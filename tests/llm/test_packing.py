import random
from collections import Counter, defaultdict

import pytest
from llm_cases import nasty, table

from noticemill.llm import packing, queries


def cost_of(placed):
    return sum(packing.cost(c) for c in {b: c for b, c, _ in placed}.values())


def check_bins(sizes, placed, capacities):
    bins = defaultdict(list)
    for size, (b, c, at) in zip(sizes, placed):
        bins[b].append((at, size, c))
    for items in bins.values():
        items.sort()
        assert len({c for *_, c in items}) == 1
        end = 0
        for at, size, _ in items:
            assert at == end
            end += size
        # Cut down to the smallest permitted length that holds the contents.
        assert items[0][2] == min(c for c in capacities if c >= end)


def test_pack_is_whole_and_cheaper_than_one_length():
    rng = random.Random(4)
    for _ in range(20):
        sizes = sorted((rng.choice([rng.randrange(1, 200), rng.randrange(1, 8193)]) for _ in range(rng.randrange(1, 300))), reverse=True)
        placed = packing.pack(sizes)
        check_bins(sizes, placed, packing.CAPACITIES)
        single = packing.pack(sizes, packing.CAPACITIES[-1:])
        check_bins(sizes, single, packing.CAPACITIES[-1:])
        assert cost_of(placed) <= cost_of(single)


def test_best_fit_takes_the_tightest_bin():
    # Bins 70 and 60 of 100 are open; 30 goes to the first, which it fills.
    placed = packing.pack([70, 60, 30], (100,))
    assert [b for b, *_ in placed] == [0, 1, 0]
    assert packing.pack([]) == []


def test_optimum_of_small_cases():
    """Against the least cost over all assignments of up to five items."""
    def best(sizes, capacities):
        least = [float("inf")]

        def go(k, bins):
            if k == len(sizes):
                least[0] = min(least[0], sum(packing.cost(min(c for c in capacities if c >= b)) for b in bins))
                return
            for n in range(len(bins)):
                if bins[n] + sizes[k] <= capacities[-1]:
                    go(k + 1, bins[:n] + [bins[n] + sizes[k]] + bins[n + 1:])
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return least[0]

    rng = random.Random(8)
    ratio = []
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 1025) for _ in range(5)), reverse=True)
        ratio.append(cost_of(packing.pack(sizes, (256, 512, 1024))) / best(sizes, (256, 512, 1024)))
    assert min(ratio) >= 1 - 1e-9 and sum(ratio) / len(ratio) < 1.12


def test_documents_are_cut_and_packed_whole(spark):
    data = nasty()
    found = packing.pack_texts(table(spark, data)).collect()
    want = Counter((r[0], len((r[1] or "").split()) + 1) for r in data if r[0] != 7)
    rows = [r for r in found if r.doc_id != 7]
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.n_tokens
    expected = defaultdict(int)
    for (i, n), k in want.items():
        expected[i] += n * k
    assert whole == expected
    by_bin = defaultdict(list)
    for r in found:
        by_bin[r.bin].append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        assert own[0].fill == sum(r.n_tokens for r in own) <= own[0].capacity
    pieces = sorted(r.piece for r in found if r.doc_id == 8)
    assert pieces == list(range(len(pieces))) and len(pieces) == -(-60_001 // 8192)


def test_odd_lengths_groups_and_empty_table(spark):
    rows = [(i, n) for i, n in enumerate([None, 0, -3, 1, 8192, 8193, 20_000])] + [(None, 5), (9, 7), (9, 7)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long"), group_pieces=3).collect()
    assert {(r.doc_id, r.bin) for r in found if r.n_tokens is None or r.n_tokens <= 0} == {(0, None), (1, None), (2, None)}
    assert sum(r.n_tokens for r in found if r.bin is not None) == sum(n for _, n in rows if n and n > 0)
    assert packing.pack_texts(table(spark, [])).collect() == []


def test_query_packs_by_the_lengths_of_the_tokenizer(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    # The last text has no blank and more tokens than the largest capacity.
    data = [*nasty(), (20, "".join(f"x{k}-" for k in range(9000)), *nasty()[0][2:])]
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_packing(spark, str(tmp_path)).collect()
    want, whole = Counter(), Counter()
    for r in data:
        want[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    for r in found:
        whole[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.capacity
    assert whole == want
    assert want[20] > packing.CAPACITIES[-1] and sum(r.doc_id == 20 for r in found) == -(-want[20] // packing.CAPACITIES[-1])
