import zlib
from collections import Counter

from llm_cases import nasty, plain, table, words

from noticemill.llm import sharding


def test_digest_has_gapless_slots_and_grows_into_the_new_shard_only(spark):
    data = nasty()
    found = sharding.shard_digest(table(spark, data)).collect()
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in found) == Counter(
        (r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in data)
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key" for r in found)
    by_key = {}
    assert all(by_key.setdefault(r.doc_id, r.shard) == r.shard for r in found)


def test_more_rows_spread_and_repeat_exactly(spark):
    import random
    rng = random.Random(1)
    docs = plain(spark, [(i, words(rng, 20)) for i in range(3000)])
    first = sharding.shard_digest(docs, bucket_bytes=4096).collect()
    again = sharding.shard_digest(docs.repartition(3), bucket_bytes=4096).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    counts = Counter(r.shard for r in first)
    assert len(counts) == 16 and max(counts.values()) < 1.5 * min(counts.values())
    moved = sum(r.grown_shard != r.shard for r in first)
    assert 0.6 * 3000 / 17 < moved < 1.4 * 3000 / 17
    # A bucket is in a shuffled order, not in that of the ids.
    one = sorted((r.slot, r.doc_id) for r in first if r.shard == 0)
    assert [i for _, i in one] != sorted(i for _, i in one)


def test_written_records_keep_their_texts(spark):
    data = nasty()
    found = sharding.write_shards(table(spark, data), shards=3)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter((r[0], r[1]) for r in data)


def test_empty_table(spark):
    assert sharding.shard_digest(table(spark, [])).collect() == []
