from difflib import SequenceMatcher
import random

from helpers import GOLDEN_ROWS, given, golden_frame, record_frame
from noticemill.functions import scale
from noticemill.functions.text import normalize_issuer
from noticemill.operators import fuzzy, reconciliation as rc
from pyspark.sql import functions as F


def lookup(spark, large=False, **identifiers):
    names = {"issuer": "issuer_name", "cnpj": "issuer_cnpj", "isin": "isin", "ticker": "ticker", "share_class": "share_class"}
    golden = rc.prepare_golden(golden_frame(spark))
    if large:
        golden.small = False
    record = record_frame(spark, {names[k]: given(v) for k, v in identifiers.items()})
    return rc.enrich(rc.reconcile(record, golden)).first()


def test_exact_match_and_enrichment(spark):
    for large in (False, True):
        r = lookup(spark, large, issuer="COMPANHIA ALFA SA", isin="br-alfa-acnor1")
        ref = r.reference_validation
        assert ref.exact_match and ref.matched_by == ["issuer", "isin"] and ref.conflicts == []
        assert (r.ticker.value, r.ticker.status, r.ticker.origin) == ("ALFA3", "REFERENCE_ENRICHED", "REFERENCE")
        assert r.asset_status.value == "ativo" and r.listing_segment.value == "Novo Mercado"


def test_isin_wins_and_ticker_conflicts(spark):
    r = lookup(spark, isin="BRALFAACNOR1", ticker="BETA4")
    conflict = r.reference_validation.conflicts[0]
    assert (conflict.code, conflict.expected, conflict.observed) == ("REF_TICKER_CONFLICT", "ALFA3", "BETA4")
    assert not r.reference_validation.exact_match
    assert r.ticker.status == "CONFLICT" and r.ticker.value == "BETA4"


def test_strong_identifiers_of_two_rows(spark):
    r = lookup(spark, isin="BRBETAACNPR2", cnpj="12345678000190")
    ref = r.reference_validation
    assert [c.code for c in ref.conflicts] == ["REF_STRONG_IDENTIFIER_CONFLICT"]
    assert ref.reference_record is None and [p.ticker for p in ref.possible_matches] == ["ALFA3", "BETA4"]
    assert r.isin.status == "EXTRACTED"


def test_unknown_share_class_alone_selects_nothing(spark):
    assert lookup(spark, share_class="ON").reference_validation.reference_record is None


def test_reference_rules(spark):
    golden = rc.prepare_golden(golden_frame(spark))
    record = record_frame(spark, {"isin": given("BRGAMAACNOR3"), "ticker": given("GAMA4")})
    got = rc.reference_results(rc.enrich(rc.reconcile(record, golden)), "r").first().r
    assert [(x.rule, x.status) for x in got] == [
        ("REF_ISIN_MATCH", "PASS"), ("REF_TICKER_CONFLICT", "FAIL"), ("REF_ASSET_INACTIVE", "FAIL")]
    nothing = rc.reference_results(rc.reconcile(record_frame(spark, {}), golden), "r").first().r
    assert [x.rule for x in nothing] == ["REF_NO_MATCH"]


def brute(name, rows):
    scored = sorted(
        (-SequenceMatcher(None, name, n).ratio(), issuer, position)
        for position, issuer, n in rows
        if SequenceMatcher(None, name, n).ratio() >= 0.72
    )
    return [(issuer, position) for _, issuer, position in scored[:3]]


def test_suggestions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    words = ["banco", "energia", "vale", "norte", "sul", "agro", "telecom", "participacoes", "do", "brasil", "sa", "aguas"]
    issuers = [" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(60)] + ["a" * 230, "ab" * 115]
    rows = [(i, n, str(i), f"I{i}", f"T{i}", "ON", "x", "ativo") for i, n in enumerate(issuers)]
    golden = rc.prepare_golden(golden_frame(spark, rows))
    asked = [" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(40)] + ["ba" * 112, "zzz"]
    names = spark.createDataFrame([(a,) for a in asked * 3], "name string")
    got = {}
    for r in fuzzy.suggestions(names, golden).orderBy("name", "rank").collect():
        got.setdefault(r.name, []).append((r.issuer, r.position))
    base = [(i, n, n) for i, n in enumerate(issuers)]
    for name in set(asked):
        assert got.get(name, []) == brute(name, base), name


def test_gram_index_loses_no_name_that_reaches_the_threshold():
    rng = random.Random(11)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 24))) for _ in range(400)]
    names += [n[:k] + rng.choice("abd") + n[k + 1:] for n in names for k in (len(n) // 2,)]
    index = fuzzy.GramIndex(names)
    kept = 0
    for asked in names[:60]:
        found = set(index.candidates(asked).tolist())
        assert {j for j, n in enumerate(names) if fuzzy.ratio(asked, n) >= fuzzy._T} <= found
        kept += len(found)
    assert kept < 60 * len(names) * 0.6


def test_suggestions_only_without_a_confirmed_row(spark):
    golden = rc.prepare_golden(golden_frame(spark))
    close = record_frame(spark, {"issuer_name": given("Companhia Alfa Brasil S.A.")})
    done = rc.reconcile(close, golden, keep_key=True)
    r = fuzzy.attach_suggestions(done, golden).first()
    assert [p.ticker for p in r.reference_validation.possible_matches] == ["ALFA3"]
    assert r.reference_validation.reference_record is None
    known = rc.reconcile(record_frame(spark, {"issuer_name": given("Companhia Alfa S.A.")}), golden, keep_key=True)
    assert fuzzy.possible_matches(known, golden).count() == 0


def test_salted_join_keeps_every_row(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    joined = scale.salted_join(facts, dim, ["k"], ["id"])
    assert joined.count() == 1000 and joined.where("v = 1").count() == 334
    assert scale.salted_join(facts, dim, ["k"], ["id"], "left_anti").count() == 1000 - 335


def test_hot_join_salts_frequent_keys_alone(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 50)
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.col("id").cast("string")).alias("k"))
    dim = spark.range(3000).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    hot = scale.hot_keys(facts, ["k"])
    assert hot == [spark.sql("select xxhash64('hot')").first()[0]]
    for how in ("left", "inner", "left_anti", "left_semi"):
        joined, plain = scale.hot_join(facts, dim, ["k"], ["id"], how), facts.join(dim, ["k"], how)
        assert joined.columns == plain.columns
        assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    assert scale.hot_join(facts, dim, ["k"], ["id"]).where("k = 'hot'").count() == 1000


def test_size_check(spark):
    assert scale.fits_broadcast(golden_frame(spark))
    assert not scale.fits_broadcast(golden_frame(spark), limit=100)


def test_running_total_by_blocks(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 == 0).alias("k"), (F.col("id") % 7).alias("v"))
    total = scale.running_total(rows, ["k"], ["id"], scale.block_of(F.col("id"), 16), F.col("v"), "t")
    expected = {}
    for i in range(500):
        expected.setdefault(i % 3 == 0, []).append((i, i % 7))
    for key, values in expected.items():
        running = 0
        got = {r.id: r.t for r in total.where(F.col("k") == key).collect()}
        for i, v in values:
            running += v
            assert got[i] == running


def test_few_names_are_scored_where_very_many_are_similar(monkeypatch):
    import itertools

    import pandas as pd

    # Equal but for four letters, one long name, and issuers that share a name: ties go to the smaller issuer and position.
    known = ["companhia siderurgica " + "".join(c) + " s a" for c in itertools.product("abcde", repeat=4)]
    known += [known[7], known[7], "companhia siderurgica abcd s a" + " e associados" * 4]
    golden = pd.DataFrame({"golden_name": known, "issuer": [f"i{n % 97:02d}" for n in range(len(known))], "position": range(len(known))})
    asked = [known[7] + " participacoes", known[300], "companhia siderurgica xxyz s a", known[-1][:60]]
    real, calls = fuzzy.ratio, []
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: calls.append(b) or real(a, b))
    found = fuzzy._best_of_block(pd.DataFrame({"name": asked}), golden)
    expected = []
    for name in asked:
        scored = sorted((-real(name, k), i, p) for k, i, p in golden.itertuples(index=False))
        expected += [(name, -s, i, p) for s, i, p in scored if -s >= fuzzy._T][:3]
    assert [tuple(r) for r in found.itertuples(index=False)] == expected
    assert len(calls) < len(known) / 2


def test_lookups_hold_a_golden_record_once(spark, monkeypatch):
    rows = golden_frame(spark, [(n, f"Companhia {n} S.A.", f"{n:014d}", f"BR{n:010d}", f"TT{n:06d}", "ON", "Novo Mercado", "ativo") for n in range(40)])
    whole = rc.prepare_golden(rows).rows
    bound = next(limit for limit in range(1000, 10**6, 100) if scale.fits_broadcast(whole, limit))
    # All columns of the golden table together need the bound; what the lookups broadcast needs half of it.
    monkeypatch.setattr(rc, "fits_broadcast", lambda df: scale.fits_broadcast(df, bound * 6 // 10))
    assert rc.prepare_golden(rows).small


def test_records_are_not_shuffled_for_a_large_golden_table(spark):
    from noticemill.operators.extraction import extract_notice
    from helpers import pages_frame

    golden = rc.prepare_golden(golden_frame(spark))
    golden.small = False
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = extract_notice(pages_frame(spark, [("a", 1, "Companhia Alfa S.A.\nISIN BRALFAACNOR1"), ("b", 1, "(ISIN BRBETAACNPR2)"), ("c", 1, "x")]))
        done = rc.reconcile(records, golden)
        plan = done._jdf.queryExecution().executedPlan().toString().split("\n")
        found = {r.document_id: r.reference_validation.reference_record for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {k: v and v.ticker for k, v in found.items()} == {"a": "ALFA3", "b": "BETA4", "c": None}
    # Wide rows cross a shuffle once, as candidates of the pages.
    wide = [line for line, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in line and "net_amount_per_share" in below]
    assert len(wide) == 1, wide
