import random

from helpers import given, jcp_fields, record_frame
from noticemill import vocab
from noticemill.operators import consensus
from pyspark.sql import functions as F

SCHEMA = (
    "document_id string, pass_no int, path string, value string, status string, "
    "sources array<struct<page:int,evidence:string>>"
)


def fold(rows):
    """Replay of the merge for one field: rows in pass order."""
    state = None
    for value, status, sources in rows:
        if state is None:
            state = [value, status, list(sources)]
            continue
        if value is None and status == "UNKNOWN":
            continue
        if state[1] in vocab.REPLACEABLE_STATUSES:
            state = [value, status, list(sources)]
        elif state[0] == value and state[1] != "CONFLICT":
            state[2] = list(dict.fromkeys([*state[2], *sources]))
        elif value is not None and state[0] != value:
            state[1] = "CONFLICT"
            state[2] = list(dict.fromkeys([*state[2], *sources]))
    return tuple(state[:2]), tuple(state[2])


def random_passes(seed, documents=150, longest=6):
    rng = random.Random(seed)
    rows, expected = [], {}
    for d in range(documents):
        history = []
        for n in range(1, rng.randint(1, longest) + 1):
            value = rng.choice(["A", "B", "C", None])
            status = rng.choice(["EXTRACTED", "EXTRACTED", "AMBIGUOUS", "UNKNOWN", "CONFLICT", "NOT_DISCLOSED"])
            sources = sorted({(1, rng.choice("xyz")) for _ in range(rng.randint(0, 2))})
            history.append((value, status, sources))
            rows.append((str(d), n, "security.share_class", value, status, sources))
        expected[str(d)] = history
    return rows, expected


def test_merge_equals_ordered_replay(spark):
    rows, expected = random_passes(7)
    got = consensus.merge_passes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(expected)
    for r in got:
        state, sources = fold(expected[r.document_id])
        assert (r.value, r.status) == state, (r, expected[r.document_id])
        assert tuple((s.page, s.evidence) for s in r.sources) == sources, (r, expected[r.document_id])


def test_attempts_equal_running_replay(spark):
    rows, _ = random_passes(11, documents=60)
    rng = random.Random(3)
    every = []
    history = {}
    for d, n, _, value, status, sources in rows:
        event = (rng.choice(["DIVIDEND", "STOCK_SPLIT", None]), rng.choice(["EXTRACTED", "AMBIGUOUS"]), [(1, "e")])
        for path, field in (("security.isin", (value, status, sources)), ("corporate_action.event_type", event)):
            every.append((d, n, path, *field))
            history.setdefault(d, {}).setdefault(path, []).append(field)
    got = {
        (r.document_id, r.pass_no): r for r in consensus.attempts(spark.createDataFrame(every, SCHEMA)).collect()
    }
    material = {None: vocab.MATERIAL_ALWAYS}
    material |= {e: vocab.MATERIAL_ALWAYS + n for e, n in vocab.MATERIAL_BY_EVENT.items()}

    def resolved(rows):
        (value, status), sources = fold(rows)
        if status in vocab.UNRESOLVED_STATUSES:
            return False
        if status == "NOT_DISCLOSED":
            return bool(sources)
        return value is not None and bool(sources)

    for d, paths in history.items():
        for n in range(1, len(paths["security.isin"]) + 1):
            event = fold(paths["corporate_action.event_type"][:n])[0][0]
            done = {p for p, rows_ in paths.items() if resolved(rows_[:n])}
            wanted = [vocab.PATH_OF[x] for x in material.get(event, vocab.MATERIAL_ALWAYS) if vocab.PATH_OF[x] not in done]
            assert got[(d, n)].unresolved == wanted, (d, n, paths)
            assert got[(d, n)].outcome == "INSUFFICIENT"


def frame(spark, *rows):
    return spark.createDataFrame([("d", n, p, v, s, [(1, "e")] if v else []) for n, p, v, s in rows], SCHEMA)


def test_two_of_three_is_67(spark):
    rows = frame(
        spark, (1, "security.ticker", "TEST3", "EXTRACTED"), (2, "security.ticker", "OUTR3", "EXTRACTED"),
        (3, "security.ticker", "TEST3", "EXTRACTED"),
    )
    assert consensus.agreement(rows).first().agreement == 67


def test_spelling_and_scale_do_not_matter(spark):
    rows = frame(
        spark,
        (1, "issuer.name", "Energética Vale do Tietê S.A.", "EXTRACTED"),
        (2, "issuer.name", "ENERGETICA VALE DO TIETE SA", "EXTRACTED"),
        (1, vocab.PATH_OF["gross_amount_per_share"], "0.4275", "EXTRACTED"),
        (2, vocab.PATH_OF["gross_amount_per_share"], "0.4275000000", "EXTRACTED"),
        (1, vocab.PATH_OF["ratio"], '{"kind":"NEW_PER_EXISTING","numerator":"1.0","denominator":"20"}', "EXTRACTED"),
        (2, vocab.PATH_OF["ratio"], '{"kind":"NEW_PER_EXISTING","numerator":"1","denominator":"20.00"}', "EXTRACTED"),
    )
    assert {r.agreement for r in consensus.agreement(rows).collect()} == {100}
    assert {r.status for r in consensus.merge_passes(rows).collect()} == {"EXTRACTED"}
    assert consensus.agreement(rows, expected=3).first().agreement == 67
    assert consensus.disagreements(rows).first().consensus


def test_strong_pass_overwrites_what_it_says(spark):
    merged = consensus.merge_passes(frame(spark, (1, "security.ticker", "A", "EXTRACTED"), (2, "security.ticker", "B", "EXTRACTED"),
                                          (1, "security.isin", "I", "EXTRACTED"), (2, "security.isin", "I", "EXTRACTED")))
    verdict = frame(spark, (3, "security.ticker", "B", "EXTRACTED"), (3, "security.isin", None, "UNKNOWN"))
    got = {r.path: (r.value, r.status) for r in consensus.adjudicate(merged, verdict).collect()}
    assert got == {"security.ticker": ("B", "EXTRACTED"), "security.isin": ("I", "EXTRACTED")}


def test_failed_pass_keeps_its_place_in_the_audit(spark):
    rows = frame(spark, (1, "corporate_action.event_type", "DIVIDEND", "EXTRACTED"))
    failed = spark.createDataFrame([("d", 2, "down"), ("e", 1, "down")], "document_id string, pass_no int, error string")
    got = {(r.document_id, r.pass_no): r for r in consensus.attempts(rows, failed).collect()}
    assert got[("d", 2)].outcome == "ERROR" and vocab.PATH_OF["currency"] in got[("d", 2)].unresolved
    assert got[("e", 1)].unresolved == [vocab.PATH_OF[n] for n in vocab.MATERIAL_ALWAYS]
    listed = consensus.attempt_list(consensus.attempts(rows, failed)).where("document_id = 'd'").first()
    assert [a.outcome for a in listed.extraction_attempts] == ["INSUFFICIENT", "ERROR"]


def test_valid_but_incomplete_passes_are_not_masked(spark):
    passes = frame(spark, (1, "security.isin", None, "UNKNOWN"))
    documents = spark.createDataFrame([("d",), ("e",)], "document_id string")
    assert [r.document_id for r in consensus.fallback_set(documents, passes).collect()] == ["e"]


def test_signals_keep_first_position(spark):
    rows = spark.createDataFrame(
        [("d", 2, 0, "JCP", "r", 1, "x"), ("d", 1, 1, "JCP", "r", 1, "x"), ("d", 1, 0, "DIVIDEND", "r", 1, "y")],
        "document_id string, pass_no int, idx int, supports string, rationale string, page int, evidence string",
    )
    got = consensus.merge_signals(rows).first().classification_evidence
    assert [s.supports for s in got] == ["DIVIDEND", "JCP"]


def test_not_disclosed_needs_evidence(spark):
    fields = jcp_fields(payment_date=given(None, 0, status="NOT_DISCLOSED"), ticker=given("X", 0))
    got = record_frame(spark, fields).select(F.expr(consensus.unresolved_of_record()).alias("u")).first().u
    assert got == ["security.ticker", "corporate_action.dates.payment_date"]
