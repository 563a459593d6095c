from noticemill import vocab
from noticemill.operators import admission, registry as reg
from pyspark.sql import functions as F


def uploads(spark, rows):
    return spark.createDataFrame(
        rows, "seq long, batch_id long, file_name string, content_type string, size_bytes long, magic string, content string"
    )


def test_first_failing_check_wins(spark):
    good = ("application/pdf", 10, "%PDF-", "x")
    rows = [
        (1, 1, "", *good), (2, 1, "a/b.txt", *good), (3, 1, "b.txt", *good), (4, 1, "b.PDF", "text/plain", 10, "%PDF-", "x"),
        (5, 1, "b.pdf", "application/x-pdf", vocab.MAX_UPLOAD_BYTES + 1, "html", "x"),
        (6, 1, "b.pdf", "application/pdf", vocab.MAX_UPLOAD_BYTES, "html", "x"), (7, 1, "b.pdf", *good),
        (8, 1, ".pdf", *good), (9, 1, "a\\b.pdf", *good),
    ]
    got = {r.seq: (r.reject_reason, r.http_status) for r in admission.admission_checks(uploads(spark, rows)).collect()}
    assert got == {
        1: (vocab.REJECT_NAME_MISSING, 400), 2: (vocab.REJECT_NAME_PATH, 400), 3: (vocab.REJECT_SUFFIX, 400),
        4: (vocab.REJECT_CONTENT_TYPE, 400), 5: (vocab.REJECT_SIZE, 413), 6: (vocab.REJECT_SIGNATURE, 400), 7: (None, None),
        8: (vocab.REJECT_SUFFIX, 400), 9: (vocab.REJECT_NAME_PATH, 400)}


def test_one_bad_file_rejects_its_batch(spark):
    rows = [(1, 1, "a.pdf", "application/pdf", 1, "%PDF-", "x"), (2, 1, "b.txt", "application/pdf", 1, "%PDF-", "y"),
            (3, 2, "c.pdf", "application/pdf", 1, "%PDF-", "z")]
    kept = admission.batch_gate(admission.admission_checks(uploads(spark, rows)))
    assert [r.seq for r in kept.collect()] == [3]


def test_names_stay_unique(spark, monkeypatch):
    monkeypatch.setattr(admission, "SEQ_BLOCK", 10)
    frame = spark.range(100).select(F.col("id").alias("seq"), F.lit("a.pdf").alias("safe_name"))
    names = [r.stored_name for r in admission.unique_names(frame).orderBy("seq").collect()]
    assert names[0] == "a.pdf" and names[17] == "a~00000011.pdf" and len(set(names)) == 100


def test_generated_names_never_meet_uploaded_ones(spark):
    uploads = spark.createDataFrame(
        [(0, "a.pdf"), (1, "a.pdf"), (2, "a_00000001.pdf"), (3, "a~00000001.pdf"), (4, "a.pdf")], "seq long, file_name string")
    names = [r.stored_name for r in admission.unique_names(admission.with_safe_names(uploads)).collect()]
    assert len(set(names)) == 5


REGISTRY = (
    "sha string, document_id string, original_file_name string, processing_state string, latest_processing_status string, "
    "latest_payload string, revision int, processed_at long"
)


def registry(spark, rows):
    return spark.createDataFrame(rows, REGISTRY)


def payload(name):
    return '{"schema_version":"2.0","source_document":{"file_name":"%s"}}' % name


def test_every_disposition(spark):
    sha = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256)).first()[0]
    known = registry(spark, [
        (sha("done"), "sha256:" + sha("done"), "stored.pdf", "COMPLETED", "ACCEPTED", payload("first.pdf"), 1, 1),
        (sha("failed"), "d", "f.pdf", "FAILED", "FAILED", None, 1, 1), (sha("busy"), "d", "b.pdf", "PROCESSING", None, None, 1, None),
        (sha("empty"), "d", "e.pdf", "COMPLETED", "ACCEPTED", None, 1, 1)])
    rows = [(i, 1, f"{i}.pdf", "application/pdf", 1, "%PDF-", c)
            for i, c in enumerate(["new", "done", "failed", "busy", "empty", "new"])]
    got = admission.classify_uploads(admission.with_content_id(uploads(spark, rows)), known).orderBy("seq").collect()
    assert [r.disposition for r in got] == [
        "PROCESSED", "REUSED", "PROCESSED", "ALREADY_PROCESSING", "ALREADY_PROCESSING", "DUPLICATE_IN_BATCH"]
    assert got[1].existing_file_name == "first.pdf"


def test_claims(spark):
    known = registry(spark, [("a", "sha256:a", "a.pdf", "COMPLETED", "ACCEPTED", "{}", 3, 9),
                             ("b", "sha256:b", "b.pdf", "FAILED", "FAILED", "{}", 1, 9),
                             ("c", "sha256:c", "c.pdf", "PROCESSING", None, None, 1, None)])
    claims = spark.createDataFrame(
        [(1, "a", "a1", False), (2, "a", "a2", True), (3, "a", "a3", True), (4, "b", "b1", False), (5, "b", "b2", False),
         (6, "c", "c1", True), (7, "d", "d1", False)], "seq long, sha string, file_name string, force boolean")
    got = {r.sha: (r.original_file_name, r.processing_state, r.revision, r.acquired, r.processed_at)
           for r in reg.apply_claims(known, claims).collect()}
    assert got == {"a": ("a2", "PROCESSING", 4, True, None), "b": ("b1", "PROCESSING", 2, True, None),
                   "c": ("c.pdf", "PROCESSING", 1, False, None), "d": ("d1", "PROCESSING", 1, True, None)}


def test_results_and_backfill_ignore_invalid_ids(spark):
    sha = "0" * 64
    known = registry(spark, [])
    log = spark.createDataFrame(
        [(1, "DOCUMENT_RECORD", "x.json", "sha256:" + sha, "FAILED", '{"schema_version":"2.0"}', 1),
         (2, "DOCUMENT_RECORD", "x.json", "sha256:" + sha, "ACCEPTED", payload("x.pdf"), 2),
         (3, "DOCUMENT_RECORD", "x.json", "sha256:" + sha, "FAILED", payload("x.pdf"), 3),
         (4, "DOCUMENT_RECORD", "y.json", "sha256:zz", "ACCEPTED", payload("y.pdf"), 1),
         (5, "EXCEPTION_REPORT", "r.json", None, None, "{}", 1)],
        "seq long, artifact_type string, file_name string, document_id string, processing_status string, payload string, created_at long")
    assert [r.processing_state for r in reg.apply_results(known, log).collect()] == ["FAILED"]
    back = reg.backfill(known, log).collect()
    assert [(r.processing_state, r.original_file_name, r.processed_at) for r in back] == [("COMPLETED", "x.pdf", 2)]


def test_replay_of_a_hot_key_equals_a_loop(spark):
    from noticemill.streaming.jobs import _advance

    log = spark.range(3000).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 977).alias("ts"),
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 11).alias("doc_key"),
        F.element_at(F.array(*[F.lit(a) for a in ("CLAIM", "FORCE", "RESULT_OK", "RESULT_FAIL", "CLAIM")]),
                     (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("action"))
    expected = {}
    for r in log.orderBy("seq").collect():
        state, revision = expected.get(r.doc_key, (None, 0))
        state, step, *_ = _advance(state, r.action)
        expected[r.doc_key] = (state, revision + step)
    assert {r.doc_key: (r.state, r.revision) for r in reg.replay(log).collect()} == expected


def test_selection(spark):
    schema = "seq long, name string, size long, type string"
    current = spark.createDataFrame([(1, "a.pdf", 5, "application/pdf")], schema)
    incoming = spark.createDataFrame(
        [(1, "a.pdf", 5, ""), (2, "b.PDF", 1, ""), (3, "b.PDF", 1, ""), (4, "c.txt", 1, "text/plain")], schema)
    merged, notice = admission.selection_dedup(current, incoming)
    assert [(r.ord.part, r.name) for r in merged.orderBy("ord").collect()] == [(0, "a.pdf"), (1, "b.PDF"), (1, "b.PDF")]
    assert incoming.agg(notice).first()[0] == vocab.SELECTION_NOTICE
