"""Latest-state registry keyed by content hash, and its append-only history.

Registry columns: sha, document_id, original_file_name, processing_state,
latest_processing_status, latest_payload, revision, processed_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.session import scratch_path
from noticemill.sources.latest import LatestTable

COLUMNS = [
    "sha", "document_id", "original_file_name", "processing_state", "latest_processing_status",
    "latest_payload", "revision", "processed_at",
]
ID_PATTERN = "^sha256:[0-9a-f]{64}$"
# Actions composed at a time.
CHUNK_ROWS = 1024


def apply_claims(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Registry after a set of claims (seq, sha, file_name, force).

    After one accepted claim the document is PROCESSING and every later claim
    is refused, so the accepted one is the first that the current state lets
    through: any claim for unknown or failed content, a forced one for
    completed content, none while processing.
    """
    first = claims.groupBy("sha").agg(
        F.min_by("file_name", "seq").alias("_any"),
        F.expr("min_by(file_name, seq) filter (where force)").alias("_forced"),
    )
    joined = registry.join(first, "sha", "full_outer")
    name = (
        "case when processing_state is null or processing_state = 'FAILED' then _any "
        "when processing_state = 'COMPLETED' then _forced end"
    )
    taken = joined.withColumn("_name", F.expr(name)).withColumn("acquired", F.col("_name").isNotNull())
    return taken.select(
        "sha",
        F.expr("coalesce(document_id, concat('sha256:', sha)) as document_id"),
        F.expr("coalesce(_name, original_file_name) as original_file_name"),
        F.expr("if(acquired, 'PROCESSING', processing_state) as processing_state"),
        "latest_processing_status",
        "latest_payload",
        F.expr(
            "case when revision is null then 1 when acquired then revision + 1 else revision end as revision"
        ),
        F.expr("if(acquired, null, processed_at) as processed_at"),
        "acquired",
    )


def _latest(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Latest artifact per valid document id; max_by combines map-side."""
    valid = artifacts.where(
        (F.col("artifact_type") == "DOCUMENT_RECORD") & F.col("document_id").rlike(ID_PATTERN)
    ).withColumn("sha", F.substring("document_id", 8, 64))
    row = F.struct("document_id", "file_name", "processing_status", "payload", "created_at")
    return valid.groupBy("sha").agg(F.max_by(row, F.struct(*order)).alias("a"))


def _payload_name() -> str:
    return "coalesce(get_json_object(a.payload, '$.source_document.file_name'), a.file_name)"


def apply_results(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Upsert finished records: state, status and payload are replaced, the
    revision and the stored file name stay."""
    joined = registry.join(_latest(artifacts, ["created_at", "seq"]), "sha", "full_outer")
    return joined.select(
        "sha",
        F.expr("coalesce(document_id, a.document_id) as document_id"),
        F.expr(f"coalesce(original_file_name, {_payload_name()}) as original_file_name"),
        F.expr(
            "case when a is null then processing_state when a.processing_status = 'FAILED' then 'FAILED' "
            "else 'COMPLETED' end as processing_state"
        ),
        F.expr("if(a is null, latest_processing_status, a.processing_status) as latest_processing_status"),
        F.expr("if(a is null, latest_payload, a.payload) as latest_payload"),
        F.expr("coalesce(revision, 1) as revision"),
        F.expr("if(a is null, processed_at, a.created_at) as processed_at"),
    )


def usable_history(log: DataFrame) -> DataFrame:
    """Artifacts a registry row can be rebuilt from, with their content hash."""
    usable = log.where("processing_status <> 'FAILED' and get_json_object(payload, '$.schema_version') = '2.0'")
    valid = usable.where((F.col("artifact_type") == "DOCUMENT_RECORD") & F.col("document_id").rlike(ID_PATTERN))
    return valid.withColumn("sha", F.substring("document_id", 8, 64))


def history_snapshot(spark: SparkSession, path: str, history: DataFrame) -> LatestTable:
    """Compacted history: the newest usable artifact per content, kept by hash bucket (see sources.latest)."""
    return LatestTable(spark, path, history.schema, "sha", ["created_at", "seq"])


def backfill(registry: DataFrame, log: DataFrame) -> DataFrame:
    """Rebuild missing registry rows from the whole history; known keys stay as they are."""
    usable = usable_history(log)
    row = F.struct(*[c for c in usable.columns if c != "sha"])
    latest = usable.groupBy("sha").agg(F.max_by(row, F.struct("created_at", "seq")).alias("_a")).select("sha", "_a.*")
    return backfill_from(registry, latest)


def backfill_from(registry: DataFrame, latest: DataFrame) -> DataFrame:
    """Rebuild missing registry rows from a snapshot of the history; known keys stay as they are.

    latest: the newest usable artifact per content, as a history_snapshot gives it after it has taken what the log has
    gained. The log itself is not read again.
    """
    missing = latest.join(registry.select("sha"), "sha", "left_anti")
    name = "coalesce(get_json_object(payload, '$.source_document.file_name'), file_name)"
    rebuilt = missing.select(
        "sha",
        "document_id",
        F.expr(f"{name} as original_file_name"),
        F.lit("COMPLETED").alias("processing_state"),
        F.col("processing_status").alias("latest_processing_status"),
        F.col("payload").alias("latest_payload"),
        F.lit(1).cast(registry.schema["revision"].dataType).alias("revision"),
        F.col("created_at").alias("processed_at"),
    )
    return registry.select(*COLUMNS).unionByName(rebuilt)


def registry_snapshot(spark: SparkSession, path: str, registry: DataFrame) -> LatestTable:
    """Registry kept by hash bucket: every change of a row is added, the one of the highest revision and time counts."""
    return LatestTable(spark, path, registry.schema, "sha", ["revision", "processed_at"])


def list_completed(registry: DataFrame) -> DataFrame:
    """Latest payloads of completed documents, oldest first."""
    return registry.where("processing_state = 'COMPLETED' and latest_payload is not null").orderBy(
        "processed_at", "document_id"
    )


def get_document(registry: DataFrame, document_id: str) -> DataFrame:
    return registry.where(
        (F.col("document_id") == document_id) & (F.col("processing_state") == "COMPLETED")
        & F.col("latest_payload").isNotNull()
    )


# What an action does to each state, as (next state, revisions added); states: none, PROCESSING, COMPLETED, FAILED.
STATES = [None, "PROCESSING", "COMPLETED", "FAILED"]
STEPS = {
    "CLAIM": [(1, 1), (1, 0), (2, 0), (1, 1)],
    "FORCE": [(1, 1), (1, 0), (1, 1), (1, 1)],
    "RESULT_OK": [(2, 1), (2, 0), (2, 0), (2, 0)],
    "RESULT_FAIL": [(3, 1), (3, 0), (3, 0), (3, 0)],
}
UNCHANGED = [(0, 0), (1, 0), (2, 0), (3, 0)]
STEP_TYPE = "array<struct<s:int,r:int>>"


def _step(rows: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, r in rows]).cast(STEP_TYPE)


def _composed(steps: Column) -> Column:
    """One step that does what the array of (order..., f) does in its order."""

    def then(done: Column, row: Column) -> Column:
        return F.transform(done, lambda x: F.struct(
            F.get(row["f"], x["s"])["s"].alias("s"), (x["r"] + F.get(row["f"], x["s"])["r"]).alias("r")))

    return F.aggregate(F.array_sort(steps), _step(UNCHANGED), then)


def replay(log: DataFrame) -> DataFrame:
    """Final state and revision per key of an action log (seq, ts, doc_key, action).

    An action maps each of the four states to the next one, and such maps compose associatively.  The log is dealt by
    ranges of (key, time, sequence), so a key with a large share of it, within one day as well, lies in many tasks;
    maps are composed over chunks of CHUNK_ROWS actions, then over the chunks of a range, then over the ranges of a
    key.  No task holds more of a key than a chunk, the chunks of a range, or one row per range.
    Actions of other names change nothing.
    """
    spark = log.sparkSession
    ordered = log.select("doc_key", "ts", "seq", "action").repartitionByRange("doc_key", "ts", "seq").sortWithinPartitions(
        "doc_key", "ts", "seq")
    path = scratch_path(spark, "ordered-log")
    # The id holds the range in its upper bits and the place within it in the lower 33.
    placed = ordered.withColumn("place", F.monotonically_increasing_id())
    placed.select("doc_key", "action", "place").write.parquet(path)
    rows = spark.read.schema("doc_key " + log.schema["doc_key"].dataType.simpleString() + ", action string, place long").parquet(path)
    step = F.coalesce(*[F.when(F.col("action") == name, _step(way)) for name, way in STEPS.items()], _step(UNCHANGED))
    part, chunk = F.shiftright("place", 33), F.floor(F.col("place") / CHUNK_ROWS)
    chunks = rows.groupBy("doc_key", part.alias("part"), chunk.alias("chunk")).agg(
        _composed(F.collect_list(F.struct("place", step.alias("f")))).alias("f"))
    parts = chunks.groupBy("doc_key", "part").agg(_composed(F.collect_list(F.struct("chunk", "f"))).alias("f"))
    whole = parts.groupBy("doc_key").agg(_composed(F.collect_list(F.struct("part", "f"))).alias("f"))
    names = F.array(*[F.lit(n).cast("string") for n in STATES])
    return whole.select("doc_key", F.get("f", F.lit(0))["r"].alias("revision"), F.get(names, F.get("f", F.lit(0))["s"]).alias("state"))
