"""Secret scans over a blob ledger: every version is addressed by its content, each blob scanned once per rule version.

DataFrame functions only. A span is a half-open range of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import stage

# Kinds in order of listing, pattern, group that is measured, least length of it.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
# A greedy run that is long enough is found by its least length as well; shorter runs, which are dropped, are not built.
LONG_RUNS = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
RULE_VERSION = 1
# What a text must contain for a rule to be worth running; each rule's matches contain it.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
MARK = "[SECRET]"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Spans of one kind: lengths of the pieces between matches and of the matches, added up.

    split() and regexp_extract_all() walk the same matches from the left, so piece i stands before match i.
    """
    pattern = LONG_RUNS.get(kind, pattern)
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(whole)), F.char_length).alias("gap"),
                        F.transform(whole, F.char_length).alias("long"),
                        F.transform(measured, F.char_length).alias("body"))
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,body:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, row: Column) -> Column:
        begin = (state["at"] + row["gap"]).cast("int")
        end = (begin + row["long"]).cast("int")
        hit = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"),
                       row["body"].cast("int").alias("body"))
        longer = F.when(row["body"] >= least, F.concat(state["found"], F.array(hit))).otherwise(state["found"])
        return F.struct(end.alias("at"), longer.alias("found"))

    every = F.aggregate(rows, start, step, lambda state: state["found"])
    return F.when(F.coalesce(text.rlike(HINTS[kind]), F.lit(False)), every).otherwise(empty)


def find_spans(text: Column) -> Column:
    """All spans of a text, ordered by start and then by kind as listed; null counts as empty."""
    found = [_spans(text, kind, pattern, group, least, n) for n, (kind, pattern, group, least) in enumerate(RULES)]
    return F.sort_array(F.concat(*found))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen. versions: path, text, one row per historical version of a path.

    Returns (findings, ledger): findings has blob and spans for every version of the input (path, blob, spans), the
    ledger one row per (blob, rule_version) with its spans, old rows included. A blob in the ledger under this rule
    version is not scanned again. Copies are scanned once: the version with the smallest path stands for its blob, and
    only these texts are shuffled to the scan. Findings go back to all paths by a join on the blob; the blob of a hot
    group of copies is a skewed key of the left side only, which adaptive execution splits.
    Null text is the empty blob; null paths and repeated rows each get their findings.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select("path", text.alias("text"), F.sha2(text, 256).alias("blob"))
    paths, _ = stage(addressed.select("path", "blob"), "versions")
    fresh = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        fresh = fresh.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    holder = fresh.select(F.col("blob").alias("own_blob"), F.col("path").alias("own_path"))
    chosen = addressed.join(holder, F.col("path").eqNullSafe(F.col("own_path")) & (F.col("blob") == F.col("own_blob")), "left_semi")
    found = chosen.select("blob", find_spans(F.col("text")).alias("spans"))
    # A path that repeats one version gives equal rows; the ledger keeps one of them.
    found = found.groupBy("blob").agg(F.first("spans").alias("spans")).withColumn("rule_version", F.lit(rule_version))
    found, _ = stage(found, "ledger")
    if ledger is not None:
        found = ledger.select("blob", "spans", "rule_version").unionByName(found)
    # Most blobs have no finding: only those with one travel to the join.
    hits = found.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,body:int>>)")
    return paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans")), found


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span replaced by a mark; overlapping spans merge into one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = text.substr(state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        longer = F.concat(state["out"], gap, F.when(span["start"] >= state["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), longer.alias("out"))

    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.char_length(text))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents with every secret replaced by MARK; all columns stay, n_chars (if there is one) counts anew.

    Documents are joined with their blob's findings by content. Only blobs with a finding are listed, and only they are
    rewritten; null texts stay null.
    """
    _, ledger = scan(docs.select(F.col("doc_id").alias("path"), "text"))
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(
        F.col("blob").alias("__noticemill_blob"), F.col("spans").alias("__noticemill_spans"))
    joined_ = docs.join(hits, F.sha2("text", 256) == F.col("__noticemill_blob"), "left")
    found = F.col("__noticemill_spans").isNotNull()
    new = joined_.withColumn("__noticemill_text", F.when(found, redact(F.col("text"), F.col("__noticemill_spans"))).otherwise(F.col("text")))
    out = {name: F.col(name) for name in docs.columns} | {"text": F.col("__noticemill_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(found, F.char_length("__noticemill_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return new.select(*[column.alias(name) for name, column in out.items()])


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Findings of every document: counts per kind, hash of the joined base spans, the spans themselves."""
    findings, _ = scan(docs.select(F.col("doc_id").alias("path"), "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = joined(F.col("spans"))
    return findings.select(F.col("path").alias("doc_id"), *[count(kind) for kind, *_ in RULES],
                           F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
