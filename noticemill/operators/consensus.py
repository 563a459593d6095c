"""Several extraction passes -> one value per field, with agreement.

Passes are a long table: (document_id, pass_no, path, value, status, sources)
with every extracted path present once per valid pass; sources are
array<struct<page, evidence>>.  The ordered merge is decomposed into
commutative aggregates (first settled pass, first contradicting pass, first
position of every source), so copies and hot documents combine map-side
instead of being collected and folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.sqltext import array_of, case_of, compact, in_list, q
from noticemill.functions.text import (
    normalize_cnpj,
    normalize_code,
    normalize_issuer,
    normalize_share_class,
    normalize_text,
)

KEY = ["document_id", "path"]
SOURCE = "struct<page:int,evidence:string>"
ATTEMPT = (
    "struct<strategy:string,outcome:string,pass_number:int,model:string,unresolved_fields:array<string>,error:string>"
)
CHECK = "struct<code:string,passed:boolean,message:string>"
_WEAK = in_list(vocab.REPLACEABLE_STATUSES)
_DECIMAL_PATHS = [vocab.PATH_OF[n] for n in vocab.DECIMAL_FIELDS]
_PRESENT = "(value is not null or status <> 'UNKNOWN')"


def _plain_number(text: str) -> str:
    """Number without sign of scale: '0.4200', '.42' and '42E-2' compare equal.

    A power of ten is written out when the result has at most 18 digits on
    either side of the point; beyond that the text stands for itself.
    """
    power = f"cast(regexp_extract({text}, '[eE]([+-]?[0-9]+)$', 1) as int)"
    exact = f"abs({power}) <= 9 and length({text}) <= 12"
    out = f"if({text} rlike '[eE]', if({exact}, cast(try_cast({text} as decimal(38,18)) as string), {text}), {text})"
    whole = f"regexp_replace({out}, '^(-?)(?=[.])', '$10')"
    digits = f"regexp_replace({whole}, '^(-?)0+(?=[0-9])', '$1')"
    short = f"if(contains({digits}, '.'), rtrim('.', rtrim('0', {digits})), {digits})"
    number = f"regexp_replace({short}, '^-0$', '0')"
    return f"if({text} rlike '^-?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$', {number}, {text})"


def canonical_value(path: str = "path", value: str = "value") -> Column:
    """Form in which two passes' values of a path are compared."""
    p, v = F.col(path), F.col(value)
    ratio = F.from_json(v, "kind string, numerator string, denominator string, percentage string")
    parts = [
        F.expr(_plain_number(f"from_json({value}, 'numerator string, denominator string, percentage string').{c}"))
        for c in ("numerator", "denominator", "percentage")
    ]
    ratio_text = F.concat_ws("|", ratio["kind"], *[F.coalesce(x, F.lit("-")) for x in parts])
    return (
        F.when(p == "issuer.name", normalize_issuer(v))
        .when(p == "issuer.cnpj", normalize_cnpj(v))
        .when(p.isin("security.isin", "security.ticker"), normalize_code(v))
        .when(p == "security.share_class", normalize_share_class(v))
        .when(p == vocab.PATH_OF["currency"], normalize_text(v))
        .when(p.isin(_DECIMAL_PATHS), F.expr(_plain_number(value)))
        .when((p == vocab.PATH_OF["ratio"]) & v.isNotNull(), ratio_text)
        .otherwise(v)
    )


def agreement(passes: DataFrame, expected: int | None = None) -> DataFrame:
    """(document_id, path, agreement): share of the commonest (value, status)."""
    votes = (
        passes.select(*KEY, canonical_value().alias("canonical"), "status")
        .groupBy(*KEY, "canonical", "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n") if expected is None else F.greatest(F.sum("n"), F.lit(expected))
    return votes.groupBy(*KEY).agg(
        F.bround(F.max("n") * F.lit(100.0) / total, 0).cast("int").alias("agreement")
    )


def agreement_map(scores: DataFrame) -> DataFrame:
    """(document_id, agreement map); a document has at most 20 paths."""
    return scores.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "agreement"))).alias("agreement")
    )


def _anchors(passes: DataFrame) -> DataFrame:
    """Per field: first settled pass, last unsettled one, very first pass."""
    row = "struct(pass_no, value, status, sources)"
    return passes.groupBy(*KEY).agg(
        F.expr(
            f"min(struct(pass_no, value, status, sources, canonical)) filter (where status not in {_WEAK})"
        ).alias("anchor"),
        F.expr(f"max({row}) filter (where {_PRESENT} and status in {_WEAK})").alias("last_weak"),
        F.expr(f"min({row})").alias("first_pass"),
    )


def _later(passes: DataFrame, anchors: DataFrame) -> DataFrame:
    """What passes after the anchor add, per field.

    conflict_pass: first pass contradicting the anchor; same_pass: first one
    repeating it; same_sourced: first repeating one with evidence; extras: every
    source with its first position among repeating and contradicting passes.
    """
    after = (
        passes.join(anchors.where("anchor is not null").select(*KEY, "anchor"), KEY)
        .where(f"pass_no > anchor.pass_no and {_PRESENT}")
        .withColumn("same", F.expr("canonical <=> anchor.canonical"))
        .withColumn("differs", F.expr("value is not null and not same"))
        .where("same or differs")
    )
    exploded = after.select(*KEY, "pass_no", "same", "differs", F.posexplode_outer("sources").alias("idx", "source"))
    per_source = exploded.groupBy(*KEY, "source").agg(
        F.expr("min(struct(pass_no, idx)) filter (where same)").alias("same_at"),
        F.expr("min(struct(pass_no, idx)) filter (where differs)").alias("differs_at"),
        F.expr("min(pass_no) filter (where same)").alias("same_pass"),
        F.expr("min(pass_no) filter (where differs)").alias("conflict_pass"),
    )
    # One row per distinct source: the same rows the result's source list holds.
    return per_source.groupBy(*KEY).agg(
        F.min("conflict_pass").alias("conflict_pass"),
        F.min("same_pass").alias("same_pass"),
        F.expr("min(same_pass) filter (where source is not null)").alias("same_sourced"),
        F.expr("collect_list(struct(source, same_at, differs_at)) filter (where source is not null)").alias("extras"),
    )


def merge_passes(passes: DataFrame) -> DataFrame:
    """(document_id, path, value, status, sources) after the ordered merge.

    The first settled pass fixes the value; repeating passes add evidence until
    a contradiction, a contradiction makes the field CONFLICT for good, and
    unsettled passes before the first settled one are simply replaced.
    """
    keyed = passes.withColumn("canonical", canonical_value())
    anchors = _anchors(keyed)
    state = anchors.join(_later(keyed, anchors), KEY, "left")
    sticky = "anchor.status = 'CONFLICT'"
    in_time = f"(not ({sticky}) and (conflict_pass is null or e.same_at.pass_no < conflict_pass))"
    # Position of a source: its earliest eligible occurrence.
    position = f"least(if({in_time}, e.same_at, null), e.differs_at)"
    added = (
        f"transform(array_sort(filter(transform(coalesce(extras, array()), e -> struct({position} as at, e.source as source)), "
        "x -> x.at is not null)), x -> x.source)"
    )
    contributed = (
        f"(conflict_pass is not null or (not ({sticky}) and same_pass is not null))"
    )
    staged = state.withColumn("_added", F.expr(added))
    return staged.select(
        *KEY,
        F.expr("if(anchor is not null, anchor.value, coalesce(last_weak, first_pass).value)").alias("value"),
        F.expr(
            "case when anchor is null then coalesce(last_weak, first_pass).status "
            "when conflict_pass is not null then 'CONFLICT' else anchor.status end"
        ).alias("status"),
        F.expr(
            "case when anchor is null then coalesce(last_weak, first_pass).sources "
            f"when {contributed} then array_distinct(concat(anchor.sources, _added)) else anchor.sources end"
        ).alias("sources"),
    )


def merge_signals(signals: DataFrame) -> DataFrame:
    """Classification signals of all passes, each once, first position kept.

    ``signals``: (document_id, pass_no, idx, supports, rationale, page, evidence),
    and extraction_method once they are grounded.
    """
    content = ["supports", "rationale", "page", "evidence"]
    content += [c for c in ["extraction_method"] if c in signals.columns]
    source = ", ".join(f"s.{c}" for c in content[2:])
    once = signals.groupBy("document_id", *content).agg(F.min(F.struct("pass_no", "idx")).alias("at"))
    return once.groupBy("document_id").agg(
        F.expr(
            f"transform(array_sort(collect_list(struct(at, {', '.join(content)}))), "
            f"s -> struct(s.supports, s.rationale, struct({source}) as source))"
        ).alias("classification_evidence")
    )


def adjudicate(merged: DataFrame, verdict: DataFrame) -> DataFrame:
    """A strong pass overwrites every field it says something about."""
    said = verdict.where(_PRESENT).select(*KEY, F.struct("value", "status", "sources").alias("_v"))
    return merged.join(said, KEY, "left").select(
        *KEY, *[F.expr(f"if(_v is not null, _v.{c}, {c})").alias(c) for c in ("value", "status", "sources")]
    )


# -- material fields -----------------------------------------------------------------


def _resolved(f: str = "") -> str:
    p = f"{f}." if f else ""
    return (
        f"({p}status not in {in_list(vocab.UNRESOLVED_STATUSES)} and ({p}status = 'NOT_APPLICABLE' "
        f"or ({p}status = 'NOT_DISCLOSED' and size({p}sources) > 0) "
        f"or ({p}status <> 'NOT_DISCLOSED' and {p}value is not null and size({p}sources) > 0)))"
    )


def _material_paths(event: str) -> str:
    """Material paths of an event type, in order."""
    always = [q(vocab.PATH_OF[n]) for n in vocab.MATERIAL_ALWAYS]
    by_event = {
        e: array_of(always + [q(vocab.PATH_OF[n]) for n in names]) for e, names in vocab.MATERIAL_BY_EVENT.items()
    }
    return case_of(event, by_event, array_of(always))


def unresolved(fields: DataFrame) -> DataFrame:
    """(document_id, event_type, unresolved) from long merged fields."""
    event_path = q(vocab.PATH_OF["event_type"])
    per_document = fields.groupBy("document_id").agg(
        F.expr(f"max(value) filter (where path = {event_path})").alias("event_type"),
        # at most the 20 paths of a record
        F.expr(f"collect_set(path) filter (where {_resolved()})").alias("_done"),
    )
    return per_document.select(
        "document_id",
        "event_type",
        F.expr(f"filter({_material_paths('event_type')}, p -> not array_contains(_done, p))").alias("unresolved"),
    )


def unresolved_of_record() -> str:
    """The same list for a wide record, as an expression."""

    def open_of(names: list[str]) -> str:
        return compact([(f"not coalesce({_resolved(n)}, false)", q(vocab.PATH_OF[n])) for n in names])

    by_event = {e: open_of(names) for e, names in vocab.MATERIAL_BY_EVENT.items()}
    return f"concat({open_of(vocab.MATERIAL_ALWAYS)}, {case_of('event_type.value', by_event, 'array()')})"


def escalation_set(merged: DataFrame) -> DataFrame:
    """Documents needing a strong pass: some material field is unresolved."""
    return unresolved(merged).where("size(unresolved) > 0")


def fallback_set(documents: DataFrame, passes: DataFrame) -> DataFrame:
    """Documents without any valid pass; only these use pattern extraction."""
    valid = passes.select("document_id").distinct()
    return documents.join(valid, "document_id", "left_anti")


def choose_extraction(pass_records: DataFrame, pattern_records: DataFrame, passes: DataFrame) -> DataFrame:
    """Merged passes where there are any, pattern records elsewhere."""
    return pass_records.unionByName(fallback_set(pattern_records, passes), allowMissingColumns=True)


def disagreements(passes: DataFrame, expected: int = vocab.BASIC_PASSES) -> DataFrame:
    """(document_id, responses, paths, consensus): reported fields on which the
    passes disagree, sorted by path."""
    present = passes.groupBy(*KEY).agg(
        F.expr(f"max({_PRESENT})").alias("present"), F.count(F.lit(1)).alias("responses")
    )
    scored = present.join(agreement(passes, expected), KEY)
    return scored.groupBy("document_id").agg(
        F.max("responses").alias("responses"),
        F.expr("array_sort(collect_set(path) filter (where present and agreement < 100))").alias("paths"),
    ).withColumn("consensus", F.expr(f"responses >= {expected} and size(paths) = 0"))


# -- audit trail ----------------------------------------------------------------------


def attempts(passes: DataFrame, failures: DataFrame | None = None, basic_passes: int | None = None) -> DataFrame:
    """One audit row per pass over the running merge.

    A field is resolved exactly from the pass that settles it (with evidence)
    up to the pass that contradicts it, so the running state needs two numbers
    per field instead of a replay.  ``failures``: (document_id, pass_no, error).
    """
    keyed = passes.withColumn("canonical", canonical_value())
    anchors = _anchors(keyed)
    state = anchors.join(_later(keyed, anchors), KEY, "left")
    since = (
        "case when anchor is null or anchor.status = 'CONFLICT' then null "
        "when anchor.status = 'NOT_APPLICABLE' then anchor.pass_no "
        "when anchor.status <> 'NOT_DISCLOSED' and anchor.value is null then null "
        "when size(anchor.sources) > 0 then anchor.pass_no else same_sourced end"
    )
    spans = state.select(*KEY, F.expr(since).alias("since"), F.col("conflict_pass").alias("until")).groupBy(
        "document_id"
    ).agg(
        F.expr("collect_list(struct(path, since, until)) filter (where since is not null)").alias("spans")
    )
    event_path = vocab.PATH_OF["event_type"]
    event_rows = keyed.where(F.col("path") == event_path).select(
        "document_id", "pass_no", F.lit(None).cast("string").alias("error"),
        F.expr(f"if({_PRESENT} and status in {_WEAK}, struct(value), null)").alias("weak"),
    )
    if failures is not None:
        event_rows = event_rows.unionByName(
            failures.select("document_id", "pass_no", "error", F.expr("cast(null as struct<value:string>) as weak"))
        )
    # Passes of one document are few by construction (the extractor's pass count).
    seen = Window.partitionBy("document_id").orderBy("pass_no").rowsBetween(Window.unboundedPreceding, 0)
    running = event_rows.withColumn("weak", F.last("weak", ignorenulls=True).over(seen))
    event_anchor = anchors.where(F.col("path") == event_path).select("document_id", F.col("anchor").alias("event_anchor"))
    joined = running.join(event_anchor, "document_id", "left").join(spans, "document_id", "left")
    event = "if(event_anchor.pass_no <= pass_no, event_anchor.value, weak.value)"
    done = (
        "exists(coalesce(spans, array()), s -> s.path = p and s.since <= pass_no "
        "and (s.until is null or s.until > pass_no))"
    )
    staged = joined.withColumn("event_type", F.expr(event)).withColumn(
        "unresolved", F.expr(f"filter({_material_paths('event_type')}, p -> not {done})")
    )
    basic = "true" if basic_passes is None else f"pass_no <= {basic_passes}"
    return staged.select(
        "document_id",
        "pass_no",
        F.expr(f"if({basic}, 'BASIC_LLM', 'STRONG_LLM')").alias("strategy"),
        F.expr(
            "case when error is not null then 'ERROR' when size(unresolved) > 0 then 'INSUFFICIENT' "
            "else 'SUFFICIENT' end"
        ).alias("outcome"),
        "unresolved",
        "error",
    )


def attempt_list(rows: DataFrame) -> DataFrame:
    """(document_id, extraction_attempts) in pass order."""
    return rows.groupBy("document_id").agg(
        F.expr(
            "transform(array_sort(collect_list(struct(pass_no, strategy, outcome, unresolved, error))), a -> "
            "struct(a.strategy, a.outcome, cast(a.pass_no as int) as pass_number, cast(null as string) as model, "
            "a.unresolved as unresolved_fields, a.error))"
        ).cast(f"array<{ATTEMPT}>").alias("extraction_attempts")
    )


def pattern_attempt(missing: str) -> str:
    """Attempt list of a record that came from pattern extraction alone; missing: column of its unresolved paths."""
    return (
        f"cast(array(named_struct('strategy', 'PYTHON', 'outcome', if(size({missing}) > 0, 'INSUFFICIENT', "
        f"'SUFFICIENT'), 'pass_number', 1, 'model', cast(null as string), 'unresolved_fields', {missing}, "
        f"'error', cast(null as string))) as array<{ATTEMPT}>)"
    )


# -- preliminary checks -----------------------------------------------------------------


def ungrounded_fields() -> str:
    """Paths of fields that claim the document without surviving evidence."""
    items = [
        f"if({n}.origin = 'DOCUMENT' and {n}.status <> 'UNREADABLE' "
        f"and {n}.status in {in_list(vocab.DOCUMENT_STATUSES)} and size({n}.sources) = 0, {q(p)}, null)"
        for n, p in vocab.FIELDS
    ]
    return f"array_compact({array_of(items)})"


def preliminary_checks(records: DataFrame, name: str = "preliminary_checks") -> DataFrame:
    """Eight ordered checks between consensus and escalation.

    ``records`` are grounded, not yet enriched, and carry reference_validation,
    validations_dates / _financial / _event, unresolved, disagreements,
    responses and weak_ocr_pages.
    """

    def check(code: str, passed: str, detail: str | None) -> str:
        ok, bad = vocab.CHECKS[code]
        failed = q(bad) if detail is None else f"concat({q(bad)}, {detail})"
        return (
            f"named_struct('code', {q(code)}, 'passed', {passed}, 'message', if({passed}, {q(ok)}, {failed}))"
        )

    def failed(group: str, only: str = "true") -> str:
        return f"transform(filter(validations_{group}, v -> v.status = 'FAIL' and {only}), v -> v.rule)"

    staged = records.withColumns(
        {
            "_ungrounded": F.expr(ungrounded_fields()),
            "_dates": F.expr(failed("dates")),
            "_money": F.expr(failed("financial")),
            "_class": F.expr(failed("event", "v.rule in ('EVENT_CLASSIFICATION_CONFLICT', 'EVENT_UNKNOWN')")),
        }
    )

    def joined(column: str) -> str:
        return f"array_join({column}, ', ')"

    golden = "reference_validation.exact_match and size(reference_validation.conflicts) = 0"
    few = f"coalesce(nullif({joined('disagreements')}, ''), {q(vocab.CONSENSUS_TOO_FEW)})"
    consensus = f"(responses >= {vocab.BASIC_PASSES} and size(disagreements) = 0)"
    first = [
        check("REQUIRED_FIELDS", "size(unresolved) = 0", joined("unresolved")),
        check("AGENT_CONSENSUS", consensus, few),
    ]
    rest = [
        check("EVIDENCE_GROUNDING", "size(_ungrounded) = 0", joined("_ungrounded")),
        check("GOLDEN_VALIDATION", f"({golden})", None),
        check("DATE_COHERENCE", "size(_dates) = 0", joined("_dates")),
        check("FINANCIAL_COHERENCE", "size(_money) = 0", joined("_money")),
        check("CLASSIFICATION_CONSISTENCY", "size(_class) = 0", joined("_class")),
        check("OCR_QUALITY", "size(weak_ocr_pages) = 0", "array_join(cast(weak_ocr_pages as array<string>), ', ')"),
    ]
    result = f"if(responses > 0, {array_of(first + rest)}, {array_of(first)})"
    return staged.withColumn(name, F.expr(f"cast({result} as array<{CHECK}>)")).drop(
        "_ungrounded", "_dates", "_money", "_class"
    )
