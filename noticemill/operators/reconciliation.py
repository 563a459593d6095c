"""Identity reconciliation against the golden table.

The golden side is normalised and written once, then measured. Identifiers are
looked up in indexes from a normalised value to a position, and a golden record
is fetched by position once it is known which one is wanted, so no table holds
records for every identifier. Below the broadcast bound all of these are
map-side hash joins without any shuffle; above it the identifiers alone are
salted and shuffled, since one issuer may own a large share of the notices, and
what they find is joined to the records by document.
Every lookup is grouped by its key, so none can multiply rows; a golden table
whose identifiers repeat is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.scale import fits_broadcast, lookup_join
from noticemill.functions.sqltext import compact, q
from noticemill.functions.text import IDENTIFIER_NORMALIZERS, normalize_text
from noticemill.session import scratch_path
from noticemill.sources.golden import check_golden

RECORD = "struct<" + ",".join(f"{c}:string" for c in vocab.GOLDEN_COLUMNS) + ">"
# Identifiers that may select a row, in the order of their lookups.
LOOKED_UP = ["isin", "cnpj", "ticker", "issuer"]
CONFLICT = "struct<code:string,field:string,expected:string,observed:string>"


# Normalised values that the row's own position in an index does not stand for: issuers and share classes may repeat.
_FORMS = ["issuer", "share_class"]


@dataclass
class Golden:
    """Golden rows in lookup form: (position, record, n_<identifier>...); a position names one row."""

    rows: DataFrame
    small: bool

    def hits(self, identifier: str) -> DataFrame:
        """One row per normalised identifier value: n rows and the position of the first one."""
        key = f"n_{identifier}"
        known = self.rows.where(f"{key} is not null")
        return known.groupBy(F.col(key).alias(f"key_{identifier}")).agg(
            F.count(F.lit(1)).alias(f"count_{identifier}"), F.min("position").alias(f"at_{identifier}")
        )

    def records(self, at: str, name: str) -> DataFrame:
        """(at, name): the record of every position."""
        return self.rows.groupBy(F.col("position").alias(at)).agg(F.min("record").alias(name))

    def forms(self, at: str) -> DataFrame:
        """(at, form_<identifier>...): the normalised values of every position that are compared as text."""
        return self.rows.groupBy(F.col("position").alias(at)).agg(*[F.min(f"n_{i}").alias(f"form_{i}") for i in _FORMS])


def prepare_golden(golden: DataFrame, position: str = "position") -> Golden:
    """Check, normalise and write the golden rows; repeated identifiers raise ValueError.

    The rows are written to the shared folder, below and above the broadcast
    bound alike: each lookup reads the same positions, even those of a
    generated number, and nothing stays cached.
    """
    check_golden(golden)
    rows = golden.select(
        F.col(position).cast("long").alias("position"),
        F.struct(*[F.col(c) for c in vocab.GOLDEN_COLUMNS]).alias("record"),
        *[IDENTIFIER_NORMALIZERS[i](F.col(i)).alias(f"n_{i}") for i in vocab.IDENTIFIERS],
    )
    path = scratch_path(golden.sparkSession, "golden")
    rows.write.parquet(path)
    written = golden.sparkSession.read.schema(rows.schema).parquet(path)
    # What the lookups broadcast: records and forms by position, positions by normalised value.
    tables = [["position", "record"], ["position", *[f"n_{i}" for i in _FORMS]], *[[f"n_{i}", "position", "position"] for i in LOOKED_UP]]
    return Golden(written, all(fits_broadcast(written.select(*t).toDF(*[f"c{n}" for n in range(len(t))])) for t in tables))


def with_keys(records: DataFrame) -> DataFrame:
    """Normalised identifiers of the document, as key_<identifier>."""
    return records.select(
        "*",
        *[
            IDENTIFIER_NORMALIZERS[i](F.col(f"{name}.value")).alias(f"key_{i}")
            for i, name in vocab.IDENTIFIERS.items()
        ],
    )


def reference_matches(records: DataFrame, golden: Golden) -> DataFrame:
    """records + per identifier the number of golden rows it hits and the position of the first.

    The share class never selects a row, so only its count is looked up.
    """
    matched = with_keys(records)
    for identifier in LOOKED_UP:
        matched = lookup_join(
            matched, golden.hits(identifier), [f"key_{identifier}"], ["document_id"], golden.small
        )
    return matched


def share_class_matches(records: DataFrame, golden: Golden) -> DataFrame:
    """(document_id, key_share_class, count_share_class, at_share_class): golden rows of the document's share class."""
    keys = with_keys(records).select("document_id", "key_share_class")
    return lookup_join(keys, golden.hits("share_class"), ["key_share_class"], ["document_id"], golden.small)


_UNIQUE = "if(count_{0} = 1, at_{0}, null)"


def reference_select(matches: DataFrame) -> DataFrame:
    """Add strong_conflict and selected_at, the position of the selected golden row (or null).

    A unique ISIN or CNPJ hit decides; two different ones are a conflict;
    then a unique ticker, then a unique issuer name.
    """
    conflict = "coalesce(at_isin <> at_cnpj, false)"
    strong = f"coalesce({_UNIQUE.format('isin')}, {_UNIQUE.format('cnpj')})"
    weak = f"coalesce({_UNIQUE.format('ticker')}, {_UNIQUE.format('issuer')})"
    return matches.withColumn("strong_conflict", F.expr(conflict)).withColumn(
        "selected_at", F.expr(f"if(strong_conflict, null, coalesce({strong}, {weak}))")
    )


def reference_records(selected: DataFrame, golden: Golden) -> DataFrame:
    """Add the records that are wanted: of the selected row, or of the two rows of a strong conflict.

    first_record and form_<identifier> are of the selected row or of the ISIN's, second_record is of the CNPJ's.
    """
    found = selected.withColumns({
        "_first": F.expr("if(strong_conflict, at_isin, selected_at)"), "_second": F.expr("if(strong_conflict, at_cnpj, null)"),
    })
    for at, dim in (("_first", golden.forms("_first")), ("_second", golden.records("_second", "second_record")),
                    ("_first", golden.records("_first", "first_record"))):
        found = lookup_join(found, dim, [at], ["document_id"], golden.small)
    return found.drop("_first", "_second")


def _looked_up(records: DataFrame, golden: Golden) -> DataFrame:
    """records + their keys and what the golden table says about them.

    Above the broadcast bound only identifiers and findings are shuffled; records that lie by document_id, as
    extraction leaves them, stay where they are. A record's document_id is not null and its own.
    """
    if golden.small:
        return reference_records(reference_select(reference_matches(records, golden)), golden)
    identifiers = records.select("document_id", *vocab.IDENTIFIERS.values())
    found = reference_records(reference_select(reference_matches(identifiers, golden)), golden)
    columns = ["strong_conflict", "selected_at", "first_record", "second_record", *[f"form_{i}" for i in _FORMS]]
    columns += [f"{p}_{i}" for i in LOOKED_UP for p in ("at", "count")]
    return with_keys(records).join(found.select("document_id", *columns), "document_id", "left")


def reference_compare(looked_up: DataFrame) -> DataFrame:
    """Add reference_validation: matches and conflicts with the selected row."""
    matched, conflicts = [], []
    for i, name in vocab.IDENTIFIERS.items():
        known = f"selected_at is not null and key_{i} is not null"
        # ISIN, CNPJ and ticker do not repeat: a row has the value if the value's position is its own.
        same = f"key_{i} <=> form_{i}" if i in _FORMS else f"at_{i} <=> selected_at"
        matched.append((f"{known} and {same}", q(i)))
        conflicts.append((
            f"{known} and not ({same})",
            f"named_struct('code', {q(vocab.CONFLICT_CODES[i])}, 'field', {q(i)}, 'expected', first_record.{i}, "
            f"'observed', {name}.value)",
        ))
    strong = (
        f"array(named_struct('code', {q(vocab.STRONG_CONFLICT_CODE)}, 'field', 'identity', "
        f"'expected', {q(vocab.STRONG_CONFLICT_EXPECTED)}, 'observed', "
        "to_json(named_struct('isin', isin.value, 'cnpj', issuer_cnpj.value), map('ignoreNullFields', 'false'))))"
    )
    candidates = (
        "if(at_isin < at_cnpj, array(first_record, second_record), array(second_record, first_record))"
    )
    staged = looked_up.withColumns(
        {
            "_matched": F.expr(compact(matched)),
            "_conflicts": F.expr(f"if(strong_conflict, {strong}, {compact(conflicts)})"),
            "_possible": F.expr(f"if(strong_conflict, {candidates}, cast(array() as array<{RECORD}>))"),
        }
    )
    reference = F.struct(
        F.expr("size(_matched) > 0 and size(_conflicts) = 0 as exact_match"),
        F.expr("_matched as matched_by"),
        F.expr("if(strong_conflict, null, first_record) as reference_record"),
        F.expr("_conflicts as conflicts"),
        F.expr("_possible as possible_matches"),
    )
    scratch = ["strong_conflict", "selected_at", "first_record", "second_record", "_matched", "_conflicts", "_possible"]
    scratch += [f"key_{i}" for i in vocab.IDENTIFIERS if i != "issuer"]
    scratch += [f"{p}_{i}" for i in LOOKED_UP for p in ("at", "count")] + [f"form_{i}" for i in _FORMS]
    return staged.withColumn("reference_validation", reference).drop(*scratch)


def reconcile(records: DataFrame, golden: Golden, keep_key: bool = False) -> DataFrame:
    """records + reference_validation (without fuzzy suggestions)."""
    done = reference_compare(_looked_up(records, golden))
    return done if keep_key else done.drop("key_issuer")


def unmatched(records: DataFrame, golden: Golden) -> DataFrame:
    """Records for which no golden row could be confirmed."""
    return reconcile(records, golden).where("reference_validation.reference_record is null")


def enrich(records: DataFrame) -> DataFrame:
    """Conflicting identifiers become CONFLICT; empty UNKNOWN fields are filled."""
    reference = "reference_validation.reference_record"
    source = {**{name: i for i, name in vocab.IDENTIFIERS.items()},
              "listing_segment": "listing_segment", "asset_status": "status"}
    columns = {}
    for name, golden_column in source.items():
        conflicting = (
            f"exists(reference_validation.conflicts, c -> c.field = {q(golden_column)})"
            if golden_column in vocab.IDENTIFIERS else "false"
        )
        fill = f"{reference} is not null and {name}.value is null and {name}.status = 'UNKNOWN'"
        columns[name] = F.expr(
            f"case when {conflicting} then named_struct('value', {name}.value, 'status', 'CONFLICT', "
            f"'origin', {name}.origin, 'sources', {name}.sources) "
            f"when {fill} then named_struct('value', {reference}.{golden_column}, 'status', 'REFERENCE_ENRICHED', "
            f"'origin', 'REFERENCE', 'sources', {name}.sources) else {name} end"
        )
    return records.withColumns(columns)


def _rule(rule: str, status: str, message: str, expected: str, observed: str) -> str:
    return (
        f"named_struct('rule', {rule}, 'status', '{status}', 'message', {message}, "
        f"'expected', cast({expected} as string), 'observed', cast({observed} as string))"
    )


def reference_results(records: DataFrame, name: str = "validations_reference") -> DataFrame:
    """Rule results of the reconciliation, as an array column."""
    ref = "reference_validation"
    none = _rule("'REF_NO_MATCH'", "FAIL", q(vocab.MSG_NO_REFERENCE), "null", "null")
    matches = (
        f"transform({ref}.matched_by, f -> named_struct('rule', concat('REF_', upper(f), '_MATCH'), 'status', 'PASS', "
        "'message', concat(f, ' matches the reference record.'), 'expected', cast(null as string), "
        "'observed', cast(null as string)))"
    )
    conflicts = (
        f"transform({ref}.conflicts, c -> named_struct('rule', c.code, 'status', 'FAIL', "
        "'message', concat(c.field, ' conflicts with the reference record.'), "
        "'expected', c.expected, 'observed', c.observed))"
    )
    staged = records.withColumn("_status", normalize_text(F.col(f"{ref}.reference_record.status")))
    inactive = _rule(
        "'REF_ASSET_INACTIVE'", "FAIL", q(vocab.MSG_INACTIVE), q(vocab.ACTIVE_STATUS), f"{ref}.reference_record.status",
    )
    not_active = compact([(f"not (_status <=> {q(vocab.ACTIVE_STATUS)})", inactive)])
    return staged.withColumn(
        name,
        F.expr(
            f"if({ref}.reference_record is null, array({none}), "
            f"concat({matches}, {conflicts}, {not_active}))"
        ),
    ).drop("_status")
