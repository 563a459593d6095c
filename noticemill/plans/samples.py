"""Operator inputs computed from the derived notice tables.

Deliberate faults are functions of the row key, stated once as SQL text so the
cross-check can restate them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.sqltext import array_of, q
from noticemill.operators import admission, consensus, reconciliation, rules
from noticemill.operators.extraction import CONFLICTS, SOURCES
from noticemill.plans import pipeline
from noticemill.sources import derived
from noticemill.sources.pages import as_pages

PASS_PATHS = [
    "corporate_action.event_type",
    "security.ticker",
    "security.isin",
    "corporate_action.dates.record_date",
    "corporate_action.dates.payment_date",
    "corporate_action.financials.gross_amount_per_share",
]

GOLDEN_COPIES = """
select issuer, cnpj, isin, ticker from {golden}
union all select issuer, replace(cnpj, '.', ''), lower(isin), concat(ticker, ' ') from {golden} where k%10=0
"""

FAILURES = """
select case cast(seq%6 as int) when 0 then 'CORRUPT_PDF' when 1 then 'OCR' when 2 then 'STRUCTURED_OUTPUT'
  when 3 then 'PROVIDER' when 4 then 'OUTPUT_WRITE' else 'KeyError' end as error_class,
 case when seq%5=0 then '' else concat('failure ', cast(seq as string)) end as error,
 case when seq%7=0 then null else {sha} end as content_sha, concat('in/', file_name) as path, file_name
from {uploads} where magic <> '%PDF-'
"""

ISSUER_FILES = """
select k, case when k%9=0 then concat('  ', chr(92), '..', issuer, '.pdf') else concat(issuer, ' - aviso (v', cast(k as string), ').PDF') end as file_name
from {golden}
"""

CLAIMS = "select seq, {sha} as sha, concat('up_', cast(seq as string), '.pdf') as file_name, seq%4=0 as force from {uploads}"

ARTIFACTS = """
select seq, case when seq%11=0 then 'EXCEPTION_REPORT' else 'DOCUMENT_RECORD' end as artifact_type,
 concat('out_', cast(seq as string), '.json') as file_name,
 case when seq%13=0 then 'sha256:bad' else concat('sha256:', {sha}) end as document_id,
 case cast(seq%3 as int) when 0 then 'ACCEPTED' when 1 then 'FAILED' else 'REVIEW_REQUIRED' end as processing_status,
 case when seq%4=0 then '{{"schema_version":"1.0"}}'
  when seq%4=1 then concat('{{"schema_version":"2.0","source_document":{{"file_name":"src_', cast(seq as string), '.pdf"}}}}')
  else '{{"schema_version":"2.0"}}' end as payload,
 cast(floor(seq/2) as bigint) as created_at
from {uploads}
"""

FILES = "select seq, file_name as name, cast(size_bytes%5000 as bigint) as size, content_type as type from {uploads}"

LINES = """
select seq as ord, concat('sha256:', {sha}) as document_id,
 case cast(seq%4 as int) when 0 then 'ACCEPTED' when 1 then 'REVIEW_REQUIRED' when 2 then 'PENDING_INFORMATION'
  else 'FAILED' end as processing_status
from {uploads}
"""

VARIANTS = """
select cast(page_id as string) as document_id, 1 as page_number, v.variant_no,
 case v.variant_no when 1 then html when 2 then replace(html, '<', ' ') else
  case when page_id%9=0 then '' else replace(html, 'e', '') end end as text, url as native_text
from {pages} cross join (select 1 as variant_no union all select 2 union all select 3) v
where page_id%10 > 0 or v.variant_no = 3
"""

MIXED = """
select cast(conv_id as string) as document_id, cast(turn + 1 as int) as page_number, text,
 case when (conv_id+turn)%3=0 then 'OCR' else 'NATIVE_TEXT' end as extraction_method,
 (conv_id+turn)%5=0 as warned
from {conversations}
"""

IDENTIFIERS = """
select f.k, cast(f.k as string) as document_id,
 case when f.k%47=0 then concat(g.issuer, ' Participacoes') when f.k%13=0 then upper(g.issuer)
  when f.k%53=0 then null else g.issuer end as issuer,
 case when f.k%37=0 then h.cnpj when f.k%41=0 or f.k%43=0 or f.k%47=0 then null
  when f.k%3=0 then replace(g.cnpj, '.', '') else g.cnpj end as cnpj,
 case when f.k%41=0 or f.k%43=0 or f.k%47=0 then null when f.k%5=0 then lower(g.isin) else g.isin end as isin,
 case when f.k%43=0 or f.k%47=0 then null when f.k%19=0 then 'ZZZZ3' else concat(g.ticker, ' ') end as ticker,
 case when f.k%7=0 then null when f.k%23=0 then 'UNIT' when f.k%2=0 then lower(g.share_class) else g.share_class end
  as share_class
from {fields} f join {golden} g on f.gk=g.k
 join {golden} h on h.k = (f.gk+1) % (select count(*) from {golden})
"""

SHARE_CLASSES = """
select o_orderkey as k, case cast(o_orderkey%10 as int) when 0 then 'Ação Ordinária' when 1 then 'ON' when 2 then ' pn '
 when 3 then 'Ações Preferenciais' when 4 then 'preferencial A' when 5 then 'PNB' when 6 then 'Units' when 7 then '--'
 when 8 then 'classe especial b' else 'Ações Ordinárias' end as raw
from {orders}
"""

# Narrative wording, two pages per notice; page 2 repeats some labels.
NARRATIVE = """
select k as doc, 1 as page, concat('AVISO', chr(10), 'O Conselho, em reunião realizada em ', cast(day(appr) as string), ' de ',
  case cast(month(appr) as int) when 1 then 'janeiro' when 2 then 'fevereiro' when 3 then 'março' when 4 then 'abril'
   when 5 then 'maio' when 6 then 'junho' when 7 then 'julho' when 8 then 'agosto' when 9 then 'setembro'
   when 10 then 'outubro' when 11 then 'novembro' else 'dezembro' end, ' de ', cast(year(appr) as string),
  ', aprovou.', chr(10), case when k%3=0 then 'Sobre o valor incidirá Imposto de Renda na fonte.' else '' end) as text
from {fields}
union all
select k, 2, concat('Data de aprovação ', DMY, chr(10),
  case when k%2=0 then concat('Período de ajuste de frações', chr(10), DMY, ' a ', DMY2, chr(10)) else '' end,
  case when k%5=0 then 'A alíquota será aplicada por beneficiário.' else '' end)
from {fields}
""".replace("DMY2", derived._dmy("pay")).replace("DMY", derived._dmy("rec"))

EVIDENCE = """
select cast(k as string) as document_id,
 case i when 1 then 'security.isin' when 2 then 'security.ticker' when 3 then 'issuer.name' else 'security.share_class' end as path,
 case i when 1 then isin when 2 then ticker when 3 then issuer end as value,
 case when i<4 then 1 end as page1,
 case i when 1 then (case when k%7=0 then concat(isin, 'X') else isin end) when 2 then concat('  ', lower(ticker))
  when 3 then issuer end as evidence1,
 case when i=1 then 2 when i=3 and k%11=0 then 1 end as page2,
 case when i=1 then isin when i=3 and k%11=0 then 'CNPJ/ME' end as evidence2
from (select f.k, g.isin, g.ticker, g.issuer from {fields} f join {golden} g on f.gk=g.k) w
cross join (select 1 as i union all select 2 union all select 3 union all select 4) t
"""

CONFLICT_SIGNALS = """
select cast(f.k as string) as document_id, 1 as conflict_no, 'title and body disagree' as description, s.signal_no,
 case s.signal_no when 1 then 'DIVIDEND' when 2 then 'JCP' else 'STOCK_SPLIT' end as supports, 'term' as rationale,
 1 as page, case s.signal_no when 1 then 'Aviso' when 2 then 'juros sobre o capital' else 'desdobramento' end as evidence
from {fields} f cross join (select 1 as signal_no union all select 2 union all select 3) s
"""

OUTCOME_PARTS = 5
# part: when a row arrives, by its place in time; one in 11 comes three parts late.
OUTCOMES = """
select cast(ts as timestamp) as ts, case event_type when 'signup' then 'ACCEPTED' when 'view' then 'ACCEPTED'
 when 'click' then 'REVIEW_REQUIRED' when 'purchase' then 'PENDING_INFORMATION' else 'FAILED' end as processing_status,
 case when event_id%11=0 and p<2 then p+3 else p end as part
from (select *, cast(floor((event_id - low) * 5 / (high - low + 1)) as int) as p from {events}
 cross join (select min(event_id) as low, max(event_id) as high from {events}) b) e
"""


def _uploads_sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{sha}", "sha2(content, 256)"), uploads=derived.uploads(spark, d))


def golden_with_copies(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(GOLDEN_COPIES, golden=derived.golden(spark, d))


def failures(spark: SparkSession, d: str) -> DataFrame:
    return _uploads_sql(spark, d, FAILURES)


def issuer_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ISSUER_FILES, golden=derived.golden(spark, d))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return _uploads_sql(spark, d, CLAIMS)


def artifact_log(spark: SparkSession, d: str) -> DataFrame:
    return _uploads_sql(spark, d, ARTIFACTS)


def files(spark: SparkSession, d: str) -> DataFrame:
    return _uploads_sql(spark, d, FILES)


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return _uploads_sql(spark, d, LINES)


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(OUTCOMES, events=derived.table(spark, d, "events"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(VARIANTS, pages=derived.table(spark, d, "pages"))


def mixed_pages(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.sql(MIXED, conversations=derived.table(spark, d, "conversations"))
    pages = as_pages(turns, "document_id", "page_number", "text").select("document_id", "page_number", "text")
    flags = turns.select("document_id", "page_number", "extraction_method", "warned")
    warning = "if(warned, array(concat('Page ', page_number, ' remained unreadable after OCR.')), array())"
    return pages.join(flags, ["document_id", "page_number"]).withColumn(
        "warnings", F.expr(f"cast({warning} as array<string>)")
    )


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(IDENTIFIERS, fields=derived.notice_fields(spark, d), golden=derived.golden(spark, d))


def identifier_records(spark: SparkSession, d: str) -> DataFrame:
    """Records holding only the five identifiers."""
    field = (
        "named_struct('value', {c}, 'status', if({c} is null, 'UNKNOWN', 'EXTRACTED'), 'origin', "
        "if({c} is null, 'UNKNOWN', 'DOCUMENT'), 'sources', cast(array() as " + SOURCES + "))"
    )
    return identifiers(spark, d).select(
        "document_id", *[F.expr(field.format(c=i)).alias(n) for i, n in vocab.IDENTIFIERS.items()]
    )


def share_classes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SHARE_CLASSES, orders=derived.table(spark, d, "orders"))


def narrative_pages(spark: SparkSession, d: str) -> DataFrame:
    return as_pages(spark.sql(NARRATIVE, fields=derived.notice_fields(spark, d)), "doc", "page", "text")


def evidence_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(EVIDENCE, fields=derived.notice_fields(spark, d), golden=derived.golden(spark, d))
    return rows.select(
        "document_id", "path", "value", F.expr("if(value is null, 'UNKNOWN', 'EXTRACTED') as status"),
        F.expr(
            "array_compact(array(if(page1 is null, null, named_struct('page', page1, 'evidence', evidence1)), "
            "if(page2 is null, null, named_struct('page', page2, 'evidence', evidence2))))"
        ).alias("sources"),
    )


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CONFLICT_SIGNALS, fields=derived.notice_fields(spark, d))


def passes(spark: SparkSession, d: str) -> DataFrame:
    """Extraction passes; a reported value cites itself on page 1."""
    return derived.passes(spark, d).select(
        F.col("k").cast("string").alias("document_id"), F.col("pass_no").cast("int").alias("pass_no"), "path", "value",
        "status",
        F.expr(
            "if(value is null, cast(array() as array<struct<page:int,evidence:string>>), "
            "array(named_struct('page', 1, 'evidence', value)))"
        ).alias("sources"),
    )


def pass_failures(spark: SparkSession, d: str) -> DataFrame:
    return derived.notice_fields(spark, d).where("k % 6 = 0").select(
        F.col("k").cast("string").alias("document_id"), F.lit(4).alias("pass_no"), F.lit("provider down").alias("error")
    )


def single_pass_records(spark: SparkSession, d: str, golden: reconciliation.Golden) -> DataFrame:
    """Pattern records seen as one valid pass, ready for preliminary checks."""
    records = reconciliation.reconcile(pipeline.pattern_records(derived.notice_pages(spark, d)), golden)
    present = array_of(
        [f"if({n}.value is not null or {n}.status <> 'UNKNOWN', {q(vocab.PATH_OF[n])}, null)" for n in vocab.EXTRACTED_FIELDS]
    )
    return rules.coherence_results(records).withColumns(
        {
            "unresolved": F.expr(consensus.unresolved_of_record()),
            "responses": F.lit(1),
            "disagreements": F.expr(f"array_sort(array_compact({present}))"),
            "weak_ocr_pages": F.expr("if(cast(document_id as bigint) % 10 = 9, array(1), cast(array() as array<int>))"),
        }
    )


def faulty(records: DataFrame) -> DataFrame:
    """Records with money, ratio and classification faults by document key."""
    k = "cast(document_id as bigint)"

    def replaced(name: str, when: str, value: str, origin: str | None = None) -> F.Column:
        return F.expr(
            f"if({when}, named_struct('value', {value}, 'status', {name}.status, "
            f"'origin', {q(origin) if origin else name + '.origin'}, 'sources', {name}.sources), {name})"
        )

    conflict = (
        "array(named_struct('description', 'title', 'signals', classification_evidence), "
        "named_struct('description', 'body', 'signals', classification_evidence))"
    )
    return records.withColumns(
        {
            "tax_treatment": replaced("tax_treatment", f"{k} % 6 = 0", "'TAX_DEPENDS_ON_BENEFICIARY'"),
            "net_amount_per_share": replaced("net_amount_per_share", f"{k} % 12 = 0", "net_amount_per_share.value", "DERIVED"),
            "currency": replaced("currency", f"{k} % 8 = 0", "cast(null as string)"),
            "gross_amount_per_share": replaced("gross_amount_per_share", f"{k} % 16 = 1", "cast(null as string)"),
            "ratio": replaced("ratio", f"{k} % 14 = 0", "replace(ratio.value, '\"1\"', '\"0\"')"),
            "classification_conflicts": F.expr(
                f"if({k} % 9 = 0, cast({conflict} as {CONFLICTS}), classification_conflicts)"
            ),
        }
    )
