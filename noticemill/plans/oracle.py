"""ANSI-SQL cross-check of the registered queries (see ``oracle_views``)."""

from __future__ import annotations

from noticemill import vocab
from noticemill.plans import samples
from noticemill.plans.oracle_views import norm_cnpj, norm_code, norm_issuer, norm_text, q, statement

S = statement
_N = {"fields": "fields", "golden": "golden", "uploads": "uploads", "orders": "orders", "pages": "pages",
      "conversations": "conversations", "events": "events", "sha": "sha256(content)"}


def _f(text: str) -> str:
    return text.format(**_N)


def _case(subject: str, mapping: dict[str, str], default: str) -> str:
    return "case " + " ".join(f"when {subject} = {q(k)} then {q(v)}" for k, v in mapping.items()) + f" else {default} end"


ORACLE: dict[str, str] = {}
O = ORACLE

# -- sources and sinks
O["scan_golden"] = S("select issuer, cnpj, isin, ticker, share_class, listing_segment, status from golden", "golden")
O["golden_duplicates"] = S(
    f"""select field, normalized, count(*) as n from (
     select 'isin' as field, {norm_code('isin')} as normalized from copies
     union all select 'cnpj', {norm_cnpj('cnpj')} from copies union all select 'ticker', {norm_code('ticker')} from copies)
     where normalized is not null group by field, normalized having count(*) > 1""",
    "golden", extra={"copies": _f(samples.GOLDEN_COPIES)})
O["scan_pages"] = S(
    """select cast(doc as varchar) as document_id, cast(page as integer) as page_number, trim(text, chr(10) || ' ') as text,
     'NATIVE_TEXT' as extraction_method from d3""", "d3")
O["sink_document_json"] = S(
    """select r.document_id, 'notice_' || r.document_id || '.json' as json_name, r.processing_status,
     '2.0' as schema_version, 'notice_' || r.document_id || '.pdf' as file_name, c.e_ticker as ticker,
     cast(c.record as varchar) as record_date, c.gross as gross,
     case when c.e_ratio is not null then c.ratio_d end as ratio_denominator, cast(r.score as varchar) as score,
     true as keeps_nulls from route r join cmp c on c.document_id = r.document_id""", "route", "cmp")
O["sink_artifact_log"] = S(
    """select 'DOCUMENT_RECORD' as artifact_type, 'notice_' || document_id || '.json' as file_name, document_id,
     processing_status from route""", "route")
O["failure_record"] = S(
    f"""select '2.0' as schema_version, 'sha256:' || coalesce(content_sha, sha256(path)) as document_id, file_name,
     'FAILED' as processing_status, {_case('error_class', vocab.TECHNICAL_CODES, q(vocab.TECHNICAL_DEFAULT))} as code,
     'TECHNICAL_ERROR' as category, case when error = '' then error_class else error end as message from failures""",
    "uploads", extra={"failures": _f(samples.FAILURES)})

# -- admission and identity
CHECKED = f"""
select *, case when file_name = '' then {q(vocab.REJECT_NAME_MISSING)} when position('/' in file_name) > 0 then {q(vocab.REJECT_NAME_PATH)}
 when not lower(file_name) like '%.pdf' then {q(vocab.REJECT_SUFFIX)}
 when content_type not in ('application/pdf', 'application/x-pdf') then {q(vocab.REJECT_CONTENT_TYPE)}
 when size_bytes > 20971520 then {q(vocab.REJECT_SIZE)} when not starts_with(magic, '%PDF-') then {q(vocab.REJECT_SIGNATURE)} end as reject_reason
from uploads
"""
O["content_sha256"] = S(
    "select seq, sha256(content) as sha256, 'sha256:' || sha256(content) as document_id from uploads", "uploads")
O["admission_checks"] = S(
    f"""select seq, reject_reason, cast(case when reject_reason is null then null when reject_reason = {q(vocab.REJECT_SIZE)}
     then 413 else 400 end as varchar) as http_status from checked""", "uploads", extra={"checked": CHECKED})
O["admission_batch_gate"] = S(
    """select cast(floor(seq / 4) as bigint) as batch_id, seq from (select seq,
     max(case when reject_reason is not null then 1 else 0 end) over (partition by cast(floor(seq / 4) as bigint)) as bad
     from checked) where bad = 0""", "uploads", extra={"checked": CHECKED})
O["safe_file_name"] = S(
    r"""select k, file_name, case when stem = '' then 'document' else substr(stem, 1, 100) end || '.pdf' as safe_name from (
     select k, file_name, trim(regexp_replace(regexp_replace(strip_accents(file_name), '\.[^.]+$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') as stem
     from files)""", "golden", extra={"files": _f(samples.ISSUER_FILES)})
O["unique_file_name"] = S(
    r"""select seq, case when n = 1 then safe else regexp_replace(safe, '\.pdf$', '') || '~' || lpad(lower(to_hex(n - 1)), 8, '0') || '.pdf' end as stored_name
     from (select seq, safe, row_number() over (partition by safe order by seq) as n from (select seq,
     trim(regexp_replace(regexp_replace(strip_accents(file_name), '\.[^.]+$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') || '.pdf' as safe
     from checked where reject_reason is null))""", "uploads", extra={"checked": CHECKED})
DEDUP = "select *, sha256(content) as sha256, batch_id%3 as b, row_number() over (partition by batch_id%3, sha256(content) order by seq) as n from uploads"
O["batch_dedup"] = S("select seq, b as batch_id, n > 1 as duplicate_in_batch from dedup", "uploads", extra={"dedup": DEDUP})
CLASSIFIED = """
select d.seq, d.sha256, case when n > 1 then 'DUPLICATE_IN_BATCH' when r.sha is null or processing_state = 'FAILED' then 'PROCESSED'
 when processing_state = 'COMPLETED' and latest_payload is not null then 'REUSED' else 'ALREADY_PROCESSING' end as disposition,
 latest_payload from dedup d left join registry r on r.sha = d.sha256
"""
CLASS_CTES = {"dedup": DEDUP, "classified": CLASSIFIED}
O["upload_disposition"] = S(
    f"""select seq, sha256, disposition, case when disposition = 'REUSED' then
     json_extract_string(latest_payload, '$.source_document.file_name') end as existing_file_name,
     {_case('disposition', vocab.DISPOSITION_MESSAGES, 'null')} as message from classified""",
    "uploads", "registry", extra=CLASS_CTES)
O["work_set"] = S(
    """select seq, case disposition when 'PROCESSED' then 'PROCESS' else 'CACHED' end as kind from classified
     where disposition in ('PROCESSED', 'REUSED')""", "uploads", "registry", extra=CLASS_CTES)
# Claims one by one: the first that the state lets through wins.
O["registry_apply_claims"] = S(
    """select coalesce(r.document_id, 'sha256:' || w.sha) as document_id,
     coalesce(w.file_name, r.original_file_name) as original_file_name,
     case when w.sha is not null then 'PROCESSING' else r.processing_state end as processing_state,
     cast(case when r.sha is null then 1 when w.sha is not null then r.revision + 1 else r.revision end as bigint) as revision,
     cast(case when w.sha is not null then null else r.processed_at end as varchar) as processed_at, w.sha is not null as acquired
     from registry r full outer join (select * from (select c.*, row_number() over (partition by c.sha order by c.seq) as n
       from claims c left join registry g on g.sha = c.sha where g.sha is null or g.processing_state = 'FAILED'
       or (g.processing_state = 'COMPLETED' and c.force)) where n = 1) w on w.sha = r.sha""",
    "uploads", "registry", extra={"claims": _f(samples.CLAIMS)})
_LATEST = """select * from (select substr(document_id, 8) as sha, *, row_number() over (partition by document_id
 order by created_at desc, seq desc) as n from {src} where artifact_type = 'DOCUMENT_RECORD'
 and regexp_full_match(document_id, 'sha256:[0-9a-f]{{64}}')) where n = 1"""
_PNAME = "coalesce(json_extract_string(a.payload, '$.source_document.file_name'), a.file_name)"
O["registry_apply_results"] = S(
    f"""select coalesce(r.document_id, a.document_id) as document_id,
     coalesce(r.original_file_name, {_PNAME}) as original_file_name,
     case when a.sha is null then r.processing_state when a.processing_status = 'FAILED' then 'FAILED' else 'COMPLETED' end as processing_state,
     case when a.sha is null then r.latest_processing_status else a.processing_status end as latest_processing_status,
     cast(coalesce(r.revision, 1) as bigint) as revision, case when a.sha is null then r.processed_at else a.created_at end as processed_at
     from registry r full outer join latest a on a.sha = r.sha""",
    "uploads", "registry", extra={"artifacts": _f(samples.ARTIFACTS), "latest": _LATEST.format(src="artifacts")})
O["registry_backfill"] = S(
    f"""select document_id, original_file_name, processing_state, latest_processing_status, cast(revision as bigint) as revision, processed_at
     from known union all select a.document_id, {_PNAME}, 'COMPLETED', a.processing_status, 1, a.created_at from latest a
     where a.sha not in (select sha from known)""",
    "uploads", "registry", extra={
        "known": "select * from registry where processed_at % 2 = 0", "artifacts": _f(samples.ARTIFACTS),
        "usable": "select * from artifacts where processing_status <> 'FAILED' and json_extract_string(payload, '$.schema_version') = '2.0'",
        "latest": _LATEST.format(src="usable")})
# The registry log replayed action by action.
_REPLAY = {
    "steps": "select doc_key, action, row_number() over (partition by doc_key order by ts, seq) as n from log",
    "run": """select doc_key, cast(0 as bigint) as n, cast(null as varchar) as state, 0 as revision, 0 as accepted
       from (select distinct doc_key from log)
      union all select s.doc_key, s.n,
       case when s.action = 'RESULT_OK' then 'COMPLETED' when s.action = 'RESULT_FAIL' then 'FAILED'
        when r.state is null or r.state = 'FAILED' or (s.action = 'FORCE' and r.state = 'COMPLETED') then 'PROCESSING' else r.state end,
       r.revision + case when s.action in ('RESULT_OK', 'RESULT_FAIL') then case when r.state is null then 1 else 0 end
        when r.state is null or r.state = 'FAILED' or (s.action = 'FORCE' and r.state = 'COMPLETED') then 1 else 0 end,
       r.accepted + case when s.action in ('RESULT_OK', 'RESULT_FAIL') or r.state is null or r.state = 'FAILED'
        or (s.action = 'FORCE' and r.state = 'COMPLETED') then 1 else 0 end
      from run r join steps s on s.doc_key = r.doc_key and s.n = r.n + 1""",
}
O["registry_replay"] = S(
    "select doc_key, cast(max(revision) as integer) as revision, arg_max(state, n) as state from run group by doc_key",
    "log", extra=_REPLAY, recursive=True)
O["list_completed"] = S(
    """select document_id, processed_at, latest_payload from registry where processing_state = 'COMPLETED'
     and latest_payload is not null order by processed_at, document_id""", "registry")
O["get_document"] = S(
    """select document_id, latest_payload from registry where document_id = (select min(document_id) from registry
     where processing_state = 'COMPLETED' and latest_payload is not null)""", "registry")
O["selection_dedup"] = S(
    """select cast(0 as integer) as part, seq, name, size from files where seq%3 = 0
     union all select 1, seq, name, size from files i where (seq%3 <> 0 or seq%2 = 0) and (type = 'application/pdf' or lower(name) like '%.pdf')
     and not exists (select 1 from files c where c.seq%3 = 0 and c.name = i.name and c.size = i.size)""",
    "uploads", extra={"files": _f(samples.FILES)})
_MERGED = """
select cast(0 as integer) as part, c.ord as position, c.document_id, coalesce(i.processing_status, c.processing_status) as processing_status
from lines c left join (select document_id, arg_max(processing_status, ord) as processing_status from lines
 where ord%3 = 0 or ord%7 = 0 group by document_id) i on i.document_id = c.document_id where c.ord%3 <> 0
union all select 1, ord, document_id, processing_status from lines where (ord%3 = 0 or ord%7 = 0)
 and document_id not in (select document_id from lines where ord%3 <> 0)
"""
_LINES = {"lines": _f(samples.LINES), "merged": _MERGED}
O["merge_by_document_id"] = S("select * from merged", "uploads", extra=_LINES)
O["session_report"] = S(
    """select count(*) as processed, count(*) filter (where processing_status = 'ACCEPTED') as accepted,
     count(*) filter (where processing_status = 'REVIEW_REQUIRED') as human_review,
     count(*) filter (where processing_status = 'PENDING_INFORMATION') as pending_information,
     count(*) filter (where processing_status = 'FAILED') as failed from merged""", "uploads", extra=_LINES)
_GO = "processing_status = 'REVIEW_REQUIRED' and cast(document_id as bigint)%3 = 0"
O["manual_approval"] = S(
    f"""select document_id, case when {_GO} then 'ACCEPTED' else processing_status end as processing_status, {_GO} as approved,
     case when {_GO} then processing_status end as previous_status,
     processing_status = 'REVIEW_REQUIRED' and not ({_GO}) as review_required,
     case when {_GO} then regexp_replace(codes, '(^|\\|)PAYMENT_DATE_NOT_DISCLOSED$', '') else '' end as acknowledged, codes from route""",
    "route")
O["manual_approval_refused"] = S(
    f"""select document_id, {q(vocab.APPROVAL_REFUSED)} as reason from route
     where cast(document_id as bigint)%3 = 0 and processing_status <> 'REVIEW_REQUIRED'""", "route")

# -- page text
O["native_text_gate"] = r"""select cast(doc_id as varchar) as document_id, cast(length(regexp_replace(text, '\s', '', 'g')) as integer) as native_text_length,
 case when length(regexp_replace(text, '\s', '', 'g')) >= 80 then 'NATIVE_TEXT' else 'OCR' end as extraction_method from documents"""
O["best_text_variant"] = S(
    r"""select document_id, page_number, case when best = '' then native_text else best end as text,
     case when best = '' then 'Page 1 remained unreadable after OCR.' else '' end as warnings from (
     select document_id, cast(page_number as integer) as page_number, first(t order by a desc, w desc, variant_no) as best,
      any_value(native_text) as native_text from (
      select *, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as a,
       len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: length(x) >= 3)) as w
      from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from variants)) group by document_id, page_number)""",
    extra={"variants": _f(samples.VARIANTS)})
MIXED = {"mixed": _f(samples.MIXED)}
O["document_pages_rollup"] = S(
    """select document_id, count(*) as page_count, case when min(case when extraction_method = 'OCR' then page_number end) is null then 'NATIVE_TEXT'
      when min(case when extraction_method = 'NATIVE_TEXT' then page_number end) is null then 'OCR'
      when min(case when extraction_method = 'OCR' then page_number end) < min(case when extraction_method = 'NATIVE_TEXT' then page_number end)
      then 'OCR|NATIVE_TEXT' else 'NATIVE_TEXT|OCR' end as methods,
     coalesce(string_agg('Page ' || page_number || ' remained unreadable after OCR.', '|' order by page_number) filter (where warned), '') as warnings
     from mixed group by document_id""", extra=MIXED)
O["document_text_assembly"] = S(
    r"""select document_id, string_agg('--- PAGE ' || page_number || ' [' || extraction_method || '] ---' || chr(10) ||
     regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) order by page_number) as text from mixed group by document_id""", extra=MIXED)
O["page_range_slice"] = S(
    """select p.document_id, cast(p.page_number as varchar) as page_number, substr(p.text, 1, cast(600 - before as bigint)) as text, cast(total > 600 or earlier >= 600 as varchar) as truncated,
      cast(null as varchar) as error from sized p join (select document_id, sum(len) as total,
      coalesce(sum(case when page_number < 3 then len end), 0) as earlier from sized group by document_id) t on t.document_id = p.document_id
     where before < 600 and page_count >= 3
     union all select distinct document_id, null, null, null, 'Página 3 inválida; o PDF possui ' || page_count || ' página(s)'
     from counted where page_count < 3""",
    extra={
        "turns": r"select cast(conv_id as varchar) as document_id, cast(turn + 1 as integer) as page_number, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from conversations",
        "counted": "select *, length(text) as len, max(page_number) over (partition by document_id) as page_count from turns",
        "sized": """select *, coalesce(sum(len) over (partition by document_id order by page_number rows between unbounded preceding and 1 preceding), 0) as before
          from counted where page_number <= 3"""})
O["page_words_topk"] = r"""select cast(doc_id as varchar) as document_id, cast(1 as integer) as page_number, cast(least(len(w), 2000) as integer) as n_words,
 array_to_string(w[1:2000], ' ') as words, len(w) > 2000 as truncated
 from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)"""
O["weak_ocr_pages"] = S(
    r"""select document_id, page_number from mixed where extraction_method = 'OCR' and
     (warned or length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 80)""", extra=MIXED)

# -- normalisers
O["strip_accents"] = S("select doc, replace(strip_accents(text), 'º', 'o') as plain from d3", "d3")
O["normalize_text"] = S(f"select doc, {norm_text('''replace(text, 'º', 'o')''')} as normalized from d3", "d3")
_IDS = {"ids": _f(samples.IDENTIFIERS)}
O["normalize_issuer"] = S(f"select k, {norm_issuer('issuer')} as normalized from ids", "fields", "golden", extra=_IDS)
O["normalize_cnpj"] = S(f"select k, {norm_cnpj('cnpj')} as normalized from ids", "fields", "golden", extra=_IDS)
O["normalize_isin"] = S(f"select k, {norm_code('isin')} as normalized from ids", "fields", "golden", extra=_IDS)
O["normalize_ticker"] = S(f"select k, {norm_code('ticker')} as normalized from ids", "fields", "golden", extra=_IDS)
O["normalize_share_class"] = S(
    f"""select k, {_case(norm_text('raw'), vocab.SHARE_CLASS_ALIASES, f"upper(replace({norm_text('raw')}, ' ', '_'))")} as normalized from classes""",
    extra={"classes": _f(samples.SHARE_CLASSES)})
_CANON = f"""case when path in ('security.isin', 'security.ticker') then {norm_code('value')}
 when path = 'corporate_action.financials.gross_amount_per_share' then
  case when regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') then regexp_replace(value, '^(-?)0+([0-9])', '\\1\\2') else value end else value end"""
O["canonical_value"] = S(
    f"select k, path, cast(pass_no as integer) as pass_no, {_CANON} as canonical from passes", "passes")


# -- pattern extraction
def _field(value: str, evidence: str, status: str = "'EXTRACTED'") -> str:
    return S(
        f"""select document_id, {value} as value, case when {evidence} is null then 'UNKNOWN' else {status} end as status,
         case when {evidence} is null then null else '1' end as page, {evidence} as evidence from notices""",
        "notices")


O["extract_issuer_name"] = _field("issuer", "issuer")
O["extract_cnpj"] = _field("e_cnpj", "e_cnpj")
O["extract_isin"] = _field("e_isin", "e_isin")
O["extract_ticker"] = _field("e_ticker", "e_ticker")
O["extract_share_class"] = _field("share_class", "e_class")
O["classify_event"] = _field("event", "e_event")
O["extract_payment_not_disclosed"] = _field(
    "cast(payment as varchar)", "coalesce(e_payment, e_open)", "case when payment is null then 'NOT_DISCLOSED' else 'EXTRACTED' end")
O["extract_currency"] = _field("currency", "e_currency")
O["extract_tax_rate"] = _field("rate", "e_rate")
O["extract_ratio"] = _field(
    """case when e_ratio is not null then '{"kind":"' || ratio_kind || '","numerator":"' || ratio_n || '","denominator":"' || ratio_d || '","percentage":null}' end""",
    "e_ratio")
O["extract_event_dates"] = S(
    """select document_id, cast(approval as varchar) as approval_date, cast(record as varchar) as record_date, cast(ex as varchar) as ex_date,
     cast(payment as varchar) as payment_date, cast(null as varchar) as credit_date, e_approval as approval_date_evidence,
     e_record as record_date_evidence, e_ex as ex_date_evidence, coalesce(e_payment, e_open) as payment_date_evidence,
     e_credit as credit_date_evidence from notices""", "notices")
O["extract_amounts"] = S(
    """select document_id, gross as gross_amount_per_share, net as net_amount_per_share, cast(null as varchar) as attributed_cost_per_share,
     e_gross as gross_amount_per_share_evidence, e_net as net_amount_per_share_evidence, e_cost as attributed_cost_per_share_evidence
     from notices""", "notices")
_NARR = {"narrative": _f(samples.NARRATIVE)}
O["extract_narrative_approval"] = S(
    r"""select cast(f.k as varchar) as document_id, cast(f.appr as varchar) as approval_date,
     regexp_extract(n.text, '(?i)reuni[aã]o realizada em \d{1,2} de [a-zç]+ de \d{4}') as approval_date_evidence
     from fields f join narrative n on n.doc = f.k and n.page = 1""", "fields", extra=_NARR)
O["extract_fraction_period"] = S(
    r"""select cast(f.k as varchar) as document_id, case when f.k%2 = 0 then cast(f.rec as varchar) end as fraction_period_start,
     case when f.k%2 = 0 then cast(f.pay as varchar) end as fraction_period_end, nullif(e, '') as fraction_period_start_evidence,
     nullif(e, '') as fraction_period_end_evidence from fields f join (select doc,
     regexp_extract(text, 'Per[ií]odo de ajuste de fra[cç][oõ]es[^\n]*\s+\S+ a \S+') as e from narrative where page = 2) n on n.doc = f.k""",
    "fields", extra=_NARR)
O["extract_tax_treatment"] = S(
    """select cast(k as varchar) as document_id, case when k%3 = 0 then 'TAX_RULE_UNIFORM' when k%5 = 0 then 'TAX_DEPENDS_ON_BENEFICIARY' end as tax_treatment,
     case when k%3 = 0 then 'incidirá Imposto de Renda na fonte' when k%5 = 0 then 'alíquota será aplicada por beneficiário' end as tax_treatment_evidence
     from fields""", "fields")
O["extract_notice"] = S(
    """select document_id, cast(null as varchar) as error, issuer as issuer_name, e_cnpj as issuer_cnpj, e_isin as isin, e_ticker as ticker,
     share_class, event as event_type, cast(approval as varchar) as approval_date, cast(record as varchar) as record_date,
     cast(ex as varchar) as ex_date, cast(payment as varchar) as payment_date, cast(null as varchar) as credit_date,
     cast(null as varchar) as fraction_period_start, cast(null as varchar) as fraction_period_end, gross as gross_amount_per_share,
     net as net_amount_per_share, rate as tax_rate_percent, cast(null as varchar) as tax_treatment, currency,
     cast(null as varchar) as attributed_cost_per_share, case when e_ratio is not null then ratio_n end as ratio_numerator,
     case when payment is not null then 'EXTRACTED' when e_open is not null then 'NOT_DISCLOSED' else 'UNKNOWN' end as payment_status,
     cast(case when event is null then 0 else 1 end as integer) as signals from notices""", "notices")

# -- grounding
_GROUND = {
    "ev": _f(samples.EVIDENCE),
    "np": f"select cast(doc as varchar) as document_id, page, {norm_text('''replace(text, 'º', 'o')''')} as t from d3",
    "g": f"""select e.*, e.page1 is not null as s1, e.page2 is not null as s2,
      coalesce(contains(a.t, {norm_text('evidence1')}), false) as ok1, coalesce(contains(b.t, {norm_text('evidence2')}), false) as ok2
      from ev e left join np a on a.document_id = e.document_id and a.page = e.page1
      left join np b on b.document_id = e.document_id and b.page = e.page2""",
}
_V = ("d3", "fields", "golden")
O["ground_evidence"] = S(
    """select document_id, path, value, cast(ok1::int + ok2::int as integer) as n_sources,
     coalesce(case when ok1 and ok2 then trim(evidence1) || '|' || trim(evidence2) when ok1 then trim(evidence1) when ok2 then trim(evidence2) end, '') as evidence,
     case when ok1 and ok2 then 'NATIVE_TEXT|NATIVE_TEXT' when ok1 or ok2 then 'NATIVE_TEXT' else '' end as methods from g""",
    *_V, extra=_GROUND)
O["field_status_after_grounding"] = S(
    """select document_id, path, case when value is null then 'UNKNOWN' when not ok1 and not ok2 then 'AMBIGUOUS' else 'EXTRACTED' end as status,
     case when value is null then 'UNKNOWN' else 'DOCUMENT' end as origin from g""", *_V, extra=_GROUND)
O["ungrounded_fields"] = S(
    f"""select document_id, coalesce(string_agg(path, '|' order by o) filter (where value is not null and not ok1 and not ok2), '') as paths
     from (select *, {_case('path', {p: f'{i:02d}' for i, (_, p) in enumerate(vocab.FIELDS)}, "''")} as o from g) group by document_id""",
    *_V, extra=_GROUND)
O["ground_classification"] = S(
    f"""select c.document_id, cast(conflict_no as integer) as conflict_no, description, count(*) as signals,
     string_agg(supports, '|' order by signal_no) as supports from conf c join np on np.document_id = c.document_id and np.page = c.page
     where contains(np.t, {norm_text('evidence')}) group by c.document_id, conflict_no, description having count(*) >= 2""",
    *_V, extra={"conf": _f(samples.CONFLICT_SIGNALS), "np": _GROUND["np"]})

# -- consensus
_P = {"p": f"select cast(k as varchar) as document_id, path, cast(pass_no as integer) as pass_no, value, status, {_CANON} as c from passes"}
O["agreement_scores"] = S(
    """select document_id, path, cast(round_even(100.0 * max(n) / sum(n), 0) as integer) as agreement from (
     select document_id, path, c, status, count(*) as n from p group by document_id, path, c, status) group by document_id, path""",
    "passes", extra=_P)
_WEAK = "('UNKNOWN', 'AMBIGUOUS', 'UNREADABLE')"


def _fold(limit: str = "true") -> dict[str, str]:
    """The ordered merge, replayed pass by pass."""
    add = "case when s.value is null or list_contains(m.src, s.value) then m.src else list_append(m.src, s.value) end"
    own = "case when s.value is null then []::varchar[] else [s.value] end"
    weak = f"m.status in {_WEAK}"
    same = "m.c is not distinct from s.c"
    return {
        **_P,
        "m": f"""select document_id, path, pass_no, value, status, c, case when value is null then []::varchar[] else [value] end as src
          from p where pass_no = 1
         union all select s.document_id, s.path, s.pass_no,
          case when s.value is null and s.status = 'UNKNOWN' then m.value when {weak} then s.value else m.value end,
          case when s.value is null and s.status = 'UNKNOWN' then m.status when {weak} then s.status
           when {same} and m.status <> 'CONFLICT' then m.status
           when s.value is not null and not ({same}) then 'CONFLICT' else m.status end,
          case when s.value is null and s.status = 'UNKNOWN' then m.c when {weak} then s.c else m.c end,
          case when s.value is null and s.status = 'UNKNOWN' then m.src when {weak} then {own}
           when {same} and m.status <> 'CONFLICT' then {add} when s.value is not null and not ({same}) then {add} else m.src end
         from m join p s on s.document_id = m.document_id and s.path = m.path and s.pass_no = m.pass_no + 1 where {limit}""",
        "f": "select * from (select *, row_number() over (partition by document_id, path order by pass_no desc) as r from m) where r = 1",
    }


O["merge_passes"] = S(
    "select document_id, path, value, status, array_to_string(src, '|') as evidence from f", "passes", extra=_fold(), recursive=True)
O["adjudicate"] = S(
    """select f.document_id, f.path, case when v.status is not null then v.value else f.value end as value,
     coalesce(v.status, f.status) as status, case when v.status is not null then coalesce(v.value, '') else array_to_string(src, '|') end as evidence
     from f left join (select * from p where pass_no = 3 and (value is not null or status <> 'UNKNOWN')) v
     on v.document_id = f.document_id and v.path = f.path""", "passes", extra=_fold("s.pass_no < 3"), recursive=True)
_RES = "(x.status not in ('UNKNOWN','AMBIGUOUS','CONFLICT','UNREADABLE') and len(x.src) > 0 and (x.status = 'NOT_DISCLOSED' or x.value is not null))"
_UNRES = {
    **_fold(),
    "ev": "select document_id, value as event from f where path = 'corporate_action.event_type'",
    "un": f"""select e.document_id, e.event, m.ord, m.path, x.document_id is not null as covered, coalesce({_RES}, false) as ok
      from ev e join material m on m.event = case when e.event in ('DIVIDEND','JCP','BONUS_SHARES','STOCK_SPLIT','REVERSE_SPLIT') then e.event else '-' end
      left join f x on x.document_id = e.document_id and x.path = m.path""",
}
O["unresolved_fields"] = S(
    """select document_id, event as event_type, coalesce(string_agg(path, '|' order by ord) filter (where not ok), '') as unresolved
     from un group by document_id, event""", "passes", "material", extra=_UNRES, recursive=True)
O["escalation_set"] = S(
    "select distinct document_id from un where covered and not ok", "passes", "material", extra=_UNRES, recursive=True)
O["extraction_attempts"] = S(
    f"""select document_id, pass_no, case when pass_no <= 2 then 'BASIC_LLM' else 'STRONG_LLM' end as strategy,
     case when error is not null then 'ERROR' when count(*) filter (where not ok) > 0 then 'INSUFFICIENT' else 'SUFFICIENT' end as outcome,
     coalesce(string_agg(path, '|' order by ord) filter (where not ok), '') as unresolved, error from (
      select a.document_id, a.pass_no, a.error, m.ord, m.path, coalesce({_RES}, false) as ok from att a
      join m2 e on e.document_id = a.document_id and e.pass_no = a.at and e.path = 'corporate_action.event_type'
      join material m on m.event = case when e.value in ('DIVIDEND','JCP','BONUS_SHARES','STOCK_SPLIT','REVERSE_SPLIT') then e.value else '-' end
      left join m2 x on x.document_id = a.document_id and x.pass_no = a.at and x.path = m.path) group by document_id, pass_no, error""",
    "passes", "material", "fields", recursive=True,
    extra={**_fold(), "m2": "select * from m",
           "att": """select distinct document_id, pass_no, pass_no as at, cast(null as varchar) as error from m2
             union all select cast(k as varchar), 4, case when k%5 = 0 then 3 else 2 end, 'provider down' from fields where k%6 = 0"""})
O["fallback_set"] = S("select cast(k as varchar) as document_id from fields where k%4 = 0", "fields")
O["consensus_disagreements"] = S(
    """select document_id, cast(max(r) as bigint) as responses, coalesce(string_agg(path, '|' order by path) filter (where present and a < 100), '') as paths,
     max(r) >= 2 and count(*) filter (where present and a < 100) = 0 as consensus from (
     select document_id, path, sum(n) as r, bool_or(present) as present, round_even(100.0 * max(n) / greatest(sum(n), 2), 0) as a from (
      select document_id, path, c, status, count(*) as n, bool_or(value is not null or status <> 'UNKNOWN') as present from p
      group by document_id, path, c, status) group by document_id, path) group by document_id""", "passes", extra=_P)


def _check(o: int, code: str, passed: str, detail: str | None, source: str) -> str:
    ok, bad = vocab.CHECKS[code]
    failed = q(bad) if detail is None else f"{q(bad)} || {detail}"
    return (f"select document_id, cast({o} as integer) as ord, '{code}' as code, {passed} as passed, "
            f"case when {passed} then {q(ok)} else {failed} end as message from {source}")


def _failed_rules(where: str) -> str:
    return (f"(select x.document_id, coalesce(string_agg(v.rule, ', ' order by v.ord) filter (where v.status = 'FAIL' and {where}), '') as d "
            "from exact x left join valid v on v.document_id = x.document_id group by x.document_id)")


O["preliminary_checks"] = S(
    " union all ".join([
        _check(0, "REQUIRED_FIELDS", "n = 0", "replace(unresolved, '|', ', ')", "missing"),
        _check(1, "AGENT_CONSENSUS", "false", f"coalesce(nullif(d, ''), {q(vocab.CONSENSUS_TOO_FEW)})",
               "(select document_id, coalesce(string_agg(path, ', ' order by path) filter (where status <> 'UNKNOWN'), '') as d from plf group by document_id)"),
        _check(2, "EVIDENCE_GROUNDING", "true", None, "exact"),
        _check(3, "GOLDEN_VALIDATION", "exact_match", None, "exact"),
        _check(4, "DATE_COHERENCE", "d = ''", "d", _failed_rules("starts_with(v.rule, 'DATE_')")),
        _check(5, "FINANCIAL_COHERENCE", "d = ''", "d", _failed_rules("starts_with(v.rule, 'FIN_')")),
        _check(6, "CLASSIFICATION_CONSISTENCY", "d = ''", "d", _failed_rules("v.rule = 'EVENT_UNKNOWN'")),
        _check(7, "OCR_QUALITY", "cast(document_id as bigint)%10 <> 9", "'1'", "exact"),
    ]), "missing", "plf", "exact", "valid")

# -- reconciliation
_REF = {
    "ids": _f(samples.IDENTIFIERS),
    "nk": f"""select *, {norm_issuer('issuer')} as k_issuer, {norm_cnpj('cnpj')} as k_cnpj, {norm_code('isin')} as k_isin,
      {norm_code('ticker')} as k_ticker, upper(share_class) as k_class from ids""",
    "hit": """select document_id, 'issuer' as identifier, count(*) as n, case when count(*) = 1 then min(g.k) end as position from nk join ngolden g on n_issuer = k_issuer group by document_id
      union all select document_id, 'cnpj', count(*), case when count(*) = 1 then min(g.k) end from nk join ngolden g on n_cnpj = k_cnpj group by document_id
      union all select document_id, 'isin', count(*), case when count(*) = 1 then min(g.k) end from nk join ngolden g on n_isin = k_isin group by document_id
      union all select document_id, 'ticker', count(*), case when count(*) = 1 then min(g.k) end from nk join ngolden g on n_ticker = k_ticker group by document_id""",
    "pick": """select n.document_id, max(position) filter (where identifier = 'isin') as i, max(position) filter (where identifier = 'cnpj') as c,
      max(position) filter (where identifier = 'ticker') as t, max(position) filter (where identifier = 'issuer') as u
      from nk n left join hit h on h.document_id = n.document_id group by n.document_id""",
    "sel": """select *, coalesce(i <> c, false) as strong_conflict, case when i <> c then null else coalesce(i, c, t, u) end as position from pick""",
    "cmpx": """select s.*, n.issuer, n.cnpj, n.isin, n.ticker, n.share_class, g.issuer as g_issuer, g.cnpj as g_cnpj, g.isin as g_isin,
      g.ticker as g_ticker, g.share_class as g_class, k_issuer = n_issuer as m_issuer, k_cnpj = n_cnpj as m_cnpj, k_isin = n_isin as m_isin,
      k_ticker = n_ticker as m_ticker, k_class = n_class as m_class
      from sel s join nk n on n.document_id = s.document_id left join ngolden g on g.k = s.position""",
}
_RV = ("fields", "ngolden")
_FIVE = [("issuer", "issuer", "issuer"), ("cnpj", "cnpj", "cnpj"), ("isin", "isin", "isin"), ("ticker", "ticker", "ticker"),
         ("share_class", "class", "share_class")]
O["reference_matches"] = S(
    """select document_id, identifier, n, cast(position as varchar) as position from (select * from hit
     union all select document_id, 'share_class', count(*), case when count(*) = 1 then min(g.k) end
     from nk join ngolden g on n_class = k_class group by document_id)""", *_RV, extra=_REF)
O["reference_select"] = S("select document_id, cast(position as varchar) as position, strong_conflict from sel", *_RV, extra=_REF)
O["reference_strong_conflict"] = S(
    """select c.document_id, 'REF_STRONG_IDENTIFIER_CONFLICT' as code, '{"isin":"' || c.isin || '","cnpj":"' || c.cnpj || '"}' as observed,
     a.issuer || '|' || b.issuer as candidates from cmpx c join golden a on a.k = least(c.i, c.c) join golden b on b.k = greatest(c.i, c.c)
     where strong_conflict""", *_RV, extra=_REF)
O["reference_compare"] = S(
    " union all ".join(
        f"select document_id, 'REF_{f.upper()}_CONFLICT' as code, '{f}' as field, g_{g} as expected, {v} as observed from cmpx where m_{g} = false"
        for f, g, v in _FIVE), *_RV, extra=_REF)
_BY = " || ".join(f"case when m_{g} then '{f}|' else '' end" for f, g, _ in _FIVE)
_CF = " || ".join(f"case when m_{g} = false then 'REF_{f.upper()}_CONFLICT|' else '' end" for f, g, _ in _FIVE)
O["reference_lookup"] = S(
    f"""select document_id, position is not null and coalesce(m_issuer, true) and coalesce(m_cnpj, true) and coalesce(m_isin, true)
      and coalesce(m_ticker, true) and coalesce(m_class, true) as exact_match, rtrim({_BY}, '|') as matched_by, g_issuer as issuer,
     case when strong_conflict then 'REF_STRONG_IDENTIFIER_CONFLICT' else rtrim({_CF}, '|') end as conflicts from cmpx""", *_RV, extra=_REF)
O["unmatched_notices"] = S("select document_id from sel where position is null", *_RV, extra=_REF)
# The sequence ratio: the longest common block (first in a, then in b), and again to its left and right. A segment is a
# pair of strings with the length of the block that cut it off its left neighbour; the sum over all segments is M.
_BLOCK = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(
  list_filter(range(1, length(b) + 1), lambda j: substr(b, j, 1) = substr(a, i, 1)), lambda j: {'l': len(list_filter(
  range(1, least(length(a) - i, length(b) - j) + 2), lambda l: substr(a, i, l) = substr(b, j, l))), 'i': -i, 'j': -j}))))"""
_FUZZY = {
    "open_names": """select n.document_id, k_issuer as name from nk n join sel s on s.document_id = n.document_id
      where s.position is null and not strong_conflict and k_issuer is not null""",
    "pairs": f"""select row_number() over () as p, o.name, g.n_issuer as other, g.issuer, g.k from (select distinct name from open_names) o
      join ngolden g on 2.0 * least(length(o.name), length(g.n_issuer)) >= {vocab.FUZZY_THRESHOLD} * (length(o.name) + length(g.n_issuer)) - 1e-9""",
    "seg": f"""select p, name as a, other as b, cast(0 as bigint) as m from pairs
      union all select p, t.a, t.b, t.m from (select p, unnest([
        {{'a': substr(a, 1, -x.i - 1), 'b': substr(b, 1, -x.j - 1), 'm': cast(x.l as bigint)}},
        {{'a': substr(a, -x.i + x.l), 'b': substr(b, -x.j + x.l), 'm': cast(0 as bigint)}}]) as t
       from (select p, a, b, {_BLOCK} as x from seg where a <> '' and b <> '') where x is not null)""",
    "scored": """select q.name, q.issuer, q.k, 2.0::double * sum(s.m) / (length(q.name) + length(q.other)) as score
      from seg s join pairs q on q.p = s.p group by q.p, q.name, q.other, q.issuer, q.k""",
    "best": f"""select *, row_number() over (partition by name order by score desc, issuer, k) as rank from scored where score >= {vocab.FUZZY_THRESHOLD}""",
}
O["fuzzy_candidates"] = S(
    f"""select o.document_id, cast(b.rank as integer) as rank, b.score, b.issuer, b.k as position from open_names o join best b on b.name = o.name
     where b.rank <= {vocab.FUZZY_TOP}""", *_RV, extra={**_REF, **_FUZZY}, recursive=True)
O["reference_enrichment"] = S(
    "select document_id, path, value, status, origin from lf where ord < 7", "lf")
O["reference_rules"] = S(
    "select document_id, ord, rule, status, message, expected, observed from valid where starts_with(rule, 'REF_')", "valid")

# -- rules
_RULE_COLUMNS = "document_id, rule, status, message, expected, observed"
for _name, _prefix in {"rule_date_approval": "DATE_APPROVAL", "rule_date_record_ex": "DATE_RECORD",
                       "rule_date_payment": "DATE_PAYMENT", "rule_gross_net_tax": "FIN_GROSS_NET"}.items():
    O[_name] = S(f"select {_RULE_COLUMNS} from rl where starts_with(rule, '{_prefix}')", "rl")
_DOC = "cast(document_id as bigint)"
_NOGROSS = f"({_DOC}%16 = 1)"
O["rule_beneficiary_tax"] = S(
    f"""select document_id, 'FIN_TAX_DEPENDS_ON_BENEFICIARY' as rule, 'WARN' as status, {q(vocab.MSG_TAX_BENEFICIARY)} as message,
      cast(null as varchar) as expected, net as observed from cmp where {_DOC}%6 = 0
     union all select document_id, 'FIN_TAX_CONDITIONAL_NET_DISCLOSED', 'WARN', {q(vocab.MSG_NET_CONDITIONAL)}, {q(vocab.EXPECT_NET_CONDITIONAL)}, net
      from cmp where {_DOC}%6 = 0 and {_DOC}%12 <> 0 and net is not null
     union all select document_id, 'FIN_UNIVERSAL_NET_NOT_APPLICABLE', 'FAIL', {q(vocab.MSG_NET_UNIVERSAL)}, null, net
      from cmp where {_DOC}%12 = 0 and net is not null
     union all select {_RULE_COLUMNS} from rl where starts_with(rule, 'FIN_GROSS_NET') and not {_NOGROSS} and {_DOC}%12 <> 0""", "cmp", "rl")
O["rule_currency"] = S(
    f"""select document_id, 'FIN_CURRENCY_MISSING' as rule, 'FAIL' as status, {q(vocab.MSG_CURRENCY)} as message,
     'ISO 4217 currency code' as expected, cast(null as varchar) as observed from cmp
     where {_DOC}%8 = 0 and (net is not null or (gross is not null and not {_NOGROSS}))""", "cmp")
_ZN = f"case when {_DOC}%14 = 0 and ratio_n = '1' then '0' else ratio_n end"
_ZD = f"case when {_DOC}%14 = 0 and ratio_d = '1' then '0' else ratio_d end"
_BADR = f"({_ZN} = '0' or {_ZD} = '0')"
O["rule_ratio"] = S(
    f"""select document_id, case when {_BADR} then 'FIN_RATIO_INVALID' else 'FIN_RATIO_VALID' end as rule,
     case when {_BADR} then 'FAIL' else 'PASS' end as status, case when {_BADR} then {q(vocab.MSG_RATIO_BAD)} else {q(vocab.MSG_RATIO_OK)} end as message,
     'numerator > 0 and denominator > 0' as expected, {_ZN} || ':' || {_ZD} || ' (' || ratio_kind || ')' as observed from cmp where e_ratio is not null""", "cmp")
O["rule_event_classification"] = S(
    f"""select document_id, case when event is null then 'EVENT_UNKNOWN' when {_DOC}%9 = 0 then 'EVENT_CLASSIFICATION_CONFLICT' else 'EVENT_CLASSIFICATION_SUPPORTED' end as rule,
     case when event is null or {_DOC}%9 = 0 then 'FAIL' else 'PASS' end as status,
     case when event is null then {q(vocab.MSG_EVENT_UNKNOWN)} when {_DOC}%9 = 0 then {q(vocab.MSG_EVENT_CONFLICT)} else {q(vocab.MSG_EVENT_OK)} end as message,
     case when event is null then 'A supported event type or OTHER' when {_DOC}%9 = 0 then 'Consistent classification evidence' else event end as expected,
     case when event is null then null when {_DOC}%9 = 0 then '["title","body"]' else event end as observed from cmp""", "cmp")
O["rule_required_fields"] = S(
    f"""select document_id, 'EVENT_REQUIRED_FIELD_MISSING' as rule, 'FAIL' as status, 'Required field is missing for ' || event || ': ' || name || '.' as message,
     name as expected, cast(null as varchar) as observed from (
     select document_id, event, 'gross_amount_per_share' as name from cmp where event in ('DIVIDEND', 'JCP') and {_NOGROSS}
     union all select document_id, event, 'currency' from cmp where event in ('DIVIDEND', 'JCP') and {_DOC}%8 = 0)""", "cmp")
O["validate_records"] = S("select document_id, ord, rule, status, message, expected, observed from valid", "valid")
O["attach_rules_to_fields"] = S(
    "select document_id, path, string_agg(rule, '|' order by ord) as rules from att group by document_id, path", "att")

# -- confidence, routing, reporting
O["field_confidence"] = S(
    "select document_id, path, value, status, origin, confidence from fc", "fc")
O["field_confidence_with_agreement"] = S(
    """select f.document_id, f.path, a.agreement as agent_agreement, cast(case when f.confidence in (0, 10, 15) or f.origin <> 'DOCUMENT' then f.confidence
      else round_even(f.confidence * 0.7::double + a.agreement * 0.3::double, 0) end as integer) as confidence
     from fc f join (select document_id, path, cast(round_even(100.0 * max(n) / sum(n), 0) as integer) as agreement from (
     select document_id, path, c, status, count(*) as n from p group by document_id, path, c, status) group by document_id, path) a
     on a.document_id = f.document_id and a.path = f.path""", "fc", "passes", extra=_P)
O["document_confidence"] = S(
    "select document_id, score, completion_percentage, required_fields, missing_fields, true as rationale_ok from dc", "dc")
O["confidence_band"] = S(
    """select path, case when confidence >= 90 then 'strong' when confidence >= 75 then 'attention' else 'critical' end as band, count(*) as n
     from fc group by 1, 2""", "fc")
O["route_documents"] = S("select document_id, processing_status, codes, messages from route", "route")
O["critical_fields"] = S(
    """select f.document_id, cast(row_number() over (partition by f.document_id order by c.ord) - 1 as integer) as ord, c.name, f.status, f.confidence
     from fc f join critical c on c.event = f.event and c.path = f.path""", "fc", "critical")
_CATEGORY = _case("code", {c: v[0] for c, v in vocab.REASONS.items()}, "null")
O["reason_dedup"] = S(
    f"""select code, {_CATEGORY} as category, count(*) as n, count(*) as distinct_n from (select distinct document_id, code, message from reason_text)
     group by code""", "reason_text")
O["exception_report_summary"] = S(
    """select count(*) as processed, count(*) filter (where processing_status = 'ACCEPTED') as accepted,
     count(*) filter (where processing_status = 'REVIEW_REQUIRED') as human_review,
     count(*) filter (where processing_status = 'PENDING_INFORMATION') as pending_information, cast(0 as bigint) as failed from route""", "route")
O["exception_report_documents"] = S(
    """select document_id, 'notice_' || document_id || '.pdf' as file_name, processing_status, score as confidence_score,
     false as manually_approved, codes from route""", "route")
O["exception_report_append"] = S(
    "select cast(case when cast(document_id as bigint)%4 = 0 then 0 else 1 end as integer) as part, document_id, processing_status from route", "route")
_SHORT = {
    "short": f"""select document_id, min(g * 100 + o) as at, message from (
      select document_id, g, o, case when code = 'CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD' then
       case when n = 1 then {q(vocab.CRITICAL_ONE)} else n || {q(vocab.CRITICAL_MANY)} end
       else {_case('code', {c: m for c, m in vocab.REASON_LABELS.items()}, 'message')} end as message
      from (select *, count(*) filter (where code = 'CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD') over (partition by document_id) as n from reason_text))
      group by document_id, message""",
}
O["attention_queue"] = S(
    """select r.document_id, r.processing_status, string_agg(s.message, ' ' order by s.at) as summary from route r join short s on s.document_id = r.document_id
     where r.processing_status <> 'ACCEPTED' group by r.document_id, r.processing_status""", "route", "reason_text", extra=_SHORT)
O["reason_summary"] = S(
    """select r.document_id, coalesce(string_agg(s.message, '|' order by s.at), '') as messages from route r left join short s on s.document_id = r.document_id
     group by r.document_id""", "route", "reason_text", extra=_SHORT)
_LABEL = _case("f.status", vocab.FIELD_STATUS_LABELS, "f.status")
O["confidence_reason"] = S(
    f"""select f.document_id, f.path, case when coalesce(a.failed, false) then {q(vocab.WHY_RULE_FAILED)}
     when f.status in ('AMBIGUOUS','CONFLICT','UNREADABLE','UNKNOWN') then {q(vocab.WHY_STATUS[0])} || {_LABEL} || {q(vocab.WHY_STATUS[1])}
     when f.status = 'NOT_DISCLOSED' then {q(vocab.WHY_NOT_DISCLOSED)} when f.origin = 'REFERENCE' then {q(vocab.WHY_REFERENCE)}
     when f.origin = 'DOCUMENT' then {q(vocab.WHY_DOCUMENT[0])} || f.confidence || {q(vocab.WHY_DOCUMENT[1])} else {q(vocab.WHY_NONE)} end as reason
     from fc f left join (select document_id, path, bool_or(status = 'FAIL') as failed from att group by document_id, path) a
     on a.document_id = f.document_id and a.path = f.path""", "fc", "att")
O["record_overview"] = S(
    """select r.document_id, m.n = 0 as read_ok, x.exact_match as reference_ok, coalesce(v.n, 0) = 0 as rules_ok,
     r.processing_status = 'ACCEPTED' as routing_ok, cast(coalesce(v.n, 0) as integer) as failed_rules
     from route r join missing m on m.document_id = r.document_id join exact x on x.document_id = r.document_id
     left join (select document_id, count(*) as n from valid where status = 'FAIL' group by document_id) v on v.document_id = r.document_id""",
    "route", "missing", "exact", "valid")
O["process_notices"] = S(
    """select r.document_id, r.processing_status, r.score, c.event as event_type, c.e_isin as isin, l.status as ticker_status,
     cast(c.record as varchar) as record_date, c.gross as gross_amount, v.rules, r.codes
     from route r join cmp c on c.document_id = r.document_id join lf l on l.document_id = r.document_id and l.path = 'security.ticker'
     join (select document_id, string_agg(rule, '|' order by ord) as rules from valid group by document_id) v on v.document_id = r.document_id""",
    "route", "cmp", "lf", "valid")

# -- streams: the batch answer
O["stream_admission"] = "select distinct sha256(text) as sha256 from documents"
O["stream_registry"] = S(
    "select doc_key, cast(max(revision) as integer) as revision, cast(max(accepted) as bigint) as accepted from run group by doc_key",
    "log", extra=_REPLAY, recursive=True)
O["stream_report"] = S(
    """select strftime(w, '%Y-%m-%d') as window_start, count(*) filter (where not is_late) as processed,
     count(*) filter (where processing_status = 'ACCEPTED' and not is_late) as accepted,
     count(*) filter (where processing_status = 'REVIEW_REQUIRED' and not is_late) as human_review,
     count(*) filter (where processing_status = 'PENDING_INFORMATION' and not is_late) as pending_information,
     count(*) filter (where processing_status = 'FAILED' and not is_late) as failed, count(*) filter (where is_late) as late
     from told group by w having w + interval 1 day <= date_trunc('millisecond', (select max(ts) from told) - interval 1 day)
     and count(*) filter (where not is_late) > 0""",
    extra={
        "outcomes": _f(samples.OUTCOMES),
        "bound": """select p.part, date_trunc('millisecond', (select max(o.ts) from outcomes o where o.part < p.part) - interval 1 day) as mark
          from (select distinct part from outcomes) p""",
        "told": """select o.ts, o.processing_status, date_trunc('day', o.ts) as w,
          coalesce(date_trunc('day', o.ts) + interval 1 day <= b.mark, false) as is_late from outcomes o join bound b on b.part = o.part"""})
O["stream_process"] = S(
    """select document_id, 'notice_' || document_id || '.json' as file_name, processing_status,
     cast(case when cast(document_id as bigint) % 4 = 0 then 2 else 1 end as bigint) as changes from route""", "route")
