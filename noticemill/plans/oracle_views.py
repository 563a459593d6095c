"""Independent ANSI-SQL statement of the computations, for cross-checking.

Common table expressions shared by the per-query statements in ``oracle.py``.
"""

from __future__ import annotations

from noticemill import vocab
from noticemill.sources import derived


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _norm_issuer(c: str) -> str:
    return (
        f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({c})), "
        r"'\bs\s*\.\s*a\s*\.?', ' sa ', 'g'), '\bltda\s*\.?', ' ltda ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
    )


def norm_text(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g')), '')"


norm_issuer = _norm_issuer


def norm_code(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')), '')"


def norm_cnpj(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '\D', '', 'g'), '')"


D = r"\d{1,2}[/-]\d{1,2}[/-]\d{4}"
M = r"\d{1,3}(?:\.\d{3})*,\d+"


def _ev(name: str, pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}'), '') as e_{name}"


EXT = rf"""
select cast(doc as varchar) as document_id, doc, text,
 case when regexp_matches(split_part(text, chr(10), 1), '(?i)\bS\.?A\.?$') then split_part(text, chr(10), 1) end as issuer,
 {_ev('cnpj', r'\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b')},
 {_ev('isin', r'\bBR[A-Z0-9]{10}\b')},
 {_ev('ticker', r'\b[A-Z]{4}\d{1,2}\b')},
 {_ev('class', r'\((ON|PN)\)')},
 {_ev('jcp', '(?i)juros sobre (?:o )?capital pr[oó]prio|remunera[cç][aã]o do capital pr[oó]prio')},
 {_ev('bonus', '(?i)bonifica[cç][aã]o em a[cç][oõ]es')},
 {_ev('reverse', r'(?i)grupamento de a[cç][oõ]es|\binplit\b')},
 {_ev('split', r'(?i)desdobramento de a[cç][oõ]es|\bsplit\b')},
 {_ev('dividend', r'(?i)dividendos?(?:\s+intercalares?)?')},
 {_ev('approval', rf'(?i)Data de aprova[cç][aã]o[^\n]*\s+{D}')},
 {_ev('record', rf'(?i)Data-base(?: do grupamento)?[^\n]*\s+{D}')},
 {_ev('ex', rf'(?i)Data\s+ex[^\n]*\s+{D}')},
 {_ev('payment', rf'(?i)Data de pagamento[^\n]*\s+{D}')},
 {_ev('credit', rf'(?i)Cr[eé]dito das a[cç][oõ]es bonificadas[^\n]*\s+{D}')},
 {_ev('fraction', rf'(?i)Per[ií]odo de ajuste de fra[cç][oõ]es[^\n]*\s+{D}\s+a\s+{D}')},
 {_ev('narrative', r'(?i)(?:reuni[aã]o|Assembleia Geral Extraordin[aá]ria)(?:\s+realizada)?\s+(?:em|de)\s+\d{1,2}\s+de\s+[A-Za-z]+\s+de\s+\d{4}')},
 {_ev('open', r'(?i)data de pagamento ser[aá] [^.\n]*(?:definida|divulgada)[^.\n]*')},
 {_ev('gross', rf'(?i)Valor bruto por a[cç][aã]o[^\n]*(?:\s*\([^\n]+\))?\s*R\$\s*{M}')},
 {_ev('net', rf'(?i)Valor l[ií]quido por a[cç][aã]o[^\n]*(?:\s*\([^\n]+\))?\s*R\$\s*{M}')},
 {_ev('cost', rf'(?i)Custo atribu[ií]do[^\n]*\s*R\$\s*{M}')},
 {_ev('rate', r'(?i)(?:IRRF na fonte|Imposto de Renda Retido na\s+Fonte)\s*\d+(?:,\d+)?%')},
 {_ev('dependent', r'(?is)al[ií]quota[^.]{0,300}(?:por benefici[aá]rio|condi[cç][aã]o do benefici[aá]rio)')},
 {_ev('uniform', r'(?i)(?:incidir[aá]|reten[cç][aã]o de)\s+Imposto de Renda[^.\n]*')},
 {_ev('ratio1', r'(?i)Propor[cç][aã]o\s+\d+\s*:\s*\d+')},
 {_ev('ratio2', r'(?i)Propor[cç][aã]o\s+\d+\s+a[cç][aã]o nova para cada\s+\d+\s+a[cç][oõ]es(?:\s*\(\d+(?:,\d+)?%\))?')}
from d3
"""


def _day(e: str) -> str:
    return rf"cast(strptime(regexp_extract({e}, '({D})$', 1), '%d/%m/%Y') as date)"


def _money(e: str) -> str:
    return f"replace(replace(regexp_extract({e}, '({M})$', 1), '.', ''), ',', '.')"


EXTRACTED = rf"""
select *,
 regexp_extract(e_class, '(ON|PN)', 1) as share_class,
 case when e_jcp is not null then 'JCP' when e_bonus is not null then 'BONUS_SHARES'
  when e_reverse is not null then 'REVERSE_SPLIT' when e_split is not null then 'STOCK_SPLIT'
  when e_dividend is not null then 'DIVIDEND' end as event,
 coalesce(e_jcp, e_bonus, e_reverse, e_split, e_dividend) as e_event,
 {_day('e_approval')} as approval, {_day('e_record')} as record, {_day('e_ex')} as ex, {_day('e_payment')} as payment,
 {_money('e_gross')} as gross, {_money('e_net')} as net,
 replace(regexp_extract(e_rate, '(\d+(?:,\d+)?)%', 1), ',', '.') as rate,
 coalesce(e_gross, e_net, e_cost) as e_currency,
 case when coalesce(e_gross, e_net, e_cost) is not null then 'BRL' end as currency,
 coalesce(e_ratio1, e_ratio2) as e_ratio,
 coalesce(regexp_extract(e_ratio1, '(\d+)\s*:\s*(\d+)', 1), regexp_extract(e_ratio2, 'o\s+(\d+)\s', 1)) as ratio_a,
 coalesce(regexp_extract(e_ratio1, '(\d+)\s*:\s*(\d+)', 2), regexp_extract(e_ratio2, 'cada\s+(\d+)', 1)) as ratio_b
from ext
"""

NOTICES = """
select *, case when event = 'REVERSE_SPLIT' then ratio_b else ratio_a end as ratio_n,
 case when event = 'REVERSE_SPLIT' then ratio_a else ratio_b end as ratio_d,
 case when event = 'BONUS_SHARES' then 'NEW_PER_EXISTING' else 'RESULTING_PER_EXISTING' end as ratio_kind
from extracted
"""

NGOLDEN = f"""
select *, {norm_issuer('issuer')} as n_issuer, {norm_cnpj('cnpj')} as n_cnpj, {norm_code('isin')} as n_isin,
 {norm_code('ticker')} as n_ticker, share_class as n_class from golden
"""

REF = f"""
select n.*, gi.k as isin_k, gc.k as cnpj_k, gt.k as ticker_k, gn.k as issuer_k, gn.c as issuer_c,
 coalesce(case when gi.c = 1 then gi.k end, case when gc.c = 1 then gc.k end, case when gt.c = 1 then gt.k end,
  case when gn.c = 1 then gn.k end) as sel,
 coalesce(gi.k <> gc.k, false) as strong_conflict
from (select *, {norm_issuer('issuer')} as k_issuer, {norm_cnpj('e_cnpj')} as k_cnpj, {norm_code('e_isin')} as k_isin,
 {norm_code('e_ticker')} as k_ticker from notices) n
left join (select n_isin, min(k) as k, count(*) as c from ngolden group by n_isin) gi on gi.n_isin = n.k_isin
left join (select n_cnpj, min(k) as k, count(*) as c from ngolden group by n_cnpj) gc on gc.n_cnpj = n.k_cnpj
left join (select n_ticker, min(k) as k, count(*) as c from ngolden group by n_ticker) gt on gt.n_ticker = n.k_ticker
left join (select n_issuer, min(k) as k, count(*) as c from ngolden group by n_issuer) gn on gn.n_issuer = n.k_issuer
"""

CMP = """
select r.*, g.issuer as g_issuer, g.cnpj as g_cnpj, g.isin as g_isin, g.ticker as g_ticker, g.share_class as g_class,
 g.listing_segment as g_segment, g.status as g_status,
 k_issuer = g.n_issuer as m_issuer, k_cnpj = g.n_cnpj as m_cnpj, k_isin = g.n_isin as m_isin,
 k_ticker = g.n_ticker as m_ticker, r.share_class = g.n_class as m_class
from ref r left join ngolden g on g.k = r.sel and not r.strong_conflict
"""


def _lf() -> str:
    """Long fields after enrichment: (document_id, ord, path, value, status, origin, src)."""
    identity = {
        "issuer_name": ("issuer", "m_issuer", "g_issuer"),
        "issuer_cnpj": ("e_cnpj", "m_cnpj", "g_cnpj"),
        "isin": ("e_isin", "m_isin", "g_isin"),
        "ticker": ("e_ticker", "m_ticker", "g_ticker"),
        "share_class": ("share_class", "m_class", "g_class"),
        "listing_segment": ("null", "null", "g_segment"),
        "asset_status": ("null", "null", "g_status"),
    }
    plain = {
        "event_type": "event", "approval_date": "cast(approval as varchar)", "record_date": "cast(record as varchar)",
        "ex_date": "cast(ex as varchar)", "payment_date": "cast(payment as varchar)", "credit_date": "null",
        "fraction_period_start": "null", "fraction_period_end": "null", "gross_amount_per_share": "gross",
        "net_amount_per_share": "net", "tax_rate_percent": "rate", "tax_treatment": "null", "currency": "currency",
        "ratio": "case when e_ratio is not null then ratio_n || ':' || ratio_d || ' (' || ratio_kind || ')' end",
        "attributed_cost_per_share": "null",
    }
    parts = []
    for i, (name, path) in enumerate(vocab.FIELDS):
        if name in identity:
            value, match, golden = identity[name]
            parts.append(
                f"select document_id, {i} as ord, '{path}' as path, coalesce({value}, {golden}) as value, "
                f"case when {value} is null and {golden} is not null then 'REFERENCE_ENRICHED' "
                f"when {value} is null then 'UNKNOWN' when {match} = false then 'CONFLICT' else 'EXTRACTED' end as status, "
                f"case when {value} is not null then 'DOCUMENT' when {golden} is not null then 'REFERENCE' "
                f"else 'UNKNOWN' end as origin, {value} is not null as src from cmp"
            )
        else:
            value = plain[name]
            open_ = "payment is null and e_open is not null" if name == "payment_date" else "false"
            parts.append(
                f"select document_id, {i}, '{path}', {value}, case when {open_} then 'NOT_DISCLOSED' "
                f"when {value} is not null then 'EXTRACTED' else 'UNKNOWN' end, "
                f"case when {value} is not null or {open_} then 'DOCUMENT' else 'UNKNOWN' end, "
                f"{value} is not null or {open_} from cmp"
            )
    return " union all ".join(parts)


def _rl() -> str:
    """Rule results: (document_id, g, o, rule, status, message, expected, observed)."""
    out = []

    def add(g, o, cond, rule, status, message, expected="null", observed="null"):
        out.append(
            f"select document_id, {g} as g, {o} as o, {rule} as rule, {status} as status, {message} as message, "
            f"cast({expected} as varchar) as expected, cast({observed} as varchar) as observed from cmp where {cond}"
        )

    pairs = [("issuer", "m_issuer", "issuer", "g_issuer"), ("cnpj", "m_cnpj", "e_cnpj", "g_cnpj"),
             ("isin", "m_isin", "e_isin", "g_isin"), ("ticker", "m_ticker", "e_ticker", "g_ticker"),
             ("share_class", "m_class", "share_class", "g_class")]
    add(0, 0, "g_isin is null", "'REF_NO_MATCH'", "'FAIL'", q(vocab.MSG_NO_REFERENCE))
    for i, (name, match, raw, golden) in enumerate(pairs):
        add(0, 1 + i, match, f"'REF_{name.upper()}_MATCH'", "'PASS'", f"'{name} matches the reference record.'")
        add(0, 11 + i, f"{match} = false", f"'REF_{name.upper()}_CONFLICT'", "'FAIL'",
            f"'{name} conflicts with the reference record.'", golden, raw)
    add(0, 20, "g_status <> 'ativo'", "'REF_ASSET_INACTIVE'", "'FAIL'", q(vocab.MSG_INACTIVE), "'ativo'", "g_status")

    def ordered(o, cond, ok, rule, good, bad, expected, observed):
        add(1, o, cond, f"'{rule}'", f"case when {ok} then 'PASS' else 'FAIL' end",
            f"case when {ok} then {q(good)} else {q(bad)} end", f"'{expected}'", observed)

    ordered(0, "event is not null and approval is not null and record is not null", "approval <= record",
            "DATE_APPROVAL_AFTER_RECORD", vocab.MSG_APPROVAL_OK, vocab.MSG_APPROVAL_BAD,
            "approval_date <= record_date", "approval || ' > ' || record")
    ordered(1, "event is not null and record is not null and ex is not null", "record < ex",
            "DATE_RECORD_NOT_BEFORE_EX", vocab.MSG_RECORD_OK, vocab.MSG_RECORD_BAD,
            "record_date < ex_date", "record || ' / ' || ex")
    add(1, 2, "event in ('DIVIDEND','JCP') and payment is null and e_open is not null", "'DATE_PAYMENT_NOT_DISCLOSED'",
        "'WARN'", q(vocab.MSG_PAYMENT_OPEN), "'A disclosed payment date'")
    ordered(3, "event in ('DIVIDEND','JCP') and payment is not null and record is not null", "payment >= record",
            "DATE_PAYMENT_BEFORE_RECORD", vocab.MSG_PAYMENT_OK, vocab.MSG_PAYMENT_BAD,
            "payment_date >= record_date", "payment || ' / ' || record")
    exp = "cast(gross as decimal(12,6)) * (1 - cast(cast(rate as decimal(9,6)) / 100 as decimal(9,6)))"
    # '15.0' and '10.0' percent need fewer fraction digits than '17.5'
    digits = "length(split_part(gross, '.', 2)) + greatest(length(split_part(rate, '.', 2)), " \
             "length(rtrim(split_part(cast(cast(cast(rate as decimal(9,6)) / 100 as decimal(9,6)) as varchar), '.', 2), '0')))"
    text = f"substr(cast({exp} as varchar), 1, instr(cast({exp} as varchar), '.') + {digits})"
    ok = f"abs(cast(net as decimal(20,12)) - ({exp})) <= 0.0000005"
    add(2, 0, "gross is not null and net is not null and rate is not null",
        f"case when {ok} then 'FIN_GROSS_NET_TAX_CONSISTENT' else 'FIN_GROSS_NET_TAX_MISMATCH' end",
        f"case when {ok} then 'PASS' else 'FAIL' end",
        f"case when {ok} then {q(vocab.MSG_TAX_OK)} else {q(vocab.MSG_TAX_BAD)} end", text, "net")
    add(2, 1, "(gross is not null or net is not null) and currency is null", "'FIN_CURRENCY_MISSING'", "'FAIL'",
        q(vocab.MSG_CURRENCY), "'ISO 4217 currency code'")
    pos = "cast(ratio_n as bigint) > 0 and cast(ratio_d as bigint) > 0"
    add(2, 2, "e_ratio is not null", f"case when {pos} then 'FIN_RATIO_VALID' else 'FIN_RATIO_INVALID' end",
        f"case when {pos} then 'PASS' else 'FAIL' end",
        f"case when {pos} then {q(vocab.MSG_RATIO_OK)} else {q(vocab.MSG_RATIO_BAD)} end",
        "'numerator > 0 and denominator > 0'", "ratio_n || ':' || ratio_d || ' (' || ratio_kind || ')'")
    add(3, 0, "event is null", "'EVENT_UNKNOWN'", "'FAIL'", q(vocab.MSG_EVENT_UNKNOWN),
        "'A supported event type or OTHER'")
    add(3, 1, "event is not null", "'EVENT_CLASSIFICATION_SUPPORTED'", "'PASS'", q(vocab.MSG_EVENT_OK), "event", "event")
    need = {"record_date": "record", "ex_date": "ex", "gross_amount_per_share": "gross", "currency": "currency",
            "ratio": "e_ratio"}
    for i, (name, col) in enumerate(need.items()):
        events = ",".join(f"'{e}'" for e, f in vocab.RULE_REQUIRED_BY_EVENT.items() if name in f)
        add(3, 2 + i, f"event in ({events}) and {col} is null", "'EVENT_REQUIRED_FIELD_MISSING'", "'FAIL'",
            f"'Required field is missing for ' || event || ': {name}.'", f"'{name}'")
    return " union all ".join(out)


def _prefixes() -> str:
    rows = [f"('{p}','{vocab.PATH_OF[f]}')" for p, fields in vocab.RULE_PREFIXES.items() for f in fields]
    return f"select * from (values {','.join(rows)}) t(prefix, path)"


def _material() -> str:
    rows = []
    for event in [*vocab.EVENT_TYPES, "-"]:
        names = vocab.MATERIAL_ALWAYS + vocab.MATERIAL_BY_EVENT.get(event, [])
        rows += [f"('{event}',{i},'{vocab.PATH_OF[n]}')" for i, n in enumerate(names)]
    return f"select * from (values {','.join(rows)}) t(event, ord, path)"


def _critical() -> str:
    rows = []
    for event in [*vocab.EVENT_TYPES, "-"]:
        names = list(vocab.CRITICAL_ALWAYS)
        if event in vocab.CASH_EVENTS:
            names.append(vocab.CRITICAL_CASH)
        if event in vocab.RATIO_EVENTS:
            names.append(vocab.CRITICAL_RATIO)
        rows += [f"('{event}',{i},'{n}','{vocab.PATH_OF[c]}')" for i, (n, c) in enumerate(names)]
    return f"select * from (values {','.join(rows)}) t(event, ord, name, path)"


VALID = """
select document_id, cast(row_number() over (partition by document_id order by g, o) - 1 as integer) as ord,
 rule, status, message, expected, observed from rl
"""

ATT = """
select distinct v.document_id, p.path, v.ord, v.rule, v.status from valid v join prefixes p on starts_with(v.rule, p.prefix)
"""

EXACT = """
select document_id, g_isin is not null and coalesce(m_issuer, true) and coalesce(m_cnpj, true) and coalesce(m_isin, true)
 and coalesce(m_ticker, true) and coalesce(m_class, true) as exact_match, coalesce(event, '-') as event from cmp
"""

FC = """
select l.document_id, l.ord, l.path, l.value, l.status, l.origin, l.src, x.event,
 cast(case when l.status in ('AMBIGUOUS','CONFLICT','UNREADABLE') then 10 when l.status = 'UNKNOWN' then 0
  when coalesce(a.failed, false) then 15 when l.status = 'NOT_DISCLOSED' then 95
  when l.origin = 'REFERENCE' then case when x.exact_match then 95 else 75 end
  when l.origin = 'DOCUMENT' then 92 else 20 end as integer) as confidence
from lf l join exact x on l.document_id = x.document_id
left join (select document_id, path, bool_or(status = 'FAIL') as failed from att group by document_id, path) a
 on a.document_id = l.document_id and a.path = l.path
"""

DC = """
select f.document_id, any_value(f.event) as event, cast(round_even(sum(case when f.value is not null or
   (f.status = 'NOT_DISCLOSED' and f.src) then f.confidence else 0 end) / count(*), 0) as integer) as score,
 cast(round_even(100.0 * count(*) filter (where (f.value is not null or (f.status = 'NOT_DISCLOSED' and f.src))
   and f.confidence > 0) / count(*), 0) as integer) as completion_percentage,
 string_agg(f.path, '|' order by m.ord) as required_fields,
 coalesce(string_agg(f.path, '|' order by m.ord) filter (where not ((f.value is not null or
   (f.status = 'NOT_DISCLOSED' and f.src)) and f.confidence > 0)), '') as missing_fields
from fc f join material m on m.event = f.event and m.path = f.path group by f.document_id
"""

REASONS = """
select document_id, 1 as g, 0 as o, 'EXTRACTION_CASCADE_EXHAUSTED' as code from missing where n > 0
union all select document_id, 2, 0, 'EVENT_CLASSIFICATION_AMBIGUOUS' from cmp where event is null
union all select document_id, 4, 0, 'DOCUMENT_CONFIDENCE_BELOW_THRESHOLD' from dc where score < 75
union all select document_id, 5, 0, 'REFERENCE_NOT_FOUND' from cmp where g_isin is null
union all select document_id, 6, 0, 'REFERENCE_IDENTIFIER_CONFLICT' from cmp where false in (m_issuer, m_cnpj, m_isin, m_ticker, m_class)
union all select document_id, 7, ord, case when starts_with(rule, 'DATE_') then 'DATE_SEQUENCE_INCONSISTENT'
  else 'FINANCIAL_VALUES_INCONSISTENT' end from valid where status = 'FAIL' and (starts_with(rule, 'DATE_') or starts_with(rule, 'FIN_'))
union all select f.document_id, 8, c.ord, 'CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD' from fc f
  join critical c on c.event = f.event and c.path = f.path where f.confidence < 75
union all select document_id, 9, 0, 'PAYMENT_DATE_NOT_DISCLOSED' from fc
  where path = 'corporate_action.dates.payment_date' and status = 'NOT_DISCLOSED'
"""

REASON_TEXT = """
select r.*, case r.code
 when 'EXTRACTION_CASCADE_EXHAUSTED' then 'The extraction cascade ended with unresolved critical fields.'
 when 'EVENT_CLASSIFICATION_AMBIGUOUS' then 'The corporate action type could not be determined.'
 when 'DOCUMENT_CONFIDENCE_BELOW_THRESHOLD' then 'Document confidence is below 75%: ' || d.score || '%.'
 when 'REFERENCE_NOT_FOUND' then 'No golden record could be confirmed for the extracted security.'
 when 'REFERENCE_IDENTIFIER_CONFLICT' then 'Extracted identifiers conflict with the golden record.'
 when 'PAYMENT_DATE_NOT_DISCLOSED' then 'The issuer states that the payment date will be disclosed later.'
 when 'CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD' then
   'Critical field confidence is below 75%: ' || c.name || ' (' || f.confidence || '%).'
 else v.message end as message
from reasons r join dc d on d.document_id = r.document_id
left join critical c on r.g = 8 and c.event = d.event and c.ord = r.o
left join fc f on r.g = 8 and f.document_id = r.document_id and f.path = c.path
left join valid v on r.g = 7 and v.document_id = r.document_id and v.ord = r.o
"""

MISSING = """
select f.document_id, f.event, count(*) filter (where not ok) as n,
 coalesce(string_agg(f.path, '|' order by f.ord) filter (where not ok), '') as unresolved
from (select x.document_id, x.event, m.ord, m.path, coalesce(l.src, false) as ok
  from exact x join material m on m.event = x.event
  left join plf l on l.document_id = x.document_id and l.path = m.path) f
group by f.document_id, f.event
"""

# Fields as extracted, before enrichment.
PLF = """
select document_id, ord, path, case when origin = 'REFERENCE' then null else value end as value,
 case when origin = 'REFERENCE' then 'UNKNOWN' when status = 'CONFLICT' then 'EXTRACTED' else status end as status,
 case when origin = 'REFERENCE' then 'UNKNOWN' else origin end as origin, src from lf
"""

ROUTE = """
select d.document_id, d.event, d.score,
 case when count(r.code) filter (where r.g < 9) > 0 then 'REVIEW_REQUIRED' when count(r.code) > 0 then 'PENDING_INFORMATION'
  else 'ACCEPTED' end as processing_status,
 coalesce(string_agg(r.code, '|' order by r.g, r.o), '') as codes,
 coalesce(string_agg(r.message, '|' order by r.g, r.o), '') as messages
from dc d left join reason_text r on r.document_id = d.document_id group by d.document_id, d.event, d.score
"""

_T = {"supplier": "supplier", "orders": "orders", "documents": "documents", "events": "events",
      "fields": "fields", "golden": "golden"}

VIEWS = {
    "golden": derived.GOLDEN.format(**_T),
    "fields": derived.FIELDS.format(**_T),
    "d3": derived.PAGES.format(**_T),
    "passes": derived.PASSES.format(**_T),
    "uploads": derived.UPLOADS.format(**_T),
    "log": derived.LOG.format(**_T),
    "registry": derived.REGISTRY.format(**_T),
    "ext": EXT,
    "extracted": EXTRACTED,
    "notices": NOTICES,
    "ngolden": NGOLDEN,
    "ref": REF,
    "cmp": CMP,
    "lf": _lf(),
    "plf": PLF,
    "rl": _rl(),
    "prefixes": _prefixes(),
    "material": _material(),
    "critical": _critical(),
    "valid": VALID,
    "att": ATT,
    "exact": EXACT,
    "fc": FC,
    "dc": DC,
    "missing": MISSING,
    "reasons": REASONS,
    "reason_text": REASON_TEXT,
    "route": ROUTE,
}
_NEEDS = {
    "golden": [], "fields": [], "d3": ["fields", "golden"], "passes": ["fields", "golden"], "uploads": [], "log": [],
    "registry": [], "ext": ["d3"], "extracted": ["ext"], "notices": ["extracted"], "ngolden": ["golden"],
    "ref": ["notices", "ngolden"], "cmp": ["ref"], "lf": ["cmp"], "plf": ["lf"], "rl": ["cmp"], "prefixes": [],
    "material": [], "critical": [], "valid": ["rl"], "att": ["valid", "prefixes"], "exact": ["cmp"],
    "fc": ["lf", "exact", "att"], "dc": ["fc", "material"], "missing": ["exact", "material", "plf"],
    "reasons": ["missing", "dc", "valid", "fc", "critical"], "reason_text": ["reasons"], "route": ["reason_text"],
}


def statement(body: str, *views: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` preceded by the views it needs (``extra`` come last)."""
    ordered: list[str] = []

    def visit(view: str) -> None:
        for needed in _NEEDS[view]:
            visit(needed)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        visit(view)
    ctes = [f"{v} as ({VIEWS[v].strip()})" for v in ordered]
    ctes += [f"{n} as ({s.strip()})" for n, s in (extra or {}).items()]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
