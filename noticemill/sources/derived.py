"""Notice-processing inputs derived from the star-schema test tables.

The generic tables hold no notices, so suppliers become the golden table,
orders become notices (with deliberate faults), documents become uploads and
events become a registry log.  Only portable integer arithmetic is used, hence
the same text serves Spark and any ANSI engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticemill.functions.scale import spread
from noticemill.sources.pages import as_pages


def _letter(e: str) -> str:
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(({e}) % 26 as int)+1, 1)"


def _code(k: str) -> str:
    """Four letters, different for each of the first 26**4 keys."""
    return "concat({}, {}, {}, {})".format(
        _letter(f"{k}*7+3+cast(floor({k}/676) as bigint)"),
        _letter(f"{k}*11+5+cast(floor({k}/17576) as bigint)"),
        _letter(f"cast(floor({k}/26) as bigint)+1"),
        _letter(k),
    )


def _dmy(d: str) -> str:
    return (
        f"concat(lpad(cast(day({d}) as string),2,'0'),'/',"
        f"lpad(cast(month({d}) as string),2,'0'),'/',cast(year({d}) as string))"
    )


# Keys beyond the 26**4 codes, counted by the further characters of ISIN and ticker.
_MORE = "cast(floor(s_suppkey/456976) as bigint)"
# Every identifier holds all digits of the key: unique to 10**8 rows (CNPJ), 26**7 (ISIN), 48 x 26**4 (ticker).
GOLDEN = f"""
select s_suppkey as k,
 concat(case cast(s_suppkey%4 as int) when 0 then 'Energética ' when 1 then 'Companhia Siderúrgica '
   when 2 then 'Águas do ' else 'Logística ' end, {_code('s_suppkey')}, ' S.A.') as issuer,
 concat(lpad(cast((s_suppkey*37+11+cast(floor(s_suppkey/1000000) as bigint))%100 as string),2,'0'),'.',lpad(cast((s_suppkey*191+7+cast(floor(s_suppkey/1000) as bigint))%1000 as string),3,'0'),
   '.',lpad(cast(s_suppkey%1000 as string),3,'0'),'/0001-',lpad(cast((s_suppkey*53)%100 as string),2,'0')) as cnpj,
 concat('BR',{_code('s_suppkey')},{_letter(_MORE)},{_letter(f'cast(floor({_MORE}/26) as bigint)+2')},
   {_letter(f'cast(floor({_MORE}/676) as bigint)+13')},case when s_suppkey%3=0 then 'PR' else 'OR' end,
   cast(s_suppkey%10 as string)) as isin,
 concat({_code('s_suppkey')}, cast({_MORE}*2 + case when s_suppkey%3=0 then 4 else 3 end as string)) as ticker,
 case when s_suppkey%3=0 then 'PN' else 'ON' end as share_class,
 case cast(s_suppkey%4 as int) when 0 then 'Novo Mercado' when 1 then 'Nível 1' when 2 then 'Nível 2'
   else 'Tradicional' end as listing_segment,
 case when s_suppkey%17=0 then 'inativo' else 'ativo' end as status
from {{supplier}}
"""

FIELDS = """
select o_orderkey as k, (o_orderkey*31) % (select count(*) from {supplier}) as gk,
 case cast(o_orderkey%10 as int) when 0 then 'JCP' when 1 then 'JCP' when 2 then 'JCP' when 3 then 'BONUS_SHARES'
   when 4 then 'REVERSE_SPLIT' when 5 then 'STOCK_SPLIT' when 6 then 'UNKNOWN' else 'DIVIDEND' end as ev,
 cast(round(o_totalprice*100) as bigint)%1000000 as g6,
 case cast(o_orderkey%4 as int) when 0 then 150 when 1 then 175 when 2 then 225 else 100 end as r10,
 cast(o_orderdate as date) as rec,
 cast(o_orderdate as date) - cast(o_orderkey%20 as int) + (case when o_orderkey%23=0 then 40 else 0 end) as appr,
 cast(o_orderdate as date) + (case when o_orderkey%29=0 then 0 else 1 end) as exd,
 cast(o_orderdate as date) + cast(o_orderkey%90 as int) - 5 as pay
from {orders}
"""

PAGES = f"""
select f.k as doc, 1 as page, concat(
 case when f.k%13=0 then upper(g.issuer) else g.issuer end, chr(10), 'CNPJ/ME nº ', g.cnpj, chr(10),
 case ev when 'JCP' then 'Aviso de juros sobre o capital próprio' when 'DIVIDEND' then 'Aviso de Dividendos'
   when 'BONUS_SHARES' then 'Bonificação em ações' when 'REVERSE_SPLIT' then 'Grupamento de ações'
   when 'STOCK_SPLIT' then 'Desdobramento de ações' else 'Fato relevante' end, chr(10),
 'Código de negociação', chr(10), case when f.k%19=0 then 'ZZZZ3' else g.ticker end, ' (ISIN ', g.isin, ')', chr(10),
 'Data de aprovação ', {_dmy('appr')}, chr(10), 'Data-base ', {_dmy('rec')}, chr(10),
 'Data ex ', {_dmy('exd')}, chr(10),
 case when f.k%31=0 then 'A data de pagamento será oportunamente divulgada'
   else concat('Data de pagamento ', {_dmy('pay')}) end, chr(10),
 case when ev in ('JCP','DIVIDEND') then concat('Valor bruto por ação (', g.share_class, ') R$ 0,',
   lpad(cast(g6 as string),6,'0'), chr(10)) else '' end,
 case when ev='JCP' then concat('Valor líquido por ação R$ 0,',
   lpad(cast(g6*(1000-r10)+(case when f.k%11=0 then 5000 else 0 end) as string),9,'0'), chr(10),
   'IRRF na fonte ', cast(cast(floor(r10/10) as int) as string), ',', cast(r10%10 as string), '%', chr(10))
   else '' end,
 case when ev in ('REVERSE_SPLIT','STOCK_SPLIT') then concat('Proporção ', cast(f.k%9+2 as string), ':1')
   when ev='BONUS_SHARES' then concat('Proporção 1 ação nova para cada ', cast(f.k%20+2 as string), ' ações')
   else '' end) as text
from {{fields}} f join {{golden}} g on f.gk=g.k
"""

PASSES = """
with w as (select f.k, f.ev, g.ticker, g.isin, cast(f.rec as string) as rec, cast(f.pay as string) as pay,
   cast(f.g6 as string) as g6 from {fields} f join {golden} g on f.gk=g.k),
 i as (select 1 as pidx union all select 2 union all select 3 union all select 4 union all select 5 union all select 6),
 l as (select k, pidx,
   case pidx when 1 then 'corporate_action.event_type' when 2 then 'security.ticker' when 3 then 'security.isin'
    when 4 then 'corporate_action.dates.record_date' when 5 then 'corporate_action.dates.payment_date'
    else 'corporate_action.financials.gross_amount_per_share' end as path,
   case pidx when 1 then ev when 2 then ticker when 3 then isin when 4 then rec when 5 then pay else g6 end as v
  from w cross join i),
 p as (select 1 as pass_no union all select 2 union all select 3)
select k,pidx,path,pass_no,
 case when (k*3+pass_no*7+pidx)%13=0 then null when (k*5+pass_no*11+pidx)%17=0 then concat('X',v)
   when path='security.ticker' and pass_no=2 then lower(v) else v end as value,
 case when (k*3+pass_no*7+pidx)%13=0 then (case when k%2=0 then 'UNKNOWN' else 'NOT_DISCLOSED' end)
   when (k+pass_no)%41=0 then 'AMBIGUOUS' else 'EXTRACTED' end as status
from l cross join p where pass_no<3 or k%5=0
"""

UPLOADS = """
select doc_id as seq, doc_id%20 as batch_id,
 case when doc_id%37=0 then '' when doc_id%41=0 then concat('a/',source,'.pdf')
   when doc_id%43=0 then concat(source,'.txt') else concat(source,'.pdf') end as file_name,
 case when doc_id%47=0 then 'text/plain' when doc_id%2=0 then 'application/pdf'
   else 'application/x-pdf' end as content_type,
 n_chars*1000 as size_bytes, case when doc_id%53=0 then '<html' else '%PDF-' end as magic, text as content
from {documents}
"""

LOG = """
select event_id as seq, cast(ts as timestamp) as ts, user_id as doc_key,
 case event_type when 'signup' then 'CLAIM' when 'view' then 'CLAIM' when 'click' then 'FORCE'
   when 'purchase' then 'RESULT_OK' else 'RESULT_FAIL' end as action, value
from {events}
"""

# A registry that knows some of the uploaded contents, in every state.
REGISTRY = """
select sha, concat('sha256:', sha) as document_id, concat('stored_', cast(k as string), '.pdf') as original_file_name,
 case cast(k%5 as int) when 1 then 'COMPLETED' when 2 then 'FAILED' when 3 then 'PROCESSING' else 'COMPLETED' end
   as processing_state,
 case cast(k%5 as int) when 1 then 'ACCEPTED' when 2 then 'FAILED' end as latest_processing_status,
 case cast(k%5 as int) when 1 then concat('{{"schema_version":"2.0","document_id":"sha256:', sha,
   '","source_document":{{"file_name":"first_', cast(k as string), '.pdf"}}}}')
   when 2 then concat('{{"schema_version":"2.0","processing_status":"FAILED","document_id":"sha256:', sha, '"}}')
   end as latest_payload,
 1 + k%3 as revision, k as processed_at
from (select sha256(text) as sha, min(doc_id) as k from {documents} group by sha256(text)) d
where k%5 <> 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> int:
    """Number of notices, told by the footers of the table."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GOLDEN, supplier=dimension(spark, sf_dir, "supplier"))


def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIELDS, supplier=dimension(spark, sf_dir, "supplier"), orders=table(spark, sf_dir, "orders"))


def notice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES, fields=notice_fields(spark, sf_dir), golden=golden(spark, sf_dir))


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(notice_text(spark, sf_dir), "doc", "page", "text")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PASSES, fields=notice_fields(spark, sf_dir), golden=golden(spark, sf_dir))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UPLOADS, documents=table(spark, sf_dir, "documents"))


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG, events=table(spark, sf_dir, "events"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = REGISTRY.replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(text, documents=table(spark, sf_dir, "documents"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as multi-page documents: one turn per page."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn + 1 as page", "text")
    return as_pages(turns, "conv_id", "page", "text")
