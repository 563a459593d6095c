"""Registered queries of the operators, each over its whole table, and their SQL cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm import (
    decontamination, jaccard, language, licences, packing, resampling, secrets, sharding, spelling, tokens, toxicity, urls, vectors,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a source tree: /source/thousand/hundred/name, by the digits of doc_id.

    One in ten is a licence file, LICENSE.<doc_id>; every hundredth of a thousand stands a level higher.
    """
    i = F.col("doc_id")
    level = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.floor(i / 1000).cast("string"))
    folder = F.when(i % 100 == 0, level).otherwise(F.concat_ws("/", level, F.pmod(F.floor(i / 100), F.lit(10)).cast("string")))
    name = F.when(i % 10 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    return docs.select(i.alias("file_id"), F.concat_ws("/", folder, name).alias("path"), "text")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(as_files(_table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_digest(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_texts(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_decontamination, op3_licences, op4_vector_duplicates, op5_jaccard_join, op6_toxicity,
    op7_secret_scan, op8_token_files, op9_language_id, op10_packing, op11_resampling, op12_spelling, op13_url_filter,
)}

ORACLE = {
    "op4_vector_duplicates": """
        with recursive usable as (
            select vec_id, label, embedding::double[] v, len(embedding) d from embeddings
            where vec_id is not null and label is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (
            select a.vec_id a, b.vec_id b from usable a join usable b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id
            where list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.98),
        reach(a, b) as (
            select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        low as (select a, min(b) b from reach group by a),
        n as (select a, count(*) n from links group by a)
        select e.vec_id, coalesce(n.n, 0)::bigint n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) component_id,
               e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) kept
        from embeddings e left join low on low.a = e.vec_id left join n on n.a = e.vec_id""",
    "op5_jaccard_join": """
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (
            select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [w]
                   else list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4]) end)) g from w),
        n as (select doc_id, count(*) n from s group by 1),
        common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        links as (
            select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        low as (select a, min(b) b from reach group by a)
        select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) component_id
        from documents d left join n on n.doc_id = d.doc_id left join low on low.a = d.doc_id""",
}
