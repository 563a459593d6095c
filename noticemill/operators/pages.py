"""Page text: gates, variants, assembly and budgeted slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.scale import block_of, running_total
from noticemill.functions.text import strip, without_spaces
from noticemill.operators.extraction import methods_in_order

PAGE_BLOCK = 10_000


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def native_text_gate(pages: DataFrame, min_chars: int = vocab.NATIVE_TEXT_MIN_CHARS) -> DataFrame:
    """Pages whose own text is long enough keep it; the others need OCR."""
    length = F.length(without_spaces(strip(F.coalesce("text", F.lit("")))))
    return pages.withColumn("native_text_length", length).withColumn(
        "extraction_method", F.when(F.col("native_text_length") >= min_chars, "NATIVE_TEXT").otherwise("OCR")
    )


def best_variant(variants: DataFrame) -> DataFrame:
    """Best reading per page out of (document_id, page_number, variant_no, text, native_text).

    More letters and digits win, then more words of three characters or more,
    then fewer replacement characters, then the earlier variant.
    """
    text = strip(F.coalesce("text", F.lit("")))
    scored = variants.withColumn("_text", text).withColumn(
        "_rank",
        F.struct(
            alnum_count(F.col("_text")).alias("a"),
            F.size(F.filter(words_of(F.col("_text")), lambda w: F.length(w) >= 3)).alias("w"),
            (-(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("�"), F.lit(""))))).alias("r"),
            (-F.col("variant_no")).alias("v"),
        ),
    )
    best = scored.groupBy("document_id", "page_number").agg(
        F.max_by("_text", "_rank").alias("ocr_text"), F.first("native_text").alias("native_text")
    )
    unreadable = F.col("ocr_text") == ""
    return best.select(
        "document_id",
        "page_number",
        F.when(unreadable, strip(F.coalesce("native_text", F.lit("")))).otherwise(F.col("ocr_text")).alias("text"),
        F.lit("OCR").alias("extraction_method"),
        F.length(without_spaces(F.coalesce("native_text", F.lit("")))).alias("native_text_length"),
        F.lit(True).alias("ocr_applied"),
        F.when(
            unreadable,
            F.array(F.concat(F.lit("Page "), F.col("page_number"), F.lit(" remained unreadable after OCR."))),
        ).otherwise(F.array()).cast("array<string>").alias("warnings"),
    )


def rollup_pages(pages: DataFrame) -> DataFrame:
    """page_count, methods in first-seen order and all warnings per document."""
    warned = F.when(F.size("warnings") > 0, F.struct("page_number", "warnings"))
    grouped = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.min(F.when(F.col("extraction_method") == "NATIVE_TEXT", F.col("page_number"))).alias("_native"),
        F.min(F.when(F.col("extraction_method") == "OCR", F.col("page_number"))).alias("_ocr"),
        F.collect_list(warned).alias("_warned"),
    )
    return grouped.select(
        "document_id",
        "page_count",
        methods_in_order("_native", "_ocr").alias("extraction_methods"),
        F.expr("flatten(transform(array_sort(_warned), w -> w.warnings))").alias("warnings"),
    )


def assemble_text(pages: DataFrame) -> DataFrame:
    """Whole document text with page headers, in page order.

    The result is one string per document, so a document's text has to fit in
    a row in any case; only that text is gathered.
    """
    section = F.concat(
        F.lit("--- PAGE "), F.col("page_number"), F.lit(" ["), F.col("extraction_method"), F.lit("] ---\n"),
        strip(F.col("text")),
    )
    return pages.groupBy("document_id").agg(
        F.expr("count(1)").alias("page_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_number", section.alias("s")))), lambda x: x["s"]
            ),
            "\n\n",
        ).alias("text"),
    )


def slice_pages(
    pages: DataFrame, start: int = 1, end: int = 0, budget: int = vocab.TEXT_BUDGET_CHARS
) -> DataFrame:
    """Pages start..end within a character budget spent in page order.

    The page crossing the budget is cut and later pages are left out
    (truncated = true); documents for which the range is invalid give one row
    with ``error``.
    """
    last = F.lit(end) if end else F.col("page_count")
    asked = (F.col("page_number") >= start) & (F.lit(end == 0) | (F.col("page_number") <= end))
    chars = F.when(asked, F.length("text"))
    # Without an end the last page is the document's own last one.
    upto = F.sum(F.when(F.col("page_number") < end, chars)) if end else F.sum(chars) - F.coalesce(F.max_by(chars, "page_number"), F.lit(0))
    counts = pages.groupBy("document_id").agg(
        F.max("page_number").alias("page_count"), F.sum(chars).alias("_all"), upto.alias("_earlier")).withColumn("_end", last)
    bad_page = F.when(~F.lit(start).between(1, F.col("page_count")), F.lit(start)).when(
        ~F.col("_end").between(1, F.col("page_count")), F.col("_end")
    )
    message = F.when(
        bad_page.isNotNull(),
        F.concat(F.lit("Página "), bad_page, F.lit(" inválida; o PDF possui "), F.col("page_count"), F.lit(" página(s)")),
    ).when(F.col("_end") < start, F.lit("page_end deve ser maior ou igual a page_start"))
    counts = counts.withColumn("error", message)
    wanted = pages.where(asked)
    sized = wanted.select("document_id", "page_number", "text", F.length("text").alias("_len"))
    spent = running_total(
        sized, ["document_id"], ["page_number"], block_of(F.col("page_number"), PAGE_BLOCK), F.col("_len"), "_before",
        exclusive=True,
    )
    flags = counts.withColumn("truncated", F.expr(f"coalesce(_all > {budget} or _earlier >= {budget}, false)"))
    kept = spent.where(F.col("_before") < budget).select(
        "document_id", "page_number", F.expr(f"substr(text, 1, {budget} - _before)").alias("text")
    )
    valid = flags.where("error is null").select("document_id", "truncated").join(kept, "document_id")
    errors = flags.where("error is not null").select(
        "document_id", F.lit(None).cast("boolean").alias("truncated"), F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("text"), "error",
    )
    return valid.withColumn("error", F.lit(None).cast("string")).unionByName(errors)


def page_words(pages: DataFrame, k: int = vocab.MAX_PAGE_WORDS) -> DataFrame:
    """First k words of every page in reading order, and whether there are more."""
    split = pages.withColumn("_words", words_of(F.col("text")))
    return split.select(
        "document_id",
        "page_number",
        F.slice("_words", 1, k).alias("words"),
        (F.size("_words") > k).alias("truncated"),
    )


def weak_ocr(pages: DataFrame) -> DataFrame:
    """OCR pages with a warning or with too few letters and digits."""
    return pages.where(
        (F.col("extraction_method") == "OCR")
        & ((F.size("warnings") > 0) | (alnum_count(F.col("text")) < vocab.OCR_MIN_ALNUM))
    )
