"""Document text from per-page native, OCR and vision outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.numbers import half_even_ratio
from dossier.operators.blocks import computed
from dossier.functions.text import strip, visible_chars


def ocr_page_rollup(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, word_no, word, conf) -> page text and mean confidence.

    Words are dealt by page before they are gathered. Lists gathered in front of a shuffle would hardly be shorter, and a
    task of many pages would sort and spill its words for them.
    """
    kept = computed(words, word=strip(F.col("word"))).where((F.col("word") != "") & (F.col("conf") >= 0))
    ordered = F.sort_array(F.collect_list(F.struct("word_no", "word")))
    return kept.repartition("doc_id", "page").groupBy("doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"),
        F.bround(F.avg(F.col("conf").cast("double")), 2).alias("confidence"),
        F.count("*").alias("words"),
    )


def ocr_document_confidence(page_rollup: DataFrame) -> DataFrame:
    cents = F.round(F.col("confidence") * 100).cast("long")
    return (
        page_rollup.groupBy("doc_id")
        .agg(F.sum(cents).alias("__cents"), F.count("*").alias("pages"))
        .select(
            "doc_id", (half_even_ratio(F.col("__cents"), F.col("pages")) / 100).alias("mean_confidence"), "pages"
        )
    )


def needs_vision(text, confidence, min_chars: int = 24, min_confidence: float = 90.0):
    """OCR output too short or too uncertain to keep."""
    return (visible_chars(text) < min_chars) | F.coalesce(confidence < min_confidence, F.lit(False))


def page_cascade(
    native: DataFrame,
    ocr: DataFrame,
    vision: DataFrame,
    budget: int | None = None,
    min_native: int = 32,
    max_chars: int | None = None,
) -> DataFrame:
    """Choose vision > OCR > native text per page and join the pages of a document.

    native: doc_id, page, text; ocr: doc_id, page, text, confidence; vision: doc_id,
    page, text. With a ``budget`` only that many first pages that need OCR may use it; with
    ``max_chars`` the text is cut there. Neither cuts by default.
    """
    pages = native.select(
        "doc_id",
        "page",
        strip(F.coalesce("text", F.lit(""))).alias("native_text"),
    ).withColumn("needs_ocr", visible_chars(F.col("native_text")) < min_native)
    place = F.sum(F.col("needs_ocr").cast("int")).over(
        Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    )
    allowed = F.lit(True) if budget is None else place <= budget
    pages = pages.withColumn("requested", F.col("needs_ocr") & allowed)
    read = pages.join(
        ocr.select("doc_id", "page", F.col("text").alias("ocr_text"), "confidence"), ["doc_id", "page"], "left"
    ).join(vision.select("doc_id", "page", F.col("text").alias("vision_text")), ["doc_id", "page"], "left")
    has_ocr = F.col("requested") & F.col("ocr_text").isNotNull()
    use_vision = (
        has_ocr
        & needs_vision(F.col("ocr_text"), F.col("confidence"))
        & (strip(F.coalesce("vision_text", F.lit(""))) != "")
    )
    use_ocr = has_ocr & (strip(F.coalesce("ocr_text", F.lit(""))) != "")
    chosen = read.select(
        "doc_id",
        "page",
        "needs_ocr",
        "requested",
        strip(
            F.when(use_vision, F.col("vision_text")).when(use_ocr, F.col("ocr_text")).otherwise(F.col("native_text"))
        ).alias("selected"),
        (F.col("needs_ocr") & ~use_vision & ~use_ocr).alias("unresolved"),
    )
    block = F.when(
        F.col("selected") != "",
        F.struct("page", F.concat(F.lit("[Page "), F.col("page"), F.lit("]\n"), F.col("selected")).alias("block")),
    )
    numbers = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("page"))))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["block"]), "\n\n")
    return (
        chosen.groupBy("doc_id")
        .agg(
            whole.alias("combined"),
            F.count("*").alias("pages"),
            numbers(F.col("needs_ocr") & ~F.col("requested")).alias("skipped_pages"),
            numbers(F.col("unresolved")).alias("unresolved_pages"),
        )
        .select(
            "doc_id",
            (F.col("combined") if max_chars is None else F.substring("combined", 1, max_chars)).alias("text"),
            (F.lit(False) if max_chars is None else F.char_length("combined") > max_chars).alias("truncated"),
            "pages",
            "skipped_pages",
            "unresolved_pages",
        )
    )
