"""Document-level cleaning: running lines, repeated paragraphs, best reading, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import join_broken_lines, normalize_chars, repair_split_numbers, squeeze, strip_page_numbers

OCR_MARGIN, OCR_FLOOR = 0.10, 60.0
# Fixed value: documents of lower quality are to be looked at.
REVIEW_FLOOR = 0.35


def edge_lines(pages: DataFrame, doc: str, page: str, text: str, window: int = 3) -> DataFrame:
    """``doc, page, line``: distinct lines at both ends of each page, as many as a third of its lines and at most ``window``."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.greatest(F.lit(1), F.least(F.lit(window), F.expr("size(lines) div 3")))
    both = F.array_distinct(F.concat(F.slice("lines", 1, cut), F.slice(F.reverse("lines"), 1, cut)))
    held = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), lines.alias("lines")).where(F.size("lines") > 0)
    return held.select("doc", "page", F.explode(both).alias("line")).where(F.length("line") > 2)


def furniture_lines(pages: DataFrame, doc: str, page: str, text: str, ratio: float = 0.6, min_pages: int = 3) -> DataFrame:
    """``doc, line, n_pages`` of lines at the ends of at least ``max(2, ratio)`` of a document's pages; documents of fewer than ``min_pages`` pages have none."""
    counts = edge_lines(pages, doc, page, text).groupBy("doc", "line").agg(F.count("*").alias("n_pages"))
    sizes = pages.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(ratio)))
    return counts.join(sizes, "doc").where((F.col("pages") >= min_pages) & (F.col("n_pages") >= need)).select("doc", "line", "n_pages")


def dedupe_paragraphs(docs: DataFrame, id: str, text: str, min_chars: int = 120, separator: str = "\n\n") -> DataFrame:
    """``id, text`` without later repeats of a document's long paragraphs; short repeats stay.

    A fold over the row's own paragraphs, so nothing is shuffled.
    """
    parts = F.split(text, separator, -1)
    keys = F.transform("parts", squeeze)
    keep = F.filter(F.arrays_zip("parts", "keys"), lambda x, i: (F.length(x["keys"]) < min_chars) | (F.array_position(F.col("keys"), x["keys"]) == i + 1))
    return docs.select(id, parts.alias("parts")).withColumn("keys", keys).select(id, F.array_join(F.transform(keep, lambda x: x["parts"]), separator).alias("text"))


def best_reading(candidates: DataFrame, key: str) -> DataFrame:
    """The best of a page's readings: ``key, method, score``.

    ``candidates``: ``key, method, ord, score, ocr_confidence``. Readings by ``ocr`` of too low
    confidence are out; one wins only if it beats the best other reading by the margin.
    """
    ok = candidates.where((F.col("method") != "ocr") | (F.col("ocr_confidence") >= OCR_FLOOR))
    pick = F.struct("score", (-F.col("ord")).alias("o"), "method")
    best = ok.groupBy(key).agg(F.max(F.when(F.col("method") == "ocr", pick)).alias("ocr"), F.max(F.when(F.col("method") != "ocr", pick)).alias("parsed"))
    wins = F.col("ocr").isNotNull() & (F.col("parsed").isNull() | (F.round(F.col("ocr.score") - F.col("parsed.score"), 6) >= OCR_MARGIN))
    return best.select(key, F.when(wins, F.col("ocr.method")).otherwise(F.col("parsed.method")).alias("method"), F.when(wins, F.col("ocr.score")).otherwise(F.col("parsed.score")).alias("score"))


def weighted_quality(pages: DataFrame, doc: str, quality: str, text: str) -> DataFrame:
    """``doc, quality``: mean page quality weighted by length; 0 for documents without text."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    mean = F.coalesce(F.try_divide(F.sum(F.col(quality) * n), F.sum(n)), F.lit(0.0))
    return pages.groupBy(F.col(doc).alias("doc")).agg(F.round(mean, 4).alias("quality"))


def sections(pages: DataFrame, page: str, text: str) -> DataFrame:
    """``page, ord, title, start_at, end_at``: headings found in a page's text, each until the next.

    A heading is a line of 3 to 70 characters that ends no sentence, is not only figures and no
    list item, before a line of at least 40. Offsets run in a window over one page's lines.
    """
    lines = pages.select(F.col(page).alias("page"), F.length(text).alias("total"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    w = Window.partitionBy("page").orderBy("no")
    placed = lines.select(
        "page", "total", "no", F.trim("line").alias("title"),
        F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_at"),
        F.length(F.trim(F.coalesce(F.lead("line").over(w), F.lit("")))).alias("following"),
    )
    n = F.length("title")
    heads = placed.where((n >= 3) & (n <= 70) & ~F.col("title").rlike(r"[.!?:։]\s*$") & ~F.col("title").rlike(r"^[0-9\s.,/%-]+$") & ~F.col("title").rlike(r"(?i)^(?:[•\-–—*]|o\s|[0-9]{1,2}[.)]\s)") & (F.col("following") >= 40))
    o = Window.partitionBy("page").orderBy("no")
    return heads.select("page", F.row_number().over(o).alias("ord"), "title", "start_at", F.coalesce(F.lead("start_at").over(o), F.col("total").cast("bigint")).alias("end_at"))


def section_at(offsets: DataFrame, found: DataFrame) -> DataFrame:
    """``page, at, title``: the section that holds each offset, by a point-in-interval join within the page."""
    met = offsets.join(found, (offsets.page == found.page) & (found.start_at <= F.col("at")) & (F.col("at") < found.end_at), "left")
    return met.select(offsets.page, "at", "title")


def strip_furniture(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``pages`` with the lines that ``furniture_lines`` finds in their document taken out of ``text``; nothing else changes.

    A document has few such lines: each stands on more than half of its pages, among six a page at most.
    """
    running = furniture_lines(pages, doc, page, text).groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    met = pages.join(running, pages[doc] == running["__doc"], "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("__gone", F.trim(x)))
    return met.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__doc", "__gone")


def prepare_for_scoring(text):
    """What is done to a page before its quality is judged: nothing that could hide a defect of its lines."""
    return squeeze_ends(strip_page_numbers(normalize_chars(text)))


def finish_page(text):
    """What is done once a reading has won: lines joined, split numbers repaired."""
    return squeeze_ends(repair_split_numbers(join_broken_lines(text)))


def squeeze_ends(text):
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages cleaned in the fixed order: characters and page numbers, running lines of the document, broken lines and numbers."""
    prepared = pages.withColumn(text, prepare_for_scoring(F.col(text)))
    return strip_furniture(prepared, doc, page, text).withColumn(text, finish_page(F.col(text)))


def needs_review(pages: DataFrame, doc: str, quality: str, text: str, floor: float = REVIEW_FLOOR) -> DataFrame:
    """``doc, quality, needs_review``: documents whose weighted quality is below the floor."""
    return weighted_quality(pages, doc, quality, text).withColumn("needs_review", F.col("quality") < floor)


def reading_summary(pages: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``doc, methods, ocr_confidence``: methods in the order in which a document's pages first use them, and the
    mean of its confidences that are not negative. Reduced to a row per method first, so no document is held whole."""
    per = pages.groupBy(F.col(doc).alias("doc"), "method").agg(F.min(F.struct(*order)).alias("at"), F.sum(F.when(F.col("ocr_confidence") >= 0, F.col("ocr_confidence"))).alias("s"), F.count_if(F.col("ocr_confidence") >= 0).alias("c"))
    one = per.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "method"))).alias("m"), F.try_divide(F.sum("s"), F.sum("c")).alias("ocr_confidence"))
    return one.select("doc", F.transform("m", lambda x: x["method"]).alias("methods"), "ocr_confidence")
