"""Records of documents, snapshots and changes: cleaning in its fixed order, summaries, provenance, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.functions import urls
from lodestack.functions import values as v
from lodestack.operators import cleaning, snapshots
from lodestack.operators.retrieval import ranked
from lodestack.plans import sqlparts as s
from lodestack.plans.document_queries import ORACLE_SQL as DOCUMENT_SQL
from lodestack.plans.value_queries import code_list
from lodestack.session import table

HOSTS = ["kekeracredit.example", "www.kekeracredit.example", "sasapobank.example"]


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), "method", "quality", "ocr_confidence")


def strip_furniture(spark: SparkSession, sf: str) -> DataFrame:
    """Every page without its document's running lines."""
    return cleaning.strip_furniture(_pages(spark, sf), "doc_id", "page_id", "text").select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page cleaned in the fixed order."""
    return cleaning.clean_pages(_pages(spark, sf), "doc_id", "page_id", "text").select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of too low quality."""
    return cleaning.needs_review(_pages(spark, sf), "doc_id", "quality", "text", 0.7).select(F.col("doc").alias("doc_id"), "needs_review")


def reading_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Methods and mean confidence of every document's reading."""
    r = cleaning.reading_summary(_pages(spark, sf), "doc_id", ["page_no", "page_id"])
    return r.select(F.col("doc").alias("doc_id"), F.array_join("methods", ",").alias("methods"), F.round("ocr_confidence", 6).alias("ocr_confidence"))


def allowed_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of two banks that may be fetched, each once."""
    links = table(spark, sf, "source_docs").select("source_url", F.unix_micros(F.col("retrieved_at").cast("timestamp")).alias("seen"))
    return urls.filter_allowed(links, "source_url", "seen", ["https"], HOSTS)


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The form in which free text values are compared."""
    said = t.squeeze(t.nfc(F.col("after")))
    return table(spark, sf, "field_changes").select("change_id", F.when(said != "", t.casefold(said)).alias("form"), F.when(said != "", F.length(said)).alias("n_chars"))


def currency_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Whether both sides of a change name the same currencies."""
    same = lambda a, b: F.array_sort(v.codes(F.col(a))).eqNullSafe(F.array_sort(v.codes(F.col(b))))
    return table(spark, sf, "field_changes").select("change_id", same("before", "after").alias("same_codes"))


def snapshot_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each snapshot can be compared with the one before."""
    p = snapshots.provenance(table(spark, sf, "snapshots").where("id IS NOT NULL"), "product_id", ["taken_at", "id"])
    return p.select("id", "provenance", F.array_join("notes", ",").alias("notes"))


def snapshot_history(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest snapshots of each product."""
    h = ranked(table(spark, sf, "snapshots").select("product_id", "id", "taken_at"), 3, ["product_id"], [F.desc("taken_at"), F.desc("id")])
    return h.select("product_id", "id", "rank")


def change_order(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of each snapshot in the order they are reported."""
    c = snapshots.ordered_changes(table(spark, sf, "field_changes").select("snapshot_id", "field_id", "significance", "change_id"), "snapshot_id", table(spark, sf, "tariff_fields"))
    return c.select("change_id", "place")


def field_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Fields with and without a value, by product."""
    c = table(spark, sf, "field_changes").where("field_id IS NOT NULL").select("product_id", "field_id", F.col("after").alias("value"))
    return snapshots.field_tally(c, "product_id").select("product_id", "found", "total", F.array_join("absent", ",").alias("absent"))


QUERIES = {f.__name__: f for f in (strip_furniture, clean_pages, needs_review, reading_summary, allowed_addresses, text_forms, currency_sets, snapshot_provenance, snapshot_history, change_order, field_tally)}
_P = "(SELECT page_id, doc_id, page_no, coalesce(text, '') AS text, method, quality, ocr_confidence FROM doc_pages)"
_FORM = s.squeeze("nfc_normalize(after)")
_W = "OVER (PARTITION BY product_id ORDER BY taken_at, id)"
ORACLE_SQL = {
    "strip_furniture": f"""WITH f AS (SELECT doc_id, list(line) AS gone FROM ({DOCUMENT_SQL["furniture_lines"]}) GROUP BY doc_id),
c AS (SELECT page_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x))), chr(10)) END AS text FROM {_P} LEFT JOIN f USING (doc_id))
SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM c""",
    "needs_review": f"SELECT doc_id, round(coalesce(sum(quality * length(text)) / nullif(sum(length(text)), 0), 0), 4) < 0.7 AS needs_review FROM {_P} GROUP BY doc_id",
    "reading_summary": f"WITH m AS (SELECT doc_id, method, min((page_no, page_id)) AS first_at FROM {_P} GROUP BY ALL), c AS (SELECT doc_id, round(avg(ocr_confidence) FILTER (ocr_confidence >= 0), 6) AS ocr_confidence FROM {_P} GROUP BY ALL) SELECT doc_id, string_agg(method, ',' ORDER BY first_at) AS methods, any_value(ocr_confidence) AS ocr_confidence FROM m JOIN c USING (doc_id) GROUP BY doc_id",
    "allowed_addresses": f"""SELECT normal AS url, min(epoch_us(retrieved_at)) AS pos FROM ({DOCUMENT_SQL["url_parts"]}) u JOIN source_docs USING (source_url) WHERE allowed GROUP BY normal""",
    "text_forms": f"SELECT change_id, nullif({s.casefold(_FORM)}, '') AS form, CAST(nullif(length({_FORM}), 0) AS INTEGER) AS n_chars FROM field_changes",
    "currency_sets": f"SELECT change_id, list_sort({code_list('before')}) IS NOT DISTINCT FROM list_sort({code_list('after')}) AS same_codes FROM field_changes",
    "snapshot_provenance": f"""WITH b AS (SELECT id, row_number() {_W} AS n, extraction_method IS DISTINCT FROM lag(extraction_method) {_W} AS m, prompt_version IS DISTINCT FROM lag(prompt_version) {_W} AS p, document_edition IS DISTINCT FROM lag(document_edition) {_W} AS e, document_date IS DISTINCT FROM lag(document_date) {_W} AS d FROM snapshots)
SELECT id, CASE WHEN n = 1 THEN 'baseline' WHEN m THEN 'method_changed' WHEN p THEN 'prompt_changed' ELSE 'comparable' END AS provenance, CASE WHEN n = 1 THEN '' ELSE concat_ws(',', CASE WHEN e THEN 'edition' END, CASE WHEN d THEN 'date' END) END AS notes FROM b""",
    "snapshot_history": "SELECT product_id, id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY taken_at DESC, id DESC) AS INTEGER) AS rank FROM snapshots QUALIFY rank <= 3",
    "change_order": "SELECT change_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE significance WHEN 'large' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, seq_no NULLS LAST, change_id) AS INTEGER) AS place FROM field_changes LEFT JOIN tariff_fields USING (field_id)",
    "field_tally": "WITH e AS (SELECT product_id, field_id, bool_or(coalesce(upper(trim(after)) NOT IN ('', 'NOT_FOUND'), false)) AS has FROM field_changes GROUP BY ALL) SELECT product_id, count(*) FILTER (has) AS found, count(*) AS total, coalesce(string_agg(field_id, ',' ORDER BY field_id) FILTER (NOT has), '') AS absent FROM e GROUP BY ALL",
}
