"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import boilerplate, bpe, language, lookalikes, mixture, neighbours, scans, site_lines
from lodestack.session import table


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("doc_id", site_lines.site_of(F.col("source_url")).alias("site"))


def _web_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_pages", heavy=True).where("method = 'html'").select("page_id", "doc_id", "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each non-blank line of a web page that is not its own content."""
    return boilerplate.judged_lines(_web_pages(spark, sf), _sites(spark, sf)).where("NOT own").select("page_id", "line_no")


def p1_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every web page."""
    pages = _web_pages(spark, sf)
    return boilerplate.main_text(pages.select("page_id", "text"), boilerplate.judged_lines(pages, _sites(spark, sf)))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Places to repair in scanned pages."""
    pages = table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "bank", "page_no", "text", "method", "ocr_confidence")
    return scans.find_defects(pages)


def p2_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned documents as readable paragraphs."""
    pages = table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "bank", "page_no", "text", "method", "ocr_confidence")
    return scans.paragraphs(pages, scans.repairs(pages)).select("doc_id", "block", "paragraph", "text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each occurrence of a line that its site repeats."""
    pages = table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "text")
    return site_lines.occurrences(*site_lines.repeated_lines(pages, _sites(spark, sf)))


def p5_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page without the lines its site repeats."""
    pages = table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "text")
    return site_lines.without_lines(pages, p5_found(spark, sf))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunk_vectors").select("vec_id", "embedder", "vector")
    return neighbours.nearest_neighbours(chunks, "vec_id", "embedder", "vector")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of which one is among the ten nearest of the other."""
    return neighbours.neighbour_pairs(_neighbours(spark, sf), "vec_id").select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest chunks of every chunk, with their cosine."""
    return _neighbours(spark, sf).select("vec_id", "other", F.round("cosine", 4).alias("cosine"))


def _strings(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts, and both sides of the changes, as ``kind, id, text``."""
    pages = table(spark, sf, "doc_pages", heavy=True).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "text")
    changes = table(spark, sf, "field_changes")
    before = changes.select(F.lit("before").alias("kind"), F.col("change_id").alias("id"), F.col("before").alias("text"))
    after = changes.select(F.lit("after").alias("kind"), F.col("change_id").alias("id"), F.col("after").alias("text"))
    return pages.unionByName(before).unionByName(after)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes whose sides look the same, and pairs of pages that do."""
    prints = lookalikes.prints(_strings(spark, sf))
    pages = lookalikes.look_same(prints.where("kind = 'page'")).select(F.lit("page").alias("record_type"), "id_a", "id_b")
    b, a = (prints.where(F.col("kind") == k).select("id", "print", "raw").distinct() for k in ("before", "after"))
    same = b.alias("b").join(a.alias("a"), (F.col("a.id") == F.col("b.id")) & (F.col("a.print") == F.col("b.print")) & (F.col("a.raw") != F.col("b.raw")))
    changes = same.select(F.lit("change").alias("record_type"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    return pages.unionByName(changes)


def p7_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every page text and change side in its one form, words beyond the rule of mixed scripts included."""
    return lookalikes.unify(_strings(spark, sf), strict=False).select("kind", "id", "form")


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every page text and change side with the class of strings that look like it."""
    return lookalikes.look_alike_classes(lookalikes.prints(_strings(spark, sf)))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids."""
    return bpe.encode_column(table(spark, sf, "documents", heavy=True), "doc_id")


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "source", "text").where("text <> ''")
    wanted = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mixture.mix(bpe.count_tokens(wanted, ["doc_id", "source"]), targets)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents with their repeats, each with its shard and place in it."""
    return _mixed(spark, sf)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture.shares(_mixed(spark, sf), table(spark, sf, "mix_targets"))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, aliases = table(spark, sf, "documents", heavy=True).select("doc_id", "text", "lang"), table(spark, sf, "lang_aliases")
    lines, labels = language.training_lines(docs, aliases)
    return docs, aliases, language.languages(docs, language.fit(lines, labels))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose label is missing or wrong, and the lines of documents in several languages."""
    docs, aliases, labelled = _labelled(spark, sf)
    return language.wrong_labels(docs, aliases, labelled).select("doc_id", "line_no", "lang").distinct()


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document, and of every line where there are several."""
    return _labelled(spark, sf)[2].select("doc_id", "line_no", "lang", F.round("confidence", 3).alias("confidence"), "mixed")


QUERIES = {"p1_found": p1_found, "p1_bodies": p1_bodies, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p5_found": p5_found, "p5_pages": p5_pages, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_found": p7_found, "p7_forms": p7_forms, "p7_classes": p7_classes, "p8_ids": p8_ids, "p10_found": p10_found, "p10_languages": p10_languages, "p9_mix": p9_mix, "p9_shares": p9_shares}
_KEY = "trim(regexp_replace(replace(replace(lower(line), 'և', 'եւ'), 'ß', 'ss'), '[ \t]+', ' ', 'g'), ' ')"
_REPEATED = rf"""WITH d AS (SELECT doc_id, min(regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')) AS site FROM source_docs GROUP BY doc_id),
l AS (SELECT page_id, doc_id, site, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM doc_pages JOIN d USING (doc_id)),
k AS (SELECT page_id, doc_id, site, line_no, {_KEY} AS k FROM l),
n AS (SELECT site, count(DISTINCT doc_id) AS docs FROM k GROUP BY site),
f AS (SELECT site, k FROM k JOIN n USING (site) WHERE k <> '' GROUP BY site, k, docs HAVING count(DISTINCT doc_id) >= greatest(5, ceil(docs / 8.0)))"""
ORACLE_SQL: dict[str, str] = {"p5_found": f"{_REPEATED} SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (site, k)"}
