"""Cleaning, quality, sections, chunks, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import quality, text as t, urls
from lodestack.functions.values import document_date, edition
from lodestack.operators import chunking, cleaning, discovery, html
from lodestack.plans import sqlparts as s
from lodestack.session import table, values
from lodestack.sources import landing


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_pages", heavy=True).select("page_id", "doc_id", "page_no", "bank", F.coalesce("text", F.lit("")).alias("text"), "method", "quality", "ocr_confidence")


def normalize_chars(spark: SparkSession, sf: str) -> DataFrame:
    n = t.normalize_chars(F.col("text"))
    return _pages(spark, sf).select("page_id", F.length(n).alias("n_chars"), F.md5(n).alias("digest"))


def page_number_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = t.strip_page_numbers(F.col("text"))
    return _pages(spark, sf).select("page_id", F.length(kept).alias("n_chars"), F.md5(kept).alias("digest"))


def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select("page_id", quality.signals(F.col("text")).alias("s"))
    q = p.select("page_id", "s", quality.score(F.col("s")).alias("q"))
    return q.select("page_id", "s.chars", F.round("s.letter_ratio", 4).alias("letter_ratio"), F.round("s.words_per_line", 3).alias("words_per_line"), F.round("q.score", 3).alias("score"), F.array_join("q.defects", ",").alias("defects"))


def weighted_doc_quality(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.weighted_quality(_pages(spark, sf), "doc_id", "quality", "text").select(F.col("doc").alias("doc_id"), F.round("quality", 3).alias("quality"))


def best_reading_per_page(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    own = p.select("page_id", "method", F.lit(0).alias("ord"), F.col("quality").alias("score"), "ocr_confidence")
    other = p.select("page_id", F.when(F.col("method") == "ocr", "pdf_text").otherwise("ocr").alias("method"), F.lit(1).alias("ord"), F.round(F.col("quality") * 0.9 + F.col("page_no") * 0.01, 3).alias("score"), F.coalesce("ocr_confidence", F.lit(65.0)).alias("ocr_confidence"))
    return cleaning.best_reading(own.unionByName(other), "page_id")


def furniture_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.furniture_lines(_pages(spark, sf), "doc_id", "page_id", "text").select(F.col("doc").alias("doc_id"), "line", "n_pages")


def dedupe_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = cleaning.dedupe_paragraphs(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text", separator="\n")
    return d.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def join_broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    j = t.join_broken_lines(F.col("text"))
    return _pages(spark, sf).select("page_id", F.size(F.split(j, "\n", -1)).alias("n_lines"), F.md5(j).alias("digest"))


def repair_thousands(spark: SparkSession, sf: str) -> DataFrame:
    r = t.repair_split_numbers(F.col("text"))
    return _pages(spark, sf).select("page_id", F.length(r).alias("n_chars"), F.md5(r).alias("digest"))


def detect_sections(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.sections(_pages(spark, sf), "page_id", "text").select(F.col("page").alias("page_id"), "ord", "title", "start_at", "end_at")


def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    offsets = p.select(F.col("page_id").alias("page"), F.explode(F.array(F.lit(100), F.lit(400), F.lit(900))).alias("at")).where("at >= 0")
    return cleaning.section_at(offsets, cleaning.sections(p, "page_id", "text")).select(F.col("page").alias("page_id"), "at", "title")


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = chunking.chunk_texts(table(spark, sf, "documents", heavy=True), ["doc_id"], "text")
    return d.select("doc_id", "ord", "start_at", "end_at", F.md5("chunk").alias("digest"))


def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    c = chunking.chunk_pages(p, cleaning.sections(p, "page_id", "text"), "doc_id", "page_id", "text")
    return c.select("chunk_id", "section", "start_at", "end_at", F.md5("chunk").alias("digest"))


def _nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("body"))
    return n.select("n_regionkey", F.concat(F.array(F.array(F.lit("NAME"), F.lit("KEY"))), F.col("body")).alias("rows"))


def table_render(spark: SparkSession, sf: str) -> DataFrame:
    return _nation_tables(spark, sf).select("n_regionkey", chunking.plausible_table(F.col("rows")).alias("plausible"), chunking.render_table(F.col("rows")).alias("text"), F.size(chunking.split_table(F.col("rows"), 60)).alias("n_groups"))


_HTML = [
    (-1, "<html><head><title>Car loan</title><script>var a='</p>'</script></head><body><nav>Home</nav><main><h1>Car loan</h1><p>Nominal rate 12%<p>Term 60 months<table><tr><th>Fee</th><td>1 %</td></tr></table><a href='/t.pdf'>Tariffs</a></main></body></html>"),
    (-2, "plain text &amp; more"),
    (-3, None),
]


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of the table as documents with a title, a menu and a paragraph a line, and three with tables, links and unclosed tags."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(safe, "\n", -1), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    made = _pages(spark, sf).where("page_id IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page"), F.concat(F.lit("<html><head><title>Page</title></head><body><nav>Home</nav><main><h1>Terms</h1>"), lines, F.lit("</main></body></html>")).alias("html"))
    read = html.read_html(values(spark, _HTML, "page bigint, html string").unionByName(made), ["page"], "html")
    return read.select("page", "title", "text", F.array_join("headings", "|").alias("headings"), F.to_json("tables").alias("tables"), F.array_join(F.transform("links", lambda x: x["href"]), "|").alias("links"))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("source_url").distinct()


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("source_url")
    return _addresses(spark, sf).select("source_url", urls.normalize_url(u).alias("normal"), urls.host_of(u).alias("host"), urls.slug_tokens(u).alias("slug"), urls.cache_key(u).alias("cache_key"), urls.is_allowed(u, ["https"], ["kekeracredit.example", "www.kekeracredit.example", "sasapobank.example"]).alias("allowed"))


_SITEMAPS = [
    ("index", "<sitemapindex><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>d</loc></sitemap></sitemapindex>"),
    ("a", "<urlset><url><loc>https://x.example/1</loc></url><url><loc>https://x.example/2</loc></url><url><loc>https://x.example/1</loc></url></urlset>"),
    ("b", "<urlset><url><loc>https://x.example/2</loc></url><url><loc>https://x.example/3"),
    ("d", "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc><![CDATA[https://x.example/5?a=1&b=2]]></loc></url></urlset>"),
    ("c", "<!DOCTYPE a [<!ENTITY b 'c'>]><urlset><url><loc>https://x.example/4</loc></url></urlset>"),
]


def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = discovery.sitemap_locations(values(spark, _SITEMAPS, "sitemap string, xml string"))
    return discovery.follow_index(found.where("sitemap = 'index'"), found.where("sitemap <> 'index'"))


def sitemap_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a sitemap per document, written from the table of sources."""
    u = F.replace(F.replace(F.trim("source_url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    maps = table(spark, sf, "source_docs").where("trim(source_url) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>")))).alias("x"))  # the addresses of one document
    return discovery.sitemap_locations(maps.select(F.col("doc_id").alias("sitemap"), F.concat(F.lit("<urlset>"), F.array_join("x", ""), F.lit("</urlset>")).alias("xml"))).select("sitemap", "url", "pos")


def source_scoring(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "source_docs").select("source_url", F.col("document_name").alias("anchor"), F.when(F.col("source_url").contains(".pdf"), "pdf").otherwise("html").alias("kind"), F.col("doc_id"))
    ord_ = F.conv(F.left("doc_id", F.lit(7)), 16, 10).cast("int")
    said = table(spark, sf, "doc_pages").select("doc_id", discovery.rate_mentions(F.col("text")).alias("m")).groupBy("doc_id").agg(F.sum("m").alias("m"))
    links = d.join(said, "doc_id", "left").groupBy("source_url", "kind", "anchor").agg(F.min(ord_).alias("ord"), F.max("m").alias("rate_mentions")).select(F.col("source_url").alias("url"), "anchor", "kind", "rate_mentions", "ord")
    return discovery.score_sources(links).select("url", "score", "role", F.array_join("reasons", ",").alias("reasons"))


def source_choice(spark: SparkSession, sf: str) -> DataFrame:
    scored = source_scoring(spark, sf).withColumn("host", urls.host_of(F.col("url")))
    return discovery.choose_sources(scored, "host", floor=15.0).select("host", "url", "score", "role", "rank")


def product_resolution(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct().select(F.col("name").alias("product_id"), "name")
    asked = values(spark, [(1, "standard tin"), (2, "promo copper brushed"), (3, "zzz"), (4, "")], "query_id int, query string")
    return discovery.resolve_names(asked, names, ["business"])


def revalidation(spark: SparkSession, sf: str) -> DataFrame:
    return landing.revalidate(table(spark, sf, "source_docs")).select("url", "doc_id", "retrieved_at", "checked_at")


def content_identity(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def host_pacing(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("retrieved_at", "source_url")
    d = table(spark, sf, "source_docs").select("source_url", "retrieved_at").distinct().withColumn("host", urls.host_of(F.col("source_url")))
    gap = (F.unix_micros(F.col("retrieved_at").cast("timestamp")) - F.unix_micros(F.lag("retrieved_at").over(w).cast("timestamp"))) / 1e6
    return d.select("source_url", "retrieved_at", F.round(gap, 3).alias("gap_s"))


def dates_and_editions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    said = F.concat(F.lit("Խմբագրություն : "), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" Updated on "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd. MM .yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    return o.select("o_orderkey", said.alias("said")).select("o_orderkey", document_date(F.col("said")).alias("stated"), edition(F.col("said")).alias("edition"))


_P = "(SELECT page_id, doc_id, page_no, coalesce(text, '') AS text, method, quality, ocr_confidence FROM doc_pages)"
_NC = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(61623), '•'), '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g'), '[{t.ODD_SPACES}]', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"""
_PN = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, " + s.q(t.PAGE_NUMBER) + ")), chr(10))"
_SECTIONS = f"""lines AS (SELECT page_id, length(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {_P}),
placed AS (SELECT page_id, total, no, trim(line) AS title, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at, length(trim(coalesce(lead(line) OVER (PARTITION BY page_id ORDER BY no), ''))) AS following FROM lines),
heads AS (SELECT * FROM placed WHERE length(title) BETWEEN 3 AND 70 AND NOT regexp_matches(title, '[.!?:։]\\s*$') AND NOT regexp_matches(title, '^[0-9\\s.,/%-]+$') AND NOT regexp_matches(title, '(?i)^(?:[•\\-–—*]|o\\s|[0-9]{{1,2}}[.)]\\s)') AND following >= 40),
found AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY no) AS INTEGER) AS ord, title, CAST(start_at AS BIGINT) AS start_at, CAST(coalesce(lead(start_at) OVER (PARTITION BY page_id ORDER BY no), total) AS BIGINT) AS end_at FROM heads)"""
_SIG = r"""sig AS (SELECT page_id, t, length(t) AS chars, len(regexp_extract_all(t, '\S+')) AS words, len(list_filter(regexp_extract_all(t, '\S+'), lambda w: length(w) > 25)) AS glued, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS lines,
length(regexp_replace(t, '\s+', '', 'g')) AS ink, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[\x{FFFD}\x{01}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]')) AS bad FROM (SELECT page_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM """ + _P + r""")),
r AS (SELECT page_id, chars, lines, coalesce(letters::DOUBLE / nullif(ink, 0), 0) AS lr, coalesce(words::DOUBLE / nullif(lines, 0), 0) AS wpl, coalesce(glued::DOUBLE / nullif(words, 0), 0) AS gr, coalesce(bad::DOUBLE / nullif(chars, 0), 0) AS br FROM sig),
f AS (SELECT *, list_filter([CASE WHEN chars < 50 THEN 'too_short' END, CASE WHEN gr > 0.3 THEN 'glued_words' END, CASE WHEN wpl < 1.5 AND lines > 5 THEN 'one_word_per_line' END, CASE WHEN lr < 0.3 THEN 'few_letters' END, CASE WHEN br > 0.05 THEN 'unreadable_characters' END], lambda x: x IS NOT NULL) AS d,
0.45 * least(1, chars / 200.0) + 0.30 * least(1, lr / 0.7) + 0.25 * greatest(0, least(1, (wpl - 1) / 5.0)) AS base FROM r)"""


def _points(pairs: list[tuple], test: str) -> str:
    return " + ".join(f"CASE WHEN {test.format(s.q(x))} THEN {float(w)} ELSE 0 END" for x, w in pairs)


def _case(x: str, pairs: list[tuple], what: int) -> str:
    return "CASE " + " ".join(f"WHEN instr({x}, {s.q(p[0])}) > 0 THEN {s.q(p[what]) if isinstance(p[what], str) else float(p[what])}" for p in pairs) + " END"


_NORMAL = r"CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '\.(:|$)', '\1') || regexp_replace(regexp_extract(u, '://[^/?#]*(.*)$', 1), '#.*$', '') ELSE u END"
_MENTIONS = " + ".join(f"(length(lower(text)) - length(replace(lower(text), {s.q(m)}, ''))) // {len(m)}" for m in discovery.RATE_MARKERS)
_SCORED = f"""rm AS (SELECT doc_id, sum({_MENTIONS}) AS m FROM doc_pages GROUP BY doc_id),
l AS (SELECT source_url AS url, document_name AS anchor, CASE WHEN contains(source_url, '.pdf') THEN 'pdf' ELSE 'html' END AS kind, min(CAST('0x' || left(doc_id, 7) AS BIGINT)) AS ord, coalesce(max(m), 0) AS m FROM source_docs LEFT JOIN rm USING (doc_id) GROUP BY source_url, document_name, kind),
n AS (SELECT {_NORMAL.replace('u,', 'trim(url),').replace('ELSE u', 'ELSE trim(url)')} AS url, kind, ord, m, lower(coalesce(anchor, '')) AS a FROM l),
m AS (SELECT url, kind, ord, a, kind <> 'pdf' AND m >= 3 AS rates, lower(url) AS u FROM n),
k AS (SELECT url, kind, ord, rates, {_case('a', discovery.ANCHORS, 0)} AS a_text, {_case('a', discovery.ANCHORS, 1)} AS aw, {_case('a', discovery.ANCHORS, 2)} AS ar, {_case('u', discovery.ADDRESSES, 0)} AS ut, {_case('u', discovery.ADDRESSES, 1)} AS uw, {_case('u', discovery.ADDRESSES, 2)} AS ur,
{_points(discovery.NEGATIVE, '(instr(u, {0}) > 0 OR instr(a, {0}) > 0)')} AS neg, {_points(discovery.SEGMENTS, 'instr(u, {0}) > 0')} AS seg FROM m),
sc AS (SELECT url, CAST(coalesce(aw, 0) + coalesce(uw, 0) + neg + seg + CASE WHEN kind = 'pdf' THEN 10 WHEN rates THEN 15 ELSE 0 END AS DOUBLE) AS score, CASE WHEN coalesce(ar, '') = 'primary' OR coalesce(ur, '') = 'primary' OR rates THEN 'primary' ELSE 'supporting' END AS role,
array_to_string(list_filter([a_text, ut, CASE WHEN neg < 0 THEN 'negative' END, CASE WHEN seg <> 0 THEN 'path' END, CASE WHEN kind = 'pdf' THEN 'pdf' END, CASE WHEN rates THEN 'rates' END], lambda x: x IS NOT NULL), ',') AS reasons, ord FROM k),
best AS (SELECT url, score, role, reasons FROM sc QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, ord) = 1)"""
_HOST = r"regexp_extract(lower(trim(%s)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"

QUERIES = {
    "normalize_chars": normalize_chars, "page_number_lines": page_number_lines, "text_quality": text_quality, "weighted_doc_quality": weighted_doc_quality,
    "best_reading_per_page": best_reading_per_page, "furniture_lines": furniture_lines, "dedupe_paragraphs": dedupe_paragraphs, "join_broken_lines": join_broken_lines,
    "repair_thousands": repair_thousands, "detect_sections": detect_sections, "section_lookup": section_lookup, "chunk_documents": chunk_documents, "chunk_pages": chunk_pages,
    "table_render": table_render, "html_extract": html_extract, "url_parts": url_parts, "sitemap_pages": sitemap_pages, "sitemap_scan": sitemap_scan, "source_scoring": source_scoring, "source_choice": source_choice,
    "product_resolution": product_resolution, "revalidation": revalidation, "content_identity": content_identity, "host_pacing": host_pacing, "dates_and_editions": dates_and_editions,
}
ORACLE_SQL = {
    "normalize_chars": f"SELECT page_id, CAST(length({_NC}) AS INTEGER) AS n_chars, md5({_NC}) AS digest FROM {_P}",
    "page_number_lines": f"SELECT page_id, CAST(length({_PN}) AS INTEGER) AS n_chars, md5({_PN}) AS digest FROM {_P}",
    "text_quality": f"WITH {_SIG} SELECT page_id, CAST(chars AS INTEGER) AS chars, round(lr, 4) AS letter_ratio, round(wpl, 3) AS words_per_line, CASE WHEN chars = 0 THEN 0.0 ELSE round(round(greatest(0, least(1, base * (CASE WHEN list_contains(d, 'too_short') THEN 0.3 ELSE 1.0 END) * (CASE WHEN list_contains(d, 'glued_words') THEN 0.2 ELSE 1.0 END) * (CASE WHEN list_contains(d, 'one_word_per_line') THEN 0.3 ELSE 1.0 END) * (CASE WHEN list_contains(d, 'few_letters') THEN 0.3 ELSE 1.0 END) * (CASE WHEN list_contains(d, 'unreadable_characters') THEN 0.2 ELSE 1.0 END))), 4), 3) END AS score, CASE WHEN chars = 0 THEN '' ELSE array_to_string(d, ',') END AS defects FROM f",
    "weighted_doc_quality": f"SELECT doc_id, round(round(coalesce(sum(quality * length(text)) / nullif(sum(length(text)), 0), 0), 4), 3) AS quality FROM {_P} GROUP BY doc_id",
    "best_reading_per_page": f"""WITH c AS (SELECT page_id, method, 0 AS ord, quality AS score, ocr_confidence FROM {_P} UNION ALL SELECT page_id, CASE WHEN method = 'ocr' THEN 'pdf_text' ELSE 'ocr' END, 1, round(quality * 0.9 + page_no * 0.01, 3), coalesce(ocr_confidence, 65.0) FROM {_P}),
ok AS (SELECT * FROM c WHERE method <> 'ocr' OR ocr_confidence >= 60),
o AS (SELECT page_id, method, score FROM ok WHERE method = 'ocr' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1),
p AS (SELECT page_id, method, score FROM ok WHERE method <> 'ocr' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1)
SELECT coalesce(o.page_id, p.page_id) AS page_id, CASE WHEN o.score IS NOT NULL AND (p.score IS NULL OR round(o.score - p.score, 6) >= 0.10) THEN o.method ELSE p.method END AS method, CASE WHEN o.score IS NOT NULL AND (p.score IS NULL OR round(o.score - p.score, 6) >= 0.10) THEN o.score ELSE p.score END AS score FROM o FULL JOIN p USING (page_id)""",
    "furniture_lines": f"""WITH h AS (SELECT doc_id, page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {_P}),
e AS (SELECT DISTINCT doc_id, page_id, unnest(list_concat(l[1:greatest(1, least(3, len(l) // 3))], list_reverse(l)[1:greatest(1, least(3, len(l) // 3))])) AS line FROM h WHERE len(l) > 0),
c AS (SELECT doc_id, line, count(*) AS n_pages FROM e WHERE length(line) > 2 GROUP BY ALL), n AS (SELECT doc_id, count(*) AS pages FROM {_P} GROUP BY ALL)
SELECT doc_id, line, n_pages FROM c JOIN n USING (doc_id) WHERE pages >= 3 AND n_pages >= greatest(2, floor(pages * 0.6))""",
    "dedupe_paragraphs": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, ps, list_transform(ps, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ks FROM p),
d AS (SELECT doc_id, array_to_string(list_filter(ps, lambda x, i: length(ks[i]) < 120 OR list_position(ks, ks[i]) = i), chr(10)) AS text FROM k)
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM d""",
    "detect_sections": f"WITH {_SECTIONS} SELECT page_id, ord, title, start_at, end_at FROM found",
    "section_lookup": f"WITH {_SECTIONS}, o AS (SELECT page_id, unnest([100, 400, 900]) AS at FROM {_P}) SELECT o.page_id, o.at, found.title FROM o LEFT JOIN found ON o.page_id = found.page_id AND found.start_at <= o.at AND o.at < found.end_at",
    "table_render": """WITH b AS (SELECT n_regionkey, list_concat(['NAME | KEY'], list_sort(list(n_name || ' | ' || n_nationkey))) AS r FROM nation GROUP BY n_regionkey),
w AS (SELECT n_regionkey, r, list_reduce(list_transform(r[2:], lambda x: [length(x) + 1, 1]), lambda acc, x: CASE WHEN acc[1] + x[1] > 60 THEN [10 + x[1], acc[2] + 1] ELSE [acc[1] + x[1], acc[2]] END, [10, 1]) AS z FROM b)
SELECT n_regionkey, true AS plausible, array_to_string(r, chr(10)) AS text, CAST(z[2] AS INTEGER) AS n_groups FROM w""",
    "url_parts": f"""WITH d AS (SELECT DISTINCT source_url FROM source_docs), n AS (SELECT source_url, {_NORMAL.replace('u,', 'trim(source_url),').replace('ELSE u', 'ELSE trim(source_url)')} AS normal FROM d),
p AS (SELECT *, list_filter(string_split(regexp_extract(normal, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM n)
SELECT source_url, normal, nullif({_HOST % 'source_url'}, '') AS host, trim(regexp_replace(array_to_string(seg[greatest(1, len(seg) - 1):], ' '), '-|_|%20', ' ', 'g')) AS slug, left(sha256(source_url), 32) AS cache_key,
starts_with(normal, 'https://') AND regexp_extract(normal, '://([^/?#]*)', 1) IN ('kekeracredit.example', 'www.kekeracredit.example', 'sasapobank.example') AS allowed FROM p""",
    "sitemap_pages": "SELECT DISTINCT unnest(['https://x.example/1', 'https://x.example/2', 'https://x.example/5?a=1&b=2']) AS url",
    "sitemap_scan": "WITH d AS (SELECT DISTINCT doc_id, trim(source_url) AS url, '<url><loc>' || replace(replace(trim(source_url), '&', '&amp;'), '<', '&lt;') || '</loc></url>' AS x FROM source_docs WHERE trim(source_url) <> '') SELECT doc_id AS sitemap, url, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x) - 1 AS INTEGER) AS pos FROM d",
    "source_scoring": f"WITH {_SCORED} SELECT url, score, role, reasons FROM best",
    "source_choice": f"WITH {_SCORED} SELECT nullif({_HOST % 'url'}, '') AS host, url, score, role, CAST(row_number() OVER (PARTITION BY nullif({_HOST % 'url'}, '') ORDER BY role = 'primary' DESC, score DESC, url) AS INTEGER) AS rank FROM best WHERE score >= 15 QUALIFY rank <= 8",
    "revalidation": "SELECT source_url AS url, doc_id, min(retrieved_at) AS retrieved_at, max(checked_at) AS checked_at FROM source_docs GROUP BY ALL",
    "content_identity": "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "host_pacing": f"WITH d AS (SELECT DISTINCT source_url, retrieved_at, nullif({_HOST % 'source_url'}, '') AS host FROM source_docs) SELECT source_url, retrieved_at, round((epoch_us(retrieved_at) - epoch_us(lag(retrieved_at) OVER (PARTITION BY host ORDER BY retrieved_at, source_url))) / 1e6, 3) AS gap_s FROM d",
    "dates_and_editions": "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2100 THEN CAST(o_orderdate AS DATE) END AS stated, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS edition FROM orders",
}
