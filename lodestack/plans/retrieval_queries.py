"""Tokens, BM25, fusion, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.functions.values import has_shape
from lodestack.operators import retrieval as r
from lodestack.plans import sqlparts as s
from lodestack.session import table, values

SEARCHES = [
    ("rate", "annual nominal rate of the loan"),
    ("term", "ամսական վճարումներով ամիս"),
    ("fee", "плата за рассмотрение заявки"),
    ("pledge", "pledge dwelling community"),
    ("insurance", "страхование компания insurance"),
]
# Phrasings of fields, from the most canonical to the least.
FIELDS = [
    ("nominal_rate", "percent", ["անվանական տոկոսադրույք", "տարեկան տոկոսադրույք", "nominal interest rate"]),
    ("effective_rate", "percent", ["փաստացի տոկոսադրույք", "effective interest rate EIR"]),
    ("term", "term", ["վարկի ժամկետ", "մինչև ամիս տարի", "loan term months"]),
    ("amount", "amount", ["վարկի գումար", "նվազագույն առավելագույն գումար", "loan amount limits"]),
    ("service_fee", "fee", ["վարկային հաշվի սպասարկման միջնորդավճար", "սպասարկման վճար", "service fee"]),
    ("collateral", "text", ["ապահովվածություն", "գրավ երաշխավորություն", "collateral pledge guarantee"]),
]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", heavy=True).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return r.postings(_docs(spark, sf), "doc_id", "text")


def _searches(spark: SparkSession) -> DataFrame:
    return values(spark, SEARCHES, "query_id string, query string")


def _fields(spark: SparkSession) -> DataFrame:
    return values(spark, [(f, k, i, x) for f, k, xs in FIELDS for i, x in enumerate(xs)], "query_id string, kind string, term_pos int, term string")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf).select(F.col("id").alias("doc_id"), F.col("dl").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return r.document_frequency(_indexed(spark, sf))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return r.bm25_topk(_indexed(spark, sf), _searches(spark)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def _by_term(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings of the searches' single words, as the phrasings of one query."""
    words = _searches(spark).select("query_id", F.posexplode(F.split("query", " ")).alias("pos", "query"))
    asked = words.select(F.concat_ws("#", "query_id", "pos").alias("query_id"), "query")
    top = r.ranked(r.bm25_scores(_indexed(spark, sf), asked), 12, ["query_id"], [F.desc("score"), F.asc("id")]).where("score > 0")
    return top.select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].cast("int").alias("pos"), "id", "score", "rank")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.get(F.array(*[F.lit(w) for w in r.TERM_WEIGHTS]), F.least("pos", F.lit(3)))
    return r.rrf(_by_term(spark, sf).withColumn("weight", weight)).select("query_id", F.col("id").alias("doc_id"), "fused")


def lexical_rank_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = _by_term(spark, sf).groupBy("query_id", "id").agg(F.min("rank").alias("best_rank"), F.max("score").alias("best_score"))
    return r.ranked(merged, 1_000_000, ["query_id"], [F.asc("best_rank"), F.desc("best_score"), F.asc("id")]).select("query_id", F.col("id").alias("doc_id"), "best_rank", "best_score", F.col("rank").alias("lexical_rank"))


def informative_hits(spark: SparkSession, sf: str) -> DataFrame:
    i = _indexed(spark, sf)
    return r.term_hits(i, _fields(spark), r.document_frequency(i)).select("query_id", F.col("id").alias("doc_id"))


def field_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: retrieval of every field's evidence, with what the evidence has."""
    return r.search_fields(_docs(spark, sf), _fields(spark), "doc_id", "text")


def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    return r.gate(field_retrieval(spark, sf), _fields(spark))


def value_shape_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *[has_shape(F.col("text"), k).alias(f"has_{k}") for k in ("percent", "amount", "currency", "term", "fee", "text")])


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return r.cosine_topk(e, q).select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


def normalized_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("doc_id", "document_name").distinct().select("doc_id", "document_name", t.normalize_query(F.col("document_name")).alias("name"))


_IDX = f"idx AS (SELECT doc_id AS id, {s.tokens('coalesce(text, chr(0))')} AS tokens FROM documents), ix AS (SELECT id, tokens, len(tokens) AS dl FROM idx)"
_DF = "df AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(tokens)) AS token FROM ix) GROUP BY token)"
_IDF = """tot AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM ix),
raw AS (SELECT token, ln(n_docs - n + 0.5) - ln(n + 0.5) AS raw FROM df, tot),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _scores(asked: str) -> str:
    return f"""asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({s.tokens('query')}) AS token FROM {asked}) GROUP BY ALL),
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS token FROM ix) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
scores AS (SELECT query_id, id, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN asked USING (token) JOIN idf USING (token), tot GROUP BY ALL)"""


_WORDS = f"(SELECT query_id || '#' || (pos - 1) AS query_id, w AS query FROM (SELECT query_id, generate_subscripts(string_split(query, ' '), 1) AS pos, unnest(string_split(query, ' ')) AS w FROM {s.rows(SEARCHES, 'query_id, query')}))"
_TERMS = f"""WITH {_IDX}, {_DF}, {_IDF}, {_scores(_WORDS)},
top AS (SELECT split_part(query_id, '#', 1) AS query_id, CAST(split_part(query_id, '#', 2) AS INTEGER) AS pos, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= 12),
by_term AS (SELECT * FROM top WHERE score > 0)"""
_FIELD_ROWS = s.rows([(f, k, i, x) for f, k, xs in FIELDS for i, x in enumerate(xs)], "query_id, kind, term_pos, term")

QUERIES = {
    "token_counts": token_counts,
    "doc_frequency": doc_frequency,
    "bm25_topk": bm25_topk,
    "rrf_fusion": rrf_fusion,
    "lexical_rank_merge": lexical_rank_merge,
    "informative_hits": informative_hits,
    "field_retrieval": field_retrieval,
    "relevance_gate": relevance_gate,
    "value_shape_flags": value_shape_flags,
    "cosine_topk": cosine_topk,
    "normalized_queries": normalized_queries,
}
ORACLE_SQL = {
    "token_counts": f"WITH {_IDX} SELECT id AS doc_id, CAST(dl AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct FROM ix",
    "doc_frequency": f"WITH {_IDX}, {_DF} SELECT token, n FROM df",
    "bm25_topk": f"WITH {_IDX}, {_DF}, {_IDF}, {_scores(s.rows(SEARCHES, 'query_id, query'))}, top AS (SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scores QUALIFY rank <= 4) SELECT * FROM top WHERE score > 0",
    "rrf_fusion": f"{_TERMS} SELECT query_id, id AS doc_id, round(sum(([1.0, 0.7, 0.5, 0.4])[least(pos, 3) + 1]::DOUBLE / (60 + rank)), 9) AS fused FROM by_term GROUP BY ALL",
    "lexical_rank_merge": f"{_TERMS}, m AS (SELECT query_id, id AS doc_id, CAST(min(rank) AS INTEGER) AS best_rank, max(score) AS best_score FROM by_term GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, best_score DESC, doc_id) AS INTEGER) AS lexical_rank FROM m",
    "informative_hits": f"""WITH {_IDX}, {_DF},
spelt AS (SELECT query_id, term_pos, tk AS token, pos FROM (SELECT query_id, term_pos, unnest(ts) AS tk, generate_subscripts(ts, 1) AS pos FROM (SELECT query_id, term_pos, {s.tokens('term')} AS ts FROM {_FIELD_ROWS}))),
sized AS (SELECT spelt.*, coalesce(n, 0) AS n FROM spelt LEFT JOIN df USING (token)),
rare AS (SELECT *, count(*) OVER w AS len, first_value(token) OVER (PARTITION BY query_id, term_pos ORDER BY n, length(token) DESC, pos) AS rarest FROM sized WINDOW w AS (PARTITION BY query_id, term_pos)),
have AS (SELECT id, unnest(list_distinct(tokens)) AS token FROM ix),
met AS (SELECT query_id, term_pos, id, len, count(*) AS matched, max(CASE WHEN token = rarest THEN 1 ELSE 0 END) AS has FROM have JOIN rare USING (token) GROUP BY ALL)
SELECT DISTINCT query_id, id AS doc_id FROM met WHERE matched >= greatest(1, CAST(round(len * 0.6) AS INTEGER)) AND has = 1""",
    "value_shape_flags": "SELECT doc_id, " + ", ".join(f"({s.shape('t', k)}) AS has_{k}" for k in ("percent", "amount", "currency", "term", "fee", "text")) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "cosine_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM e),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_inner_product(a.v, b.v) / ((CASE WHEN a.m = 0 THEN 1 ELSE a.m END) * (CASE WHEN b.m = 0 THEN 1 ELSE b.m END)), 5) AS similarity FROM n a, n b WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 4""",
    "normalized_queries": f"SELECT doc_id, document_name, {s.casefold(s.squeeze('regexp_replace(nfc_normalize(left(document_name, 200)), ' + s.q(t.QUERY_PUNCTUATION) + ', chr(32), chr(103))'))} AS name FROM (SELECT DISTINCT doc_id, document_name FROM source_docs)",
}
