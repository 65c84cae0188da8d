"""Lexical, shape and vector retrieval, and their fusion by rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import tokenize
from lodestack.functions.values import has_shape
from lodestack.session import cut

# Ranking constants, and weights of a field's phrasings by position.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
TERM_WEIGHTS = [1.0, 0.7, 0.5, 0.4]
SHAPE_WEIGHT = 1.5
COVERAGE = 0.6
#: Query vectors that are compared in one scan.
QUERY_BLOCK = 4096


def postings(chunks: DataFrame, id: str, text: str, tokens: Column | None = None) -> DataFrame:
    """``id, dl, tokens``: each chunk's number of tokens and the tokens; chunks without any count too."""
    t = tokens if tokens is not None else tokenize(F.coalesce(F.col(text), F.lit("")))
    return chunks.select(F.col(id).alias("id"), t.alias("tokens")).withColumn("dl", F.size("tokens"))


def document_frequency(indexed: DataFrame) -> DataFrame:
    """``token, n``: in how many chunks each token stands. Distinct within a chunk first, so one pre-aggregated shuffle by token."""
    return indexed.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of a whole corpus: document frequencies as a written table, and two numbers."""

    df: DataFrame
    n_docs: int
    avgdl: float


def statistics(indexed: DataFrame) -> Statistics:
    """Document frequencies, number and mean length of all chunks, in one pass and one shuffle: a chunk
    sends each distinct token once, and one row without token that carries its length."""
    tokens = F.concat(F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("dl"))), F.array(F.struct(F.lit(None).cast("string").alias("token"), F.col("dl"))))
    counted = cut(indexed.select(F.inline(tokens)).groupBy("token").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")))
    whole = counted.where("token IS NULL").first()
    n, total = (whole["n"], whole["dl"]) if whole else (0, 0)
    return Statistics(counted.where("token IS NOT NULL").select("token", "n"), n, float(total or 0) / n if n else 1.0)


def inverse_frequency(stats: Statistics) -> DataFrame:
    """``token, idf``: ln(N - n + 0.5) - ln(n + 0.5), negative ones replaced by a share of the mean over all tokens."""
    raw = stats.df.select("token", (F.log(F.lit(stats.n_docs) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("token", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(indexed: DataFrame, queries: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """``query_id, id, score`` of every chunk that has a token of a query.

    ``queries``: ``query_id, query``, a stated set of few rows. A token asked twice counts
    twice. Chunks are narrowed to the asked tokens before anything is shuffled.
    """
    stats = stats or statistics(indexed)
    asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighted = asked.join(inverse_frequency(stats), "token")
    terms = F.broadcast(asked.select("token").distinct())
    hits = indexed.select("id", "dl", F.explode("tokens").alias("token")).join(terms, "token", "left_semi").groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("times") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats.avgdl)))
    joined = hits.join(F.broadcast(weighted), "token")  # the tokens of a stated query set
    return joined.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scores: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` of each group with their ``rank``; Spark limits each group before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bm25_topk(indexed: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` best chunks of each query, cut first and only then kept where the score is above 0."""
    return ranked(bm25_scores(indexed, queries), k, ["query_id"], [F.desc("score"), F.asc("id")]).where("score > 0")


def rrf(rankings: DataFrame) -> DataFrame:
    """``query_id, id, fused``: sum of weight / (60 + rank) over the rankings an item is in."""
    return rankings.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("fused"))


def term_hits(indexed: DataFrame, terms: DataFrame, df: DataFrame) -> DataFrame:
    """``query_id, id``: chunks in which some phrasing substantially stands.

    ``terms``: ``query_id, term_pos, term``, few rows. Of a phrasing's tokens at least
    ``max(1, round(0.6 n))`` must be there, and among them the one rarest in the corpus.
    """
    spelt = terms.select("query_id", "term_pos", F.posexplode(tokenize(F.col("term"))).alias("pos", "token"))
    sized = spelt.join(df, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("query_id", "term_pos")
    # a min over one term's few tokens
    rare = sized.withColumn("len", F.count("*").over(w)).withColumn("rarest", F.min_by("token", F.struct("n", -F.length("token"), "pos")).over(w)).select("query_id", "term_pos", "token", "len", "rarest")
    asked = F.broadcast(rare.select("token").distinct())
    present = indexed.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(asked, "token", "left_semi")
    met = present.join(F.broadcast(rare), "token").groupBy("query_id", "term_pos", "id", "len").agg(F.count("*").alias("matched"), F.max((F.col("token") == F.col("rarest")).cast("int")).alias("has_rarest"))
    return met.where((F.col("matched") >= F.greatest(F.lit(1), F.round(F.col("len") * COVERAGE).cast("int"))) & (F.col("has_rarest") == 1)).select("query_id", "id").distinct()


def search_fields(chunks: DataFrame, fields: DataFrame, id: str, text: str, k: int = 4) -> DataFrame:
    """Retrieval per field: rankings of every phrasing and of value shapes, fused; with what each chunk has.

    ``fields``: ``query_id, kind, term_pos, term``, a stated set of few rows. Columns out:
    ``query_id, id, rank, fused, lexical_rank, lexical_score, has_term, has_value``. If the
    best shaped chunk is not among the ``k``, it takes the last place.
    """
    indexed = cut(postings(chunks, id, text))  # tokenised once, read for statistics, scores and terms
    stats = statistics(indexed)
    per_term = fields.select(F.concat_ws("#", "query_id", "term_pos").alias("query_id"), F.col("term").alias("query"))
    lexical = ranked(bm25_scores(indexed, per_term, stats), 3 * k, ["query_id"], [F.desc("score"), F.asc("id")]).where("score > 0")
    parts = F.split("query_id", "#")
    lexical = cut(lexical.select(parts[0].alias("query_id"), parts[1].cast("int").alias("term_pos"), "id", "score", "rank"))
    weights = F.array(*[F.lit(w) for w in TERM_WEIGHTS])
    by_term = lexical.select("query_id", "id", "rank", F.get(weights, F.least(F.col("term_pos"), F.lit(len(TERM_WEIGHTS) - 1))).alias("weight"))
    merged = lexical.groupBy("query_id", "id").agg(F.min("rank").alias("best"), F.max("score").alias("lexical_score"))
    order = Window.partitionBy("query_id").orderBy("best", F.desc("lexical_score"), "id")
    merged = merged.withColumn("lexical_rank", F.row_number().over(order))
    kinds = fields.select("query_id", "kind").distinct()
    hits = term_hits(indexed, fields, stats.df)
    texts = chunks.select(F.col(id).alias("id"), F.col(text).alias("text"))
    annotated = hits.join(F.broadcast(kinds), "query_id").join(texts, "id").select("query_id", "id", has_shape(F.col("text"), F.col("kind")).alias("has_value"))
    scored = cut(annotated.join(merged.select("query_id", "id", "lexical_score"), ["query_id", "id"], "left").withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0))))
    shaped = ranked(scored.where("has_value"), 3 * k, ["query_id"], [F.desc("lexical_score"), F.asc("id")]).select("query_id", "id", "rank", F.lit(SHAPE_WEIGHT).alias("weight"))
    fused = cut(rrf(by_term.unionByName(shaped)))
    top = ranked(fused, k, ["query_id"], [F.desc("fused"), F.asc("id")])
    first = shaped.where("rank = 1").select("query_id", F.col("id").alias("best_shaped"))
    held = top.join(first, "query_id", "left")
    lacks = held.groupBy("query_id", "best_shaped").agg(F.max((F.col("id") == F.col("best_shaped")).cast("int")).alias("there"), F.max("rank").alias("last")).where("there = 0")
    swapped = lacks.join(fused, (lacks.query_id == fused.query_id) & (lacks.best_shaped == fused.id)).select(lacks.query_id, "id", "fused", F.col("last").alias("rank"))
    kept = held.join(lacks.select("query_id", F.col("last").alias("rank"), F.lit(True).alias("out")), ["query_id", "rank"], "left").where("out IS NULL").select("query_id", "id", "fused", "rank")
    chosen = kept.unionByName(swapped)
    with_terms = scored.select("query_id", "id", F.lit(True).alias("has_term"))
    values = chosen.join(F.broadcast(kinds), "query_id").join(texts, "id").select("query_id", "id", "fused", "rank", has_shape(F.col("text"), F.col("kind")).alias("has_value"))
    return (
        values.join(with_terms, ["query_id", "id"], "left")
        .join(merged.select("query_id", "id", "lexical_rank", "lexical_score"), ["query_id", "id"], "left")
        .select("query_id", "id", "rank", "fused", "lexical_rank", F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("has_term", F.lit(False)).alias("has_term"), "has_value")
    )


def gate(retrieved: DataFrame, fields: DataFrame) -> DataFrame:
    """``query_id, is_relevant, reason``: relevant if one retrieved chunk has both the term and a value of the kind."""
    asked = fields.select("query_id").distinct()
    found = retrieved.groupBy("query_id").agg(F.max(F.col("has_term") & F.col("has_value")).alias("states"), F.max("has_term").alias("mentions"))
    reason = F.when(F.col("states"), "stated").when(F.col("mentions"), "mentioned").when(F.col("mentions").isNotNull(), "no_term").otherwise("nothing")
    return asked.join(found, "query_id", "left").select("query_id", F.coalesce("states", F.lit(False)).alias("is_relevant"), reason.alias("reason"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm counts as 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot / (one(norm(a)) * one(norm(b)))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """``query_id, id, similarity, rank``: a stated set of query vectors against all rows, exactly.

    The query set is worked off in blocks of ``QUERY_BLOCK``; each block rides along with one scan
    of the vectors as an array, and each row keeps nothing but its scores. For every row as a
    query there is the index of the training-data operators.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        asked = own.agg(F.collect_list(F.struct("query_id", "query_vector"))).scalar()
        pairs = vectors.select("id", "vector", F.explode(asked).alias("q"))
        parts.append(pairs.select("q.query_id", "id", F.round(cosine(F.col("vector"), F.col("q.query_vector")), 5).alias("similarity")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return ranked(scored, k, ["query_id"], [F.desc("similarity"), F.asc("id")])
