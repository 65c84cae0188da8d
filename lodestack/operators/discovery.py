"""Finding and ranking sources: names, links, scores."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.fuzzy import token_set_ratio
from lodestack.functions.text import normalize_query
from lodestack.functions.urls import normalize_url

# Thresholds of name resolution.
RESOLVED, PLAUSIBLE, LEAD, UNSUPPORTED = 85.0, 60.0, 10.0, 45.0
# What anchors and addresses tell of a source (text, weight, role), in order of precedence.
ANCHORS = [
    ("տեղեկատվական ամփոփագիր", 50, "primary"), ("ամփոփագիր", 40, "primary"), ("ամփոփաթերթիկ", 40, "primary"),
    ("information summary", 40, "primary"), ("վարկային սակագներ", 28, "supporting"), ("սակագներ", 25, "supporting"),
    ("սակագին", 25, "supporting"), ("տարիֆ", 20, "supporting"), ("պայմաններ", 10, "supporting"), ("տոկոսադրույք", 10, "supporting"),
]
ADDRESSES = [("loan info", 30, "primary"), ("loan%20info", 30, "primary"), ("loans-tariffs", 25, "supporting"), ("tariffs", 15, "supporting")]
NEGATIVE = [("tariffs-archive", -60), ("արխիվ", -50), ("archive", -50), ("բիզնես", -35), ("business", -35), ("calculator", -30), ("հաշվիչ", -30)]
SEGMENTS = [("/individual/", 20), ("/business/", -60), ("/agro/", -60), ("/news/", -40), ("/announcements/", -25), ("/calculators/", -40)]
PDF_BONUS, RATE_BONUS, RATE_MENTIONS = 10, 15, 3
RATE_MARKERS = ["տոկոսադրույք", "տարեկան փաստացի", "interest rate"]


def _first(text: Column, table: list[tuple]) -> Column:
    """The first entry, in the table's order, that a text holds."""
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(w)).alias("weight"), F.lit(r).alias("role")) for t, w, r in table])
    return F.get(F.filter(rows, lambda k: F.instr(text, k["text"]) > 0), F.lit(0))


def _total(table: list[tuple], test) -> Column:
    out = F.lit(0.0)
    for t, w in table:
        out = out + F.when(test(t), float(w)).otherwise(0.0)
    return out


def score_sources(links: DataFrame) -> DataFrame:
    """``url, score, role, reasons``: the best of each address's candidates.

    ``links``: ``url, anchor, kind, rate_mentions, ord``. Points add up: the first anchor phrase and
    the first address phrase, all negative phrases and path segments, and a bonus for documents or
    for pages that state rates. Of equal candidates of one address the first counts.
    """
    url, anchor = F.lower(normalize_url(F.col("url"))), F.lower(F.coalesce(F.col("anchor"), F.lit("")))
    base = links.withColumns({"__a": _first(anchor, ANCHORS), "__u": _first(url, ADDRESSES), "__neg": _total(NEGATIVE, lambda t: (F.instr(url, t) > 0) | (F.instr(anchor, t) > 0)), "__seg": _total(SEGMENTS, lambda t: F.instr(url, t) > 0)})
    pdf = F.col("kind") == "pdf"
    rates = ~pdf & (F.coalesce(F.col("rate_mentions"), F.lit(0)) >= RATE_MENTIONS)
    points = F.coalesce(F.col("__a.weight"), F.lit(0.0)) + F.coalesce(F.col("__u.weight"), F.lit(0.0)) + F.col("__neg") + F.col("__seg") + F.when(pdf, float(PDF_BONUS)).when(rates, float(RATE_BONUS)).otherwise(0.0)
    primary = (F.col("__a.role") == "primary") | (F.col("__u.role") == "primary") | rates
    reasons = F.array_compact(F.array(F.col("__a.text"), F.col("__u.text"), F.when(F.col("__neg") < 0, F.lit("negative")), F.when(F.col("__seg") != 0, F.lit("path")), F.when(pdf, F.lit("pdf")), F.when(rates, F.lit("rates"))))
    scored = base.select(normalize_url(F.col("url")).alias("url"), points.alias("score"), F.when(F.coalesce(primary, F.lit(False)), "primary").otherwise("supporting").alias("role"), reasons.alias("reasons"), "ord")
    best = scored.groupBy("url").agg(F.max_by(F.struct("score", "role", "reasons"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("url", "b.score", "b.role", "b.reasons")


def choose_sources(scored: DataFrame, group: str, floor: float = 15.0, most: int = 8) -> DataFrame:
    """The ``most`` best sources of each group at or above the floor, primary ones first."""
    w = Window.partitionBy(group).orderBy(F.desc(F.col("role") == "primary"), F.desc("score"), "url")
    return scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rate_mentions(text: Column) -> Column:
    """How often a text mentions rates."""
    low = F.lower(text)
    return sum((F.regexp_count(low, F.lit(m)) for m in RATE_MARKERS), F.lit(0))


def resolve_names(queries: DataFrame, names: DataFrame, unsupported: list[str]) -> DataFrame:
    """``query_id, status, product_id, score, lead``: the product a typed name means.

    ``queries`` is a stated set (``query_id, query``), ``names`` a catalogue (``product_id, name, ord``).
    The best name of a product speaks for it; a query with an unsupported word loses points; it is
    resolved at 85 with a lead of 10, not found under 60, else ambiguous.
    """
    q = queries.select("query_id", normalize_query(F.col("query")).alias("q"))
    n = names.select("product_id", normalize_query(F.col("name")).alias("n"))
    asked = q.where("q <> ''").agg(F.collect_list(F.struct("query_id", "q"))).scalar()  # a stated query set
    pairs = n.select("product_id", "n", F.explode(asked).alias("a")).select("product_id", "n", "a.query_id", "a.q")
    best = pairs.select("query_id", "q", "product_id", token_set_ratio("q", "n").alias("s")).groupBy("query_id", "q", "product_id").agg(F.max("s").alias("s"))
    off = F.arrays_overlap(F.split("q", " "), F.array(*[F.lit(u) for u in unsupported])) if unsupported else F.lit(False)
    final = best.select("query_id", "product_id", F.greatest(F.lit(0.0), F.col("s") - F.when(off, UNSUPPORTED).otherwise(0.0)).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "product_id")
    top = final.select("query_id", "product_id", "s", F.row_number().over(w).alias("rn"), (F.col("s") - F.coalesce(F.lead("s").over(w), F.lit(0.0))).alias("lead")).where("rn = 1")
    status = F.when(F.col("s").isNull() | (F.col("s") < PLAUSIBLE), "not_found").when((F.col("s") >= RESOLVED) & (F.col("lead") >= LEAD), "resolved").otherwise("ambiguous")
    return q.join(top, "query_id", "left").select("query_id", status.alias("status"), F.when(status == "resolved", F.col("product_id")).alias("product_id"), F.round("s", 4).alias("score"), F.round("lead", 4).alias("lead"))


def _locations(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, xml in zip(*(c.to_pylist() for c in b.columns)):
                if not xml or "<!ENTITY" in xml.upper():
                    continue
                try:
                    root = ElementTree.fromstring(xml.strip().encode("utf-8", "replace") if not xml.lstrip().startswith("<?xml") else xml.strip())
                except (ElementTree.ParseError, ValueError):
                    continue
                found = [e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == "loc" and e.text and e.text.strip()]
                is_index = root.tag.endswith("sitemapindex")
                out += [(name, u, is_index, i) for i, u in enumerate(dict.fromkeys(found)) if i < most]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], names=["sitemap", "url", "is_index", "pos"])

    return run


def sitemap_locations(sitemaps: DataFrame, most: int = 5000) -> DataFrame:
    """``sitemap, url, is_index, pos``: the first ``most`` addresses of each sitemap in order, repeats dropped.

    Namespaces and character data sections are read as XML has them. A document that is not
    well-formed, null, or declares entities has none.
    """
    return sitemaps.select(F.col("sitemap").cast("string").alias("sitemap"), "xml").mapInArrow(_locations(most), "sitemap string, url string, is_index boolean, pos int")


def follow_index(root: DataFrame, children: DataFrame, most: int = 10) -> DataFrame:
    """``url``: pages of an index's first children, one level deep; a nested index is skipped."""
    first = root.where("is_index").where(F.col("pos") < most).select(F.col("url").alias("sitemap"))
    return children.where("NOT is_index").join(first, "sitemap", "left_semi").select("url").distinct()
