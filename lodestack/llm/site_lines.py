"""Lines repeated across the documents of one site."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

#: Entries a heavy-hitter summary keeps.
CAPACITY = 2048
#: Documents of one site are spread over so many shards before they are summarised.
SHARDS = 16
#: Confirmed lines that are sent to every executor at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def site_of(url: Column) -> Column:
    """Host in lower case, without ``www.`` and port; NULL for an address without host."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", "")
    return F.when(bare != "", bare)


def line_key(line: Column) -> Column:
    """What makes two lines the same: letters apart from case, words apart from spaces and tabs between."""
    folded = F.replace(F.replace(F.lower(line), F.lit("և"), F.lit("եւ")), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[ \t]+", " "))


def line_hashes(text: Column) -> Column:
    """One 64-bit key per line of a text, 0 for blank lines."""
    return F.transform(F.split(text, "\n", -1), lambda x: _hash(line_key(x)))


def _hash(key: Column) -> Column:
    return F.when(key == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(key))


SUMMARY = pa.schema([("site", pa.string()), ("line", pa.int64()), ("n", pa.int64()), ("lost", pa.int64())])


def prune(counts: Counter, capacity: int) -> tuple[Counter, int]:
    """A summary of at most ``capacity`` entries: all counts less the first one beyond. The second
    value is what any line's count may have lost by it. Pruned summaries add up: counts and losses
    of two summaries are summed, and the sum is pruned again."""
    if len(counts) <= capacity:
        return counts, 0
    cut_at = sorted(counts.values(), reverse=True)[capacity]
    return Counter({k: n - cut_at for k, n in counts.items() if n > cut_at}), cut_at


def _summarise(batches: Iterator[pa.RecordBatch], capacity: int = CAPACITY) -> Iterator[pa.RecordBatch]:
    """Pages sorted by site, shard and document in; per site and shard a summary of how many documents have each line out."""
    at, doc = None, None
    counts: Counter = Counter()
    lines: set[int] = set()
    lost = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal counts, lost
        counts.update(lines)
        counts, more = prune(counts, capacity)
        lost += more
        if at is not None:
            # the site's own row, line 0, carries what the summary lost
            keys, ns = [0, *counts.keys()], [0, *counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(keys)), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array([lost] + [0] * (len(keys) - 1), pa.int64())], schema=SUMMARY)
        counts, lost = Counter(), 0
        lines.clear()

    for b in batches:
        sites, shards, docs, hashes = (b.column(i).to_pylist() for i in range(4))
        for s, h, d, ls in zip(sites, shards, docs, hashes):
            if (s, h) != at:
                yield from flush()
                at, doc = (s, h), d
            elif d != doc:
                counts.update(lines)
                lines.clear()
                doc = d
                if len(counts) > 8 * capacity:
                    counts, more = prune(counts, capacity)
                    lost += more
            lines.update(ls)
    yield from flush()


def repeated_lines(pages: DataFrame, sites: DataFrame, min_docs: int = 5, min_share: float = 0.125, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Lines found in at least ``min_docs`` documents and ``min_share`` of all documents of their site.

    ``pages``: ``page_id, doc_id, text``; ``sites``: ``doc_id, site``, one row per document.
    Returns ``(lines, keyed)``: ``lines`` is ``site, line, n_docs``; ``keyed`` is
    ``page_id, doc_id, site, hashes`` with one 64-bit line key per line of the page.

    First pass: mergeable heavy-hitter summaries per site. Pages are shuffled as line keys
    (8 bytes a line), spread by document over ``SHARDS`` shards of a site, so a site with a
    third of all pages is summarised by many tasks, and each summary has ``capacity`` entries
    whatever it saw. Summaries add up by ``(site, line)``. A line is a candidate if its count
    plus all its site's losses reaches the threshold, so none can be missed as long as the
    losses alone stay under it; a site where they do not (very many lines a document) takes
    all its lines as candidates instead. Second pass: exact counts of distinct documents for
    the candidates alone.

    Defined cases: null, empty and blank lines never count; a page stored twice counts once;
    a document without site gives nothing; no rows give no rows.
    """
    per_doc = sites.where(F.col("site").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("site").alias("site"))
    keyed = (
        pages.where(F.col("doc_id").isNotNull())
        .select("page_id", "doc_id", line_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
        .join(per_doc, "doc_id")
    )
    keyed = cut(keyed.select("page_id", "doc_id", "site", "hashes"))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
    own = keyed.select("site", shard.alias("shard"), "doc_id", F.array_remove(F.array_distinct("hashes"), F.lit(0).cast("bigint")).alias("lines"))
    sharded = own.repartition("site", "shard").sortWithinPartitions("site", "shard", "doc_id")
    summary = sharded.mapInArrow(lambda it: _summarise(it, capacity), "site string, line bigint, n bigint, lost bigint")
    summary = cut(summary.groupBy("site", "line").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")))

    docs = keyed.select("site", "doc_id").distinct().groupBy("site").agg(F.count("*").alias("docs"))
    need = F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * F.lit(min_share)))
    bounds = summary.where("line = 0").select("site", "lost").join(docs, "site").select("site", "lost", need.alias("need"))
    candidates = summary.where("line <> 0").drop("lost").join(bounds, "site").where(F.col("n") + F.col("lost") >= F.col("need"))

    lines = keyed.select("site", "doc_id", F.explode(F.array_distinct("hashes")).alias("line")).where("line <> 0")
    sure = candidates.where(F.col("lost") < F.col("need")).select("site", "line", "need")
    counted = lines.join(_small(sure), ["site", "line"])
    open_sites = bounds.where(F.col("lost") >= F.col("need")).select("site", "need")
    counted = counted.unionByName(lines.join(open_sites, "site"))
    exact = counted.groupBy("site", "line", "need", "doc_id").agg(F.lit(1).alias("one")).groupBy("site", "line", "need").agg(F.count("*").alias("n_docs"))
    return exact.where("n_docs >= need").select("site", "line", "n_docs"), keyed


def _small(df: DataFrame) -> DataFrame:
    """``df`` written, and marked for broadcast if it has few enough rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def occurrences(lines: DataFrame, keyed: DataFrame) -> DataFrame:
    """``page_id, line_no`` of every line that ``repeated_lines`` confirmed."""
    each = keyed.select("page_id", "site", F.posexplode("hashes").alias("line_no", "line")).where("line <> 0")
    return each.join(_small(lines.select("site", "line")), ["site", "line"]).select("page_id", "line_no")


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``page_id, text`` of every page, without the lines ``found`` names; a page that loses all lines has an empty text."""
    gone = found.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return pages.join(gone, "page_id", "left").select("page_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
