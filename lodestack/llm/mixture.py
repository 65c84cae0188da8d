"""Mixing sources to target shares of a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import cut

#: Tokens of a block, the unit that the splitting tree deals out, and how few and many blocks a source has.
BLOCK_TOKENS, LEAST_BLOCKS, MOST_BLOCKS = 200_000, 64, 1 << 20
#: Tokens of an output shard.
SHARD_TOKENS = 4_000_000
#: Nodes to which the driver draws the splitting tree; the tree below each is drawn by a task.
NODES = 256


def quotas(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[int, int]]:
    """``source -> (whole repeats, tokens of one more, partial repeat)``.

    Without ``total`` the mixture is as large as the caps allow with every share exact: the
    least of ``size * cap / share`` over the sources. With it, a source that cannot fill its
    share gives all its repeats, and the shares reported show the shortfall.
    """
    live = [(s, share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and sizes.get(s, 0) > 0]
    if not live:
        return {}
    if total is None:
        total = int(min(sizes[s] * cap / share for s, share, cap in live))
    out = {}
    for s, share, cap in live:
        want = min(int(round(total * share)), sizes[s] * cap)
        out[s] = (want // sizes[s], want % sizes[s])
    return out


def split_blocks(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal blocks of every source to shards: ``shards x sources`` block counts, exact in sum.

    A binary tree over the shards: at each node the blocks at hand are divided between the
    halves in proportion to their shards, and how many of each source go left is one draw
    from the multivariate hypergeometric distribution, so every way to deal the blocks out
    without replacement is as likely as any other.
    """
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    n = int(counts.sum())
    take = n * left // shards
    go = rng.multivariate_hypergeometric(counts, take, method="marginals") if n else counts * 0
    return np.concatenate([split_blocks(go, left, rng), split_blocks(counts - go, shards - left, rng)])


def upper_nodes(counts: np.ndarray, shards: int, nodes: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The splitting tree down to about ``nodes`` nodes: ``first shard, shards, counts, starts`` of each, where
    ``starts`` is how many blocks of each source the nodes before it have."""
    rng = np.random.default_rng(seed)
    todo, out = [(0, shards, counts)], []
    most = max(1, -(-shards // nodes))
    while todo:
        first, n, own = todo.pop()
        if n <= most:
            out.append((first, n, own))
            continue
        left = n // 2
        total = int(own.sum())
        go = rng.multivariate_hypergeometric(own, total * left // n, method="marginals") if total else own * 0
        todo += [(first, left, go), (first + left, n - left, own - go)]
    out.sort(key=lambda x: x[0])
    starts = np.cumsum([np.zeros_like(counts), *[own for _, _, own in out]], axis=0)
    return [(first, n, own, at) for (first, n, own), at in zip(out, starts)]


def _lower(seed: int):
    """Nodes in; the range of each source's blocks that each shard below them gets out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, counts, starts in zip(*(c.to_pylist() for c in b.columns)):
                table = split_blocks(np.array(counts, np.int64), n, np.random.default_rng([seed, first]))
                ends = table.cumsum(0) + np.array(starts, np.int64)
                shard, source = np.nonzero(table)
                last = ends[shard, source]
                cols = (source.astype(np.int32), (shard + first).astype(np.int32), last - table[shard, source], last)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "shard", "first", "last"])

    return run


def _permuted(*cols: str, seed: int):
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "n_tokens", shards: int | None = None, total: int | None = None, seed: int = 11) -> DataFrame:
    """``doc, source, n_tokens, copy, shard, position``: the mixture, one row per document and repeat.

    Each source gives its quota of tokens: all its documents as many whole times as fit, then
    documents in a permuted order as long as they bring it nearer to the quota, so a source misses
    its share by half a document at most and no document is repeated more often than the cap.
    Blocks of documents are dealt to ``shards`` by ``split_blocks``; a block keeps its documents
    together and each shard is shuffled on its own, by ``position``.

    Defined cases: documents of other sources, of no tokens, or without id or source are not in the
    mixture; sources without documents give nothing, which the report shows; a source listed
    twice counts by its larger target; documents stored twice are mixed once; no rows give no rows.

    How it scales: the driver holds the targets, their sizes, and the block counts of ``NODES`` nodes
    of the splitting tree, never documents, blocks or shards; tasks draw the tree below the nodes and
    its ranges meet the blocks in a join. Shards are of bounded tokens, and blocks too up to
    ``MOST_BLOCKS`` of a source, so there are more of them as the corpus grows. A source's running token count is taken over its blocks first and only
    inside a block over documents, so a source with a third of all documents is worked on by
    as many tasks as it has blocks.
    """
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeat", "target_share").alias("max_repeat"))
    # the targets are a configuration table of one row per source
    aims = [(r["source"], r["target_share"], r["max_repeat"]) for r in goal.orderBy("source").collect()]
    named = goal.select(F.col("source").alias("s"))
    own = (
        docs.where(F.col(doc).isNotNull() & (F.col(size) > 0))
        .select(F.col(doc).alias("d"), F.col(source).alias("s"), F.col(size).cast("bigint").alias("n"))
        .join(F.broadcast(named), "s", "left_semi")
        .groupBy("s", "d").agg(F.max("n").alias("n"))
        .withColumn("h", _permuted("s", "d", seed=seed))
    )
    own = cut(own)
    sizes = {r["s"]: int(r["n"]) for r in own.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    give = quotas(sizes, aims, total)
    spark = docs.sparkSession
    cells = [(s, w, p, max(LEAST_BLOCKS, min(MOST_BLOCKS, sizes[s] // BLOCK_TOKENS))) for s, (w, p) in sorted(give.items())]
    shards = shards or max(8, sum(w * sizes[s] + p for s, w, p, _ in cells) // SHARD_TOKENS)
    quota = spark.createDataFrame(cells, "s string, whole bigint, part bigint, blocks bigint")
    own = own.join(F.broadcast(quota), "s").withColumn("b", F.pmod(F.shiftright("h", 20), F.col("blocks")))
    blocks = own.groupBy("s", "b").agg(F.sum("n").alias("bn"))

    # which documents are in the partial repeat: a running count over blocks, then inside one
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("s", "b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "b").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(at, ["s", "b"]).withColumn("upto", F.col("base") + F.sum("n").over(inside))
    copies = F.col("whole") + F.when(F.col("upto") - F.col("n") / 2 <= F.col("part"), 1).otherwise(0)
    each = placed.withColumn("copies", copies).where("copies > 0").select("s", "d", "n", "b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    each = cut(each)

    # blocks of one copy of a source are the tree's balls, ranked in a permuted order: within slices of it, after the slices before
    dealt = each.select("s", "b", "copy").distinct().withColumn("order", _permuted("s", "b", "copy", seed=seed + 1)).withColumn("slice", F.shiftright("order", 54))
    slices = dealt.groupBy("s", "slice").agg(F.count("*").alias("c"))
    counts = {r["s"]: int(r["n"]) for r in slices.groupBy("s").agg(F.sum("c").alias("n")).collect()}  # a row per source of the targets
    names = sorted(counts)
    if not names:
        return each.select(F.col("d").alias(doc), F.col("s").alias(source), F.col("n").alias("n_tokens"), F.col("copy").cast("int").alias("copy"), F.lit(0).alias("shard"), F.lit(0).alias("position"))
    earlier = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = slices.select("s", "slice", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("s", "slice").orderBy("order", "b", "copy")
    balls = dealt.withColumn("at", F.row_number().over(within) - 1).join(offset, ["s", "slice"]).select("s", "b", "copy", (F.col("offset") + F.col("at")).alias("rank"))

    # ranges meet the balls by steps of a source's order that are about as wide as a range, in time that grows with both only
    steps = spark.createDataFrame([(s, i, max(1, counts[s] // shards)) for i, s in enumerate(names)], "s string, i int, step bigint")
    nodes = [(f, n, c.tolist(), at.tolist()) for f, n, c, at in upper_nodes(np.array([counts[s] for s in names], np.int64), shards, NODES, seed)]
    drawn = spark.createDataFrame(nodes, "first_shard int, shards int, counts array<bigint>, starts array<bigint>").repartition(min(len(nodes), spark.sparkContext.defaultParallelism))
    ranges = drawn.mapInArrow(_lower(seed), "i int, shard int, first bigint, last bigint").join(F.broadcast(steps), "i")
    ranges = ranges.withColumn("stride", F.explode(F.sequence(F.expr("first div step"), F.expr("(last - 1) div step")))).select("s", "stride", "shard", "first", "last")
    strided = balls.join(F.broadcast(steps), "s").withColumn("stride", F.expr("rank div step")).select("s", "b", "copy", "rank", "stride")
    sent = strided.join(ranges, ["s", "stride"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select("s", "b", "copy", "shard")
    local = Window.partitionBy("shard").orderBy("key", "s", "d", "copy")
    mixed = each.join(sent, ["s", "b", "copy"]).withColumn("key", _permuted("s", "d", "copy", "shard", seed=seed + 2))
    return mixed.select(F.col("d").alias(doc), F.col("s").alias(source), F.col("n").alias("n_tokens"), F.col("copy").cast("int").alias("copy"), "shard", F.row_number().over(local).alias("position"))


def shares(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """``source, target_share, max_repeat, n_docs, n_rows, n_tokens, share``: what each source got; zeros where it gave nothing."""
    got = mixture.groupBy(source).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.max("copy").alias("most_repeats"))
    total = got.agg(F.sum("n_tokens")).scalar()
    joined = targets.join(got, source, "left").withColumn("total", total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(source, "target_share", "max_repeat", zero("n_docs"), zero("n_rows"), zero("n_tokens"), zero("most_repeats"), F.round(F.coalesce(F.try_divide("n_tokens", "total"), F.lit(0.0)), 6).alias("share"))
