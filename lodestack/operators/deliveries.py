"""What changed from one full delivery of a table to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_deliveries(rows: DataFrame, group: str, run: str, taken: str) -> DataFrame:
    """``group, run, seq``: deliveries of each group numbered from 0 by their earliest ``taken``.

    Ties are broken by the run's name. Two levels, so that a group with a third of
    all deliveries is not sorted in one task: positions within a day, plus the
    running count of the group's earlier days.
    """
    runs = rows.groupBy(group, run).agg(F.min(taken).alias("__at")).withColumn("__day", F.to_date("__at"))
    inner = Window.partitionBy(group, "__day").orderBy("__at", run)
    days = runs.groupBy(group, "__day").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(F.col("__day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(group, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = runs.withColumn("__rn", F.row_number().over(inner) - 1).alias("r").join(
        days.alias("d"), (F.col(f"r.{group}").eqNullSafe(F.col(f"d.{group}"))) & F.col("r.__day").eqNullSafe(F.col("d.__day"))
    )
    return placed.select(F.col(f"r.{group}").alias(group), F.col(f"r.{run}").alias(run), (F.col("__before") + F.col("__rn")).alias("seq"))


#: Deliveries per block of a key: the most rows one key puts into one range.
BLOCK = 512
CHANGES = pa.schema([("g", pa.string()), ("k", pa.string()), ("seq", pa.int64()), ("change_type", pa.string()), ("columns", pa.list_(pa.int32()))])


def _states(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """One row of hashes per state, and which states are null."""
    null = np.asarray(col.is_null())
    flat = np.asarray(col.flatten())
    width = len(flat) // max(1, len(null) - int(null.sum()))
    out = np.zeros((len(null), width), np.int64)
    out[~null] = flat.reshape(-1, width) if width else 0
    return out, null


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbouring deliveries in one sorted stream of ``g, k, block, seq, halo, state``.

    The older pointer stands on the key's previous row, the newer one on the next; both run
    over a batch at once, and only the older pointer's row is remembered between batches.
    Rows of neighbouring deliveries are compared column by column; a gap is a removal after
    the older row and an addition at the newer. A block reports the changes that fall into
    its own deliveries; its halo row is the key's row in the last delivery before it.
    """
    held: pa.Table | None = None

    def pack(t: pa.Table, parts: list[tuple[str, np.ndarray, np.ndarray]], differs: np.ndarray | None = None) -> pa.RecordBatch:
        rows = pa.array(np.concatenate([at for _, at, _ in parts]))
        kinds = pa.array([kind for kind, at, _ in parts for _ in range(len(at))], pa.string())
        columns: list = [np.flatnonzero(differs[i]).tolist() if kind == "changed" else None for kind, at, _ in parts for i in at]
        seq = pa.array(np.concatenate([seq for _, _, seq in parts]), pa.int64())
        g, k = (t.column(c).take(rows).combine_chunks() for c in ("g", "k"))
        return pa.RecordBatch.from_arrays([g, k, seq, kinds, pa.array(columns, CHANGES.field("columns").type)], schema=CHANGES)

    def ends(seq: np.ndarray, block: np.ndarray) -> np.ndarray:
        return seq + 1 < (block + 1) * BLOCK

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        fresh = held is None
        held = t.slice(t.num_rows - 1, 1)
        block, seq, halo = (np.asarray(t.column(c)) for c in ("block", "seq", "halo"))
        state, null = _states(t.column("state").combine_chunks())
        same = block[1:] == block[:-1]
        for c in ("g", "k"):
            col = t.column(c).combine_chunks()
            same &= np.asarray(pc.equal(col[1:], col[:-1]))
        older, newer = np.arange(len(same)), np.arange(1, len(same) + 1)
        next_to = same & (seq[1:] == seq[:-1] + 1)
        gap = same & ~next_to
        differs = np.zeros(state.shape, bool)
        differs[1:] = (state[1:] != state[:-1]) | (null[1:] != null[:-1])[:, None]
        changed = next_to & (differs[1:].any(1) | (null[1:] != null[:-1]))
        starts = np.r_[fresh, ~same] if fresh else np.r_[False, ~same]
        first = starts & ~halo.astype(bool) & (seq > 0)
        closed = ~same & ends(seq[:-1], block[:-1])
        parts = [
            ("added", np.flatnonzero(first), seq[first]),
            ("removed", older[closed], seq[:-1][closed] + 1),
            ("changed", newer[changed], seq[1:][changed]),
            ("removed", older[gap], seq[:-1][gap] + 1),
            ("added", newer[gap], seq[1:][gap]),
        ]
        if sum(len(at) for _, at, _ in parts):
            yield pack(t, parts, differs)
    if held is not None:
        block, seq = (np.asarray(held.column(c)) for c in ("block", "seq"))
        if ends(seq, block)[0]:
            yield pack(held, [("removed", np.zeros(1, np.int64), seq + 1)])


def delivery_changes(rows: DataFrame, group: str, run: str, key: str, taken: list[str], state: str | list[str], is_reading: str) -> DataFrame:
    """Typed changes between consecutive full deliveries: ``group, run, key, change_type``, and ``columns``, the
    names of the columns that changed, where ``state`` is a list of columns.

    ``rows`` has any number of rows per delivery (``run``) and key. A key is delivered
    if the run has any row of it; its state is that of the last row (by ``taken``, the
    first of which also orders the runs) with ``is_reading``, else the state it had
    before, else NULL. ``run`` in the result is the later delivery; a group's first
    delivery gives no rows.

    Defined cases: a NULL group is a group of its own, rows with a NULL run or key are
    ignored, states compare null-safely, repeated rows change nothing, no rows give
    no rows.

    How it scales: rows are reduced to one per run and key before anything is sorted;
    the reduced table is range-partitioned and sorted by key and block of deliveries,
    so a key with a third of all rows spreads over as many ranges as it has blocks.
    """
    names = [state] if isinstance(state, str) else state
    hashes = F.array(*[F.xxhash64(F.col(c)) for c in names])  # a column travels as 64 bits
    if isinstance(state, str):
        hashes = F.when(F.col(state).isNotNull(), hashes)
    own = rows.where(F.col(run).isNotNull() & F.col(key).isNotNull()).select(
        F.coalesce(F.col(group), F.lit("\u0000")).alias("g"), F.col(run).alias("run"), F.col(key).alias("k"), F.col(taken[0]).alias("at"), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(taken)], hashes.alias("h")).alias("last"), F.col(is_reading).alias("ok")
    )
    seqs = number_deliveries(own, "g", "run", "at")
    per_run = own.groupBy("g", "run", "k").agg(F.max(F.when(F.col("ok"), F.col("last")))["h"].alias("h"))
    placed = per_run.join(seqs, ["g", "run"]).select("g", "k", F.expr(f"seq div {BLOCK}").alias("block"), "seq", "h")

    # What a key was last known to be before each of its blocks.
    blocks = placed.groupBy("g", "k", "block").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("seq"))).alias("h"))
    earlier = Window.partitionBy("g", "k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("g", "k", "block", F.last("h", ignorenulls=True).over(earlier).alias("carry"))
    within = Window.partitionBy("g", "k", "block").orderBy("seq")
    known = placed.join(carry, ["g", "k", "block"]).withColumn("state", F.coalesce(F.last("h", ignorenulls=True).over(within), "carry"))
    edge = F.expr(f"seq % {BLOCK} = {BLOCK - 1}")
    halo = F.when(edge, F.array(F.struct("block", F.lit(False).alias("halo")), F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct("block", F.lit(False).alias("halo"))))
    stream = known.select("g", "k", "seq", "state", F.inline(halo)).select("g", "k", "block", "seq", "halo", "state")
    ranged = stream.repartitionByRange("g", "k", "block").sortWithinPartitions("g", "k", "block", "seq")
    changes = ranged.mapInArrow(_merge, "g string, k string, seq bigint, change_type string, columns array<int>")
    named = F.transform("columns", lambda i: F.get(F.array(*map(F.lit, names)), i)).alias("columns")
    more = [] if isinstance(state, str) else [named]
    return changes.join(seqs, ["g", "seq"]).select(F.when(F.col("g") != "\u0000", F.col("g")).alias(group), F.col("run").alias(run), F.col("k").alias(key), "change_type", *more)
