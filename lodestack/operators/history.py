"""Version histories of entities whose attributes change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(states: Column) -> Column:
    """Left fold of a sorted array of ``struct<d, h>``: keep an element only where ``h`` differs from the last kept one."""
    empty = F.slice(states, 1, 0)
    return F.aggregate(
        states,
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & F.element_at(acc, -1)["h"].eqNullSafe(s["h"]), acc).otherwise(F.concat(acc, F.array(s))),
    )


def version_history(readings: DataFrame, entity: str, date: str, taken: list[str], state: str, period: str = "year") -> DataFrame:
    """Every version of every entity with the period in which it was valid.

    ``readings`` has one row per reading: the entity, the date it speaks of, the
    columns ``taken`` that say which of two readings of one date is later, and a
    comparable ``state``. Result: ``entity, valid_from, valid_to, state``;
    ``valid_to`` is the date of the next version, NULL for the last.

    Defined cases: rows with a NULL entity or date are no readings; a NULL state
    is a state like any other; of rows that tie in ``taken`` the largest state
    counts, so repeated rows change nothing; no rows give no rows.

    How it scales: readings are first reduced to one row per entity and date
    (map-side combined), so an entity's array is bounded by calendar days however
    many rows it has. The fold runs per entity and ``period``, which also splits
    one hot entity's days over several tasks; a window over the few period
    summaries of an entity then drops a period's first version where it only
    continues the last one of the period before.
    """
    e, d = F.col(entity), F.col(date)
    daily = (
        readings.where(e.isNotNull() & d.isNotNull())
        .select(e.alias("__e"), d.cast("date").alias("__d"), F.struct(*[F.col(c) for c in taken], F.col(state).alias("h")).alias("__last"))
        .groupBy("__e", "__d")
        .agg(F.max("__last")["h"].alias("h"))
    )
    folded = (
        daily.groupBy("__e", F.trunc("__d", period).alias("__p"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__d").alias("d"), F.col("h")))).alias("__a"))
        .select("__e", "__p", _fold(F.col("__a")).alias("v"))
    )
    over = Window.partitionBy("__e").orderBy("__p")
    first = F.col("v")[0]["h"]
    same = F.lag(F.element_at("v", -1)).over(over)
    stitched = folded.select("__e", "__p", "v", (same.isNotNull() & same["h"].eqNullSafe(first)).alias("__cont")).select(
        "__e", "__p", F.when(F.col("__cont"), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).otherwise(F.col("v")).alias("v")
    )
    # The end of a period's last version is the start of the next version in any later period.
    kept = stitched.where(F.size("v") > 0)
    following = F.lead(F.col("v")[0]["d"]).over(over)
    ends = F.transform("v", lambda s, i: F.struct(s["d"].alias("valid_from"), F.coalesce(F.get(F.col("v"), i + 1)["d"], F.col("__next")).alias("valid_to"), s["h"].alias("state")))
    return kept.withColumn("__next", following).select("__e", F.inline(ends)).withColumnRenamed("__e", entity).withColumnRenamed("state", state)
