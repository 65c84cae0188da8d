"""Streams over the landing zone: windows of events, and what is new per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, kind, n, total``: tumbling windows that close once the watermark has passed."""
    w = F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def first_decisions(decisions: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key's first row within the watermark; repeats are dropped by state that the watermark clears."""
    return decisions.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def changes_only(readings: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """``key, at, state``: rows whose state differs from the key's row before, in order of time within a trigger.

    What is kept per key is its last state and time; rows older than that are late and dropped.
    """

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, when = held.get if held.exists else (None, None)
        rows = pd.concat(list(pdfs)).sort_values(["at", "state"])
        out = []
        for t, s in zip(rows["at"], rows["state"]):
            if when is not None and t.value // 1000 < when:
                continue
            if last != s:
                out.append((k[0], t, s))
            last, when = s, t.value // 1000
        held.update((last, when))
        yield pd.DataFrame(out, columns=["key", "at", "state"])

    narrow = readings.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(state).cast("string").alias("state"))
    return narrow.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, state string", "last string, at_us bigint", "append", GroupStateTimeout.NoTimeout)


def run_batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off all that is there, batch by batch, and stop; a batch is repeated as a whole if it fails."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
