"""Landing zone: fetched bodies in, tables and logs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.urls import cache_key, host_of

#: Largest body that is processed; larger ones are quarantined.
MOST_BYTES = 25 * 1024 * 1024


def read_bodies(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content, length, modificationTime`` of landed files; the size filter is pushed to the listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def content_kind(mime: Column, content: Column) -> Column:
    """``pdf`` or ``html`` where the declared type and the body agree, else NULL."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    html = F.regexp_replace(head, r"^(?:ï»¿)?\s*", "")
    said = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(said.contains("pdf") & F.contains(head, F.lit("%PDF-")), "pdf").when(said.rlike("html|xml") & html.startswith("<"), "html")


def gate_bodies(bodies: DataFrame, mime: str = "content_type", content: str = "content") -> DataFrame:
    """Bodies with their ``kind`` and an ``error`` (``too_large``, ``empty``, ``unexpected_content``) instead of an exception."""
    size = F.length(content)
    kind = content_kind(F.col(mime), F.col(content))
    error = F.when(F.col(content).isNull() | (size == 0), "empty").when(size > MOST_BYTES, "too_large").when(kind.isNull(), "unexpected_content")
    return bodies.select("*", kind.alias("kind"), error.alias("error"), F.sha2(F.col(content), 256).alias("doc_id"))


def unchanged(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` that are not stored yet under their content key: what an incremental run has to do."""
    return new.join(stored.select(*key), key, "left_anti")


def revalidate(fetches: DataFrame, url: str = "source_url", retrieved: str = "retrieved_at", checked: str = "checked_at") -> DataFrame:
    """``url, doc_id, retrieved_at, checked_at``: a body seen again keeps the time it was first retrieved and moves the time it was checked."""
    return fetches.groupBy(F.col(url).alias("url"), "doc_id").agg(F.min(retrieved).alias("retrieved_at"), F.max(checked).alias("checked_at"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` whose longest matching rule does not forbid them. ``rules``: ``host, prefix, allow``, some rows per host; hosts without rules allow all."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)?$", 1)
    asked = urls.withColumns({"host": host_of(F.col("url")), "path": F.when(path == "", "/").otherwise(path)})
    met = asked.join(rules, "host").where(F.startswith(F.col("path"), F.col("prefix")))
    verdict = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(verdict.where("NOT allow").select("url"), "url", "left_anti")


def store_bodies(bodies: DataFrame, path: str) -> None:
    """Append bodies under their cache key."""
    bodies.withColumn("key", cache_key(F.col("url"))).write.mode("append").parquet(path)


def append_snapshots(rows: DataFrame, path: str, partition: str = "bank") -> None:
    """Append snapshot rows, partitioned by a column of few values."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def write_log(events: DataFrame, path: str) -> None:
    """Append events as lines of JSON."""
    events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON back as rows; broken lines are dropped."""
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("e"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("e.*")
