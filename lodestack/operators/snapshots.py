"""Comparing two states of a product's fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import label_fold, squeeze

# How large a move must be to count as large.
LARGE_PERCENT_POINTS, LARGE_AMOUNT_PERCENT = 2.0, 25.0


def migrate(stored: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """``key, field_id, value, status``: exactly the registry's fields for every key; missing ones are ``NOT_FOUND``, unknown ones dropped.

    ``registry`` is the small table of fields, so the grid of keys and fields is bounded by it.
    """
    keys = stored.select(key).distinct()
    grid = keys.select(key, F.explode(registry.agg(F.collect_list("field_id")).scalar()).alias("field_id"))
    joined = grid.join(stored, [key, "field_id"], "left")
    value = F.coalesce(F.col("value"), F.lit("NOT_FOUND"))
    gone = F.upper(F.trim(value)).isin("", "NOT_FOUND")
    return joined.select(key, "field_id", F.when(gone, F.lit("NOT_FOUND")).otherwise(value).alias("value"), F.when(gone, "not_found").otherwise("found").alias("status"))


def diff_fields(previous: DataFrame, current: DataFrame, key: list[str], state: str = "norm") -> DataFrame:
    """``key..., before, after, kind``: fields that differ: ``appeared``, ``disappeared`` or ``value``.

    Inputs: ``key..., value, norm``. A field that one side does not have, or has as null or
    ``NOT_FOUND``, is absent there. Normal forms are compared where both sides have one, else the
    written values apart from case and spacing.
    """
    form = lambda d: d.select(*key, F.col("value"), F.col(state).alias("s"), F.lower(squeeze(F.col("value"))).alias("said"), (F.col("value") != "NOT_FOUND").alias("has"))
    p, c = form(previous).alias("p"), form(current).alias("c")
    both = p.join(c, key, "full")
    had, has = F.coalesce("p.has", F.lit(False)), F.coalesce("c.has", F.lit(False))
    same = F.when(F.col("p.s").isNotNull() & F.col("c.s").isNotNull(), F.col("p.s") == F.col("c.s")).otherwise(F.col("p.said") == F.col("c.said"))
    kind = F.when(~had & ~has, F.lit(None)).when(~had, "appeared").when(~has, "disappeared").when(same, F.lit(None)).otherwise("value")
    return both.select(*key, F.col("p.value").alias("before"), F.col("c.value").alias("after"), kind.alias("kind")).where("kind IS NOT NULL")


def magnitude(kind, p, c):
    """How far a value moved: percentage points of the lower end, percent of the upper end of an amount, months of a term's upper end."""
    return (
        F.when(kind == "percent", F.bround(c["min"] - p["min"], 4))
        .when((kind == "amount") & (p["max"] != 0), F.bround((c["max"] - p["max"]) / p["max"] * 100, 2))
        .when(kind == "term", F.bround(c["max"] - p["max"], 2))
    )


def significance(kind, size):
    """``large`` beyond the limits of the kind, else ``notable``."""
    large = ((kind == "percent") & (F.abs(size) > LARGE_PERCENT_POINTS)) | ((kind == "amount") & (F.abs(size) > LARGE_AMOUNT_PERCENT))
    return F.when(F.coalesce(large, F.lit(False)), "large").otherwise("notable")


def variant_diff(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, label, change``: labels that moved, went or came between two sets of labelled values.

    Labels are compared by their letters, digits and spaces without case; of a label given twice the last value counts.
    """
    last = lambda d: d.groupBy(key, label_fold(F.col("label")).alias("label")).agg(F.max_by("value", "ord").alias("value"))
    p, c = last(previous).alias("p"), last(current).alias("c")
    both = p.join(c, [key, "label"], "full")
    change = F.when(F.col("c.value").isNull(), "gone").when(F.col("p.value").isNull(), "new").when(F.col("p.value") != F.col("c.value"), "moved")
    return both.select(key, "label", change.alias("change")).where("change IS NOT NULL")


def provenance(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``snapshots`` with ``provenance`` and ``notes``: whether each can be compared with its key's one before.

    ``baseline`` for the first, ``method_changed`` or ``prompt_changed`` where the reading itself is another,
    else ``comparable``; ``notes`` names a new ``edition`` or ``date`` of the document.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    moved = lambda c: ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    cols = ("extraction_method", "prompt_version", "document_edition", "document_date")
    seen = snapshots.withColumns({"__first": first, **{f"__{c}": before(c) for c in cols}})
    kind = F.when(F.col("__first"), "baseline").when(moved("extraction_method"), "method_changed").when(moved("prompt_version"), "prompt_changed").otherwise("comparable")
    notes = F.array_compact(F.array(F.when(moved("document_edition"), F.lit("edition")), F.when(moved("document_date"), F.lit("date"))))
    return seen.withColumn("provenance", kind).withColumn("notes", F.when(F.col("__first"), F.slice(notes, 1, 0)).otherwise(notes)).drop("__first", *[f"__{c}" for c in cols])


def ordered_changes(changes: DataFrame, group: str, registry: DataFrame) -> DataFrame:
    """``changes`` with ``place``: large ones first, then notable and silent ones, each in the registry's order of fields."""
    weight = F.when(F.col("significance") == "large", 0).when(F.col("significance") == "notable", 1).otherwise(2)
    known = changes.join(F.broadcast(registry.select("field_id", "seq_no")), "field_id", "left")  # a row per field
    w = Window.partitionBy(group).orderBy(weight, F.col("seq_no").asc_nulls_last(), "change_id")
    return known.withColumn("place", F.row_number().over(w)).drop("seq_no")


def field_tally(fields: DataFrame, group: str) -> DataFrame:
    """``group, found, total, absent``: how many fields have a value, and the names of those that do not.

    ``fields``: ``group, field_id, value``; a field counts as found if any of its rows has a value. Registries are small.
    """
    has = F.coalesce(~F.upper(F.trim("value")).isin("", "NOT_FOUND"), F.lit(False))
    each = fields.groupBy(group, "field_id").agg(F.max(has).alias("has"))
    return each.groupBy(group).agg(F.count_if("has").alias("found"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~F.col("has"), F.col("field_id")))).alias("absent"))
