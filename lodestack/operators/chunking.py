"""Cutting texts and tables into citable chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1200, 150
# Where a text may be cut, and what must not be cut.
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[։.!?])\s+")
_FIGURES = re.compile("[0-9][0-9.,%  ]*[0-9%]")


def windows(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Windows over a text: each ends at its last paragraph, else sentence, if that is past a third of
    it, never inside a number; the next begins ``overlap`` characters before that end."""
    start, n = 0, len(text)
    while start < n or n == 0:
        end = min(start + most, n)
        if end < n:
            ends = [m.end() for m in _PARAGRAPH.finditer(text, start, end)] or [m.end() for m in _SENTENCE.finditer(text, start, end)]
            if ends and ends[-1] - start > most // 3:
                end = ends[-1]
            # figures around the cut reach back no further than their own characters do
            back = end
            while back > start and text[back - 1] in "0123456789.,%  ":
                back -= 1
            for m in _FIGURES.finditer(text, back):
                if m.start() >= end:
                    break
                if m.end() > end:
                    end = m.start() if m.start() > start else end
                    break
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


_WINDOW_SQL = "start_at int, end_at int, chunk string"


def chunk_texts(texts: DataFrame, keep: list[str], text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``keep, ord, start_at, end_at, chunk``: the trimmed non-empty windows of each text, numbered from 0 per row.

    Null and empty texts give no chunk. A projection by Arrow batch; offsets are those of the untrimmed window.
    """
    n = len(keep)
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep) + ", ord int, " + _WINDOW_SQL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ords, starts, ends, parts = [], [], [], [], []
            for i, t in enumerate(b.column(n).to_pylist()):
                k = 0
                for a, e in windows(t, most, overlap) if t else ():
                    if piece := t[a:e].strip():
                        row.append(i)
                        ords.append(k)
                        starts.append(a)
                        ends.append(e)
                        parts.append(piece)
                        k += 1
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(n)), pa.array(ords, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())], names=[*keep, "ord", "start_at", "end_at", "chunk"])

    return texts.select(*keep, text).mapInArrow(run, schema)


def chunk_pages(pages: DataFrame, sections: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``doc, page, chunk_id, section, start_at, end_at, chunk``: chunks that never leave their section, with an untitled lead-in."""
    first = sections.groupBy("page").agg(F.min("start_at").alias("first"))
    body = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"))
    lead = body.join(first, "page", "left").select("doc", "page", F.lit(None).cast("string").alias("section"), F.lit(0).cast("bigint").alias("from"), F.left("text", F.coalesce(F.col("first").cast("int"), F.length("text"))).alias("span"))
    inside = body.join(sections, "page").select("doc", "page", F.col("title").alias("section"), F.col("start_at").alias("from"), F.substring(F.col("text"), F.col("start_at").cast("int") + 1, (F.col("end_at") - F.col("start_at")).cast("int")).alias("span"))
    spans = lead.unionByName(inside).where(F.length("span") > 0)
    cut = chunk_texts(spans, ["doc", "page", "section", "from"], "span")
    w = Window.partitionBy("doc", "page").orderBy("from", "ord")
    number = F.format_string("%03d", F.row_number().over(w) - 1)
    return cut.select("doc", "page", F.concat_ws("-", F.left(F.col("doc").cast("string"), F.lit(8)), F.concat(F.lit("p"), F.col("page").cast("string")), number).alias("chunk_id"), "section", (F.col("from") + F.col("start_at")).alias("start_at"), (F.col("from") + F.col("end_at")).alias("end_at"), "chunk")


def plausible_table(rows: Column) -> Column:
    """At least two rows, a row of at least two cells, and half of the cells filled."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, F.size)) >= 2) & (F.coalesce(F.try_divide(filled, F.size(cells)), F.lit(0.0)) >= 0.5)


def render_table(rows: Column) -> Column:
    """A table as text: cells joined by bars, rows by line ends."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


def split_table(rows: Column, most: int = MAX_CHARS) -> Column:
    """A long table as row groups that each begin with its header and hold at most ``most`` characters, by a fold over its rows."""
    width = lambda r: F.length(F.array_join(r, " | ", ""))
    header = rows[0]
    start = F.struct(F.slice(F.array(rows), 1, 0).alias("done"), F.array(header).alias("open"), width(header).alias("size"))

    def step(acc: Column, row: Column) -> Column:
        more = width(row) + 1
        full = (acc["size"] + more > most) & (F.size(acc["open"]) > 1)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(header, row)).otherwise(F.concat(acc["open"], F.array(row))).alias("open"),
            F.when(full, width(header) + more).otherwise(acc["size"] + more).alias("size"),
        )

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
