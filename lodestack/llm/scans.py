"""Repair of text from scanned pages: furniture, words cut by line ends, misread words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.boosting import Boost
from lodestack.llm.lookalikes import simple_form
from lodestack.session import cut

#: The most frequent clean words, sent to the workers so that they need not be looked up by a join.
FREQUENT = 100_000
#: How often a clean word must occur, scans included, to be a candidate for replacement.
LEAST_COUNT = 3
#: Pairs that ``by_chance`` gives about. No query samples: classifiers are fitted on all rows.
SAMPLE = 12_000
#: Pages of one document per task group, and pages beyond its ends that it also sees.
PAGES, HALO = 256, 2
#: Verdicts, and kinds of misreading, that are sent to the workers at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

# Marks that join a cut word, and characters at a word's edges that are not part of it.
HYPHENS = "-‐¬­֊"
EDGES = "«»\"'“”„().,;:!?։՝՜՞•…—–[]{}"
# Fixed value: single edits that what ``edits`` finds comes to at most.
EDITS = 3
# Letters that scanners put for digits.
DIGITS = str.maketrans({"O": "0", "o": "0", "О": "0", "о": "0", "օ": "0", "Օ": "0", "l": "1", "I": "1", "|": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "?": "7", "з": "3", "З": "3", "g": "9", "q": "9"})
_NUMERIC = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")


def bare(token: str) -> str:
    """A token as it is looked up: no edge punctuation, one width and composition, lower case."""
    return simple_form(token).strip(EDGES).lower()


def shape(word: str) -> str:
    """A word with its runs of digits masked."""
    return _DIGITS.sub("#", word)


def some(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About ``n`` rows, chosen by a hash of their key, so that the same rows always give the same sample."""
    share = min(1.0, n / max(1, df.count()))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(share * 1_000_000))


def count_words(pages: DataFrame) -> DataFrame:
    """``word, n``: words of pages, those with digits by their shape; pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()

        def flush() -> pa.RecordBatch:
            own: Counter = Counter()
            for t, n in raw.items():
                if w := shape(bare(t)):
                    own[w] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                raw.update((t or "").split())
            if len(raw) > 300_000:
                yield flush()
        yield flush()

    return pages.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def scanned(pages: DataFrame) -> DataFrame:
    """Pages of method ``ocr``, and pages of documents of method ``pdf_text`` that look scanned:
    no line is long and many lines go on in the next one."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    stats = (
        pages.where((F.col("method") == "pdf_text") & F.col("text").isNotNull())
        .select("doc_id", lines.alias("lines"))
        .select("doc_id", F.array_max(F.transform("lines", F.length)).alias("longest"), F.size("lines").alias("n"), F.size(F.filter("lines", lambda x: ~x.rlike(r"[.։:;!?%»0-9]\s*$"))).alias("open"))
        .groupBy("doc_id")
        .agg(F.max("longest").alias("longest"), F.sum("n").alias("n"), F.sum("open").alias("open"))
    )
    scans = stats.where("longest < 110 AND n >= 4 AND open > 0.3 * n").select("doc_id")
    return pages.where("method = 'ocr' AND text IS NOT NULL").unionByName(pages.where("method = 'pdf_text' AND ocr_confidence IS NULL AND text IS NOT NULL").join(scans, "doc_id", "left_semi"))


# ---------------------------------------------------------------- furniture


def edge_key(line: str) -> str:
    """A line at a page's edge as it recurs: digits and letters that stand for digits masked, case and spacing dropped."""
    s = simple_form(line).lower()
    out = []
    for t in s.split():
        if _NUMERIC.search(t) or t in ("l", "i", "o", "о"):
            t = _DIGITS.sub("#", t.translate(DIGITS))
        out.append(t)
    return " ".join(out)


def page_number(line: str) -> int | None:
    """The number a page-number line gives; None for other lines."""
    s = simple_form(line).strip()
    m = re.fullmatch(r"[^\w]*(?:[^\W\d_]{1,5}\.?\s+)?[\[(·\-–— ]*([0-9OoОоlI|SBbZ?]{1,4})(?:\s*/\s*[0-9OoОоlI|SBbZ?]{1,4})?[\])·\-–— .]*", s)
    if m:
        digits = m.group(1).translate(DIGITS)
        if digits.isdigit() and not s.rstrip().endswith("%"):
            return int(digits)
    r = re.fullmatch(r"[ivxl]{1,6}", s.lower())
    if r:
        values, total = {"i": 1, "v": 5, "x": 10, "l": 50}, 0
        n = [values[c] for c in s.lower()]
        for a, b in zip(n, [*n[1:], 0]):
            total += -a if a < b else a
        return total
    return None


def pairs_of(text: str) -> set[str]:
    """A string's pairs of neighbouring characters."""
    return {text[i : i + 2] for i in range(len(text) - 1)}


def dice(a: set[str], b: set[str]) -> float:
    """Likeness of two strings by their character pairs."""
    return 2 * len(a & b) / max(1, len(a) + len(b))


_TRIM = re.compile(r"^[# ]+|[# ]+$")


class Edge:
    """A line at a page's edge, with what it is compared by; read once, compared with several pages."""

    def __init__(self, no: int, line: str):
        self.no, self.line = no, line
        self.key, self.number = _TRIM.sub("", edge_key(line)), page_number(line)
        self.pairs = pairs_of(self.key)


def pair_features(edge: Edge, bank: set[str], page: int, others: list[tuple[int, Edge]]) -> list[float]:
    """A line against the lines at its place on neighbouring pages: likeness, whether numbers step
    with the pages; and by itself: likeness to the bank's name, length, share of digits."""
    key, number, line = edge.key, edge.number, edge.line
    like = max(((1.0 if key == o.key else dice(edge.pairs, o.pairs)) if len(key) > 3 else 0.0 for _, o in others), default=0.0)
    steps = [1.0 if o.number - number == p - page else 0.0 for p, o in others if o.number is not None and number is not None and p != page]
    step = max(steps, default=-1.0 if number is None else 0.0)
    dressed = float(bool(re.match(r"\s*(?:[\[·]|[-–—] ?\S{1,4} ?[-–—]\s*$|[^\W\d_]{2,5}\.? )", line))) if number is not None else 0.0
    return [like, step, dice(edge.pairs, bank), float(len(key)), float(number is not None), float(number == page), dressed, float(line[:1] == " ")]


#: Lines that may be furniture (first, last, second) and lines that never are (second-last, third).
SLOTS = {0: 0, 1: -1, 2: 1, 3: -2, 4: 2}
_PAGE_SQL = "page_id bigint, doc_id string, slot int, line_no int, line string, features array<double>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by document, block and number in; for the first three and last two lines of each page
    its line-pair features out. Two pages to either side are in memory."""
    window: list[tuple] = []
    at = None

    def slots(text: str) -> dict[int, Edge]:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
        few = len(lines) < 6
        return {slot: Edge(*lines[k]) for slot, k in SLOTS.items() if (slot == 0 and lines) or (slot == 1 and len(lines) > 1) or (slot > 1 and not few)}

    def emit(i: int) -> list[tuple]:
        pid, doc, bank, no, halo, own = window[i]
        if halo:
            return []
        near = [w for j, w in enumerate(window) if j != i and w[3] != no and abs(w[3] - no) <= HALO]
        return [(pid, doc, slot, e.no, e.line, pair_features(e, bank, no, [(w[3], w[5][slot]) for w in near if slot in w[5]])) for slot, e in own.items()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "doc_id", "slot", "line_no", "line", "features"])

    done = 0
    for b in batches:
        rows: list[tuple] = []
        for doc, block, no, pid, bank, halo, text in zip(*(c.to_pylist() for c in b.columns)):
            if (doc, block) != at:
                for i in range(done, len(window)):
                    rows += emit(i)
                at, window, done = (doc, block), [], 0
            window.append((pid, doc, pairs_of((bank or "").lower()), no, halo, slots(text)))
            while done < len(window) and no - window[done][3] > HALO:
                rows += emit(done)
                done += 1
            while done and window[done - 1][3] < no and window[0][3] < window[min(done, len(window) - 1)][3] - HALO:
                window.pop(0)
                done -= 1
        if rows:
            yield pack(rows)
    rows = []
    for i in range(done, len(window)):
        rows += emit(i)
    if rows:
        yield pack(rows)


def _blocks(pages: DataFrame) -> DataFrame:
    """Pages with the block of their document they belong to, and again where a neighbouring block sees them."""
    block, place = F.expr(f"page_no div {PAGES}"), F.expr(f"pmod(page_no, {PAGES})")
    own = F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")))
    less = F.when(place < HALO, F.array(F.struct((block - 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.slice(own, 1, 0))
    more = F.when(place >= PAGES - HALO, F.array(F.struct((block + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.slice(own, 1, 0))
    return pages.withColumn("b", F.explode(F.concat(own, less, more))).withColumn("block", F.col("b.block")).withColumn("halo", F.col("b.halo"))


def furniture(pages: DataFrame) -> DataFrame:
    """``page_id, line_no`` of running headers and page numbers.

    Only a page's first and last line can be one, and the second if the first is. A boosted
    classifier on line pairs decides; it is fitted on all lines that speak for themselves:
    such lines that recur, or whose number steps with the pages, against third and
    second-last lines, which are never furniture. All are fitted once more as if their
    page stood alone.
    """
    sent = _blocks(pages).select("doc_id", "block", "page_no", "page_id", "bank", "halo", "text").repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "page_no", "page_id")
    key = F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#")
    edges = sent.mapInArrow(_edges, _PAGE_SQL).withColumn("key", key)
    edges = cut(edges)
    inner = pages.select(F.explode(F.filter(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x, i: i > 1)).alias("line")).where(F.length("line") < 70).select(key.alias("key")).groupBy("key").agg(F.count("*").alias("inside"))
    ends = edges.where("slot < 3").groupBy("key").agg(F.count("*").alias("ends"), F.count_if(F.col("slot") == 1).alias("lasts"))
    known = edges.join(ends, "key", "left").join(inner, "key", "left")
    # how often the line stands inside pages, the line at hand left out
    inside = F.greatest(F.coalesce("inside", F.lit(0)) - F.coalesce("lasts", F.lit(0)) - F.when(F.col("slot") > 2, 1).otherwise(0), F.lit(0))
    rows = known.select("page_id", "slot", "line_no", F.concat("features", F.array(F.log1p(F.coalesce("ends", F.lit(0)) - F.when(F.col("slot") < 3, 1).otherwise(0)), F.log1p(inside), F.col("slot").cast("double") % 2)).alias("x"))
    rows = cut(rows)
    like, step = F.col("x")[0], F.col("x")[1]
    good = (F.col("slot") < 3) & ((like >= 0.95) | ((step == 1) & (F.col("slot") < 2)))
    alone = F.transform("x", lambda v, i: F.when((i == 0) | ((i == 1) & (v > 0)), 0.0).otherwise(v))
    # both kinds with and without neighbours, so that having none says nothing
    train = rows.where(good | (F.col("slot") > 2)).select(F.explode(F.array("x", alone)).alias("x"), (F.col("slot") < 3).cast("double").alias("y"))
    model = Boost().fit_rows(train, 11)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
                # at a page's head figures may be a value of the text; there their number has to step
                bare_value = (x[:, 4] == 1) & (x[:, 1] != 1) & (np.asarray(b.column(3)) != 1)
                ok = pa.array((shared.value.probability(x) > 0.5) & ~bare_value)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1, 3)], names=["page_id", "line_no", "slot"])

    judged = rows.where("slot < 3").select("page_id", "line_no", "x", "slot").mapInArrow(run, "page_id bigint, line_no int, slot int")
    # three lines a page at most; a second line counts only under a first one
    held = judged.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "slot")).alias("f"), F.max((F.col("slot") == 0).cast("int")).alias("top"))
    kept = F.filter("f", lambda x: (x["slot"] != 2) | (F.col("top") == 1))
    return held.select("page_id", F.explode(kept).alias("x")).select("page_id", F.col("x.line_no").alias("line_no")).distinct()


# ---------------------------------------------------------------- words and line ends

_TOKEN_SQL = "kind string, page_id bigint, line_no int, word_no int, a string, b string, mark string, page_b bigint, line_b int"


def _walk(batches: Iterator[pa.RecordBatch], frequent: frozenset) -> Iterator[pa.RecordBatch]:
    """Pages sorted by document, block and number, with their furniture, in. Out come ``end`` rows, a word
    with a mark at a line's end and the first word of the next text line, be it on the next page;
    ``mark`` rows, marks that are no words; and ``word`` rows, every other word that is not among the
    frequent ones."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
    names = ["kind", "page_id", "line_no", "word_no", "a", "b", "mark", "page_b", "line_b"]
    at, pages_open = None, []  # open ends of the pages with the last number seen
    seen: dict[str, str | None] = {}  # tokens as they stand: None for frequent words, "" for marks, else the word

    def look(w: str) -> str | None:
        if len(seen) > 500_000:
            seen.clear()
        own = bare(w)
        seen[w] = got = "" if stray(w) else None if own in frequent else own or " "
        return got

    for batch in batches:
        out: list[tuple] = []
        for doc, block, no, pid, halo, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if (doc, block) != at:
                at, pages_open = (doc, block), []
            skip = set(gone or ())
            lines = [(i, x.split()) for i, x in enumerate(text.split("\n")) if i not in skip and x.strip()]
            if not lines:
                continue
            first = lines[0]
            for e in pages_open:
                if e[0] < no and not e[1]:
                    out.append(("end", *e[2], first[1][0], e[3], pid, first[0]))
            pages_open = [e for e in pages_open if e[0] == no]
            for k, (i, ws) in enumerate(lines):
                for j, w in enumerate(ws):
                    if j == len(ws) - 1 and len(w) > 1 and w[-1] in HYPHENS and (_LETTER.search(w[:-1]) or _NUMERIC.search(w)):
                        if k + 1 < len(lines):
                            if not halo:
                                out.append(("end", pid, i, j, w, lines[k + 1][1][0], w[-1], pid, lines[k + 1][0]))
                        else:
                            pages_open.append((no, halo, (pid, i, j, w), w[-1]))
                    elif not halo:
                        own = seen[w] if w in seen else look(w)
                        if own:
                            out.append(("word", pid, i, j, w, own.strip(), None, None, None))
                        elif own is not None:
                            out.append(("mark", pid, i, j, w, None, None, None, None))
            if len(out) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _join_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spellings of both pieces: as one word, with a hyphen of its own, and each by itself."""
    for b in batches:
        a, c = b.column(3).to_pylist(), b.column(4).to_pylist()
        first = [bare(x[:-1]) for x in a]
        second = [bare(x) for x in c]
        whole = [shape(x + y) for x, y in zip(first, second)]
        hyphened = [shape(f"{x}-{y}") for x, y in zip(first, second)]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, pa.string()) for v in (whole, hyphened, [shape(x) for x in first], [shape(x) for x in second]))], names=[*b.schema.names, "whole", "hyphened", "first", "second"])


def splits(ends: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``ends`` with ``is_split``: whether the two pieces are one word that the line end cut.

    ``vocabulary`` has clean words and, with their hyphen, words seen with one inside a line.
    A boosted classifier on the line pair decides; it is fitted on all pairs of which one
    spelling only is known.
    """
    spelt = ends.select("page_id", "line_no", "word_no", "a", "b", "mark", "page_b", "line_b").mapInArrow(_join_features, "page_id bigint, line_no int, word_no int, a string, b string, mark string, page_b bigint, line_b int, whole string, hyphened string, first string, second string")
    for name in ("whole", "hyphened", "first", "second"):
        spelt = spelt.join(vocabulary.select(F.col("word").alias(name), F.log1p("n").alias(f"n_{name}")), name, "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lower = F.col("b").rlike(r"^\p{Ll}").cast("double")
    x = F.array(num("n_whole"), num("n_hyphened"), num("n_first"), num("n_second"), (F.col("mark") == "-").cast("double"), F.length("first").cast("double"), F.length("second").cast("double"), lower, F.col("first").contains("#").cast("double"), F.col("second").contains("#").cast("double"))
    rows = cut(spelt.select("page_id", "line_no", "word_no", "a", "b", "page_b", "line_b", x.alias("x")))
    one, two = F.col("x")[0], F.col("x")[1]
    hidden = F.transform("x", lambda v, i: F.when(i < 2, 0.0).otherwise(v))
    train = rows.where(((one > 0) & (two == 0)) | ((one == 0) & (two > 0))).select(F.explode(F.array("x", hidden)).alias("x"), (one > 0).cast("double").alias("y"))
    model = Boost()
    model.base = 2.0  # without such pairs
    model.fit_rows(train, 10)
    shared = ends.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = shared.value.probability(np.asarray(b.column(7).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(p > 0.5)], names=[*b.schema.names[:7], "is_split"])

    return rows.mapInArrow(run, "page_id bigint, line_no int, word_no int, a string, b string, page_b bigint, line_b int, is_split boolean")


# ---------------------------------------------------------------- misread words


def gram_keys(word: str, query: bool) -> list[str]:
    """Positional q-grams by which a word meets its candidates.

    Characters at the start, in the middle and at the end, two to four of them so that a
    misread place leaves one of the three whole, together with the candidate's length. A query
    asks for neighbouring lengths too. Short words also meet by masks: the word with each
    character, and each pair of characters, left open.
    """
    n = len(word)
    out = set()
    if n <= 5:
        out = {f"m{word[:i]}_{word[i + 1:]}" for i in range(n)}
        if query and n > 1:
            out |= {f"m{word[:i]}_{word[i + 2:]}" for i in range(n - 1)}
        if n > 1:
            out |= {f"m{word[:i]}_{word[i:]}" for i in range(n + 1)} if not query else set()
    for m in (n - 1, n, n + 1) if query else (n,):
        if m >= 5:
            q = min(4, (m - 1) // 2)
            out.add(f"s{m}{word[:q]}")
            out.add(f"e{m}{word[-q:]}")
            if m >= 8:
                out.add(f"c{m}{word[3:7]}")
    return sorted(out)


def edits(seen: str, meant: str) -> list[tuple[str, str]] | None:
    """What was read for what, at one or two places; None if the words differ more."""
    a, b = 0, 0
    while a < min(len(seen), len(meant)) and seen[a] == meant[a]:
        a += 1
    while b < min(len(seen), len(meant)) - a and seen[-1 - b] == meant[-1 - b]:
        b += 1
    x, y = seen[a : len(seen) - b], meant[a : len(meant) - b]
    if len(x) <= 2 and len(y) <= 2 and (len(x) != 2 or len(y) != 2):
        return [(x, y)]
    if len(x) == len(y):
        got = [(p, q) for p, q in zip(x, y) if p != q]
        return got if len(got) <= 2 else None
    if abs(len(x) - len(y)) == 1 and min(len(x), len(y)) >= 2:
        # one place at each end of what differs: a single character and a pair
        if len(x) > len(y):
            if x[2:] and x[2:-1] == y[1:-1]:
                return [(x[:2], y[:1]), (x[-1:], y[-1:])]
            if x[1:-2] == y[1:-1]:
                return [(x[:1], y[:1]), (x[-2:], y[-1:])]
        elif y[2:-1] == x[1:-1]:
            return [(x[:1], y[:2]), (x[-1:], y[-1:])]
    return None


def places(seen: str, meant: str, shared: int) -> tuple[list[str], list[float]] | None:
    """What was read for what, and the features of the pair that do not depend on how likely that is."""
    ops = edits(seen, meant)
    if ops is None:
        return None
    odd = any(c.isdigit() for c in seen) and not any(c.isdigit() for c in meant)
    return [f"{x}\t{y}" for x, y in ops], [float(len(seen)), float(len(seen) - len(meant)), float(shared), float(odd), float(sum(len(x) for x, _ in ops)), float(seen.isalpha())]


_KEY_SQL = "word string, n bigint, key string"


def _keyed(query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ns = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys = [gram_keys(w, query) for w in words]
            reps = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(words, object), reps).tolist(), pa.string()), pa.array(np.repeat(np.array(ns, np.int64), reps)), pa.array([x for k in keys for x in k], pa.string())], names=["word", "n", "key"])

    return run


def index_of(vocabulary: DataFrame) -> DataFrame:
    """``meant, n_meant, key``: the q-grams of vocabulary words that may replace others."""
    return vocabulary.where(F.col("n") >= LEAST_COUNT).where(~F.col("word").contains("#")).mapInArrow(_keyed(False), _KEY_SQL).select(F.col("word").alias("meant"), F.col("n").alias("n_meant"), "key")


def candidates(words: DataFrame, index: DataFrame) -> DataFrame:
    """``word, n, meant, n_meant, shared, ops, own``: vocabulary words that share q-grams with each word, by an
    inverted join, and differ from it at one or two places."""
    asked = words.select("word", "n").mapInArrow(_keyed(True), _KEY_SQL)
    # pairs of more than three edits differ at more places than ``edits`` has; they go before they are shuffled
    near = (F.col("word") != F.col("meant")) & (F.levenshtein("word", "meant", EDITS) >= 0)
    met = asked.join(index, "key").where(near).groupBy("word", "meant").agg(F.max("n").alias("n"), F.max("n_meant").alias("n_meant"), F.count("*").alias("shared"))
    return met.select("word", "meant", "n", "n_meant", "shared").mapInArrow(_close, _CLOSE_SQL)


_CLOSE_SQL = "word string, meant string, n bigint, n_meant bigint, shared bigint, ops array<string>, own array<double>"


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that differ at one or two places, with those and their own features."""
    for b in batches:
        got = [places(w, m, k) for w, m, k in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)))]
        keep = pa.array([x is not None for x in got], pa.bool_())
        ops, own = pa.array([x[0] for x in got if x], pa.list_(pa.string())), pa.array([x[1] for x in got if x], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in b.columns), ops, own], names=["word", "meant", "n", "n_meant", "shared", "ops", "own"])


def by_chance(chance: DataFrame) -> DataFrame:
    """About ``SAMPLE`` close pairs of clean rare words with words they are like by chance, of any script in
    proportion: a look at them; ``verdicts`` is fitted on all."""
    close = cut(chance.select("word", "meant", "n", "n_meant", "shared").mapInArrow(_close, _CLOSE_SQL))
    return some(close, SAMPLE, "word", "meant").orderBy("word", "meant")


def confusions(pairs: DataFrame, chance: DataFrame) -> DataFrame:
    """``op, noisy, ratio``: how often characters are misread for others, and how much likelier than by chance.

    Learned from words out of the vocabulary that have one close candidate, against clean rare words
    that have one by chance; all words and all kinds of misreading are counted."""

    def learned(df: DataFrame, weight: str, name: str) -> DataFrame:
        one = df.where("n_meant >= 10 AND size(ops) = 1").select("word", "n", "n_meant", F.col("ops")[0].alias("op"))
        best = one.groupBy("word").agg(F.max_by(F.struct("op", "n"), F.struct("n_meant", "op")).alias("b"))
        return best.groupBy(F.col("b.op").alias("op")).agg(F.sum(F.expr(f"CAST({weight} AS DECIMAL(18, 6))")).cast("double").alias(name))  # sums that no order changes

    both = cut(learned(pairs, "log2(1 + b.n)", "noisy").join(learned(chance, "1", "chance"), "op", "full").select("op", F.coalesce("noisy", F.lit(0.0)).alias("noisy"), F.coalesce("chance", F.lit(0.0)).alias("chance")))
    noisy, chances = (x or 0.0 for x in both.agg(*(F.sum(F.col(c).cast("decimal(24, 6)")).cast("double") for c in ("noisy", "chance"))).first())
    return both.select("op", "noisy", F.log(((F.col("noisy") + 0.02) / (noisy + 1)) / ((F.col("chance") + 0.3) / (chances + 1))).alias("ratio"))


#: Likelihood of kinds of misreading that were never seen.
UNKNOWN = -2.0


def weighed(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``word, meant, x``: the features of pairs, with how likely their misreadings are."""
    pairs = pairs.withColumn("op", F.col("ops")[0]).withColumn("op2", F.coalesce(F.get("ops", F.lit(1)), F.col("ops")[0]))
    for op, r in (("op", "r"), ("op2", "r2")):
        pairs = pairs.join(ratios.select(F.col("op").alias(op), F.col("ratio").alias(r)), op, "left").withColumn(r, F.coalesce(r, F.lit(UNKNOWN)))
    n, own = F.size("ops"), lambda i: F.col("own")[i]
    total = F.col("r") + F.when(n > 1, F.col("r2")).otherwise(0.0)
    return pairs.select("word", "meant", F.array(total, F.least("r", "r2"), n.cast("double"), F.log1p("n_meant"), *(own(i) for i in range(6))).alias("x"))


class Misreader:
    """Makes misreadings of words: a word always the same one, drawn from those of its characters by how frequent they are."""

    def __init__(self, ops: list[tuple[str, str, float]]):
        by: dict[str, tuple[list[str], list[float]]] = {}
        for x, y, n in sorted(ops):
            seen, upto = by.setdefault(y, ([], []))
            seen.append(x)
            upto.append(n + (upto[-1] if upto else 0.0))
        self.by = by

    def of(self, word: str) -> str | None:
        held = sorted({"", *word, *(word[i : i + 2] for i in range(len(word) - 1))} & self.by.keys())
        if not held:
            return None
        h = hashlib.blake2b(word.encode(), digest_size=12).digest()
        u, v, w = (int.from_bytes(h[i : i + 4], "little") / 2**32 for i in (0, 4, 8))
        upto = np.cumsum([self.by[y][1][-1] for y in held])
        y = held[int(np.searchsorted(upto, u * upto[-1], side="right"))]
        seen, upto = self.by[y]
        x = seen[int(np.searchsorted(upto, v * upto[-1], side="right"))]
        at = word.find(y) if y else int(w * (len(word) + 1))
        return word[:at] + x + word[at + len(y) :]


def misreadings(vocabulary: DataFrame, learned: DataFrame) -> DataFrame:
    """Pairs as of ``candidates``: a misreading of each clean word, of the kinds ``learned`` to be likelier than by chance."""
    ops = learned.where("noisy > 0 AND ratio > 0").select("op", "noisy").toArrow()
    shared = vocabulary.sparkSession.sparkContext.broadcast(Misreader([(*o.split("\t"), n) for o, n in zip(*(c.to_pylist() for c in ops.columns))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, m, 1, n, len(set(gram_keys(s, True)) & set(gram_keys(m, False)))) for m, n in zip(*(c.to_pylist() for c in b.columns)) if (s := shared.value.of(m)) is not None and s != m]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["word", "meant", "n", "n_meant", "shared"])

    clean = vocabulary.where(F.col("n") >= LEAST_COUNT).where(~F.col("word").contains("#")).select("word", "n")
    return clean.mapInArrow(lambda it: _close(run(it)), _CLOSE_SQL)


def verdicts(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, meant, p``: the best replacement of each unknown word and how likely it is one.

    Ranking is by a boosted classifier: pairs of unknown words with candidates against pairs
    of clean words that occur once, which are right as they stand. It is fitted on all of the
    latter and, for the former, on a misreading made of each clean word as learned, both kinds with
    the same weight. What is sent to the workers has as many rows as characters are read for others.
    """
    rare = vocabulary.where("n = 1").where(~F.col("word").contains("#")).where(F.length("word") > 2)
    index = cut(index_of(vocabulary))
    pairs, chance = cut(candidates(unknown, index)), cut(candidates(rare, index))
    learned = cut(confusions(pairs, chance))
    ratios = learned.select("op", "ratio")
    ratios = F.broadcast(ratios) if learned.count() <= BROADCAST_ROWS else ratios
    one = lambda df, y: weighed(df, ratios).select("x", F.lit(y).alias("y"))
    train = cut(one(misreadings(vocabulary, learned), 1.0).unionByName(one(chance, 0.0)))
    model = Boost(rounds=80).fit_rows(train, 10, even=True)
    shared = unknown.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, 10)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(shared.value.probability(x)), pa.array(x[:, 0] + 0.3 * x[:, 3])], names=["word", "meant", "p", "gain"])

    scored = weighed(pairs, ratios).mapInArrow(run, "word string, meant string, p double, gain double")
    return scored.groupBy("word").agg(F.max_by(F.struct("meant", "p"), F.struct("p", "gain", "meant")).alias("b")).select("word", "b.meant", "b.p")


_PLAIN = set("-–—•·/%֏$€₽&+*«»…") | set(EDGES)


def stray(token: str) -> bool:
    """A mark that is no word: no letter, no digit, and not one that texts have on their own."""
    t = simple_form(token)
    return bool(t) and not any(c.isalnum() for c in t) and not all(c in _PLAIN for c in t)


def number_reading(token: str) -> tuple[str, str | None, bool] | None:
    """``own, after, sure`` of a token that may be a number once letters that stand for digits are read as such: its
    shape as it stands, the shape it would have (None if the whole is a plain number), and whether
    its own shape, be it known, does not vouch for it. None for other tokens."""
    t = simple_form(token).strip(EDGES.replace("?", ""))
    t = t.rstrip("?") if t[:-1].isalpha() else t
    core = t.replace("°/o", "%").replace("°/о", "%").replace("%o", "%")
    head = re.match(r"[0-9A-Za-zОоЗзօՕ|?.,%]+", core)
    if not head:
        return None
    body, rest = head.group(), core[head.end() :]
    if not (_NUMERIC.search(body) or "%" in body):
        return None
    fixed = body.translate(DIGITS)
    if (fixed == body and core == t) or not re.fullmatch(r"[0-9]+(?:[.,][0-9]+)*%?", fixed.strip(".,")):
        return None
    plain = not rest or rest[0] in "-֊‐"
    return shape(t.strip(EDGES).lower()), None if plain else shape(fixed + rest).strip(EDGES).lower(), "?" in t


def misread_number(token: str, known: frozenset | set) -> bool:
    """Whether a token is a misread number: its own shape is not among the known ones, and what it would be read as is a number or of a known shape."""
    got = number_reading(token)
    return got is not None and (got[2] or got[0] not in known) and (got[1] is None or got[1] in known)


_LONE = re.compile(r"(?<![0-9])[0134678](?![0-9])")


def letters_with_digit(word: str, known: frozenset) -> bool:
    """A word of letters in which lone digits stand where letters belong, in a shape no clean word has."""
    letters = len(_LETTER.findall(word))
    lone = len(_LONE.findall(word))
    return letters >= 3 and 0 < lone <= 2 and lone == len(_NUMERIC.findall(word)) and word.replace("-", "").isalnum() and shape(word) not in known and not re.search(r"(?:^|-)[0-9](?:-|$)", word)


def _shapes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Types with the shapes that decide whether they are misread numbers or words: three at most."""
    for b in batches:
        out = []
        for a, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = number_reading(a)
            out.append(sorted({x for x in (shape(w), *(got[:2] if got else ())) if x}))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=["a", "word", "n", "shapes"])


def _by_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Types with those of their shapes that are known in; how each is judged out."""
    for b in batches:
        kind = []
        for a, w, known in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            shapes = set(known or ())
            kind.append("number" if misread_number(a, shapes) else "digit" if letters_with_digit(w, shapes) else "ask" if _LETTER.search(w) and not re.fullmatch(r"[\d.,/%]+", w) else "")
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kind, pa.string())], names=["a", "word", "n", "verdict"])


def fixed_number(token: str) -> str:
    """A misread number with digits for the letters that stand for them."""
    core = token.strip(EDGES.replace("?", ""))
    at = token.find(core)
    head = re.match(r"[0-9A-Za-zОоЗзօՕ|?.,%°/]+", core)
    body = (head.group() if head else core).replace("°/o", "%").replace("°/о", "%")
    return token[:at] + body.translate(DIGITS) + core[head.end() if head else len(core) :] + token[at + len(core) :]


_LETTER_FOR = str.maketrans({"0": "o", "1": "l", "3": "з", "4": "ч", "6": "б"})


def in_place(token: str, meant: str | None) -> str:
    """A replacement with the token's own edge punctuation and capitals; without one, digits become the letters they stand for."""
    core = token.strip(EDGES)
    at = token.find(core)
    new = core.translate(_LETTER_FOR) if meant is None else meant.upper() if len(core) > 1 and core.isupper() else meant[:1].upper() + meant[1:] if core[:1].isupper() or core[:1].isdigit() and core[1:2].isupper() else meant
    return token[:at] + new + token[at + len(core) :]


def find_defects(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, word_no, defect`` of scanned pages, as ``repairs`` finds them."""
    return repairs(pages).select("page_id", "line_no", "word_no", "defect").distinct()


_PARAGRAPH_SQL = "doc_id string, block bigint, paragraph int, page_id bigint, text string, continues boolean"
_INDENT = re.compile(r"^(?: {2,}|\t)")
#: A line of less than this share of the page's longest line ends its paragraph.
SHORT_LINE = 0.6
_ITEM = re.compile(r"^\s*[•\-–—] ")


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by document, block and number, with their repairs, in; paragraphs out."""
    at, open_, number, last_no = None, None, 0, None
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    names = ["doc_id", "block", "paragraph", "page_id", "text", "continues"]

    def close(out: list, more: bool = False) -> None:
        nonlocal open_, number
        if open_ and open_[1].strip():
            out.append((*at, number, open_[0], open_[1].strip(), more))
            number += 1
        open_ = None

    for batch in batches:
        out: list[tuple] = []
        for doc, block, no, pid, text, fixes in zip(*(c.to_pylist() for c in batch.columns)):
            if (doc, block) != at:
                close(out, at is not None and at[0] == doc)
                at, number, last_no = (doc, block), 0, None
            if no == last_no:
                continue  # a page stored twice is read once
            last_no = no
            by: dict[int, dict[int, tuple]] = {}
            for f in fixes or ():
                by.setdefault(f["line_no"], {})[f["word_no"]] = (f["defect"], f["meant"])
            lines = text.split("\n")
            width = max(map(len, lines))
            for i, line in enumerate(lines):
                own = by.get(i, {})
                if own.get(-1, ("",))[0] == "furniture":
                    continue
                if not line.strip():
                    close(out)
                    continue
                if _INDENT.match(line) or _ITEM.match(line):
                    close(out)
                words, glue = [], False
                for j, w in enumerate(line.split()):
                    what, meant = own.get(j, ("", None))
                    if what == "split":
                        w, glue = w[:-1], True
                    elif what == "misread":
                        w = meant
                    if w:
                        words.append(w)
                glue = glue or bool(words) and len(words[-1]) > 1 and words[-1][-1] in HYPHENS
                piece = " ".join(words)
                if open_ is None:
                    open_ = (pid, piece, glue)
                else:
                    open_ = (open_[0], open_[1] + ("" if open_[2] else " ") + piece, glue)
                if len(line) < SHORT_LINE * width and not glue:
                    close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    out = []
    close(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def paragraphs(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, block, paragraph, page_id, text, continues``: scanned documents as readable paragraphs.

    ``found`` is what ``repairs`` gave for ``pages``. Furniture is out, cut words are whole, misread
    ones replaced, stray marks gone; lines run on until a blank line, an indent, a list item or a line
    much shorter than the page's longest, over page ends too. A paragraph at the end of a block of ``PAGES`` pages that may go on in the next
    says so. Of a page stored twice the first is read.
    """
    per_page = found.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "word_no", "defect", "meant")).alias("fixes"))  # a page's own places
    scans = scanned(pages).select("doc_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), "page_id", "text")
    sent = scans.join(per_page, "page_id", "left").select("doc_id", F.expr(f"page_no div {PAGES}").alias("block"), "page_no", "page_id", "text", "fixes")
    return sent.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "page_no", "page_id").mapInArrow(_paragraphs, _PARAGRAPH_SQL)


def repairs(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, word_no, defect, meant`` of scanned pages: ``furniture``, ``split`` and ``misread``.

    ``meant`` is what a misread word should read, empty for a stray mark, null for the rest.

    ``pages``: ``page_id, doc_id, bank, page_no, text, method, ocr_confidence``, scanned and others;
    the others give the vocabulary.

    Defined cases: null and empty texts have no defects; pages stored twice are each reported,
    and both go on in the next page; documents of one page are judged by the corpus alone;
    without clean pages nothing is misread but marks and numbers; no rows give no rows.

    How it scales: documents are cut into blocks of ``PAGES`` pages with ``HALO`` more at their
    ends and stream by in order. Only words outside the ``FREQUENT`` most frequent leave a
    page as rows; they meet the vocabulary, and their types its q-gram index, in joins. What is
    sent to the workers is of bounded size: frequent words, classifiers, character confusions.
    """
    spark = pages.sparkSession
    scans = cut(scanned(pages).select("page_id", "doc_id", "bank", F.coalesce("page_no", F.lit(0)).alias("page_no"), "text"))
    clean = pages.join(scans.select("page_id"), "page_id", "left_anti").where(F.col("text").isNotNull())
    vocabulary = cut(count_words(clean))
    top = vocabulary.where("n >= 3").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow().column(0).to_pylist()
    frequent = spark.sparkContext.broadcast(frozenset(top))

    gone = furniture(scans)
    gone = cut(gone)
    # a page has three such lines at most
    lists = gone.groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    sent = _blocks(scans.join(lists, "page_id", "left")).select("doc_id", "block", "page_no", "page_id", "halo", "text", "gone")
    ordered = sent.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "page_no", "page_id")
    walked = cut(ordered.mapInArrow(lambda it: _walk(it, frequent.value), _TOKEN_SQL))
    words = walked.where("kind = 'word'").select("page_id", "line_no", "word_no", "a", F.col("b").alias("word"))

    # scans themselves may misread a hyphenated word: their spellings tell splits only
    hyphened = words.where(F.col("word").rlike(r"[^\W\d_]-[^\W\d_]")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    both = cut(vocabulary.unionByName(hyphened).groupBy("word").agg(F.sum("n").alias("n")))
    ends = cut(splits(walked.where("kind = 'end'"), both))
    split = ends.where("is_split").select("page_id", "line_no", "word_no").distinct()
    second = ends.select(F.col("page_b").alias("page_id"), F.col("line_b").alias("line_no"), F.lit(0).alias("word_no")).distinct()

    # words of their own that the vocabulary does not know
    masked = F.regexp_replace("word", "[0-9]+", "#")
    free = words.join(second, ["page_id", "line_no", "word_no"], "left_anti").withColumn("shape", masked)
    odd = cut(free.join(vocabulary.select(F.col("word").alias("shape")), "shape", "left_anti"))
    types = cut(odd.groupBy("a", "word").agg(F.count("*").alias("n")))
    # the shapes that decide about numbers and words with digits are looked up by a join, each once
    asked_shapes = cut(types.mapInArrow(_shapes_of, "a string, word string, n bigint, shapes array<string>"))
    clean_shapes = vocabulary.where(F.col("word").contains("#") & (F.col("n") >= LEAST_COUNT)).select(F.col("word").alias("shape"))
    met = asked_shapes.select("a", "word", F.explode("shapes").alias("shape")).join(clean_shapes, "shape").groupBy("a", "word").agg(F.collect_set("shape").alias("known"))
    formed = cut(asked_shapes.join(met, ["a", "word"], "left").select("a", "word", "n", "known").mapInArrow(_by_form, "a string, word string, n bigint, verdict string"))

    # clean words with how often they occur in scans too; of the frequent ones, which are candidates anyway, scans are not counted
    read = words.groupBy(masked.alias("word")).agg(F.count("*").alias("read"))
    counted = cut(vocabulary.join(read, "word", "left").select("word", (F.col("n") + F.coalesce("read", F.lit(0))).alias("n")))

    asked = formed.where("verdict IN ('ask', 'digit')").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = verdicts(asked, counted).where("p > 0.5").select("word", "meant")
    judged = formed.where("verdict <> ''").join(ranked, "word", "left").where("verdict <> 'ask' OR meant IS NOT NULL")

    def respell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [fixed_number(a) if k == "number" else in_place(a, m) for a, k, m in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["a", "meant"])

    wrong = cut(judged.select("a", "verdict", "meant").distinct().mapInArrow(respell, "a string, meant string").groupBy("a").agg(F.min("meant").alias("meant")))
    found = odd.join(F.broadcast(wrong) if wrong.count() <= BROADCAST_ROWS else wrong, "a")

    nothing = F.lit(None).cast("string")
    place = lambda df, what, meant: df.select("page_id", "line_no", "word_no", F.lit(what).alias("defect"), meant.alias("meant"))
    whole = place(gone.withColumn("word_no", F.lit(-1)), "furniture", nothing).unionByName(place(split, "split", nothing))
    return whole.unionByName(place(found, "misread", F.col("meant"))).unionByName(place(walked.where("kind = 'mark'"), "misread", F.lit(""))).distinct()
