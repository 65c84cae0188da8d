"""The main body of web pages, told from the site's furniture line by line."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.lookalikes import options, simple_form, suspects
from lodestack.session import cut

#: Rows of a table that are sent to the workers at most; a larger one is joined instead, with the same result.
LOOKUP_ROWS = 2_000_000
#: Rounds in which surroundings and templates inform each other.
ROUNDS = 6
#: From this many characters on a line that no other page has is taken for text of its own, with this value.
LONG, OWN_VALUE = 60, 0.8
#: Reach of a line's surroundings in lines, as the sigma of a Gaussian.
AROUND = 1.5
#: A line on this share of its site's pages of one script counts half; pages of corpus-wide evidence added to a site's own.
HALF_SHARE, PRIOR = 0.08, 20
#: Lines of its skeleton that are added to a template's own, and how often a template must stand to be known.
BACK_OFF, LEAST = 3.0, 3
#: Lines before and after that tell a heading of offers, and how much less content follows it than goes before.
SIDE, LEADS = 4, 0.65
#: Characters from which on a line is as good as a longer one; sigma and own weight of the last smoothing.
ENOUGH, SIGMA, ITSELF = 20.0, 1.0, 8.0
#: Where the two clusters lie on pages that have one only, and how many lines that counts for.
LOW, HIGH, SURE = 0.5, 0.9 * float(np.log1p(ENOUGH)), 10.0

_NUMBER = re.compile(r"\d+(?:[ .,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_WORDS = re.compile(r"w(?: w)+")
_BULLET = re.compile(r"^[•·\-–—*▪◦] ?(?=\S)")
_SCRIPTS = {"L": re.compile("[A-Za-zÀ-ɏ]+"), "C": re.compile("[Ѐ-ԯ]+"), "A": re.compile("[Ա-և]+")}


class _Events(HTMLParser):
    """Counts text and tags of each line as the parser's events stream by."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1

    def handle_data(self, data):
        self.text.append(data)

    def line(self, source: str) -> tuple[str, int]:
        self.tags, self.text = 0, []
        self.feed(source)
        if self.rawdata:  # an unfinished tag or a bare "<" belongs to the text
            self.text.append(self.rawdata)
            self.rawdata = ""
        return "".join(self.text), self.tags


def read_lines(text: str) -> list[tuple[int, str, int]]:
    """``number, text, tags`` of each line; lines without ``<`` and ``&`` make one data event and are not parsed."""
    events = None
    out = []
    for i, line in enumerate(text.split("\n")):
        tags = 0
        if "<" in line or "&" in line:
            events = events or _Events()
            line, tags = events.line(line)
        out.append((i, line, tags))
    return out


def plain(line: str) -> str:
    """A line as it is compared: one width of characters and spaces, words of one script, no case."""
    line = simple_form(line)
    if not line.isascii() and (odd := suspects(line)):
        out, at = [], 0
        for a, b, around in odd:
            out += [line[at:a], *(options(line[a:b], around)[:1] or [line[a:b]])]
            at = b
        line = "".join(out) + line[at:]
    return " ".join(line.split()).casefold()


def template(key: str) -> str:
    """The line with numbers masked, without a bullet."""
    return _NUMBER.sub("#", _BULLET.sub("", key))


def skeleton(masked: str) -> str:
    """What remains of a template when its words are masked too: marks, and where words and numbers stand."""
    s = _WORDS.sub("w", _WORD.sub("w", masked))
    return s if len(s) < LONG else "long"


def writing(text: str) -> str:
    """The script that most letters of a text are of."""
    n = {s: sum(map(len, p.findall(text))) for s, p in _SCRIPTS.items()}
    return max(n, key=n.__getitem__)


def _hash(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)


_LINES_SQL = "page_id bigint, site string, writing string, no array<int>, line array<bigint>, here array<bigint>, tmpl array<bigint>, skel array<bigint>, chars array<float>, tags array<float>"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 4, *[pa.list_(pa.float32())] * 2)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page_id, site, text`` in; each page's non-blank lines out, as hashes with their characters and tags."""
    hashes: dict[str, int] = {}

    def hashed(t: str) -> int:
        if len(hashes) > 200_000:
            hashes.clear()
        got = hashes[t] = _hash(t)
        return got

    for b in batches:
        rows: list[tuple] = []
        for pid, site, text in zip(*(c.to_pylist() for c in b.columns)):
            script = writing(text)
            lines = [(i, k, tags) for i, x, tags in read_lines(text) if (k := plain(x))]
            masked = [template(k) for _, k, _ in lines]
            every = [[hashes.get(t) or hashed(t) for t in ts] for ts in ([f"{script}\n{k}" for _, k, _ in lines], [f"{site}\n{script}\n{k}" for _, k, _ in lines], [f"{script}\t{m}" for m in masked], [f"{script}\r{skeleton(m)}" for m in masked])]
            rows.append((pid, site, script, [i for i, _, _ in lines], *every, [float(len(k)) for _, k, _ in lines], [float(t) for _, _, t in lines]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=["page_id", "site", "writing", "no", "line", "here", "tmpl", "skel", "chars", "tags"])


class Known:
    """A table ``key, ...numbers`` that workers look lines up in: sent to them while it has no more than
    ``LOOKUP_ROWS`` rows, else joined to the pages; either way ``read`` gives a number per line."""

    def __init__(self, rows: DataFrame, key: str, names: list[str], most: int | None = None):
        self.key, self.names, self.rows = key, names, rows
        self.shared = None
        if rows.count() <= (LOOKUP_ROWS if most is None else most):
            got = rows.select("key", *names).orderBy("key").toArrow()
            arrays = [np.asarray(got.column(c).combine_chunks()) for c in ("key", *names)]
            self.shared = rows.sparkSession.sparkContext.broadcast([arrays[0].astype(np.int64), *(a.astype(np.float32) for a in arrays[1:])])

    def onto(self, pages: DataFrame) -> DataFrame:
        if self.shared is not None:
            return pages
        each = pages.select("page_id", F.posexplode(self.key).alias("at", "key")).join(self.rows, "key", "left")
        got = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", *self.names))).alias("got"))  # the lines of one page
        return pages.join(got.select("page_id", *[F.transform(f"got.{c}", lambda x: x.cast("float")).alias(f"{self.key}_{c}") for c in self.names]), "page_id", "left")

    def under(self, key: str) -> Known:
        """The same table looked up by another column."""
        other = copy.copy(self)
        other.key, other.rows = key, self.rows
        return other

    def __getstate__(self) -> dict:
        return {"key": self.key, "names": self.names, "shared": self.shared}

    def read(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Of each line its numbers, 0 where it is not in the table."""
        if self.shared is None:
            return {c: np.nan_to_num(np.asarray(b.column(f"{self.key}_{c}").flatten().fill_null(0), np.float32)) for c in self.names}
        keys, *values = self.shared.value
        mine = np.asarray(b.column(self.key).flatten())
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        ok = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        return {c: np.where(ok, v[at], 0).astype(np.float32) if len(keys) else np.zeros(len(mine), np.float32) for c, v in zip(self.names, values)}


#: Empty lines put between pages when those of a batch are smoothed in one go.
_GAP = 8


class Lines:
    """The lines of a batch's pages, one after the other."""

    def __init__(self, b: pa.RecordBatch):
        ends = np.asarray(b.column("no").offsets)
        self.sizes = np.diff(ends)
        self.n = int(self.sizes.sum())
        self.page = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.spread = np.arange(self.n) + _GAP * (self.page + 1)
        self.chars, self.tags, self.keep = (np.asarray(b.column(c).flatten(), np.float64) for c in ("chars", "tags", "keep"))

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n + _GAP * (len(self.sizes) + 1))
        out[self.spread] = x
        return out

    def shifted(self, x: np.ndarray, by: int) -> np.ndarray:
        return x[self.spread + by]

    def smooth(self, x: np.ndarray, weight: np.ndarray, sigma: float, itself: float) -> np.ndarray:
        """Gaussian over the lines of a page, each line with its weight, the line at hand with ``itself``."""
        wx, w = self.padded(x * weight), self.padded(weight)
        top, below = itself * x * weight, itself * weight
        for d in range(1, min(_GAP, int(3 * sigma) + 2)):
            g = np.exp(-0.5 * (d / sigma) ** 2)
            top = top + g * (self.shifted(wx, d) + self.shifted(wx, -d))
            below = below + g * (self.shifted(w, d) + self.shifted(w, -d))
        return top / np.maximum(below, 1e-9)

    def around(self, x: np.ndarray, sigma: float) -> np.ndarray:
        """Gaussian over the lines before and after each, itself left out; beyond a page's ends there is nothing."""
        z, out, total = self.padded(x), np.zeros(self.n), 0.0
        for d in range(1, min(_GAP, int(3 * sigma) + 2)):
            g = np.exp(-0.5 * (d / sigma) ** 2)
            out += g * (self.shifted(z, d) + self.shifted(z, -d))
            total += 2 * g
        return out / total

    def after_first(self, flag: np.ndarray) -> np.ndarray:
        """From the first flagged line of its page on."""
        run = np.cumsum(flag)
        before = np.r_[0, run][np.r_[0, np.cumsum(self.sizes)[:-1]]] if len(self.sizes) else run
        return run - np.repeat(before, self.sizes) > 0


def own_share(lines: Lines, tmpl: dict | None, skel: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which share of each line's characters is content as far as the corpus knows, the same as if no
    heading of offers stood before it, and how often its template stands."""
    if tmpl is None:
        n, q = np.zeros(lines.n), np.full(lines.n, 0.5)
        v = np.where(lines.chars >= LONG, (0.5 + BACK_OFF * OWN_VALUE) / (1 + BACK_OFF), q) * lines.keep
        return v, v, n
    n = tmpl["n"].astype(float)
    q = np.where(lines.chars >= LONG, OWN_VALUE, np.where(skel["n"] > 0, skel["value"], 0.5))
    v = (tmpl["value"] * n + BACK_OFF * q) / (n + BACK_OFF) * lines.keep
    return np.where(lines.after_first((tmpl["leads"] > 0) & (lines.keep < 0.2)), 0.0, v), v, n


_ROUND_SQL = "key bigint, n bigint, s double, ahead double, n_ahead double, behind double, n_behind double"


def _round(tmpl: Known | None, skel: Known | None):
    """One round: what surrounds each template and skeleton, summed up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(b)
            if not lines.n:
                continue
            v, apart, n = own_share(lines, tmpl.read(b) if tmpl else None, skel.read(b) if skel else None)
            near = lines.around(v, AROUND)
            known = ((lines.chars < LONG) | (n >= 5)).astype(float)
            z, c = lines.padded(apart * known), lines.padded(known)
            sides = [sum(lines.shifted(x, s * d) for d in range(1, SIDE + 1)) for s in (1, -1) for x in (z, c)]
            prompt = (lines.keep < 0.2).astype(float)
            keys = np.concatenate([np.asarray(b.column(k).flatten()) for k in ("tmpl", "skel")])
            which, at = np.unique(keys, return_inverse=True)
            none = np.zeros(lines.n)
            cols = [np.r_[near, near], *(np.r_[x * prompt, none] for x in sides)]
            sums = [np.bincount(at, w, len(which)) for w in cols]
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.bincount(at, minlength=len(which)).astype(np.int64)), *map(pa.array, sums)], names=["key", "n", "s", "ahead", "n_ahead", "behind", "n_behind"])

    return run


def clusters(s: np.ndarray, sizes: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Which lines are above their page's threshold: the middle between the means of two clusters."""
    sizes = sizes[sizes > 0]
    if not len(s):
        return np.zeros(0, bool)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    lo, hi = np.full(len(sizes), LOW), np.full(len(sizes), HIGH)
    for _ in range(rounds):
        above = s > np.repeat((lo + hi) / 2, sizes)
        n = np.add.reduceat(above.astype(float), starts)
        top, all_ = np.add.reduceat(s * above, starts), np.add.reduceat(s, starts)
        lo, hi = (all_ - top + SURE * LOW) / (sizes - n + SURE), (top + SURE * HIGH) / (n + SURE)
    return s > np.repeat((lo + hi) / 2, sizes)


def regions(lines: Lines, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which lines lie in a content region.

    The text-to-tag ratio of a line counts only the share of its characters that is content, up to
    ``ENOUGH``; its logarithm is smoothed by a Gaussian, lines of templates that are hardly known
    counting less, and split in two clusters.
    """
    ratio = np.log1p(np.minimum(lines.chars, ENOUGH) * v / (1 + lines.tags))
    return clusters(lines.smooth(ratio, 0.3 + 0.7 * n / (n + 5), SIGMA, ITSELF), lines.sizes)


_FOUND_SQL = "page_id bigint, line_no int, own boolean"


def _judge(tmpl: Known, skel: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(b)
            v, _, n = own_share(lines, tmpl.read(b), skel.read(b))
            pages = np.repeat(np.asarray(b.column("page_id")), lines.sizes)
            yield pa.RecordBatch.from_arrays([pa.array(pages), b.column("no").flatten(), pa.array(regions(lines, v, n))], names=["page_id", "line_no", "own"])

    return run


def judged_lines(pages: DataFrame, sites: DataFrame, lookup_rows: int | None = None) -> DataFrame:
    """``page_id, line_no, own`` for every non-blank line of every page.

    ``pages``: ``page_id, doc_id, text``; ``sites``: ``doc_id, site``.

    Each page is read once through the standard library's HTML parser, which gives each line's
    text-to-tag ratio. Texts whose tags are gone have no links left that lower the ratio of
    menus and offers; what was a link is estimated from the corpus instead. A line's characters
    count as content less the more of its site's pages have it, and as far as lines of its
    template (numbers masked; of its skeleton, words masked too, while the template is rare)
    stand among content: the ratios are smoothed by a Gaussian over lines, averaged per
    template and fed back into the ratio, ``ROUNDS`` times. A line that many pages have, before
    which content stands and after which it ends, leads to offers; nothing behind it counts.
    ``regions`` then smooths the ratios and clusters them by a threshold on each page;
    a line is the page's own exactly if it lies in a region.

    Defined cases: null and empty texts have no lines; pages of unknown site are one
    site; page ids are unique; no rows give no rows. ``lookup_rows`` overrides ``LOOKUP_ROWS``.

    How it scales: lines are 64-bit hashes. Counts are summed within each batch before they are
    shuffled. Templates that stand fewer than ``LEAST`` times are not looked up. What one
    task holds is a batch of pages. Tables of up to ``LOOKUP_ROWS`` rows of a hash and
    three numbers are sent to the workers, larger ones are joined by shuffle.
    """
    per_doc = sites.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("site").alias("site"))
    own = pages.where(F.col("text").isNotNull()).join(per_doc, "doc_id", "left").select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("site", F.lit("")).alias("site"), "text")
    described = cut(own.mapInArrow(_describe, _LINES_SQL))

    once = described.select("site", "writing", F.explode(F.array_distinct(F.arrays_zip("line", "here"))).alias("x")).select("site", "writing", "x.line", "x.here")
    on_site = cut(once.groupBy("site", "writing", "line", "here").agg(F.count("*").alias("k")))
    pages_of = described.groupBy("site", "writing").agg(F.count("*").alias("n"))
    pages_in = pages_of.groupBy("writing").agg(F.sum("n").alias("n_all"))
    overall = on_site.groupBy("writing", "line").agg(F.sum("k").alias("k_all"))
    share = (F.col("k") + PRIOR * F.col("k_all") / F.col("n_all")) / (F.col("n") + PRIOR)
    shares = on_site.join(overall, ["writing", "line"]).join(F.broadcast(pages_in), "writing").join(pages_of, ["site", "writing"]).select(F.col("here").alias("key"), share.alias("share")).where(F.col("share") >= HALF_SHARE / 20)  # pages_in: a row per script
    common = Known(cut(shares), "here", ["share"], lookup_rows)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(1 / (1 + (common.read(b)["share"] / HALF_SHARE) ** 2), pa.float32())
            lists = pa.ListArray.from_arrays(_offsets(b.column("no")), keep)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "no", "tmpl", "skel", "chars", "tags")), lists], names=["page_id", "no", "tmpl", "skel", "chars", "tags", "keep"])

    lines = cut(common.onto(described).mapInArrow(kept, "page_id bigint, no array<int>, tmpl array<bigint>, skel array<bigint>, chars array<float>, tags array<float>, keep array<float>"))
    tmpl = skel = None
    for _ in range(ROUNDS):
        sent = skel.onto(tmpl.onto(lines)) if tmpl else lines
        seen = sent.mapInArrow(_round(tmpl, skel), _ROUND_SQL).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ahead", "n_ahead", "behind", "n_behind")]).where(F.col("n") >= LEAST)
        ahead, behind = F.coalesce(F.try_divide("ahead", "n_ahead"), F.lit(0.0)), F.coalesce(F.try_divide("behind", "n_behind"), F.lit(0.0))
        leads = ((F.col("n") >= 5) & (behind > 0.25) & (ahead < LEADS * behind)).cast("double")
        table = cut(seen.select("key", "n", (F.col("s") / F.col("n")).alias("value"), (leads if tmpl else F.lit(0.0)).alias("leads")))
        tmpl = Known(table, "tmpl", ["n", "value", "leads"], lookup_rows)
        skel = tmpl.under("skel")
    return skel.onto(tmpl.onto(lines)).mapInArrow(_judge(tmpl, skel), _FOUND_SQL)


def _offsets(col: pa.ListArray) -> pa.Array:
    """Offsets of a list column, from 0."""
    ends = np.asarray(col.offsets)
    return pa.array(ends - ends[0], pa.int32())


def main_text(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """``page_id, text``: each page's own lines; empty where it has none."""
    keep = judged.where("own").groupBy("page_id").agg(F.collect_set("line_no").alias("keep"))
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: F.array_contains("keep", i))
    return pages.join(keep, "page_id", "left").select("page_id", F.when(F.col("keep").isNull(), F.lit("")).otherwise(F.array_join(lines, "\n")).alias("text"))
