"""All-pairs nearest neighbours with an inverted file of product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import cut


@dataclass(frozen=True)
class Settings:
    """``sample`` rows of a group, or ``per_list`` for each of its lists if that is more, train its centroids and
    codebooks (every row is indexed; with ``max_lists`` lists that is 131,072 rows at most);
    lists hold about ``list_rows`` rows; a row is searched for in its list's ``probes`` nearest
    lists; ``rerank`` candidates a row and batch go from the quantised scores to exact ones."""

    k: int = 10
    sample: int = 40_000
    per_list: int = 8
    list_rows: int = 256
    max_lists: int = 16_384
    probes: int = 16
    parts: int = 16
    codes: int = 256
    rerank: int = 128
    query_block: int = 2_048
    rounds: int = 8
    seed: int = 7


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from random rows; an emptied centroid restarts at a random row."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(k))
        n = np.diff(np.append(starts, len(x)))
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    """The nearest centroid of each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + block] @ c.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Of one group and dimension: coarse centroids, each one's nearest lists, and a codebook per part."""

    centroids: np.ndarray
    near: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, n: int, s: Settings) -> Index:
        rng = np.random.default_rng(s.seed)
        c = kmeans(x, int(max(1, min(s.max_lists, n // s.list_rows, len(x)))), s.rounds, rng)
        rest = x - c[nearest(x, c)]
        books = np.stack([_book(p, s, rng) for p in np.split(_padded(rest, s.parts), s.parts, axis=1)])
        return Index(c, _nearest_lists(c, s.probes), books)

    def encode(self, x: np.ndarray, lists: np.ndarray, parts: int) -> np.ndarray:
        rest = _padded(x - self.centroids[lists], parts)
        return np.stack([nearest(p, b) for p, b in zip(np.split(rest, parts, axis=1), self.books)], axis=1).astype(np.uint8)


def _nearest_lists(c: np.ndarray, probes: int, block: int = 512) -> np.ndarray:
    """Of each centroid its ``probes`` nearest, block by block."""
    half, k = (c * c).sum(1) / 2, min(probes, len(c))
    out = np.zeros((len(c), k), np.int32)
    for i in range(0, len(c), block):
        far = half - c[i : i + block] @ c.T
        out[i : i + block] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """Dimensions filled up with zeros to a multiple of ``parts``."""
    more = -x.shape[1] % parts
    return np.pad(x, ((0, 0), (0, more))) if more else x


def _book(x: np.ndarray, s: Settings, rng: np.random.Generator) -> np.ndarray:
    b = kmeans(x[: 256 * 48], s.codes, s.rounds, rng)
    return np.concatenate([b, np.full((s.codes - len(b), b.shape[1]), 1e6, np.float32)]) if len(b) < s.codes else b


def _matrix(col: pa.ListArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = np.asarray(col.flatten(), dtype=np.float32)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)


_ENTRY_SQL = "g int, list int, block int, is_candidate boolean, rep bigint, from_list int, data binary"
_HITS_SQL = "rep bigint, other bigint, cosine float"
NOBODY = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of row ids that spreads them evenly."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((z ^ (z >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)


def _by_group(b: pa.RecordBatch, numbers: dict) -> Iterator[tuple[int, pa.Array]]:
    """The batch's rows of each group, as positions; columns 0 and 1 name the group."""
    g = np.array([numbers[x] for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
    for one in np.unique(g):
        yield int(one), pa.array(np.flatnonzero(g == one))


def _place(batches: Iterator[pa.RecordBatch], numbers: dict, index: list[Index], routes: list, s: Settings) -> Iterator[pa.RecordBatch]:
    """``grp, dim, rep, vec`` in; one query entry for the row's own list out, and a candidate entry
    for each query block of each list that searches the row's list."""
    for b in batches:
        if not b.num_rows:
            continue
        for g, at in _by_group(b, numbers):
            own, (n_blocks, targets, target_blocks) = index[g], routes[g]
            rep, x = np.asarray(b.column(2).take(at)), _matrix(b.column(3).take(at))
            lists = nearest(x, own.centroids)
            data = np.concatenate([x.view(np.uint8), own.encode(x, lists, s.parts)], axis=1)
            n = len(rep)
            copies = np.array([len(targets[l]) for l in lists])
            row = np.concatenate([np.arange(n), np.repeat(np.arange(n), copies)])
            to = np.concatenate([lists, *[targets[l] for l in lists]]).astype(np.int32)
            block = np.concatenate([_mix(rep) % n_blocks[lists], *[target_blocks[l] for l in lists]]).astype(np.int32)
            for i in range(0, len(row), 16384):
                m = row[i : i + 16384]
                width = data.shape[1]
                ends = pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * width)
                packed = pa.Array.from_buffers(pa.binary(), len(m), [None, ends, pa.py_buffer(np.ascontiguousarray(data[m]))])
                cols = [np.full(len(m), g, np.int32), to[i : i + 16384], block[i : i + 16384], np.arange(i, i + len(m)) >= n, rep[m], lists[m].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), packed], names=["g", "list", "block", "is_candidate", "rep", "from_list", "data"])


def _unpack(col: pa.BinaryArray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and codes of entries."""
    rows = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return np.ascontiguousarray(rows[:, :-parts]).view(np.float32), rows[:, -parts:]


class _Search:
    """The queries of one block of a list, and the best candidates seen so far."""

    def __init__(self, own: Index, list_: int, s: Settings):
        self.own, self.s = own, s
        self.lists = np.sort(own.near[list_])
        self.queries: list[tuple[np.ndarray, np.ndarray]] = []
        self.rep: np.ndarray | None = None

    def start(self) -> None:
        self.rep = np.concatenate([r for r, _ in self.queries])
        self.vec = np.concatenate([v for _, v in self.queries])
        self.best = np.full((len(self.rep), self.s.k), -2.0, np.float32)
        self.who = np.full((len(self.rep), self.s.k), NOBODY)
        # asymmetric distance tables: each part of each query times each code of that part
        parts = np.split(_padded(self.vec, self.s.parts), self.s.parts, axis=1)
        self.tables = [p @ b.T for p, b in zip(parts, self.own.books)]
        self.coarse = self.vec @ self.own.centroids[self.lists].T

    def offer(self, rep: np.ndarray, vec: np.ndarray, code: np.ndarray, lists: np.ndarray) -> None:
        """Score candidates by table look-ups, rank the best ones exactly, keep the ``k`` best of all so far."""
        if self.rep is None:
            self.start()
        score = self.coarse[:, np.searchsorted(self.lists, lists)]
        for table, c in zip(self.tables, code.T):
            score += table[:, c]
        r = min(self.s.rerank + 1, len(rep))
        top = np.argpartition(score, len(rep) - r, axis=1)[:, len(rep) - r :]
        exact = np.einsum("qd,qrd->qr", self.vec, vec[top], optimize=True).astype(np.float32)
        exact[self.rep[:, None] == rep[top]] = -2
        every, who = np.concatenate([self.best, exact], axis=1), np.concatenate([self.who, np.where(exact > -2, rep[top], NOBODY)], axis=1)
        keep = np.lexsort((who, -every), axis=1)[:, : self.s.k]
        self.best, self.who = np.take_along_axis(every, keep, 1), np.take_along_axis(who, keep, 1)

    def hits(self) -> Iterator[pa.RecordBatch]:
        if self.rep is not None:
            ok = self.best > -2
            cols = [np.repeat(self.rep, ok.sum(1)), self.who[ok], self.best[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rep", "other", "cosine"])


def _search(batches: Iterator[pa.RecordBatch], index: list[Index], s: Settings) -> Iterator[pa.RecordBatch]:
    """Entries sorted by group, list, block, queries before candidates, in; the best candidates of every query out."""
    at, search = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(i).cast(pa.int32())) for i in range(4)], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(keys[i, :3].tolist())
            if key != at:
                if search is not None:
                    yield from search.hits()
                at, search = key, _Search(index[key[0]], key[1], s)
            part = b.slice(i, j - i)
            rep = np.asarray(part.column(4))
            vec, code = _unpack(part.column(6), s.parts)
            if not keys[i, 3]:
                search.queries.append((rep, vec))
            elif search.queries:
                lists = np.asarray(part.column(5))
                for a in range(0, len(rep), 1024):
                    z = slice(a, a + 1024)
                    search.offer(rep[z], vec[z], code[z], lists[z])
    if search is not None:
        yield from search.hits()


_ROWS_SQL = "grp string, dim int, id bigint, key binary, vec array<float>"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``grp, id, vector`` in; usable rows out, their vectors of length one, with 128 bits that are equal for equal directions."""
    for b in batches:
        col = b.column(2)
        ends = np.asarray(col.offsets)
        width = np.where(np.asarray(col.is_null()), 0, np.diff(ends))
        for d in np.unique(width[width > 0]):
            at = np.flatnonzero(width == d)
            cells = ends[at][:, None] + np.arange(d)
            x = np.asarray(pc.take(col.values, pa.array(cells.reshape(-1))).cast(pa.float64()).fill_null(np.nan)).reshape(-1, d)
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)  # so that no square leaves the range of numbers
                x = np.round(x / np.sqrt((x * x).sum(1))[:, None], 7).astype(np.float32) + np.float32(0)
            ok = np.isfinite(x).all(1)
            at, x = at[ok], x[ok]
            keys = [xxhash.xxh3_128_digest(row) for row in x]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(d)), pa.array(x.reshape(-1)))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.full(len(x), d, np.int32)), b.column(1).take(rows), pa.array(keys, pa.binary()), lists], names=["grp", "dim", "id", "key", "vec"])


def _representatives(rows: DataFrame, most: int) -> DataFrame:
    """``grp, dim, key, vec, rep, ids``: each distinct direction with its ``most`` smallest ids, the smallest first.

    Only directions with several ids go on to where ids are ranked, and there without their
    vectors; ids are cut to ``most`` within salted groups before they meet, so copies in any
    number are never rows of one task.
    """
    by = ["grp", "dim", "key"]
    first = rows.groupBy(*by).agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("rep"), (F.min("id") != F.max("id")).alias("several"))
    first = cut(first)
    w = Window.partitionBy(*by, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    copies = rows.select(*by, "id").join(first.where("several").select(*by), by, "left_semi").distinct()
    few = copies.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    ids = few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))
    return first.join(ids, by, "left").select(*by, "vec", "rep", F.coalesce("ids", F.array("rep")).alias("ids"))


def _fit(reps: DataFrame, sizes: dict, s: Settings) -> list[Index]:
    """An index of each group from a bounded sample of its rows."""
    out = []
    for (g, d), n in sizes.items():
        own = reps.where((F.col("grp") == g) & (F.col("dim") == d)).select("rep", "vec")
        lists = max(1, min(s.max_lists, n // s.list_rows))
        share = min(1.0, max(s.sample, s.per_list * lists) / n)
        if share < 1:  # by a hash of the id, so that the same rows always give the same index
            own = own.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000))
        drawn = own.orderBy("rep").select("vec").toArrow().column("vec").combine_chunks()
        x = _matrix(drawn.chunk(0) if isinstance(drawn, pa.ChunkedArray) else drawn)
        out.append(Index.fit(x.reshape(-1, d), n, s))
    return out


def nearest_neighbours(vectors: DataFrame, id: str, group: str, vector: str, settings: Settings | None = None) -> DataFrame:
    """``id, other, cosine``: for every usable vector the ``k`` of highest cosine in its group, itself left out.

    Ties go to the smaller id. Vectors are compared only within a group and with their own
    number of dimensions. Equal directions are indexed once: of each, the ``k + 1`` smallest
    ids stand for all copies, which is all that the tie rule lets into a result, so a group of
    copies of any size costs one entry.

    Defined cases: null, empty and all-zero vectors, and those with nulls or infinities, are not
    usable and appear nowhere; a null group is a group of its own; rows stored twice under one id
    count once; groups of fewer than ``k + 1`` give what they have; no rows give no rows.

    How it scales: centroids and codebooks are trained on at most ``sample`` rows a group and
    sent to the workers (at most ``max_lists`` centroids a group); every row is then indexed.
    Searching is one shuffle: each row goes as a query to its own list, and as a candidate to the
    lists that search its list. A list with many queries is cut into blocks of about
    ``query_block``, each a task group of its own, and candidates stream by, so neither a hot
    list nor a hot group is held in memory. Groups are embedding models: few, whatever the rows.
    """
    s = settings or Settings()
    named = vectors.where(F.col(id).isNotNull()).select(F.coalesce(F.col(group), F.lit("\u0000")).alias("grp"), F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = cut(named.mapInArrow(_normalise, _ROWS_SQL))
    reps = cut(_representatives(rows, s.k + 1))
    sizes = {(r["grp"], r["dim"]): r["n"] for r in reps.groupBy("grp", "dim").agg(F.count("*").alias("n")).orderBy("grp", "dim").collect()}
    numbers = {key: i for i, key in enumerate(sizes)}
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(_fit(reps, sizes, s))
    index = shared.value

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, at in _by_group(b, numbers) if b.num_rows else ():
                lists, n = np.unique(nearest(_matrix(b.column(2).take(at)), shared.value[g].centroids), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), g, np.int32)), pa.array(lists.astype(np.int32)), pa.array(n.astype(np.int64))], names=["g", "list", "n"])

    # lengths of the lists, at most max_lists a group, come to the driver
    counted = reps.select("grp", "dim", "vec").mapInArrow(lengths, "g int, list int, n bigint").groupBy("g", "list").agg(F.sum("n").alias("n")).collect()
    n_blocks = [np.ones(len(own.centroids), np.int64) for own in index]
    for r in counted:
        n_blocks[r["g"]][r["list"]] = -(-r["n"] // s.query_block)
    routes = []
    for own, n in zip(index, n_blocks):
        to: list[list[int]] = [[] for _ in n]
        for q, near in enumerate(own.near):
            for x in near:
                to[x].append(q)
        routes.append((n, [np.repeat(np.array(t, np.int32), n[t] if t else 0) for t in to], [np.concatenate([np.arange(n[q], dtype=np.int32) for q in t] or [np.zeros(0, np.int32)]) for t in to]))
    shared_routes = spark.sparkContext.broadcast(routes)
    placed = reps.select("grp", "dim", "rep", "vec").mapInArrow(lambda it: _place(it, numbers, shared.value, shared_routes.value, s), _ENTRY_SQL)
    # as many tasks as hold about 64 MB of entries each
    moved = sum(n * (s.probes + 1) * (4 * d + 60) for (_, d), n in sizes.items())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), moved // 64_000_000 + 1)
    ordered = placed.repartition(tasks, "g", "list", "block").sortWithinPartitions("g", "list", "block", "is_candidate")
    hits = ordered.mapInArrow(lambda it: _search(it, shared.value, s), _HITS_SQL)

    # copies: a row's neighbours are its direction's other ids, then the ids of the directions found
    found = hits.join(reps.select(F.col("rep").alias("other"), "ids"), "other").select("rep", F.struct((-F.col("cosine")).alias("far"), "ids").alias("hit"))
    gathered = found.groupBy("rep").agg(F.collect_list("hit").alias("hits"))
    members = rows.select("grp", "dim", "key", "id").join(reps.select("grp", "dim", "key", "rep", "ids"), ["grp", "dim", "key"]).select("id", "rep", "ids").dropDuplicates(["id"])
    full = members.join(gathered, "rep", "left")
    mine = F.array(F.struct(F.lit(-2.0).cast("float").alias("far"), F.col("ids")))
    every = F.flatten(F.transform(F.concat(mine, F.coalesce("hits", F.slice(mine, 1, 0))), lambda h: F.transform(h["ids"], lambda i: F.struct(h["far"].alias("far"), i.alias("id")))))
    top = F.slice(F.array_sort(F.filter(every, lambda x: x["id"] != F.col("id"))), 1, s.k)
    cosine = F.when(F.col("x.far") == -2, F.lit(1.0)).otherwise(-F.col("x.far")).cast("float")
    return full.select("id", F.explode(top).alias("x")).select(F.col("id").alias(id), F.col("x.id").alias("other"), cosine.alias("cosine"))


def neighbour_pairs(neighbours: DataFrame, id: str) -> DataFrame:
    """``a, b`` with ``a < b``: each pair in which one is a neighbour of the other, once."""
    return neighbours.select(F.least(F.col(id), F.col("other")).alias("a"), F.greatest(F.col(id), F.col("other")).alias("b")).distinct()
