"""Languages of documents and of their lines, by a string kernel."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spectrum lengths that are blended, and buckets that n-grams are hashed to.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Words whose n-grams a worker remembers.
REMEMBERED = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


class Spectrum:
    """Presence of n-grams: 1 to 4 characters of each word with a blank at its ends."""

    def __init__(self) -> None:
        self.words: dict[str, bytes] = {}

    def word(self, token: str) -> bytes:
        """Bucket numbers of a token's n-grams as packed 32-bit integers; none without letters."""
        found: set[int] = set()
        for w in _LETTERS.findall(token.lower()):
            p = f" {w} "
            for n in GRAMS:
                found.update(zlib.crc32(p[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(p) - n + 1))
        return np.array(sorted(found), np.int32).tobytes()

    def line(self, text: str) -> bytes:
        known, out = self.words, []
        for t in text.split():
            g = known.get(t)
            if g is None:
                if len(known) > REMEMBERED:
                    known.clear()
                g = self.word(t)
                if len(t) < 64:
                    known[t] = g
            out.append(g)
        return b"".join(out)

    def product(self, lines: list[str], right: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Presence vectors of lines times ``right`` (``BUCKETS x k``), and each line's number of n-grams; block by block."""
        dense = np.zeros((block, BUCKETS), np.float32)
        flat = dense.reshape(-1)
        ones = np.concatenate([right, np.ones((BUCKETS, 1), np.float32)], axis=1).astype(np.float32)
        out = []
        for i in range(0, len(lines), block):
            packed = [self.line(x) for x in lines[i : i + block]]
            at = np.frombuffer(b"".join(packed), np.int32) + np.repeat(np.arange(len(packed)) * BUCKETS, [len(p) // 4 for p in packed])
            flat[at] = 1
            out.append(dense[: len(packed)] @ ones)
            flat[at] = 0
        got = np.concatenate(out) if out else np.zeros((0, ones.shape[1]), np.float32)
        return got[:, :-1], got[:, -1]


@dataclass
class Model:
    """``weights``: landmarks, whitening and ridge coefficients multiplied into one matrix, ``BUCKETS x languages``."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, spectrum: Spectrum, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, n = spectrum.product(lines, self.weights)
        return raw / np.sqrt(np.maximum(n, 1))[:, None], n


def _landmarks(lines: list[str], spectrum: Spectrum) -> np.ndarray:
    """Normalised presence vectors of landmark lines, ``BUCKETS x m``."""
    out = np.zeros((BUCKETS, len(lines)), np.float32)
    for k, x in enumerate(lines):
        at = np.unique(np.frombuffer(spectrum.line(x), np.int32))
        out[at, k] = 1 / np.sqrt(max(1, len(at)))
    return out


def _ridge(lines: list[str], y: np.ndarray, marks: list[str], languages: list[str], spectrum: Spectrum, penalty: float) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of the normalised presence kernel."""
    basis = _landmarks(marks, spectrum)
    kmm = basis.T @ basis
    w, v = np.linalg.eigh(kmm.astype(np.float64))
    ok = w > 1e-4 * w[-1]
    whiten = v[:, ok] / np.sqrt(w[ok])
    raw, n = spectrum.product(lines, basis)
    phi = (raw / np.sqrt(np.maximum(n, 1))[:, None]) @ whiten
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0 / max(1, len(languages) - 1))
    weight = (1 / np.maximum(1, np.bincount(y, minlength=len(languages))))[y] * len(y) / len(languages)
    left = (phi * weight[:, None]).T @ phi + penalty * len(y) * 1e-3 * np.eye(phi.shape[1])
    beta = np.linalg.solve(left, (phi * weight[:, None]).T @ target)
    return Model(languages, (basis @ (whiten @ beta)).astype(np.float32))


def _writing(line: str) -> str:
    """Latin, Cyrillic, Armenian or other: what most letters of a line are."""
    n = {"L": 0, "C": 0, "A": 0, "o": 0}
    for ch in line:
        c = ord(ch)
        if ch.isalpha():
            n["L" if c < 0x250 else "C" if 0x400 <= c < 0x530 else "A" if 0x531 <= c < 0x588 else "o"] += 1
    return max(n, key=n.__getitem__)


def fit(lines: list[str], labels: list[str], per_stratum: int = 40, rounds: int = 3, penalty: float = 1.0, seed: int = 3) -> Model:
    """A model from labelled lines, part of whose labels are wrong.

    Landmarks are drawn per language and writing. After each round lines that the model
    puts elsewhere are left out of the next, so that wrong labels do not stay in it.
    Without labelled lines the model has no language and labels nothing.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    y = np.array([languages.index(x) for x in labels])
    writing = np.array([_writing(x) for x in lines])
    spectrum, rng = Spectrum(), np.random.default_rng(seed)
    keep = np.ones(len(lines), bool)
    model = Model(languages, np.zeros((BUCKETS, len(languages)), np.float32))
    for turn in range(rounds):
        marks = []
        for k in range(len(languages)):
            for s in "LCA":
                own = np.flatnonzero(keep & (y == k) & (writing == s))
                if len(own) >= (1 if turn == 0 else 3):
                    marks += [lines[i] for i in rng.choice(own, min(per_stratum, len(own)), replace=False)]
        at = np.flatnonzero(keep)
        model = _ridge([lines[i] for i in at], y[at], marks, languages, spectrum, penalty)
        said = model.scores(spectrum, lines)[0].argmax(1)
        keep = said == y
        if not keep.any():
            break
    return model


def training_lines(docs: DataFrame, aliases: DataFrame, sample: int = 4000, lines_each: int = 4, shortest: int = 16, longest: int = 600) -> tuple[list[str], list[str]]:
    """Lines of about ``sample`` labelled documents (the bound of the sample), with the language their label names:
    ``lines_each`` a document at most, of a longer line ``longest`` characters from a place that its hash gives.

    Documents are drawn by a hash of their id, so the same rows always give the same sample."""
    named = docs.select("doc_id", "text", "lang").join(F.broadcast(aliases.select(F.col("label").alias("lang"), F.col("lang").alias("named"))), "lang")
    n = named.count()
    drawn = named.where(F.length("text") >= shortest).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))).where(F.col("u") < min(1.0, sample / max(1, n)) * 1_000_000)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                own = [x for x in text.split("\n") if len(x) >= shortest]
                for i, x in enumerate(own[:: max(1, len(own) // lines_each)][:lines_each]):
                    at = zlib.crc32(x.encode("utf-8", "surrogatepass")) % (len(x) - longest + 1) if len(x) > longest else 0
                    out.append((doc, i, x[at : at + longest], lang))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], names=["d", "i", "line", "named"])

    if not n:
        return [], []
    got = drawn.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "named").mapInArrow(pick, "d bigint, i int, line string, named string").orderBy("d", "i", "line", "named").toArrow()
    return got.column("line").to_pylist(), got.column("named").to_pylist()


#: A line counts as another language than its document's from this lead on; shorter lines need more.
LEAD, SHORT = 0.2, 14.0


def decide(scores: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """``labels, main`` of a document's non-blank lines.

    Every line first speaks for its best language with its size; the document's language is
    the one with most characters. A line shows another language only if that leads the
    document's own by a margin that grows as the line has fewer n-grams; so names and a few
    foreign words do not change a line. Where lines show several languages, each line gets
    the best of these. Lines without letters follow the document.
    """
    k = scores.shape[1]
    sure = grams > 0
    best = scores.argmax(1)
    need = LEAD + SHORT / np.maximum(grams, 1)
    main = int(np.bincount(best[sure], weights=sizes[sure], minlength=k).argmax()) if sure.any() else 0
    for _ in range(3):
        lead = scores[np.arange(len(best)), best] - scores[:, main]
        labels = np.where(sure & (lead > need), best, main)
        shown = np.unique(np.append(labels, main))
        if len(shown) > 1:
            labels = np.where(sure, shown[scores[:, shown].argmax(1)], main)
        again = int(np.bincount(labels[sure] if sure.any() else labels, weights=sizes[sure] if sure.any() else sizes, minlength=k).argmax())
        if again == main:
            break
        main = again
    return labels, main


def _confidence(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A probability from the lead over the best other language."""
    own = np.take_along_axis(scores, label[:, None], 1)[:, 0]
    rest = scores.copy()
    np.put_along_axis(rest, label[:, None], -9, 1)
    return 1 / (1 + np.exp(-12 * (own - rest.max(1))))


_SEGMENT_SQL = "doc_id bigint, line_no int, lang string, confidence double, mixed boolean"


def _label(batches: Iterator[pa.RecordBatch], model: Model, spectrum: Spectrum) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 2000):
            part = b.slice(start, 2000)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            lines, owner, number = [], [], []
            for d, t in enumerate(texts):
                for i, x in enumerate((t or "").split("\n")):
                    if x.strip():
                        lines.append(x)
                        owner.append(d)
                        number.append(i)
            if not lines or not model.languages:
                continue
            scores, grams = model.scores(spectrum, lines)
            owner_, sizes = np.array(owner), np.array([len(x) for x in lines], float)
            starts = np.flatnonzero(np.r_[True, owner_[1:] != owner_[:-1]])
            out: list[tuple] = []
            for i, j in zip(starts, [*starts[1:], len(lines)]):
                if not grams[i:j].any():
                    continue
                labels, main = decide(scores[i:j], grams[i:j], sizes[i:j])
                mine = (grams[i:j] > 0) & (labels == main)
                w = sizes[i:j] * mine
                whole = (scores[i:j] * w[:, None]).sum(0) / max(1.0, w.sum())
                mixed = bool((labels != main).any())
                d = ids[owner[i]]
                sure = _confidence(scores[i:j], labels)
                out.append((d, -1, model.languages[main], float(_confidence(whole[None], np.array([main]))[0]), mixed))
                if mixed:
                    out += [(d, number[k], model.languages[labels[k - i]], float(sure[k - i]), True) for k in range(i, j)]
            cols = list(zip(*out)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "line_no", "lang", "confidence", "mixed"])


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line_no, lang, confidence, mixed``: a row with ``line_no`` -1 per document, and for
    documents with lines in several languages one row per non-blank line.

    Defined cases: null, empty and blank texts and those without letters give no row; very long
    texts are read whole; a document stored twice is labelled twice, alike. A projection: no
    shuffle; the model, of fixed size, is sent to the workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _label(batches, shared.value, Spectrum())

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SEGMENT_SQL)


def wrong_labels(docs: DataFrame, aliases: DataFrame, labelled: DataFrame) -> DataFrame:
    """Document rows of ``labelled`` whose label is missing or names another language, and all line rows."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("label")).join(F.broadcast(aliases.select("label", F.col("lang").alias("named"))), "label", "left").select("doc_id", "named").distinct()
    joined = labelled.join(named, "doc_id")
    return joined.where((F.col("line_no") >= 0) | ~F.col("named").eqNullSafe(F.col("lang"))).select("doc_id", "line_no", "lang", "confidence").distinct()
