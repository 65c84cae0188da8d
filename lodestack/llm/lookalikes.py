"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

# Letters that look alike; each group is Latin, Cyrillic, Armenian, "." where a script has none.
SHAPES = """
aа. cс. eе. g.ց hһհ iі. jјյ lӏ. n.ո oоօ pр. qԛզ sѕ. u.ս vѵ. wԝ. xх. yу. dԁ.
AА. BВ. CС. EЕ. HН. IІ. JЈ. KК. L.Լ MМ. OОՕ PР. QԚ. SЅՏ TТ. U.Ս XХ. YУ.
ëё. ïї. ËЁ. ÏЇ.
""".split()
# Greek letters with a Latin shape.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))

SCRIPTS = ("LATIN", "CYRILLIC", "ARMENIAN")


def _pairs() -> dict[str, dict[str, str]]:
    """For each script, what every foreign letter with a shape in it becomes."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for row in SHAPES:
        for s, own in zip(SCRIPTS, row):
            if own != ".":
                for other in row:
                    if other not in (".", own):
                        to[s].setdefault(other, own)
    for g, l in GREEK.items():
        to["LATIN"][g] = l
        for s in SCRIPTS[1:]:
            if l in to[s]:
                to[s][g] = to[s][l]
    return to


TO = _pairs()
_LETTERS = {"LATIN": "A-Za-zÀ-ɏ", "CYRILLIC": "Ѐ-ԯ", "ARMENIAN": "Ա-և", "GREEK": "Ͱ-Ͽ"}
_ANY = "".join(_LETTERS.values())


def script(ch: str) -> str | None:
    c = ord(ch)
    if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or 0xC0 <= c <= 0x24F:
        return "LATIN"
    if 0x400 <= c <= 0x52F:
        return "CYRILLIC"
    if 0x531 <= c <= 0x587:
        return "ARMENIAN"
    if 0x370 <= c <= 0x3FF:
        return "GREEK"
    return None


def _simple_map() -> dict[int, str | None]:
    """Width, kind of space, typographic ligatures and invisible characters, by rule from the Unicode data."""
    out: dict[int, str | None] = {}
    for c in range(0x80, 0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x34F, 0x115F, 0x1160, 0x3164):
            out[c] = None
        elif kind == "Zs":
            out[c] = " "
        elif tag in ("<wide>", "<narrow>") or tag == "<compat>" and 0xFB00 <= c <= 0xFB4F:
            out[c] = unicodedata.normalize("NFKC", ch)
    out |= {0x2010: "-", 0x2011: "-", 0x2024: "."}
    return out


SIMPLE = _simple_map()


def _classes(chars: list[int]) -> str:
    """A regex class of code points, as ranges."""
    parts, start = [], None
    for a, b in zip(chars, [*chars[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            parts.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "".join(parts)


_ODD = re.compile(f"[{_classes(sorted(SIMPLE))}]")
_MARK = re.compile("[̀-ͯ]")
_WORD = re.compile(f"[{_ANY}]+")
_MIXED = re.compile("|".join(f"[{own}][{''.join(v for k, v in _LETTERS.items() if k != s)}]" for s, own in _LETTERS.items()))


def _alike(s: str) -> str:
    """Letters of script ``s`` that some other script has too."""
    return "".join(sorted({ch for o in SCRIPTS if o != s for ch in TO[o] if script(ch) == s}))


# A word that only has letters of this script which another script has too.
_ONLY = {s: re.compile(f"(?<![{_ANY}])[{_alike(s)}]+(?![{_ANY}])") for s in SCRIPTS}
_SURE = {s: re.compile(f"[{_LETTERS[s]}]") for s in SCRIPTS}


def simple_form(text: str) -> str:
    """The text without differences of width, kind of space, composition and invisible characters."""
    if text.isascii():
        return text
    if _ODD.search(text):
        text = text.translate(SIMPLE)
    if _MARK.search(text):
        text = unicodedata.normalize("NFC", text)
    return text


def line_script(line: str) -> str | None:
    """The script most letters of a line are of that no other script has."""
    n = dict.fromkeys(SCRIPTS, 0)
    for ch in line:
        s = script(ch)
        if s in n and not any(ch in TO[o] for o in SCRIPTS if o != s):
            n[s] += 1
    best = max(SCRIPTS, key=n.__getitem__)
    return best if n[best] else None


def suspects(text: str, disguised: bool = True) -> list[tuple[int, int, str]]:
    """``start, end, around`` of each word that may have look-alikes in it: words of mixed script
    (``around`` is empty) and, with ``disguised``, words made of look-alikes only amid a line of another script."""
    out = []
    if _MIXED.search(text):
        for w in _WORD.finditer(text):
            if _MIXED.search(w.group()):
                out.append((w.start(), w.end(), ""))
    for s, only in _ONLY.items() if disguised else ():
        if any(_SURE[o].search(text) for o in SCRIPTS if o != s):
            for w in only.finditer(text):
                a = text.rfind("\n", 0, w.start()) + 1
                b = text.find("\n", w.end())
                around = line_script(text[a : b if b >= 0 else None])
                if around not in (None, s) and all(ch in TO[around] for ch in w.group()):
                    out.append((w.start(), w.end(), around))
    return sorted(out)


def options(word: str, around: str) -> list[str]:
    """Spellings of a suspect in one script, the word's dominant script first; only those that every letter allows."""
    if around:
        return ["".join(TO[around][ch] for ch in word)]
    count = dict.fromkeys(SCRIPTS, 0)
    for ch in word:
        if (s := script(ch)) in count:
            count[s] += 1
    out = []
    for s in sorted((s for s in SCRIPTS if count[s]), key=lambda s: -count[s]):
        got = [ch if script(ch) == s else TO[s].get(ch) for ch in word]
        if None not in got:
            out.append("".join(got))
    return out


SCANNED = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("form", pa.string()), ("print", pa.binary()), ("suspects", pa.list_(pa.string()))])
_SCANNED_SQL = "kind string, id bigint, form string, print binary, suspects array<string>"
_EDGE = re.compile(f"^[^{_ANY}]+|[^{_ANY}]+$")


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _scan(batches: Iterator[pa.RecordBatch], keep_text: bool, strict: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``kind, id, text`` in; each row's simple form (or its print) with its suspects out, and in the end the words seen."""
    words: set[str] = set()

    def vocabulary() -> Iterator[pa.RecordBatch]:
        own = sorted({v for w in words for v in _WORD.findall(w) if not _MIXED.search(v)})
        words.clear()
        for i in range(0, len(own), 20000):
            part = own[i : i + 20000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * n), pa.nulls(n, pa.int64()), pa.array(part), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.string()))], schema=SCANNED)

    for b in batches:
        forms, prints, found = [], [], []
        for t in b.column(2).to_pylist():
            f = simple_form(t)
            words.update(f.split())
            s = sorted({f"{around}\t{f[a:e]}" for a, e, around in suspects(f, not strict)}) if not f.isascii() else []
            keep = keep_text or s
            forms.append(f if keep else None)
            prints.append(None if s else _digest(f))
            found.append(s)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(prints, pa.binary()), pa.array(found, pa.list_(pa.string()))], schema=SCANNED)
        if len(words) > 200_000:
            yield from vocabulary()
    yield from vocabulary()


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(s, i, o, len(opts)) for s in b.column(0).to_pylist() for opts in [options(s.partition("\t")[2], s.partition("\t")[0])] for i, o in enumerate(opts)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["suspect", "place", "option", "n_options"])


def _apply(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms, prints = [], []
        for f, befores, afters in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            to = dict(zip(befores or [], afters or []))
            out, at = [], 0
            for a, e, around in suspects(f, not strict):
                out += [f[at:a], to.get(f"{around}\t{f[a:e]}", f[a:e])]
                at = e
            done = "".join(out) + f[at:]
            forms.append(done)
            prints.append(_digest(done))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(prints, pa.binary())], names=["kind", "id", "form", "print"])


def unify(texts: DataFrame, keep_text: bool = True, strict: bool = True) -> DataFrame:
    """``kind, id, form, print``: the one form of each text and 128 bits that are equal for equal forms.

    ``texts``: ``kind, id, text``. Width of characters, kind of space, composition of accents,
    typographic ligatures and invisible characters are settled character by character. Words
    of mixed script are spelt in one script if every letter has a look-alike there and that
    spelling occurs in the corpus as a word of one script: in the word's dominant script
    if it does, else in another. Case, digits, accents, words and the length of dashes are
    never touched. With ``keep_text`` false ``form`` is null for texts without such words.

    ``strict`` false goes beyond that: a mixed word that only one script can spell is respelt
    though the corpus does not have it, and words made of look-alikes only are respelt in the
    script of their line.

    Defined cases: null texts give no row; empty texts have the empty form; texts of any length
    are processed whole; ids repeat as given; no rows give no rows.

    How it scales: one pass over the texts, which also gives each task's distinct words. Only
    texts with suspects go on: their distinct suspects meet the vocabulary in a join by word,
    and come back to their texts by a join on id, so nothing that grows with the corpus is
    collected or broadcast.
    """
    scanned = cut(texts.where(F.col("text").isNotNull()).select("kind", F.col("id").cast("bigint").alias("id"), "text").mapInArrow(lambda it: _scan(it, keep_text, strict), _SCANNED_SQL))
    vocabulary = scanned.where("kind = 'word'").select(F.col("form").alias("option")).distinct()
    rows = scanned.where("kind <> 'word'")
    clean = rows.where(F.size("suspects") == 0).select("kind", "id", "form", "print")
    dirty = rows.where(F.size("suspects") > 0).select("kind", "id", "form", "suspects")
    proposed = dirty.select(F.explode("suspects").alias("suspect")).distinct().mapInArrow(_propose, "suspect string, place int, option string, n_options int")
    known = proposed.join(vocabulary.withColumn("known", F.lit(True)), "option", "left")
    usable = known.where(F.col("known")) if strict else known.where(F.col("known") | (F.col("n_options") == 1))
    chosen = usable.groupBy("suspect").agg(F.min_by("option", F.struct(F.col("known").isNull(), F.col("place"))).alias("option"))
    pairs = dirty.select("kind", "id", F.explode("suspects").alias("suspect")).distinct().join(chosen, "suspect").groupBy("kind", "id").agg(F.collect_list(F.struct("suspect", "option")).alias("pairs"))
    mended = (
        dirty.join(pairs, ["kind", "id"], "left")
        .select("kind", "id", "form", F.col("pairs.suspect").alias("befores"), F.col("pairs.option").alias("afters"))
        .mapInArrow(lambda it: _apply(it, strict), "kind string, id bigint, form string, print binary")
    )
    return clean.unionByName(mended)


def prints(texts: DataFrame) -> DataFrame:
    """``kind, id, print, raw``: 128 bits of each text's form and of the text itself."""
    forms = unify(texts, keep_text=False).select("kind", "id", "print")
    raw = texts.where(F.col("text").isNotNull()).select("kind", F.col("id").cast("bigint").alias("id"), F.unhex(F.md5("text")).alias("raw"))
    return cut(forms.join(raw, ["kind", "id"]))


def look_same(prints: DataFrame) -> DataFrame:
    """``kind, id_a, id_b`` of texts of one kind that differ as strings and have one form.

    ``prints`` is what the function of that name gives. Forms with one string only, however
    many copies, are left out before the join; the rest are joined on the form, where Spark's
    skew join splits a large group, and only different strings are paired.
    """
    several = prints.groupBy("kind", "print").agg((F.min("raw") != F.max("raw")).alias("several")).where("several").select("kind", "print")
    live = prints.join(several, ["kind", "print"], "left_semi")
    a, b = live.alias("a"), live.alias("b")
    met = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.print") == F.col("b.print")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.raw") != F.col("b.raw")))
    return met.select(F.col("a.kind").alias("kind"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def look_alike_classes(prints: DataFrame) -> DataFrame:
    """``kind, id, class_id, n_strings, n_texts``: for each text the smallest id of its form, and how many
    different strings and how many texts have that form. One row per text, whatever the size of a class."""
    raws = prints.groupBy("kind", "print", "raw").agg(F.count("*").alias("c"), F.min("id").alias("low"))
    forms = raws.groupBy("kind", "print").agg(F.count("*").alias("n_strings"), F.sum("c").alias("n_texts"), F.min("low").alias("class_id"))
    return prints.join(forms, ["kind", "print"]).select("kind", "id", "class_id", "n_strings", "n_texts")
