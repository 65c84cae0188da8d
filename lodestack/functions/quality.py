"""How usable extracted text is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a full text, letters' share of one, words of a line, and the limits of defects.
MIN_CHARS, LETTER_SHARE, IDEAL_WORDS = 200, 0.7, 6.0
GLUED_CHARS, GLUED, ONE_WORD, FEW_LETTERS, UNREADABLE, TOO_SHORT = 25, 0.3, 1.5, 0.3, 0.05, 50
PENALTIES = [("too_short", 0.3), ("glued_words", 0.2), ("one_word_per_line", 0.3), ("few_letters", 0.3), ("unreadable_characters", 0.2)]


def signals(text: Column) -> Column:
    """Characters, letter and bad-character shares, words a line, share of glued words; NULL text counts as empty."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n\f\u000b"))
    words = F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")
    ink = F.length(F.regexp_replace(t, r"\s+", ""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    bad = F.regexp_count(t, F.lit(r"[\uFFFD\u0000-\u0008\u000B-\u001F\u007F-\u009F]"))
    glued = F.size(F.filter(words, lambda w: F.length(w) > GLUED_CHARS))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return F.struct(
        F.length(t).alias("chars"),
        ratio(letters, ink).alias("letter_ratio"),
        ratio(F.size(words), F.size(lines)).alias("words_per_line"),
        ratio(glued, F.size(words)).alias("glued_ratio"),
        ratio(bad, F.length(t)).alias("bad_ratio"),
        F.size(lines).alias("lines"),
    )


def score(s: Column) -> Column:
    """Score and defects from ``signals``, which should be a column of its own by then."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    base = 0.45 * clamp(s["chars"] / F.lit(float(MIN_CHARS))) + 0.30 * clamp(s["letter_ratio"] / LETTER_SHARE) + 0.25 * clamp((s["words_per_line"] - 1.0) / (IDEAL_WORDS - 1.0))
    has = [
        s["chars"] < TOO_SHORT,
        s["glued_ratio"] > GLUED,
        (s["words_per_line"] < ONE_WORD) & (s["lines"] > 5),
        s["letter_ratio"] < FEW_LETTERS,
        s["bad_ratio"] > UNREADABLE,
    ]
    penalty = F.lit(1.0)
    for (_, p), h in zip(PENALTIES, has):
        penalty = penalty * F.when(h, p).otherwise(1.0)
    defects = F.array_compact(F.array(*[F.when(h, F.lit(n)) for (n, _), h in zip(PENALTIES, has)]))
    empty = s["chars"] == 0
    return F.struct(F.when(empty, 0.0).otherwise(F.round(clamp(base * penalty), 4)).alias("score"), F.when(empty, F.array().cast("array<string>")).otherwise(defects).alias("defects"))
