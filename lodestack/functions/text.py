"""Text columns: folding, tokens, stems, cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inflectional suffixes, tried in this order; at most one is taken off.
SUFFIXES = [
    "ներիս", "ներիդ", "ներին", "ներից", "ներով", "ներում", "ները", "ների", "ներ",
    "ությամբ", "ությունից", "ությունը", "ություն",
    "ին", "ից", "ով", "ում", "ու", "ը", "ն", "ի",
]
MIN_STEM = 3
# Function words that are no tokens, before folding.
STOPWORDS = [
    "և", "եւ", "որ", "որը", "է", "են", "էր", "այլ", "կամ", "նաև", "իսկ",
    "այս", "այդ", "այն", "ու", "թե", "ին", "մեջ", "համար", "հետ", "առ", "ն",
    "the", "and", "or", "of", "for", "in", "on", "to", "a", "an", "is", "are",
]
TOKEN = r"[0-9][0-9.,]*%?|\p{L}+"
# Spaces that text has besides the plain one, and the private-use bullet.
ODD_SPACES = "\u00a0\u2007\u2009\u202f\u2002\u2003\u2005"
BULLET = "\uf0b7"
QUERY_PUNCTUATION = r"""[«»„“”"'`՝․,.!?;:()\[\]{}/\\|_—–-]+"""
MAX_QUERY = 200


# White space as Unicode has it: Java's own class knows ASCII only.
SPACE = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _class_of(changes: Callable[[str], bool]) -> str:
    """A pattern class of the characters of the basic plane for which ``changes`` holds, as ranges."""
    points = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and changes(chr(c))]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends)) + "]"


# Characters that canonical composition may change or join to the one before, and those whose folded form is not the lower-case one.
_COMPOSES = _class_of(lambda ch: unicodedata.combining(ch) > 0 or unicodedata.normalize("NFC", ch) != ch or 0x1160 <= ord(ch) <= 0x11FF or unicodedata.category(ch) == "Mc") + "|[\\x{10000}-\\x{10FFFF}]"
_FOLDS = _class_of(lambda ch: ch.casefold() != ch.lower()) + "|[\\x{10000}-\\x{10FFFF}]"


def _each(f: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


_nfc, _casefold = _each(lambda x: unicodedata.normalize("NFC", x)), _each(str.casefold)


def nfc(text: Column) -> Column:
    """Canonical composition. Only texts with a character that it may change reach Python, the rest stay in the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(_COMPOSES), text)), text)


def casefold(text: Column) -> Column:
    """Full case folding: the lower case, and in Python the texts with one of the few characters that fold otherwise."""
    return F.coalesce(_casefold(F.when(text.rlike(_FOLDS), text)), F.lower(text))


def fold(text: Column) -> Column:
    """The form used for comparison: composed, the ligature U+0587 read as U+0576, case folded."""
    return casefold(F.replace(nfc(text), F.lit("և"), F.lit("ն")))


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def stem(token: Column) -> Column:
    """A token without the first suffix of the list that leaves ``MIN_STEM`` letters; tokens with digits stay.

    One pattern does it: of two suffixes that both end a token one ends the other, and the list has
    the longer one first, so the shortest possible beginning is the one the list order gives.
    """
    ends = "|".join(SUFFIXES)
    return F.when(token.rlike("[0-9]"), token).otherwise(F.regexp_replace(token, f"^(.{{{MIN_STEM},}}?)(?:{ends})$", "$1"))


def stopwords() -> list[str]:
    """The stop list, folded as tokens are."""
    return sorted({w.replace("և", "ն").casefold() for w in STOPWORDS})


def tokenize(text: Column) -> Column:
    """Numbers with their separators and percent sign, and runs of letters; stop words dropped, then stems.

    Null gives null, a text without tokens an empty array.
    """
    raw = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    kept = F.filter(raw, lambda t: ~t.isin(*stopwords()))
    return F.filter(F.transform(kept, stem), lambda t: t != "")


def normalize_query(text: Column) -> Column:
    """A name as typed: cut to ``MAX_QUERY``, punctuation to spaces, collapsed, lower case."""
    return casefold(squeeze(F.regexp_replace(nfc(F.left(text, F.lit(MAX_QUERY))), QUERY_PUNCTUATION, " ")))


def normalize_chars(text: Column) -> Column:
    """Composed; private-use bullet to a bullet, private-use characters out, odd spaces plain, one kind of line end, blanks collapsed."""
    t = F.replace(nfc(text), F.lit(BULLET), F.lit("•"))
    t = F.regexp_replace(t, "[\uE000-\uF8FF]", "")
    t = F.regexp_replace(t, f"[{ODD_SPACES}]", " ")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]{2,}", " ")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def clean_cell(text: Column) -> Column:
    """A table cell on one line."""
    return squeeze(normalize_chars(text))


def label_fold(text: Column) -> Column:
    """A label's letters, digits and spaces, lower case."""
    return F.regexp_replace(F.lower(squeeze(text)), r"[^\p{L}\p{N} ]", "")


# Lines that are only a page number.
PAGE_NUMBER = r"(?iu)^\s*(?:[0-9]{1,3}|[0-9]{1,3}\s*/\s*[0-9]{1,3}|էջ\s*[0-9]{1,3}\s*(?:/\s*[0-9]{1,3})?|page\s*[0-9]{1,3}\s*(?:of\s*[0-9]{1,3})?|-\s*[0-9]{1,3}\s*-)\s*$"


def strip_page_numbers(text: Column) -> Column:
    """The text without lines that are only a page number."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")


# A line that ends a sentence, and one that starts a list item.
SENTENCE_END = r"[.!?:։՝;]\s*$"
LIST_START = r"^\s*(?:[•\-–—*]|[0-9]{1,2}[.)]|[ա-ֆ][.)])\s+"


def join_broken_lines(text: Column) -> Column:
    """Lines wrapped in mid-sentence rejoined, as a left fold: a hyphen at the end joins without a
    space, an open line with one; list items, blank lines and ended sentences stay apart."""

    def step(acc: Column, raw: Column) -> Column:
        line = F.rtrim(raw)
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (line == "") | (F.trim(last) == "") | line.rlike(LIST_START) | last.rlike(SENTENCE_END)
        joined = F.when(last.endswith("-"), F.concat(F.left(last, F.length(last) - 1), F.ltrim(line))).otherwise(F.concat(last, F.lit(" "), F.ltrim(line)))
        return F.when(apart, F.concat(acc, F.array(line))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))

    lines = F.split(text, "\n", -1)
    # element_at of an empty array raises, so the fold starts from the first line
    start = F.slice(F.transform(lines, F.rtrim), 1, 1)
    return F.array_join(F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, step), "\n")


def repair_split_numbers(text: Column) -> Column:
    """Digit groups of three that are one number joined; other groups, such as telephone numbers, stay."""
    # Java's look-behind and look-ahead find a space between two groups of one whole number; every
    # group but the first has three digits, so a space is inside a number if what is left of it
    # reaches back over such groups to a start of one to three digits.
    inner = r"(?<=(?<![0-9,.])[0-9]{1,3}(?: [0-9]{3}){0,6}) (?=[0-9]{3}(?: [0-9]{3})*(?![0-9,.]))"
    return F.regexp_replace(text, inner, "")
