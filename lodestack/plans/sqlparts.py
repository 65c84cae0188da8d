"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

from lodestack.functions import text as t
from lodestack.functions import values as v


SPACE = r"[\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    """A SQL string literal; DuckDB's patterns fold case of all letters without being told to."""
    return "'" + s.replace("(?iu)", "(?i)").replace("'", "''") + "'"


def fold(x: str) -> str:
    return casefold(f"replace(nfc_normalize({x}), 'և', 'ն')")


def casefold(x: str) -> str:
    """Case folding in SQL: lower case, and the letters and ligatures of the tables' scripts that fold otherwise."""
    out = f"lower({x})"
    for ch in "ßςևﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ":
        out = f"replace({out}, '{ch}', '{ch.casefold()}')"
    return out


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def stem(x: str) -> str:
    whens = " ".join(f"WHEN suffix({x}, {q(s)}) AND length({x}) - {len(s)} >= {t.MIN_STEM} THEN left({x}, length({x}) - {len(s)})" for s in t.SUFFIXES)
    return f"CASE WHEN regexp_matches({x}, '[0-9]') THEN {x} {whens} ELSE {x} END"


def tokens(x: str) -> str:
    stop = ", ".join(map(q, t.stopwords()))
    raw = f"regexp_extract_all({fold(x)}, {q(t.TOKEN)})"
    return f"list_filter(list_transform(list_filter({raw}, lambda a: a NOT IN ({stop})), lambda b: {stem('b')}), lambda c: c <> '')"


def shape(x: str, kind: str) -> str:
    return " AND ".join("(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in options) + ")" for options in v.SHAPES[kind])


def rows(values: list[tuple], names: str) -> str:
    """A literal table."""
    def one(x) -> str:
        return "NULL" if x is None else q(x) if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values) + f") AS t({names})"
