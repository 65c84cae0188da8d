"""Shapes and normal forms of values as they are written in running text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.tariff_values import let
from lodestack.functions.text import SPACE

# What a value of each kind looks like.
PERCENT = r"[0-9]{1,3}(?:[.,][0-9]{1,2})?\s?%"
AMOUNT = r"[0-9]{1,3}(?:[ ,.][0-9]{3})+|[0-9]{4,}"
CURRENCY = r"(?iu)ՀՀ\s*դրամ|դրամ|AMD|USD|EUR|ԱՄՆ\s*դոլար|դոլար|եվրո|արտարժույթ"
TERM = r"(?iu)[0-9]{1,3}\s*(?:ամիս|ամսվա|տարի|տարվա|months?|years?)"
FREE = r"(?iu)անվճար|չի\s*գանձվում|չի\s*կիրառվում|0\s?%"
COLLATERAL = r"(?iu)գրավ|երաշխավոր|ապահովվածություն|ապահովում|collateral|pledge"
SALARY = r"(?iu)աշխատավարձ|աշխատավարձային|salary|payroll"
SHAPES = {
    "percent": [[PERCENT]],
    "amount": [[AMOUNT], [CURRENCY]],
    "currency": [[CURRENCY]],
    "term": [[TERM]],
    "fee": [[PERCENT, AMOUNT, FREE]],
    "text": [[COLLATERAL, SALARY]],
}
# How values are parsed.
PERCENT_VALUE = r"([0-9]{1,3}(?:[.,][0-9]{1,3})?)\s*%?"
AMOUNT_VALUE = r"[0-9]{1,3}(?:[ ,.\u00A0][0-9]{3})+|[0-9]{4,}"
TERM_VALUE = r"(?iu)([0-9]{1,4})\s*(?:-|–|—)?\s*(?:ից|-ից)?\s*(?:-|–|—)?\s*([0-9]{1,4})?\s*(ամիս|ամսվա|տարի|տարվա|months?|years?)"
UP_TO = r"(?iu)մինչև|մինչն|առավելագույն|max(?:imum)?|up\s+to"
YEARS = r"(?iu)^(տարի|տարվա|year)"
CURRENCIES = [("ՀՀ դրամ", "AMD"), ("դրամ", "AMD"), ("AMD", "AMD"), ("ԱՄՆ դոլար", "USD"), ("դոլար", "USD"), ("USD", "USD"), ("եվրո", "EUR"), ("EUR", "EUR"), ("ռուբլի", "RUB"), ("RUB", "RUB")]
FOREIGN = r"(?iu)արտարժույթ|foreign currency"
NO_CHARGE = r"(?iu)անվճար|չի\s*գանձվում|չի\s*կիրառվում|առկա\s*չէ|չկա|առանց\s+[^։.\n]{0,60}?(?:վճար|միջնորդավճար)|free\b|not\s+applicable|no\s+fee"
BARE_ZERO = r"^0(?:[.,]0+)?$"
MONTHS_PER_YEAR = 12.0


def has_shape(text: Column, kind: Column | str) -> Column:
    """Whether a text has a value of the kind: for each list of patterns one must match."""
    def one(k: str) -> Column:
        out = F.lit(True)
        for options in SHAPES[k]:
            any_of = F.lit(False)
            for p in options:
                any_of = any_of | text.rlike(p)
            out = out & any_of
        return out

    if isinstance(kind, str):
        return one(kind)
    out = F.lit(None).cast("boolean")
    for k in SHAPES:
        out = F.when(kind == k, one(k)).otherwise(out)
    return out


def _trimmed(value: Column) -> Column:
    t = F.trim(value)
    return F.when(t != "", t)


def _least(numbers: Column, body: Callable[[Column], Column]) -> Column:
    return let(numbers, lambda n: F.when(F.size(n) > 0, body(n)))


def percent(value: Column) -> Column:
    """``min, max`` of the percentages between 0 and 100; NULL without percent sign or word."""
    t = _trimmed(value)
    found = F.transform(F.regexp_extract_all(t, F.lit(PERCENT_VALUE), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    kept = F.filter(found, lambda x: (x >= 0) & (x <= 100))
    return F.when(t.rlike("(?iu)%|տոկոս"), _least(kept, lambda n: F.struct(F.array_min(n).alias("min"), F.array_max(n).alias("max"))))


def codes(value: Column) -> Column:
    """Currency codes in the order of the list of spellings, ``UNSPECIFIED`` where only foreign currency is named; NULL without any."""
    low = F.lower(value)
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.instr(low, needle.lower()) > 0, F.lit(code)) for needle, code in CURRENCIES])))
    return let(named, lambda n: F.when(F.size(n) > 0, n).when(value.rlike(FOREIGN), F.array(F.lit("UNSPECIFIED"))))


def amount(value: Column) -> Column:
    """``min, max, currency`` of the grouped or long numbers, their grouping dropped."""
    t = _trimmed(value)
    found = F.transform(F.regexp_extract_all(t, F.lit(AMOUNT_VALUE), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", "").try_cast("double"))
    return _least(found, lambda n: F.struct(F.array_min(n).alias("min"), F.array_max(n).alias("max"), F.get(codes(value), F.lit(0)).alias("currency")))


def term(value: Column) -> Column:
    """``min_months, max_months`` of the first term; one number after "up to" starts at 0; a year has 12 months."""
    t = _trimmed(value)
    group = lambda i: F.regexp_extract(t, TERM_VALUE, i)
    factor = F.when(group(3).rlike(YEARS), MONTHS_PER_YEAR).otherwise(1.0)
    first, second = group(1).try_cast("double") * factor, group(2).try_cast("double") * factor
    low = F.when(second.isNotNull(), F.least(first, second)).when(t.rlike(UP_TO), 0.0).otherwise(first)
    return F.when(first.isNotNull(), F.struct(low.alias("min_months"), F.greatest(first, F.coalesce(second, first)).alias("max_months")))


def fee(value: Column) -> Column:
    """``kind, min, max, currency``: nothing charged (zero), a percentage or an amount; NULL if unreadable."""
    t = _trimmed(value)
    free = t.rlike(NO_CHARGE)
    nonzero = F.replace(t, F.lit("0"), F.lit("")).rlike(r"[0-9]{1,3}(?:[.,][0-9]{1,3})?\s*%?")
    row = lambda k, lo, hi, c: F.struct(F.lit(k).alias("kind"), lo.alias("min"), hi.alias("max"), c.alias("currency"))
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    p, a = percent(value), amount(value)
    return (
        F.when(free & ~nonzero, row("none", zero, zero, none))
        .when(t.rlike(BARE_ZERO), row("none", zero, zero, none))
        .when(p.isNotNull(), row("percent", p["min"], p["max"], none))
        .when(a.isNotNull(), row("amount", a["min"], a["max"], a["currency"]))
        .when(free, row("none", zero, zero, none))
    )


# Armenian month stems and phrases that introduce a document's date.
MONTHS = ["հունվար", "փետրվար", "մարտ", "ապրիլ", "մայիս", "հունիս", "հուլիս", "օգոստոս", "սեպտեմբեր", "հոկտեմբեր", "նոյեմբեր", "դեկտեմբեր"]
DATE_MARKERS = ["թարմացվել", "ուժի մեջ", "հաստատման", "updated", "effective"]
DOTTED = r"([0-9]{1,2})\s*\.\s*([0-9]{1,2})\s*\.\s*([0-9]{4})"
SLASHED = r"([0-9]{1,2})\s*/\s*([0-9]{1,2})\s*/\s*([0-9]{2,4})"
ARMENIAN_DATE = r"(?iu)([0-9]{4})\s*թ\.?\s*([ա-ֆԱ-Ֆ]+?)(?:ի|in)?\s*([0-9]{1,2})"
EDITION = r"(?:Խմբագրություն|խմբագրություն|Edition|edition)\s*[:\s]\s*([0-9]{1,4})"
DATE_WINDOW = 220


def _built(y: Column, m: Column, d: Column) -> Column:
    """A date of the years 2000 to 2100, NULL if there is none such."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((y >= 2000) & (y <= 2100), F.try_to_date(text, "yyyy-MM-dd"))


def date_in(fragment: Column) -> Column:
    """The first dotted date of a fragment, else an Armenian one, else a slashed one."""
    num = lambda p, i: F.regexp_extract(fragment, p, i).try_cast("int")
    month = F.lit(None).cast("int")
    name = F.lower(F.regexp_extract(fragment, ARMENIAN_DATE, 2))
    for i, stem in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(name.startswith(stem), i).otherwise(month)
    year = num(SLASHED, 3)
    year = F.when(year < 100, year + 2000).otherwise(year)
    return (
        F.when(fragment.rlike(DOTTED), _built(num(DOTTED, 3), num(DOTTED, 2), num(DOTTED, 1)))
        .when(fragment.rlike(ARMENIAN_DATE) & month.isNotNull(), _built(num(ARMENIAN_DATE, 1), month, num(ARMENIAN_DATE, 3)))
        .when(fragment.rlike(SLASHED), _built(year, num(SLASHED, 2), num(SLASHED, 1)))
    )


def document_date(text: Column) -> Column:
    """The date within ``DATE_WINDOW`` characters of the first phrase, in list order, that has one."""
    low = F.lower(text)
    per_marker = []
    for marker in DATE_MARKERS:
        # pieces between occurrences of the marker: each begins where one stands
        pieces = F.slice(F.split(low, marker, -1), 2, 1_000_000)
        rest = F.transform(pieces, lambda x, i: date_in(F.left(F.array_join(F.slice(pieces, i + 1, 4), marker), F.lit(DATE_WINDOW - len(marker)))))
        per_marker.append(F.get(F.filter(rest, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*per_marker)


def edition(text: Column) -> Column:
    """The edition number a document states, NULL without one."""
    e = F.regexp_extract(text, EDITION, 1)
    return F.when(e != "", e)


def digits_of(text: Column) -> Column:
    """Every number of a text as digits only, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[0-9](?:[0-9.,]|{SPACE})*[0-9]|[0-9]"), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")


def numbers_are_real(quote: Column, passage: Column) -> Column:
    """Whether a quote states no number that the passage does not; null texts state none."""
    said = lambda x: F.coalesce(digits_of(x), F.array().cast("array<string>"))
    return F.size(F.array_except(said(quote), said(passage))) == 0
