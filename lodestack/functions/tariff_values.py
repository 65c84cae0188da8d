"""Canonical forms of the ten tariff values, as Spark columns.

Two written values have equal canonical forms exactly when they say the same:
grouping of digits, decimal comma, kind of space and dash, name of a currency,
unit of a term and the many ways to say "no charge" do not matter. A missing
value (absent, null, blank, ``NOT_FOUND``) is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How currencies are written, needle pattern -> code.
CURRENCY_NEEDLES = [
    (r"\bamd\b|֏|դրամ|драм|\bdram", "AMD"),
    (r"\busd\b|\$|դոլար|доллар|dollar", "USD"),
    (r"\beur\b|€|եվրո|евро|\beuros?\b", "EUR"),
    (r"\brub\b|\brur\b|₽|ռուբլ|рубл|\bruble", "RUB"),
]
# Phrases meaning that nothing is charged.
FREE_PHRASES = r"անվճար|չի գանձվում|բացակայում|бесплатно|без комиссии|не взимается|\bfree\b|no charge|no fee|without charge|gratuit|kostenlos|безкоштовно"
YEAR_UNIT = r"[0-9]\s*(տարի|տարվա|год|лет|года|year)"
DAY_UNIT = r"[0-9]\s*(օր|дн|день|day)"

_SPACES = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_HIDDEN = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"
_DASHES = r"[\u2010-\u2015\u2212]"


def tidy(value: Column) -> Column:
    """Lower case, one kind of dash, single plain spaces, no invisible characters."""
    v = F.regexp_replace(F.regexp_replace(value, _HIDDEN, ""), _SPACES, " ")
    return F.trim(F.lower(F.regexp_replace(v, _DASHES, "-")))


def present(value: Column) -> Column:
    """The tidied value, NULL when it says nothing."""
    t = tidy(value)
    return F.when((t == "") | t.isin("not_found", "null", "none"), F.lit(None)).otherwise(t)


def _decimals(t: Column) -> Column:
    """The numbers of a text that has decimals but no grouping, as canonical strings."""
    found = F.regexp_extract_all(t, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.coalesce(F.replace(x, F.lit(","), F.lit(".")).try_cast("double").cast("string"), x))


def _integers(t: Column) -> Column:
    """The numbers of an amount text, grouping removed."""
    found = F.regexp_extract_all(t, F.lit(r"[0-9]{1,3}(?:[ ,.'][0-9]{3})+(?![0-9])|[0-9]+(?:[.,][0-9]{1,2}(?![0-9]))?"), F.lit(0))

    def one(x: Column) -> Column:
        grouped = x.rlike(r"^[0-9]{1,3}([ ,.'][0-9]{3})+$")
        plain = F.when(grouped, F.regexp_replace(x, r"[ ,.']", "")).otherwise(F.replace(x, F.lit(","), F.lit(".")))
        return F.coalesce(plain.try_cast("double").cast("string"), x)

    return F.transform(found, one)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _span(numbers: Column) -> Column:
    """``a`` for one number, ``a..b`` for the ends of several; a range of equal ends is one number."""
    return let(
        numbers,
        lambda n: F.when(F.size(n) == 0, F.lit(None)).when(n[0] == F.element_at(n, -1), n[0]).otherwise(F.array_join(n, "..")),
    )


def currency_codes(t: Column) -> Column:
    """Sorted distinct currency codes that a tidied text names."""
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(c)) for p, c in CURRENCY_NEEDLES]))


def canonical(value: Column, kind: str) -> Column:
    """The canonical form of ``value`` under a field kind of the registry.

    Nulls, blanks and ``NOT_FOUND`` give NULL; a text that does not have its
    kind's shape falls back to itself, tidied.
    """
    return let(present(value), lambda t: F.when(t.isNotNull(), _shaped(t, kind)))


def _shaped(t: Column, kind: str) -> Column:
    codes = F.array_join(currency_codes(t), "/")
    if kind == "currency":
        return let(codes, lambda c: F.when(c != "", c).otherwise(t))
    if kind == "percent":
        return F.coalesce(F.concat(_span(_decimals(t)), F.lit("%")), t)
    if kind == "term":
        unit = F.when(t.rlike(YEAR_UNIT), F.lit(12.0)).otherwise(F.lit(1.0))
        months = F.transform(_decimals(t), lambda x: (x.try_cast("double") * unit).cast("string"))
        return F.coalesce(F.concat(_span(months), F.when(t.rlike(DAY_UNIT), F.lit("d")).otherwise(F.lit("m"))), t)
    if kind == "amount":
        return let(_span(_integers(t)), lambda n: F.when(n.isNotNull(), F.concat(n, F.lit(" "), codes)).otherwise(t))
    if kind == "fee":
        pct = t.contains("%")
        number = F.when(pct, F.concat(_span(_decimals(t)), F.lit("%"))).otherwise(_span(_integers(t)))

        def fee(n: Column) -> Column:
            zero = F.replace(n, F.lit("%"), F.lit("")).try_cast("double") == 0
            return (
                F.when(zero | (n.isNull() & t.rlike(FREE_PHRASES)), F.lit("0"))
                .when(n.isNull(), t)
                .when(pct, n)
                .otherwise(F.concat(n, F.lit(" "), codes))
            )

        return let(number, fee)
    return t


# The ten fields and their kinds.
TARIFF_KINDS = {
    "currency": "currency",
    "term": "term",
    "amount": "amount",
    "nominal_rate": "percent",
    "effective_rate": "percent",
    "collateral": "text",
    "application_fee": "fee",
    "disbursement_fee": "fee",
    "service_fee": "fee",
    "salary_privileges": "text",
}


def payload_variant(payload: Column) -> Column:
    """The payload as VARIANT, NULL when it is not valid JSON."""
    return F.try_parse_json(payload)


def payload_value(doc: Column, field: str) -> Column:
    """A field's written value in either schema: an object with ``value``, or a plain string."""
    inner = F.try_variant_get(doc, f"$.fields.{field}.value", "string")
    plain = F.try_variant_get(doc, f"$.fields.{field}", "string")
    return F.coalesce(inner, F.when(~plain.startswith("{"), plain))


def payload_canonical(doc: Column) -> list[Column]:
    """The ten canonical values of a parsed payload, in registry order."""
    return [canonical(payload_value(doc, f), k).alias(f) for f, k in TARIFF_KINDS.items()]


def fingerprint(cols: list[Column]) -> Column:
    """128 bits that are equal for equal lists of values, NULLs included."""
    return F.unhex(F.md5(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("\u0000")) for c in cols])))
