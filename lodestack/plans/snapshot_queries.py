"""Queries over the snapshot history (problems 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import tariff_values as tv
from lodestack.operators.deliveries import delivery_changes
from lodestack.operators.history import version_history
from lodestack.session import table


def readings(spark: SparkSession, sf: str, columns: bool = False) -> DataFrame:
    """Every snapshots row with the fingerprint of its ten values, or with ``columns`` the values themselves;
    ``is_reading`` where the payload is valid JSON and not rejected."""
    said = tv.payload_canonical(F.col("doc"))
    doc = table(spark, sf, "snapshots", heavy=True).select("id", "bank", "product_id", "run_id", "taken_at", "document_date", "status", tv.payload_variant(F.col("payload")).alias("doc"))
    taken = F.to_date("taken_at")
    stated = F.when(F.col("document_date") <= taken, F.col("document_date"))
    return doc.select(
        "id",
        "bank",
        "product_id",
        "run_id",
        "taken_at",
        F.coalesce(stated, taken).alias("reading_date"),
        (F.col("doc").isNotNull() & F.coalesce(F.col("status") != "rejected", F.lit(True))).alias("is_reading"),
        *(said if columns else [tv.fingerprint(said).alias("state")]),
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per version of a product."""
    r = readings(spark, sf).where("is_reading")
    h = version_history(r, "product_id", "reading_date", ["taken_at", "id"], "state")
    return h.select("product_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def p3_history(spark: SparkSession, sf: str) -> DataFrame:
    """The full history: each version with its period."""
    r = readings(spark, sf).where("is_reading")
    h = version_history(r, "product_id", "reading_date", ["taken_at", "id"], "state")
    return h.select("product_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return delivery_changes(readings(spark, sf, columns=True), "bank", "run_id", "product_id", ["taken_at", "id"], list(tv.TARIFF_KINDS), "is_reading")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """What each delivery of a bank changed against the one before."""
    return _changes(spark, sf).select("run_id", "product_id", "change_type")


def p4_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the ten values each changed product changed."""
    return _changes(spark, sf).where("change_type = 'changed'").select("run_id", "product_id", F.array_join("columns", ",").alias("columns"))


_TIDY = r"trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '[\x{{2010}}-\x{{2015}}\x{{2212}}]', '-', 'g')))"
_DEC = "list_transform(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?'), lambda a: CAST(replace(a, ',', '.') AS DOUBLE))"
_INT = r"list_transform(regexp_extract_all(t, '[0-9]{1,3}(?:[ ,.''][0-9]{3})+\b|[0-9]+'), lambda a: CAST(regexp_replace(a, '[^0-9]', '', 'g') AS DOUBLE))"
_CUR = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{n}') THEN '{c}' END" for n, c in tv.CURRENCY_NEEDLES) + "], lambda z: z IS NOT NULL), '/')"
_ENDS = "CASE WHEN len({0}) = 0 THEN NULL WHEN ({0})[1] = ({0})[-1] THEN CAST(({0})[1] AS VARCHAR) ELSE array_to_string(list_transform({0}, lambda y: CAST(y AS VARCHAR)), '..') END"


def _canonical_sql(kind: str) -> str:
    """The canonical form of ``t`` in SQL, for the values that the tables hold."""
    dec, whole = _ENDS.format(_DEC), _ENDS.format(_INT)
    if kind == "currency":
        return f"coalesce(nullif({_CUR}, ''), t)"
    if kind == "percent":
        return f"coalesce({dec} || '%', t)"
    if kind == "term":
        months = f"list_transform({_DEC}, lambda m: m * CASE WHEN regexp_matches(t, '{tv.YEAR_UNIT}') THEN 12 ELSE 1 END)"
        return f"coalesce({_ENDS.format(months)} || 'm', t)"
    if kind == "amount":
        return f"coalesce({whole} || ' ' || {_CUR}, t)"
    if kind == "fee":
        n = f"CASE WHEN contains(t, '%') THEN {dec} || '%' ELSE {whole} END"
        return f"CASE WHEN t IS NULL THEN NULL WHEN TRY_CAST(replace({n}, '%', '') AS DOUBLE) = 0 OR (({n}) IS NULL AND regexp_matches(t, '{tv.FREE_PHRASES}')) THEN '0' WHEN ({n}) IS NULL THEN t WHEN contains(t, '%') THEN {n} ELSE ({n}) || ' ' || {_CUR} END"
    return "t"


def _value_sql(field: str, kind: str) -> str:
    raw = f"CASE json_type(payload, '$.fields.{field}') WHEN 'OBJECT' THEN json_extract_string(payload, '$.fields.{field}.value') ELSE json_extract_string(payload, '$.fields.{field}') END"
    return f"(SELECT {_canonical_sql(kind)} FROM (SELECT CASE WHEN x NOT IN ('', 'not_found', 'null', 'none') THEN x END AS t FROM (SELECT {_TIDY.format(raw)} AS x)))"


_STATE = " || chr(31) || ".join(f"coalesce({_value_sql(f, k)}, chr(30))" for f, k in tv.TARIFF_KINDS.items())
_READ = f"""r AS (SELECT id, bank, product_id, run_id, taken_at, CASE WHEN document_date <= CAST(taken_at AS DATE) THEN document_date ELSE CAST(taken_at AS DATE) END AS d,
valid AND status <> 'rejected' AS ok, CASE WHEN valid THEN {_STATE} END AS state FROM (SELECT * REPLACE (CASE WHEN json_valid(payload) THEN payload ELSE '{{}}' END AS payload), json_valid(payload) AS valid FROM snapshots))"""

QUERIES = {"p3_found": p3_found, "p3_history": p3_history, "p4_found": p4_found, "p4_columns": p4_columns}
_VERSIONS = f"""WITH {_READ}, d AS (SELECT product_id, d, arg_max(state, (taken_at, id)) AS state FROM r WHERE ok GROUP BY ALL),
v AS (SELECT product_id, d, state, lag(state) OVER w AS before, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY product_id ORDER BY d)), s AS (SELECT product_id, d FROM v WHERE n = 1 OR state <> before)"""
_DELIVERED = f"""WITH {_READ}, q AS (SELECT bank, run_id, row_number() OVER (PARTITION BY bank ORDER BY min(taken_at), run_id) AS n FROM r GROUP BY bank, run_id),
p AS (SELECT bank, run_id, product_id, arg_max(state, (taken_at, id)) FILTER (ok) AS state FROM r GROUP BY ALL),
k AS (SELECT bank, product_id, n, last_value(state IGNORE NULLS) OVER (PARTITION BY bank, product_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM p JOIN q USING (bank, run_id)),
c AS (SELECT coalesce(a.bank, b.bank) AS bank, coalesce(a.product_id, b.product_id) AS product_id, coalesce(b.n, a.n + 1) AS n, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.state IS DISTINCT FROM b.state THEN 'changed' END AS change_type, a.state AS old, b.state AS new FROM k a FULL JOIN k b ON a.bank = b.bank AND a.product_id = b.product_id AND a.n + 1 = b.n)"""
ORACLE_SQL: dict[str, str] = {
    "p3_found": f"{_VERSIONS} SELECT product_id, strftime(d, '%Y-%m-%d') AS valid_from FROM s",
    "p3_history": f"{_VERSIONS} SELECT product_id, strftime(d, '%Y-%m-%d') AS valid_from, strftime(lead(d) OVER (PARTITION BY product_id ORDER BY d), '%Y-%m-%d') AS valid_to FROM s",
    "p4_found": f"""{_DELIVERED}
SELECT q.run_id, c.product_id, c.change_type FROM c JOIN q ON c.bank = q.bank AND c.n = q.n WHERE c.change_type IS NOT NULL AND c.n > 1""",
    "p4_columns": f"""{_DELIVERED}
SELECT q.run_id, c.product_id, array_to_string(list_filter({list(tv.TARIFF_KINDS)!r}, lambda x, i: (c.old IS NULL) <> (c.new IS NULL) OR string_split(c.old, chr(31))[i] <> string_split(c.new, chr(31))[i]), ',') AS columns FROM c JOIN q ON c.bank = q.bank AND c.n = q.n WHERE c.change_type = 'changed' AND c.n > 1""",
}
