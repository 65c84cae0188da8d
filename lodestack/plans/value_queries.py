"""Values: normal forms, quotes, validation, differences, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import values as v
from lodestack.operators import extraction as x
from lodestack.operators import snapshots
from lodestack.plans import sqlparts as s
from lodestack.session import table


def _after(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "field_changes").select("change_id", F.col("after").alias("said"))


def normalize_percent(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf).select("change_id", v.percent(F.col("said")).alias("p")).select("change_id", "p.min", "p.max")


def normalize_amount(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf).select("change_id", v.amount(F.col("said")).alias("p")).select("change_id", "p.min", "p.max", "p.currency")


def normalize_term(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf).select("change_id", v.term(F.col("said")).alias("p")).select("change_id", "p.min_months", "p.max_months")


def normalize_currency(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf).select("change_id", F.array_join(v.codes(F.col("said")), "/").alias("codes"))


def normalize_fee(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf).select("change_id", v.fee(F.col("said")).alias("p")).select("change_id", "p.kind", "p.min", "p.max")


def numbers_are_real(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "field_changes")
    return c.select("change_id", v.numbers_are_real(F.col("after"), F.col("before")).alias("real"))


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunk_vectors").where("text IS NOT NULL")
    return c.select("vec_id", "doc_id", F.substring("text", 5, 60).alias("quote"))


def _places(spark: SparkSession, sf: str, quotes: DataFrame) -> DataFrame:
    pages = table(spark, sf, "doc_pages").select("page_id", "doc_id", "text")
    met = quotes.join(pages, "doc_id")
    return met.where(x.occurs(F.col("quote"), F.col("text"))).select("vec_id", "page_id").distinct()


def quote_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of its document on which the quote of each chunk stands."""
    return _places(spark, sf, _quotes(spark, sf))


def quote_verify(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunk_vectors").where("text IS NOT NULL").select("vec_id", "doc_id", "text")
    passages = chunks.select(F.col("doc_id").alias("grp"), F.col("vec_id").alias("passage_id"), "text")
    asked = chunks.where("length(text) > 60").select(F.col("vec_id").alias("answer_id"), F.col("doc_id").alias("grp"), F.translate(F.substring("text", 3, 50), "ae", "eo").alias("quote"), F.col("vec_id").alias("cited"))
    return x.verify_quotes(asked, passages)


def rule_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "doc_pages", heavy=True).select("doc_id", "page_id", "text")
    return x.rule_extract(pages, "doc_id", "page_id", "text", F.lower("sentence").rlike("rate|ставка|տոկոսադրույք"), "percent").select("doc_id", F.col("chunk_ord").alias("page_id"), "quote", "value")


def _ends(n: str):
    p, a, m = v.percent(F.col(n)), v.amount(F.col(n)), v.term(F.col(n))
    lo = F.when(F.col("value_kind") == "percent", p["min"]).when(F.col("value_kind") == "amount", a["min"]).when(F.col("value_kind") == "term", m["min_months"])
    hi = F.when(F.col("value_kind") == "percent", p["max"]).when(F.col("value_kind") == "amount", a["max"]).when(F.col("value_kind") == "term", m["max_months"])
    return F.struct(lo.alias("min"), hi.alias("max"))


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "field_changes")
    kinds = table(spark, sf, "tariff_fields").select("field_id", F.col("kind").alias("value_kind"))  # ten rows
    return c.join(F.broadcast(kinds), "field_id")


def validate_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every changed value against the limits of its kind; evidence counts as approved for products of some banks."""
    f = _kinds(spark, sf).select("change_id", F.col("value_kind").alias("kind"), F.col("after").alias("value"), _ends("after").alias("e"), F.coalesce(F.col("product_id") < "t", F.lit(False)).alias("hosts_ok"))
    checked = x.validate_values(f.select("change_id", "kind", "value", "e.min", "e.max", "hosts_ok"))
    return checked.select("change_id", F.array_join("problems", ",").alias("problems"), "status")


def effective_below_nominal(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose effective rate is below their nominal one."""
    f = _kinds(spark, sf).select("product_id", "field_id", _ends("after").alias("e"), F.col("change_id").alias("ord"))
    return x.rate_problems(f.select("product_id", "field_id", "e.min", "e.max", "ord"), "product_id", "nominal_rate", "effective_rate")


def conflict_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and years in which returned and other items were sold in quantities that do not overlap."""
    li = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("/", "l_partkey", F.year("l_shipdate")))
    side = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy("k").agg(F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))
    return x.conflicts(side("A"), side("R"), "k")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "tariff_fields").select("field_id", "is_required")
    c = table(spark, sf, "field_changes").join(F.broadcast(fields), "field_id").select("product_id", "is_required", (F.coalesce("after", F.lit("NOT_FOUND")) != "NOT_FOUND").alias("is_found"))
    return x.completeness(c, "product_id")


def snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "reviews").select("id", "product_id", F.col("decided_at").alias("at"))
    facts = table(spark, sf, "snapshots").where("status <> 'rejected'").groupBy("product_id", F.col("taken_at").alias("at")).agg(F.max("id").alias("snapshot"))
    return x.as_of(probes, facts, "product_id", "at", ["snapshot"]).select("id", "product_id", "snapshot_before")


def review_memory(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reviews").where("decision <> 'deferred'").select("product_id", "trigger", "subject", "decision", "decided_at", "id")
    return x.latest_by(r, ["product_id", "trigger", "subject"], ["decided_at", "id"]).select("product_id", "trigger", "subject", "decision", "id")


def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "field_changes").select("product_id", "field_id", F.col("after").alias("value"), "change_id")
    stored = x.latest_by(c, ["product_id", "field_id"], ["change_id"]).select("product_id", "field_id", "value")
    return snapshots.migrate(stored, table(spark, sf, "tariff_fields"), "product_id")


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "field_changes")
    side = lambda n: c.select("change_id", F.col(n).alias("value"), v.percent(F.col(n)).cast("string").alias("norm"))
    return snapshots.diff_fields(side("before"), side("after"), ["change_id"]).select("change_id", "kind")


def diff_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    e = _kinds(spark, sf).select("change_id", "value_kind", _ends("before").alias("p"), _ends("after").alias("c"))
    m = e.select("change_id", "value_kind", snapshots.magnitude(F.col("value_kind"), F.col("p"), F.col("c")).alias("size"))
    return m.select("change_id", "value_kind", F.round("size", 1).alias("magnitude"), snapshots.significance(F.col("value_kind"), F.round("size", 1)).alias("significance"))


def variant_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Balances labelled by nation: those of suppliers against those of customers, whose labels are written otherwise."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")  # one row per nation
    at = lambda t, c, key, bal, label: table(spark, sf, t).join(F.broadcast(n), F.col(c) == F.col("n_nationkey")).select((F.col(key) % 5).alias("grp"), label.alias("label"), F.floor(bal).alias("value"), F.col(key).alias("ord"))
    name = F.col("n_name")
    return snapshots.variant_diff(at("supplier", "s_nationkey", "s_suppkey", "s_acctbal", name), at("customer", "c_nationkey", "c_custkey", "c_acctbal", F.concat(F.lit(" "), F.lower(name), F.lit("."))), "grp")


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 100).alias("large"), F.round(F.sum("value"), 2).alias("total"), F.round(F.try_divide(F.count_if(F.col("value") > 100).cast("double"), F.count("*").cast("double")), 6).alias("share"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    p = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    tag = lambda d, w: d.select("k", F.lit(w).alias("what"))
    return tag(c.intersect(p), "both").unionByName(tag(n.exceptAll(p), "no_supplier")).unionByName(tag(c.union(p).distinct(), "any"))


_C = "field_changes"
_PCT = r"list_filter(list_transform(regexp_extract_all(trim({0}), '([0-9]{{1,3}}(?:[.,][0-9]{{1,3}})?)\s*%?', 1), lambda a: TRY_CAST(replace(a, ',', '.') AS DOUBLE)), lambda b: b BETWEEN 0 AND 100)"
_HASP = "regexp_matches(trim({0}), '(?i)%|տոկոս')"
_AMT = r"list_transform(regexp_extract_all(trim({0}), '[0-9]{{1,3}}(?:[ ,.\x{{A0}}][0-9]{{3}})+|[0-9]{{4,}}'), lambda a: TRY_CAST(regexp_replace(a, '[^0-9]', '', 'g') AS DOUBLE))"
_TERM = s.q(v.TERM_VALUE)


def _pmin(c: str) -> str:
    return f"CASE WHEN {_HASP.format(c)} THEN list_min({_PCT.format(c)}) END"


def _pmax(c: str) -> str:
    return f"CASE WHEN {_HASP.format(c)} THEN list_max({_PCT.format(c)}) END"


def _codes(c: str) -> str:
    named = "list_filter([" + ", ".join(f"CASE WHEN instr(lower({c}), {s.q(n.lower())}) > 0 THEN '{k}' END" for n, k in v.CURRENCIES) + "], lambda z: z IS NOT NULL)"
    order = "['AMD', 'USD', 'EUR', 'RUB']"
    kept = f"list_filter({order}, lambda y: list_contains({named}, y))"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN len({named}) > 0 THEN {kept} WHEN regexp_matches({c}, {s.q(v.FOREIGN)}) THEN ['UNSPECIFIED'] END"


def code_list(c: str) -> str:
    """The currencies that a text names, in SQL."""
    return _codes(c)


def _tfac(c: str) -> str:
    return f"(CASE WHEN regexp_matches(regexp_extract(trim({c}), {_TERM}, 3), {s.q(v.YEARS)}) THEN 12.0 ELSE 1.0 END)"


def _t(c: str, i: int) -> str:
    return f"(TRY_CAST(regexp_extract(trim({c}), {_TERM}, {i}) AS DOUBLE) * {_tfac(c)})"


def _tmin(c: str) -> str:
    return f"CASE WHEN {_t(c, 2)} IS NOT NULL THEN least({_t(c, 1)}, {_t(c, 2)}) WHEN {_t(c, 1)} IS NULL THEN NULL WHEN regexp_matches(trim({c}), {s.q(v.UP_TO)}) THEN 0.0 ELSE {_t(c, 1)} END"


def _tmax(c: str) -> str:
    return f"greatest({_t(c, 1)}, coalesce({_t(c, 2)}, {_t(c, 1)}))"


def _digits(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[0-9](?:[0-9.,]|{s.SPACE})*[0-9]|[0-9]'), lambda a: regexp_replace(a, '[^0-9]', '', 'g')), lambda b: b <> '')"


_FREE = f"regexp_matches(trim(after), {s.q(v.NO_CHARGE)})"
_NONZERO = r"regexp_matches(replace(trim(after), '0', ''), '[0-9]{1,3}(?:[.,][0-9]{1,3})?\s*%?')"
_ZERO = f"regexp_matches(trim(after), {s.q(v.BARE_ZERO)})"
_FEE = f"CASE WHEN after IS NULL OR trim(after) = '' THEN NULL WHEN {_FREE} AND NOT {_NONZERO} THEN 'none' WHEN {_ZERO} THEN 'none' WHEN {_pmin('after')} IS NOT NULL THEN 'percent' WHEN len({_AMT.format('after')}) > 0 THEN 'amount' WHEN {_FREE} THEN 'none' END"
_SIDE = "CASE value_kind WHEN 'percent' THEN {p} WHEN 'amount' THEN {a} WHEN 'term' THEN {t} END"

_SIDES = ", ".join(f"CASE t.kind WHEN 'percent' THEN {(_pmin if n == 'lo' else _pmax)('after')} WHEN 'amount' THEN {'list_min' if n == 'lo' else 'list_max'}({_AMT.format('after')}) WHEN 'term' THEN {(_tmin if n == 'lo' else _tmax)('after')} END AS {n}" for n in ("lo", "hi"))

QUERIES = {
    "normalize_percent": normalize_percent, "normalize_amount": normalize_amount, "normalize_term": normalize_term, "normalize_currency": normalize_currency, "normalize_fee": normalize_fee,
    "numbers_are_real": numbers_are_real, "quote_exact": quote_exact, "quote_verify": quote_verify, "rule_extract": rule_extract, "validate_ranges": validate_ranges, "effective_below_nominal": effective_below_nominal, "conflict_detect": conflict_detect,
    "completeness": completeness, "snapshot_asof": snapshot_asof, "review_memory": review_memory, "schema_migration": schema_migration, "snapshot_diff": snapshot_diff, "diff_magnitude": diff_magnitude,
    "variant_diff": variant_diff, "run_metrics": run_metrics, "set_operations": set_operations,
}
ORACLE_SQL = {
    "normalize_percent": f"SELECT change_id, {_pmin('after')} AS min, {_pmax('after')} AS max FROM {_C}",
    "normalize_amount": f"SELECT change_id, list_min({_AMT.format('after')}) AS min, list_max({_AMT.format('after')}) AS max, CASE WHEN len({_AMT.format('after')}) > 0 THEN ({_codes('after')})[1] END AS currency FROM {_C}",
    "normalize_term": f"SELECT change_id, {_tmin('after')} AS min_months, {_tmax('after')} AS max_months FROM {_C}",
    "normalize_currency": f"SELECT change_id, array_to_string({_codes('after')}, '/') AS codes FROM {_C}",
    "normalize_fee": f"WITH f AS (SELECT *, {_FEE} AS fk FROM {_C}) SELECT change_id, fk AS kind, CASE fk WHEN 'none' THEN 0.0 WHEN 'percent' THEN {_pmin('after')} WHEN 'amount' THEN list_min({_AMT.format('after')}) END AS min, CASE fk WHEN 'none' THEN 0.0 WHEN 'percent' THEN {_pmax('after')} WHEN 'amount' THEN list_max({_AMT.format('after')}) END AS max FROM f",
    "numbers_are_real": f"SELECT change_id, len(list_filter({_digits('after')}, lambda d: NOT list_contains({_digits('before')}, d))) = 0 AS real FROM {_C}",
    "quote_exact": f"WITH c AS (SELECT vec_id, doc_id, {s.squeeze('substr(text, 5, 60)')} AS quote FROM chunk_vectors WHERE text IS NOT NULL) SELECT DISTINCT vec_id, page_id FROM c JOIN doc_pages p USING (doc_id) WHERE quote <> '' AND instr({s.squeeze('p.text')}, quote) > 0",
    "validate_ranges": "WITH e AS (SELECT change_id, t.kind AS kind, product_id, after, " + _SIDES + " FROM field_changes f JOIN tariff_fields t USING (field_id)), c AS (SELECT *, after IS NULL OR upper(trim(after)) IN ('', 'NOT_FOUND') AS gone, CASE kind WHEN 'percent' THEN 100 WHEN 'term' THEN 600 END AS most FROM e), b AS (SELECT change_id, gone, CASE WHEN gone THEN '' ELSE array_to_string(list_filter([CASE WHEN coalesce(product_id < 't', false) THEN NULL ELSE 'evidence_host' END, CASE WHEN kind NOT IN ('percent', 'amount', 'term') THEN NULL WHEN lo IS NULL OR hi IS NULL THEN 'unreadable' WHEN lo > hi THEN 'unordered' END, CASE WHEN lo < 0 THEN 'too_low' END, CASE WHEN hi > most AND lo IS NOT NULL THEN 'too_high' END], lambda z: z IS NOT NULL), ',') END AS problems FROM c) SELECT change_id, problems, CASE WHEN gone THEN 'not_found' WHEN problems <> '' THEN 'unverified' ELSE 'found' END AS status FROM b",
    "effective_below_nominal": "WITH e AS (SELECT change_id, t.kind AS kind, product_id, field_id, after, " + _SIDES + " FROM field_changes f JOIN tariff_fields t USING (field_id)), p AS (SELECT product_id, arg_max(lo, change_id) FILTER (field_id = 'nominal_rate' AND lo IS NOT NULL) AS lo, arg_max(hi, change_id) FILTER (field_id = 'effective_rate' AND hi IS NOT NULL) AS hi FROM e GROUP BY ALL) SELECT product_id, lo, hi FROM p WHERE hi < lo",
    "conflict_detect": "WITH s AS (SELECT l_returnflag AS f, l_partkey || '/' || year(l_shipdate) AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) SELECT p.k, p.lo AS primary_min, p.hi AS primary_max, q.lo AS supporting_min, q.hi AS supporting_max FROM s p JOIN s q ON p.k = q.k AND p.f = 'A' AND q.f = 'R' WHERE (p.hi < q.lo OR q.hi < p.lo) AND NOT (p.hi = 0 AND q.hi = 0)",
    "completeness": "WITH c AS (SELECT product_id, is_required, coalesce(after, 'NOT_FOUND') <> 'NOT_FOUND' AS found FROM field_changes JOIN tariff_fields USING (field_id)) SELECT product_id, count(*) FILTER (is_required) AS n_required, count(*) FILTER (is_required AND found) AS n_found, round(count(*) FILTER (is_required AND found)::DOUBLE / nullif(count(*) FILTER (is_required), 0), 6) AS completeness FROM c GROUP BY ALL",
    "snapshot_asof": "WITH f AS (SELECT product_id, taken_at, max(id) AS snapshot FROM snapshots WHERE status <> 'rejected' GROUP BY ALL) SELECT r.id, r.product_id, f.snapshot AS snapshot_before FROM reviews r ASOF LEFT JOIN f ON r.product_id = f.product_id AND r.decided_at > f.taken_at",
    "review_memory": "SELECT product_id, trigger, subject, decision, id FROM reviews WHERE decision <> 'deferred' QUALIFY row_number() OVER (PARTITION BY product_id, trigger, subject ORDER BY decided_at DESC, id DESC) = 1",
    "schema_migration": "WITH l AS (SELECT product_id, field_id, after FROM field_changes QUALIFY row_number() OVER (PARTITION BY product_id, field_id ORDER BY change_id DESC) = 1), g AS (SELECT product_id, field_id FROM (SELECT DISTINCT product_id FROM l), tariff_fields) SELECT product_id, field_id, CASE WHEN upper(trim(coalesce(after, 'NOT_FOUND'))) IN ('', 'NOT_FOUND') THEN 'NOT_FOUND' ELSE after END AS value, CASE WHEN upper(trim(coalesce(after, 'NOT_FOUND'))) IN ('', 'NOT_FOUND') THEN 'not_found' ELSE 'found' END AS status FROM g LEFT JOIN l USING (product_id, field_id)",
    "snapshot_diff": f"WITH c AS (SELECT change_id, coalesce(before, 'NOT_FOUND') AS before, coalesce(after, 'NOT_FOUND') AS after, ({_pmin('before')})::VARCHAR || '-' || ({_pmax('before')})::VARCHAR AS b, ({_pmin('after')})::VARCHAR || '-' || ({_pmax('after')})::VARCHAR AS a, lower({s.squeeze('before')}) AS sb, lower({s.squeeze('after')}) AS sa FROM field_changes), k AS (SELECT change_id, CASE WHEN before = 'NOT_FOUND' AND after = 'NOT_FOUND' THEN NULL WHEN before = 'NOT_FOUND' THEN 'appeared' WHEN after = 'NOT_FOUND' THEN 'disappeared' WHEN a IS NOT NULL AND b IS NOT NULL AND a = b THEN NULL WHEN (a IS NULL OR b IS NULL) AND sa = sb THEN NULL ELSE 'value' END AS kind FROM c) SELECT change_id, kind FROM k WHERE kind IS NOT NULL",
    "diff_magnitude": "WITH e AS (SELECT change_id, t.kind AS value_kind, before, after FROM field_changes f JOIN tariff_fields t USING (field_id)), r AS (SELECT change_id, value_kind, "
    + ", ".join(f"{_SIDE.format(p=(_pmin if n == 'lo' else _pmax)(c), a=('list_min' if n == 'lo' else 'list_max') + '(' + _AMT.format(c) + ')', t=(_tmin if n == 'lo' else _tmax)(c))} AS {n}_{c}" for c in ("before", "after") for n in ("lo", "hi"))
    + " FROM e), m AS (SELECT change_id, value_kind, CASE WHEN value_kind = 'percent' THEN round_even(lo_after - lo_before, 4) WHEN value_kind = 'amount' AND hi_before <> 0 THEN round_even((hi_after - hi_before) / hi_before * 100, 2) WHEN value_kind = 'term' THEN round_even(hi_after - hi_before, 2) END AS size FROM r) SELECT change_id, value_kind, round(size, 1) AS magnitude, CASE WHEN coalesce((value_kind = 'percent' AND abs(round(size, 1)) > 2.0) OR (value_kind = 'amount' AND abs(round(size, 1)) > 25.0), false) THEN 'large' ELSE 'notable' END AS significance FROM m",
    "variant_diff": "WITH v AS (SELECT 's' AS t, s_suppkey % 5 AS grp, lower(n_name) AS label, CAST(floor(s_acctbal) AS BIGINT) AS value, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'c', c_custkey % 5, lower(n_name), CAST(floor(c_acctbal) AS BIGINT), c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT t, grp, replace(label, '_', '') AS label, arg_max(value, ord) AS value FROM v GROUP BY ALL), d AS (SELECT coalesce(p.grp, c.grp) AS grp, coalesce(p.label, c.label) AS label, CASE WHEN c.value IS NULL THEN 'gone' WHEN p.value IS NULL THEN 'new' WHEN p.value <> c.value THEN 'moved' END AS change FROM (FROM l WHERE t = 's') p FULL JOIN (FROM l WHERE t = 'c') c ON p.grp = c.grp AND p.label = c.label) SELECT grp, label, change FROM d WHERE change IS NOT NULL",
    "run_metrics": "SELECT event_type, count(*) AS calls, count(*) FILTER (value > 100) AS large, round(sum(value), 2) AS total, round(count(*) FILTER (value > 100)::DOUBLE / count(*), 6) AS share FROM events GROUP BY ALL",
    "set_operations": "WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), p AS (SELECT DISTINCT s_nationkey AS k FROM supplier), n AS (SELECT n_nationkey AS k FROM nation) SELECT k, 'both' AS what FROM (SELECT k FROM c INTERSECT SELECT k FROM p) UNION ALL SELECT k, 'no_supplier' FROM (SELECT k FROM n EXCEPT ALL SELECT k FROM p) UNION ALL SELECT k, 'any' FROM (SELECT k FROM c UNION SELECT k FROM p)",
}
