"""Rule-based extraction, quote verification, validation and conflicts between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.fuzzy import partial_ratio
from lodestack.functions.text import squeeze
from lodestack.functions.values import has_shape, numbers_are_real
from lodestack.operators.retrieval import ranked

# Least likeness of a quote, and the length under which only exact ones count.
QUOTE_LIKENESS, SHORT_QUOTE = 0.90, 8
# Value patterns by kind, and least length of a sentence.
VALUE = {
    "percent": r"[0-9]{1,3}(?:[.,][0-9]{1,2})?\s*(?:-|–)?\s*[0-9]{0,3}(?:[.,][0-9]{1,2})?\s*%",
    "amount": r"[0-9]{1,3}(?:[ ,.][0-9]{3})+(?:\s*(?:-|–)\s*[0-9]{1,3}(?:[ ,.][0-9]{3})+)?[^։.\n]{0,20}",
    "term": r"[0-9]{1,4}\s*(?:-|–|ից)?\s*[0-9]{0,4}\s*(?:ամիս|տարի)",
}
SENTENCE_CUT = r"(?<=[։.!?])\s+|\n"
LEAST_SENTENCE = 12
# Fixed value: the longest term in months that is taken for one.
MAX_TERM = 600.0


def sentences(chunks: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep, sent_ord, sentence``: the sentences of each chunk that are long enough to quote."""
    return chunks.select(*keep, F.posexplode(F.split(text, SENTENCE_CUT, -1)).alias("sent_ord", "sentence")).where(F.length(F.trim("sentence")) >= LEAST_SENTENCE)


def rule_extract(chunks: DataFrame, group: str, ord: str, text: str, mentions: Column, kind: str) -> DataFrame:
    """``group, chunk_ord, quote, value``: per group the first sentence that mentions the field and has a value of its kind.

    ``mentions`` is a predicate over ``sentence``; the value is what the kind's pattern finds, else the sentence.
    """
    found = sentences(chunks, [group, ord], text).where(mentions & has_shape(F.col("sentence"), kind))
    first = found.groupBy(group).agg(F.min_by(F.struct(ord, F.trim("sentence").alias("quote")), F.struct(ord, "sent_ord")).alias("b"))
    value = F.regexp_extract("quote", VALUE[kind], 0) if kind in VALUE else F.lit("")
    return first.select(group, F.col(f"b.{ord}").alias("chunk_ord"), F.col("b.quote").alias("quote")).withColumn("value", F.when(value == "", F.col("quote")).otherwise(F.trim(value)))


def occurs(quote: Column, text: Column) -> Column:
    """A quote's literal occurrence, apart from white space."""
    q = squeeze(quote)
    return (q != "") & (F.instr(squeeze(text), q) > 0)


def verify_quotes(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``answer_id, verified, corrected, passage_id, score`` of each quote.

    ``answers``: ``answer_id, grp, quote, cited``; ``passages``: ``grp, passage_id, text``, the few
    passages retrieved for the group. The cited passage counts first, then the best other one of the
    group (``corrected``). Exact occurrences are decided without the likeness UDF, which only sees
    the rest; a quote with a number its passage lacks scores 0; short quotes must occur exactly.
    """
    pairs = answers.join(passages, "grp").withColumn("exact", occurs(F.col("quote"), F.col("text")))
    exact = pairs.where("exact").withColumn("score", F.lit(1.0))
    done = exact.where("passage_id = cited").select("answer_id").distinct()
    rest = pairs.where(~F.col("exact") & (F.length("quote") >= SHORT_QUOTE)).join(done, "answer_id", "left_anti")
    near = rest.withColumn("score", partial_ratio(squeeze(F.col("quote")), squeeze(F.col("text"))) / 100)
    near = near.withColumn("score", F.when(numbers_are_real(F.col("quote"), F.col("text")), F.col("score")).otherwise(0.0))
    good = exact.unionByName(near).where(F.col("score") >= QUOTE_LIKENESS)
    best = ranked(good, 1, ["answer_id"], [F.desc(F.col("passage_id").eqNullSafe(F.col("cited"))), F.desc("score"), F.asc("passage_id")])
    return answers.select("answer_id", "cited").join(best.select("answer_id", "passage_id", "score"), "answer_id", "left").select("answer_id", F.col("passage_id").isNotNull().alias("verified"), F.coalesce(F.col("passage_id") != F.col("cited"), F.lit(False)).alias("corrected"), "passage_id", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


# Limits of a value's range by kind; no upper one where it is absent.
LIMITS = {"percent": (0.0, 100.0), "amount": (0.0, None), "term": (0.0, MAX_TERM)}


def validate_values(fields: DataFrame) -> DataFrame:
    """``fields`` with ``problems`` and ``status``: values that fail a check of their kind are ``unverified``.

    ``fields``: ``kind, value, min, max, hosts_ok`` (any more columns stay). A value that is absent, null or
    ``NOT_FOUND``, is ``not_found`` and not checked; a number that could not be read, a range out of order or
    limits, and evidence of a host that is not approved are problems; other kinds have no range.
    """
    kind = F.col("kind")
    absent = F.col("value").isNull() | (F.upper(F.trim("value")).isin("", "NOT_FOUND"))
    checks = F.array().cast("array<string>")
    for k, (least, most) in LIMITS.items():
        unread = F.col("min").isNull() | F.col("max").isNull()
        found = F.when(unread, F.array(F.lit("unreadable"))).otherwise(range_problems(F.col("min"), F.col("max"), least, most))
        checks = F.when(kind == k, found).otherwise(checks)
    host = F.when(F.col("hosts_ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("evidence_host")))
    problems = F.when(absent, F.array().cast("array<string>")).otherwise(F.concat(host, checks))
    return fields.withColumn("problems", problems).withColumn("status", F.when(absent, "not_found").when(F.size("problems") > 0, "unverified").otherwise("found"))


def rate_problems(fields: DataFrame, key: str, smaller: str, larger: str) -> DataFrame:
    """``key``: keys whose ``larger`` field, which includes the ``smaller`` one, ends below where that starts.

    ``fields``: ``key, field_id, min, max``; of a field given twice the last row by ``ord`` counts.
    """
    pick = lambda f, c: F.max_by(F.when(F.col("field_id") == f, F.col(c)), F.when(F.col("field_id") == f, F.col("ord")))
    both = fields.where(F.col("field_id").isin(smaller, larger)).groupBy(key).agg(pick(smaller, "min").alias("lo"), pick(larger, "max").alias("hi"))
    return both.where(F.col("hi") < F.col("lo")).select(key, "lo", "hi")


def range_problems(lo: Column, hi: Column, least: float, most: float | None) -> Column:
    """Names of the checks a range fails: order, lower and upper limit."""
    checks = [F.when(lo > hi, F.lit("unordered")), F.when(lo < least, F.lit("too_low"))]
    if most is not None:
        checks.append(F.when(hi > most, F.lit("too_high")))
    return F.array_compact(F.array(*checks))


def outside(variants: Column, lo: Column, hi: Column, tolerance: float = 0.01) -> Column:
    """Variants whose range leaves the headline's."""
    return F.filter(variants, lambda v: (v["max"] < lo - tolerance) | (v["min"] > hi + tolerance))


def ranges_conflict(a: Column, b: Column) -> Column:
    """Two ranges that do not overlap; a range without ends conflicts with none."""
    return F.coalesce((a["max"] < b["min"]) | (b["max"] < a["min"]), F.lit(False))


def conflicts(primary: DataFrame, supporting: DataFrame, key: str) -> DataFrame:
    """``key, primary_min, primary_max, supporting_min, supporting_max`` of values on which two sources disagree.

    Both inputs: ``key, min, max``. Two zeros agree; else ranges that do not overlap are a conflict.
    """
    p, s = primary.alias("p"), supporting.alias("s")
    both = p.join(s, key)
    zero = (F.col("p.max") == 0) & (F.col("s.max") == 0)
    apart = (F.col("p.max") < F.col("s.min")) | (F.col("s.max") < F.col("p.min"))
    return both.where(apart & ~zero).select(key, F.col("p.min").alias("primary_min"), F.col("p.max").alias("primary_max"), F.col("s.min").alias("supporting_min"), F.col("s.max").alias("supporting_max"))


def completeness(fields: DataFrame, group: str) -> DataFrame:
    """``group, n_required, n_found, completeness``: share of the required fields that were found; null where none is required."""
    need, got = F.count_if("is_required"), F.count_if(F.col("is_required") & F.col("is_found"))
    return fields.groupBy(group).agg(need.alias("n_required"), got.alias("n_found"), F.round(F.try_divide(got.cast("double"), need.cast("double")), 6).alias("completeness"))


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's last row, as an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def as_of(probes: DataFrame, facts: DataFrame, key: str, at: str, value: list[str]) -> DataFrame:
    """Each probe with the last fact of its key strictly before it.

    Probes and facts are united and swept in order, so no pair of them is ever made; ``value`` is null where there is none.
    """
    v = F.struct(*value)
    left = probes.withColumns({"__p": F.lit(1), "__v": F.lit(None).cast(facts.select(v.alias("v")).schema["v"].dataType.simpleString())})
    names = [c for c in probes.columns if c not in (key, at)]
    right = facts.select(key, at, *[F.lit(None).cast(probes.schema[c].dataType.simpleString()).alias(c) for c in names], F.lit(0).alias("__p"), v.alias("__v"))
    both = left.select(key, at, *names, "__p", "__v").unionByName(right)
    w = Window.partitionBy(key).orderBy(at, F.desc("__p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__p = 1")
    return swept.select(*probes.columns, *[F.col(f"__last.{c}").alias(f"{c}_before") for c in value])
