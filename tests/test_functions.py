"""Literal inputs and outputs of the column functions."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import fuzzy, quality, tariff_values, text, urls, values


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokenize(spark):
    assert one(spark, "The rate is 12.5% և վարկի ժամկետը", text.tokenize) == ["rate", "12.5%", "վարկ", "ժամկետ"]
    assert one(spark, "", text.tokenize) == []
    assert one(spark, None, text.tokenize) is None


def test_stem_takes_the_first_suffix_of_the_list(spark):
    def slow(t):
        if any(c.isdigit() for c in t):
            return t
        return next((t[: -len(s)] for s in text.SUFFIXES if t.endswith(s) and len(t) - len(s) >= text.MIN_STEM), t)

    stems = ["աբգ", "աբ", "վարկ", "ա"]
    words = [a + b + c for a, b, c in itertools.product(stems, [*text.SUFFIXES, ""], [*text.SUFFIXES, ""])] + ["12ներ", "ներ"]
    got = spark.createDataFrame([(w,) for w in words], "x string").select("x", text.stem(F.col("x")).alias("y")).collect()
    assert all(r["y"] == slow(r["x"]) for r in got)


@pytest.mark.parametrize(
    ("value", "kind", "same"),
    [
        ("13.45-15%", "percent", "13,45 – 15.00 %"), ("12 000 ֏", "fee", "12,000 ՀՀ դրամ"), ("անվճար", "fee", "0 AMD"), ("free", "fee", "бесплатно"),
        ("AMD / EUR", "currency", "amd,eur"), ("12-180 months", "term", "12 – 180 ամիս"), ("500 000 - 25 000 000 AMD", "amount", "500000-25\xa0000\xa0000 ֏"),
        ("Real  estate pledge", "text", " real estate pledge"), ("1 year", "term", "12 months"),
    ],
)
def test_values_that_say_the_same(spark, value, kind, same):
    f = lambda c: tariff_values.canonical(c, kind)
    assert one(spark, value, f) == one(spark, same, f) is not None


@pytest.mark.parametrize(("a", "b", "kind"), [("13%", "13.1%", "percent"), ("3 000 AMD", "3 000 USD", "fee"), ("1%", "1 AMD", "fee"), ("6-12 months", "6-120 months", "term"), ("two guarantors", "three guarantors", "text")])
def test_values_that_differ(spark, a, b, kind):
    f = lambda c: tariff_values.canonical(c, kind)
    assert one(spark, a, f) != one(spark, b, f)


@pytest.mark.parametrize("value", [None, "", "  ", "NOT_FOUND", "not_found"])
def test_missing_values(spark, value):
    for kind in ("percent", "amount", "term", "currency", "fee", "text"):
        assert one(spark, value, lambda c, k=kind: tariff_values.canonical(c, k)) is None


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (values.percent, "20.1-21.6%", (20.1, 21.6)), (values.percent, "13,5 %", (13.5, 13.5)), (values.percent, "250", None), (values.amount, "50.000-10.000.000 ՀՀ դրամ", (50000.0, 10000000.0, "AMD")),
        (values.term, "9-60 ամիս", (9.0, 60.0)), (values.term, "մինչև 240 ամիս", (0.0, 240.0)), (values.term, "3 տարի", (36.0, 36.0)), (values.term, "9-ից 60 ամիս", (9.0, 60.0)), (values.term, "nothing", None),
        (values.fee, "անվճար", ("none", 0.0, 0.0, None)), (values.fee, "0", ("none", 0.0, 0.0, None)), (values.fee, "0.5%", ("percent", 0.5, 0.5, None)), (values.fee, "5,000 AMD", ("amount", 5000.0, 5000.0, "AMD")),
        (values.codes, "ՀՀ դրամ և արտարժույթ", ["AMD"]), (values.codes, "foreign currency", ["UNSPECIFIED"]), (values.codes, "none", None),
    ],
)
def test_normal_forms(spark, f, value, expected):
    got = one(spark, value, f)
    assert (tuple(got) if hasattr(got, "asDict") else got) == expected


def test_dates(spark):
    d = lambda x: str(one(spark, x, values.document_date))
    assert d("Թարմացվել է առ՝ 15. 05.2023թ.") == "2023-05-15"
    assert d("Ուժի մեջ է 2026թ. ապրիլի 29-ից") == "2026-04-29"
    assert d("Հաստատման ամսաթիվ 23/04/26") == "2026-04-23"
    assert d("updated soon, later updated 1.2.2021") == "2021-02-01"
    assert d("15.05.2023") == d("updated 45.13.2023") == "None"
    assert one(spark, "Խմբագրություն 132", values.edition) == "132"


def test_numbers_are_real(spark):
    f = lambda q, p: spark.createDataFrame([(q, p)], "q string, p string").select(values.numbers_are_real(F.col("q"), F.col("p"))).first()[0]
    assert f("50,000 AMD", "50 000 AMD, 9-60 months")
    assert not f("9-600 ամիս", "9-60 ամիս")


def test_cleaning(spark):
    assert one(spark, "10 000 000 AMD, 10 59 10 10, 13, 5, 1 000", text.repair_split_numbers) == "10000000 AMD, 10 59 10 10, 13, 5, 1000"
    assert one(spark, "a\n12\nէջ 1/9\nPage 3 of 9\n- 3 -\nb 12", text.strip_page_numbers) == "a\nb 12"
    assert one(spark, "one two\nthree-\nfour.\nFive\n\n• six\nseven", text.join_broken_lines) == "one two threefour.\nFive\n\n• six seven"
    assert one(spark, "a b﻿c\r\n\n\n\nd", text.normalize_chars) == "a b﻿c\n\nd•"
    assert one(spark, "", text.join_broken_lines) == ""


def test_quality(spark):
    score = lambda x: spark.createDataFrame([(x,)], "x string").select(quality.signals(F.col("x")).alias("s")).select(quality.score(F.col("s")).alias("q")).first()["q"]
    good = "This is a sentence of ordinary words on a line.\n" * 10
    assert score(good)["score"] > 0.9 and score(good)["defects"] == []
    assert score("\n".join(["word"] * 60))["defects"] == ["one_word_per_line"]
    assert "glued_words" in score("averylongwordwithoutanyboundaries " * 10)["defects"]
    assert score(None)["score"] == score("  ")["score"] == 0


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.Bank.Example./A%20b/c-d_e?x=1#top", urls.normalize_url) == "https://www.bank.example/A%20b/c-d_e?x=1"
    assert one(spark, "https://b.example/loans/rural-house_two/", urls.slug_tokens) == "loans rural house two"
    assert one(spark, "https://b.example/x", urls.slug_tokens) == "x"
    allowed = lambda u: one(spark, u, lambda c: urls.is_allowed(c, ["https"], ["b.example"]))
    assert allowed("https://B.example/a") and not allowed("https://b.example:443/a") and not allowed("http://b.example/") and not allowed("https://a.b.example/") and not allowed(None)
    assert one(spark, "https://b.example/a+b%20c.pdf", urls.document_name) == "a+b c.pdf"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_lcs_against_the_table(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", min_size=1, max_size=6), st.text("abc ", min_size=1, max_size=12))
def test_partial_is_the_best_window(a, b):
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    want = max(200 * slow_lcs(s, w) / (len(s) + len(w)) for i in range(-len(s) + 1, len(l)) if (w := l[max(0, i) : i + len(s)]))
    assert fuzzy.partial(a, b) == pytest.approx(want, abs=12) and fuzzy.partial(a, b) <= want + 1e-9


def test_token_set():
    assert fuzzy.token_set("car loan", "loan car") == 100 == fuzzy.token_set("car", "car loan")
    assert fuzzy.token_set("", "a") == fuzzy.token_set(None, "a") == 0
    assert 0 < fuzzy.token_set("car lone", "car loan") < 100
