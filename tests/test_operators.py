"""Operators against brute force and on hand-made cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunking, cleaning, deliveries, discovery, extraction, history, html, retrieval, snapshots
from lodestack.sources import landing

DAY = dt.date(2020, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("period", ["year", "month"])
def test_version_history(spark, period):
    rng = random.Random(1)
    data = [(f"p{rng.randrange(4)}", DAY + dt.timedelta(days=rng.randrange(1500)), i, rng.choice("ab") if rng.random() < 0.95 else None) for i in range(600)]
    data += data[:20] + [(None, DAY, 1, "a"), ("p1", None, 1, "a")]
    last: dict = {}
    for e, d, t, s in data:
        if e and d:
            k = last.setdefault(e, {})
            if d not in k or (t, s or "") >= (k[d][0], k[d][1] or ""):
                k[d] = (t, s)
    want = []
    for e, k in last.items():
        kept = []
        for d in sorted(k):
            if not kept or kept[-1][1] != k[d][1]:
                kept.append((d, k[d][1]))
        want += [(e, d, kept[i + 1][0] if i + 1 < len(kept) else None, s) for i, (d, s) in enumerate(kept)]
    df = spark.createDataFrame(data, "e string, d date, t int, s string")
    got = history.version_history(df, "e", "d", ["t"], "s", period).select("e", "valid_from", "valid_to", "s").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert history.version_history(df.limit(0), "e", "d", ["t"], "s").count() == 0


def brute_changes(data):
    groups: dict = {}
    for g, run, k, t, s, ok in data:
        if run is not None and k is not None:
            groups.setdefault(g, {}).setdefault(run, []).append((t, s, ok, k))
    out = set()
    for g, runs in groups.items():
        order = sorted(runs, key=lambda r: (min(x[0] for x in runs[r]), r))
        last, before = {}, None
        for r in order:
            now = {}
            for t, s, ok, k in sorted(runs[r], key=lambda x: (x[0], x[1] or "")):
                now.setdefault(k, None)
                if ok:
                    now[k] = s
                    last[k] = s
            now = {k: s if any(o and kk == k for _, _, o, kk in runs[r]) else last.get(k) for k, s in now.items()}
            if before is not None:
                out |= {(g, r, k, "added") for k in now.keys() - before.keys()} | {(g, r, k, "removed") for k in before.keys() - now.keys()}
                out |= {(g, r, k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before = now
    return out


@pytest.mark.parametrize("block", [2, 3, 512])
def test_delivery_changes(spark, monkeypatch, block):
    rng = random.Random(block)
    at = dt.datetime(2020, 1, 1)
    data = []
    for g in ("a", "b", None):
        for n in range(17):
            t = at + dt.timedelta(hours=30 * n)
            data += [(g, f"{g}{n}", f"k{k}", t + dt.timedelta(minutes=k), rng.choice("xyz"), rng.random() < 0.8) for k in range(7) if rng.random() < 0.7]
    data += data[:9]
    df = spark.createDataFrame([*data, ("a", None, "k", at, "x", True), ("a", "a1", None, at + dt.timedelta(days=99), "x", True)], "g string, run string, k string, t timestamp, s string, ok boolean")
    monkeypatch.setattr(deliveries, "BLOCK", block)
    monkeypatch.setenv("LODESTACK_BLOCK", str(block))
    if block != 512:
        # workers import the module themselves; the block is small enough only in this process
        merged = _local_changes(df, block)
    else:
        merged = {tuple(r) for r in deliveries.delivery_changes(df, "g", "run", "k", ["t"], "s", "ok").collect()}
    assert merged == brute_changes(data)


def _local_changes(df, block):
    """The plan up to the merge by Spark, the merge itself in this process."""
    import pyarrow as pa

    kept = {}

    class Stop(Exception):
        pass

    real = type(df).mapInArrow

    def grab(self, f, schema):
        kept["t"] = self.orderBy("g", "k", "block", "seq").toArrow()
        raise Stop

    type(df).mapInArrow = grab
    try:
        deliveries.delivery_changes(df, "g", "run", "k", ["t"], "s", "ok")
    except Stop:
        pass
    finally:
        type(df).mapInArrow = real
    batches = [b for x in range(0, kept["t"].num_rows, 7) for b in kept["t"].slice(x, 7).combine_chunks().to_batches()]
    found = pa.Table.from_batches(list(deliveries._merge(iter(batches))), deliveries.CHANGES).to_pylist()
    own = df.where("run IS NOT NULL AND k IS NOT NULL").select(F.coalesce("g", F.lit("\u0000")).alias("g"), "run", F.col("t").alias("at"))
    seqs = {(r["g"], r["seq"]): r["run"] for r in deliveries.number_deliveries(own, "g", "run", "at").collect()}
    return {(None if r["g"] == "\u0000" else r["g"], seqs[r["g"], r["seq"]], r["k"], r["change_type"]) for r in found if (r["g"], r["seq"]) in seqs}


def test_as_of_is_strict_and_null_without_fact(spark):
    probes = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, at int")
    facts = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z")], "k string, at int, v string")
    assert rows(extraction.as_of(probes, facts, "k", "at", ["v"]).select("id", F.coalesce("v_before", F.lit("-")))) == [(1, "y"), (2, "-"), (3, "-")]


def test_latest_by(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, t int, v string")
    assert [tuple(r) for r in extraction.latest_by(df, ["k"], ["t", "v"]).orderBy("k").collect()] == [("a", 2, "z"), ("b", 1, None)]


def test_verify_quotes(spark):
    text = "The nominal rate is 20.1-21.6% a year.\nTerm 9-60 months for every customer of the bank."
    answers = [(1, "g", "nominal rate is 20.1-21.6%", "p1"), (2, "g", "Term 9-600 months for every customer", "p1"), (3, "g", "wholly different words that stand nowhere", "p1"), (4, "g", "nominal rate is 20.1-21.6%", "p2"), (5, "g", "AMD", "p1"), (6, "g", "Term 9-60 months for evry customer", "p1")]
    got = {r["answer_id"]: r for r in extraction.verify_quotes(spark.createDataFrame(answers, "answer_id int, grp string, quote string, cited string"), spark.createDataFrame([("g", "p1", text), ("g", "p2", "other text of the document")], "grp string, passage_id string, text string")).collect()}
    assert {k: r["verified"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert got[4]["corrected"] and not got[1]["corrected"]


def test_conflicts(spark):
    side = lambda d: spark.createDataFrame(d, "k int, min double, max double")
    got = extraction.conflicts(side([(1, 0.0, 0.0), (2, 1.0, 2.0), (3, 1.0, 5.0), (4, None, None)]), side([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 4.0, 9.0), (4, 1.0, 1.0)]), "k")
    assert rows(got.select("k")) == [(2,)]


def test_furniture_and_paragraphs(spark):
    pages = spark.createDataFrame([("d", i, f"Bank name\nbody {i} one\nbody {i} two\nbody {i} three\nfoot") for i in range(4)] + [("e", 9, "Bank name\nx\ny")], "doc string, page int, text string")
    assert rows(cleaning.furniture_lines(pages, "doc", "page", "text")) == [("d", "Bank name", 4), ("d", "foot", 4)]
    long = "x" * 130
    df = spark.createDataFrame([(1, f"{long}\n\nshort\n\n{long}\n\nshort"), (2, "")], "id int, text string")
    assert rows(cleaning.dedupe_paragraphs(df, "id", "text")) == [(1, f"{long}\n\nshort\n\nshort"), (2, "")]


def test_best_reading(spark):
    c = spark.createDataFrame([(1, "pdf_text", 0, 0.8, None), (1, "ocr", 1, 0.85, 90.0), (2, "pdf_text", 0, 0.5, None), (2, "ocr", 1, 0.7, 90.0), (3, "pdf_text", 0, 0.1, None), (3, "ocr", 1, 0.9, 50.0)], "p int, method string, ord int, score double, ocr_confidence double")
    assert rows(cleaning.best_reading(c, "p").select("p", "method")) == [(1, "pdf_text"), (2, "ocr"), (3, "pdf_text")]


@pytest.mark.parametrize("text", ["", "short", "word " * 700, "a" * 4000, "Sentence one. " * 300, ("para " * 60 + "\n\n") * 12, "1 000 000 " * 400])
def test_windows_cover_and_overlap(text):
    spans = list(chunking.windows(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d or not text
        assert b - a <= chunking.MAX_CHARS
        if text.startswith("1 000") is False and b < len(text):
            assert not (text[b - 1].isdigit() and text[b].isdigit())


def test_chunks_keep_offsets(spark):
    df = spark.createDataFrame([(1, "Alpha. " * 400), (2, None), (3, "")], "id int, text string")
    for r in chunking.chunk_texts(df, ["id"], "text").collect():
        assert r["id"] == 1 and ("Alpha. " * 400)[r["start_at"] : r["end_at"]].strip() == r["chunk"]


def test_split_table(spark):
    t = [["head", "x"]] + [[f"row {i}", "1"] for i in range(20)]
    got = spark.createDataFrame([(t,)], "t array<array<string>>").select(chunking.split_table(F.col("t"), 40).alias("g")).first()["g"]
    assert all(g[0] == ["head", "x"] for g in got) and [r for g in got for r in g[1:]] == t[1:]
    assert all(sum(len(" | ".join(r)) + 1 for r in g) <= 42 for g in got)


def test_html():
    p = html.read_page("<title>T</title><nav>menu</nav><h1>Head <b>two</b></h1><p>one<br>two<p>three &amp; four<table><tr><td>a<td>b<tr><td>c</table><a href='/x'>go</a><script>'</p>'</script>")
    assert p["title"] == "T" and p["text"] == "Head two\none\ntwo\nthree & four\ngo"
    assert p["tables"] == [[["a", "b"], ["c"]]] and p["headings"] == ["Head two"] and p["links"] == [{"href": "/x", "anchor": "go"}]
    assert html.read_page("<p>broken <b")["text"].startswith("broken")


def test_resolve_names(spark):
    names = spark.createDataFrame([("car", "Car loan", 0), ("car", "Auto credit", 1), ("home", "Home loan", 0)], "product_id string, name string, ord int")
    asked = spark.createDataFrame([(1, "car loan!"), (2, "loan"), (3, "zzzz qqqq"), (4, "  "), (5, "business car loan")], "query_id int, query string")
    got = {r["query_id"]: r for r in discovery.resolve_names(asked, names, ["business"]).collect()}
    assert got[1]["status"] == "resolved" and got[1]["product_id"] == "car"
    assert got[2]["status"] == "ambiguous" and got[3]["status"] == got[4]["status"] == "not_found" and got[5]["status"] == "not_found"


def test_score_sources(spark):
    links = [("https://b.example/a.pdf", "Information summary", "pdf", 0, 0), ("https://B.example/a.pdf#x", None, "pdf", 0, 1), ("https://b.example/news/1", "archive", "html", 5, 2)]
    got = {r["url"]: r for r in discovery.score_sources(spark.createDataFrame(links, "url string, anchor string, kind string, rate_mentions int, ord int")).collect()}
    assert got["https://b.example/a.pdf"]["score"] == 50 and got["https://b.example/a.pdf"]["role"] == "primary"
    assert got["https://b.example/news/1"]["score"] == -50 - 40 + 15


def test_migration_and_diff(spark):
    registry = spark.createDataFrame([("rate",), ("term",)], "field_id string")
    stored = spark.createDataFrame([("p", "rate", "5%"), ("p", "old", "x"), ("q", "term", " ")], "k string, field_id string, value string")
    assert rows(snapshots.migrate(stored, registry, "k")) == [("p", "rate", "5%", "found"), ("p", "term", "NOT_FOUND", "not_found"), ("q", "rate", "NOT_FOUND", "not_found"), ("q", "term", "NOT_FOUND", "not_found")]
    side = lambda d: spark.createDataFrame(d, "k int, value string, norm string")
    got = snapshots.diff_fields(side([(1, "NOT_FOUND", None), (2, "A  b", None), (3, "5%", "5"), (4, "x", None), (5, "NOT_FOUND", None)]), side([(1, "x", None), (2, "a B", None), (3, "6%", "6"), (4, "NOT_FOUND", None), (5, "NOT_FOUND", None)]), ["k"])
    assert rows(got.select("k", "kind")) == [(1, "appeared"), (3, "value"), (4, "disappeared")]


def test_search_guarantees_a_stating_chunk(spark):
    noise = [(i, "nominal interest rate " * 3 + "talk") for i in range(8)]
    docs = spark.createDataFrame([*noise, (99, "the nominal interest rate of this loan, described in many more words than usual, is 12.5% per year " + "filler word " * 40)] + [(200 + i, "unrelated text about offices and cards") for i in range(30)], "id int, text string")
    fields = spark.createDataFrame([("rate", "percent", 0, "nominal interest rate")], "query_id string, kind string, term_pos int, term string")
    got = retrieval.search_fields(docs, fields, "id", "text").collect()
    assert len(got) == 4 and any(r["id"] == 99 and r["has_value"] and r["has_term"] for r in got)
    assert retrieval.gate(retrieval.search_fields(docs, fields, "id", "text"), fields).first()["is_relevant"]


def test_landing(spark, tmp_path):
    big = spark.createDataFrame([(1, "application/pdf", bytearray(b"%PDF-1.4 x")), (2, "text/html", bytearray(b"  <html>")), (3, "text/html", bytearray(b"%PDF-")), (4, "application/pdf", bytearray(b"")), (5, None, None)], "id int, content_type string, content binary")
    assert [(r["id"], r["kind"], r["error"]) for r in landing.gate_bodies(big).orderBy("id").collect()] == [(1, "pdf", None), (2, "html", None), (3, None, "unexpected_content"), (4, None, "empty"), (5, None, "empty")]
    log = spark.createDataFrame([(1, "a"), (2, None)], "id int, what string")
    landing.write_log(log, str(tmp_path / "log"))
    assert rows(landing.read_log(spark, str(tmp_path / "log"), "id int, what string").select("id")) == [(1,), (2,)]
    rules = spark.createDataFrame([("b.example", "/", True), ("b.example", "/private", False)], "host string, prefix string, allow boolean")
    asked = spark.createDataFrame([("https://b.example/private/x",), ("https://b.example/open",), ("https://c.example/private",)], "url string")
    assert rows(landing.allowed_by_robots(asked, rules)) == [("https://b.example/open",), ("https://c.example/private",)]
