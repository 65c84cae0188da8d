"""Training-data operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import boilerplate, boosting, bpe, language, lookalikes, mixture, neighbours, scans, site_lines

TIKTOKEN = f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIKTOKEN, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(TIKTOKEN)


def ids(e, text):
    return np.frombuffer(e.encode(text), np.int32).tolist()


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " a", "a  b", "a \n b", "don't", "it's 12,5%", "<|endoftext|>", "ՀՀ դրամ", "ё́", "x" * 5000, "ab" * 3000, "   　x", "a\u0085b\u001cc d", "👩‍🚀 🚀", "\t\ttab  end  "])
def test_bpe_cases(own, reference, text):
    assert ids(own, text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(" \n\tab'1.ա", max_size=60))
def test_bpe_random(own, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(own, text) == reference.encode_ordinary(text)
    assert b"".join(own.by_id[i] for i in ids(own, text)).decode() == text


def test_rank_queue_orders_like_a_heap():
    rng, q, held = random.Random(2), bpe.RankQueue(50256), {}
    for _ in range(3000):
        r = rng.randrange(50256)
        q.push(r, len(held))
        held.setdefault(r, []).append(len(held))
    seen = []
    while (got := q.pop_bucket()) is not None:
        seen.append(got[0])
    assert seen == sorted(held)


def test_encode_column_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, "doc_id").collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 2
    assert bpe.encode_column(df.limit(0), "doc_id").count() == 0


# ------------------------------------------------------------ look-alikes


@pytest.mark.parametrize(("a", "b"), [("ｖｅｈｉｃｌｅ ｐｌｅｄｇｅ", "vehicle pledge"), ("12-180 աﬕս", "12-180 ամիս"), ("бе\xadсплатно", "бесплатно"), ("ёлка", "ёлка"), ("10‑20", "10-20"), ("ﬁne", "fine")])
def test_simple_form(a, b):
    assert lookalikes.simple_form(a) == b


def unified(spark, texts):
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "kind string, id bigint, text string")
    return [r["form"] for r in lookalikes.unify(df).orderBy("id").collect()]


def test_mixed_words_are_mended_by_the_vocabulary(spark):
    got = unified(spark, ["AMD and the rate", "АМD аnd thе rаtе", "поручительство есть", "пopyчитeльcтвo ecть", "դրամ ամիս ոչ", "ամիu nչ", "а с о у, кот и the"])
    assert got[1] == got[0] and got[3] == got[2] and got[5] == "ամիս ոչ" and got[6] == "а с о у, кот и the"


@pytest.mark.parametrize(("a", "b"), [("amd", "AMD"), ("1%", "7%"), ("a–b", "a-b"), ("café", "cafe"), ("loan", "loans"), ("но", "на")])
def test_true_differences_stay(spark, a, b):
    x, y = unified(spark, [a, b])
    assert x != y


def test_look_same_pairs(spark):
    rows = [("t", 1, "АМD"), ("t", 2, "AMD"), ("t", 3, "AMD"), ("t", 4, "ＡＭＤ"), ("t", 5, "amd"), ("t", 6, None), ("t", 2, "AMD"), ("u", 9, "АМD")]
    df = spark.createDataFrame(rows, "kind string, id bigint, text string")
    got = {(r["id_a"], r["id_b"]) for r in lookalikes.look_same(lookalikes.prints(df)).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}


# ------------------------------------------------------------ repeated lines


def test_pruned_summaries_lose_no_more_than_they_say():
    from collections import Counter

    rng = random.Random(3)
    stream = [int(rng.paretovariate(0.7)) % 4000 for _ in range(40_000)]
    true, total, lost = Counter(stream), Counter(), 0
    for i in range(0, len(stream), 5000):
        part, less = site_lines.prune(Counter(stream[i : i + 5000]), 64)
        total.update(part)
        lost += less
    assert all(0 <= true[k] - total[k] <= lost for k in true)


@pytest.mark.parametrize("capacity", [3, 2048])
def test_repeated_lines_exact_for_any_capacity(spark, capacity):
    rng = random.Random(4)
    pages, sites = [], []
    for d in range(60):
        site = "hot.example" if d % 3 else "b.example"
        sites += [(f"d{d}", site)] * 2
        for p in range(2):
            lines = [f"unique {d} {p} {i}" for i in range(6)] + [x for x in ("All rights  reserved", "MENU", "menu", "", " \t", "rare") if rng.random() < (0.05 if x == "rare" else 0.6)]
            pages.append((d * 10 + p, f"d{d}", "\n".join(lines)))
    pages += [pages[0], (9999, "nosite", "MENU"), (9998, "d1", None)]
    key = lambda x: " ".join(x.casefold().replace("\t", " ").split(" ")).strip() if x.strip(" \t") else ""
    norm = lambda x: " ".join(key(x).split())
    of = dict(sites)
    docs, n = {}, {}
    for p, d, t in pages:
        if d in of:
            n.setdefault(of[d], set()).add(d)
            for x in (t or "").split("\n"):
                if norm(x):
                    docs.setdefault((of[d], norm(x)), set()).add(d)
    ok = {k for k, v in docs.items() if len(v) >= 5 and 8 * len(v) >= len(n[k[0]])}
    want = {(p, i) for p, d, t in pages if d in of for i, x in enumerate((t or "").split("\n")) if (of[d], norm(x)) in ok}
    pdf, sdf = spark.createDataFrame(pages, "page_id bigint, doc_id string, text string"), spark.createDataFrame(sites, "doc_id string, site string")
    lines, keyed = site_lines.repeated_lines(pdf, sdf, capacity=capacity)
    found = site_lines.occurrences(lines, keyed)
    assert {tuple(r) for r in found.collect()} == want
    left = {r["page_id"]: r["text"] for r in site_lines.without_lines(pdf.dropDuplicates(["page_id"]), found).collect()}
    assert left[9999] == "MENU" and "MENU" not in left[0].split("\n")


def test_site_of(spark):
    df = spark.createDataFrame([("HTTPS://www.Bank.example:443/x",), ("http://u:p@b.example?x",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(site_lines.site_of(F.col("u"))).collect()] == ["bank.example", "b.example", None, None]


# ------------------------------------------------------------ neighbours


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(25, 16)) for c in centres]).astype(np.float32)
    rows = [(i, "a", (v * rng.uniform(0.5, 3)).tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, "a", rows[7][2]) for i in range(30)]  # copies beyond k
    rows += [(9000, "a", None), (9001, "a", []), (9002, "a", [0.0] * 16), (9003, "a", [1.0, None] + [0.0] * 14), (9004, "b", rows[0][2]), (9005, None, rows[0][2]), (9006, "a", [1.0, 2.0, 3.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, grp string, v array<float>")
    got = neighbours.nearest_neighbours(df, "vec_id", "grp", "v", neighbours.Settings(list_rows=64, probes=6, query_block=50)).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r["other"])
    assert not set(found) & set(range(9000, 9010))
    assert all(len(set(v)) == 10 and k not in v for k, v in found.items())
    assert sorted(found[5003]) == sorted([7, 5000, 5001, 5002, *range(5004, 5010)])
    ids_ = np.array([r[0] for r in rows[:1030]])
    m = np.array([r[2] for r in rows[:1030]], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    c = np.round(m @ m.T, 6)
    np.fill_diagonal(c, -9)
    hits = [len(set(found[int(ids_[i])]) & set(ids_[np.lexsort((ids_, -c[i]))[:10]].tolist())) for i in range(1030)]
    assert sum(hits) / 10300 >= 0.95


# ------------------------------------------------------------ mixture


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 33), st.integers(0, 5))
def test_split_blocks_is_exact(counts, shards, seed):
    got = mixture.split_blocks(np.array(counts), shards, np.random.default_rng(seed))
    assert got.shape == (shards, len(counts)) and (got >= 0).all() and got.sum(0).tolist() == counts
    assert got.sum(1).max() - got.sum(1).min() <= 1 + np.log2(shards)


def test_mix_shares_caps_and_shards(spark):
    rng = random.Random(5)
    rows = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(["big"] * 3000 + ["small"] * 200 + ["other"] * 50)] + [(7, "big", 40), (None, "big", 5), (8888, None, 5), (8889, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("gone", 0.2, 4)], "source string, target_share double, max_repeat int")
    got = mixture.mix(docs, targets, shards=5).toPandas()
    size = {s: sum({i: n for i, t, n in rows[:3250] if t == s}.values()) for s in ("big", "small")}
    total = min(size["small"] * 3 / 0.5, size["big"] * 2 / 0.5)
    per = got.groupby("source").n_tokens.sum()
    assert set(per.index) == {"big", "small"} and all(abs(per[s] - total / 2) <= 60 for s in per.index)
    copies = got.groupby("doc_id").copy.agg(["count", "max"])
    assert (copies["count"] == copies["max"]).all() and got.groupby(["source", "doc_id"]).copy.max().groupby("source").max().to_dict()["small"] <= 3
    assert got.groupby("shard").position.apply(lambda p: sorted(p) == list(range(1, len(p) + 1))).all()
    again = mixture.mix(docs, targets, shards=5).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    report = {r["source"]: r for r in mixture.shares(spark.createDataFrame(got), targets).collect()}
    assert report["gone"]["n_tokens"] == 0 and abs(report["small"]["share"] - 0.5) < 0.01


# ------------------------------------------------------------ language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    aliases = spark.read.parquet("/root/testdata/sf0.01/lang_aliases.parquet")
    lines, labels = language.training_lines(docs.where("doc_id % 2 = 0"), aliases)
    model = language.fit(lines, labels)
    other, truth = language.training_lines(docs.where("doc_id % 2 = 1"), aliases)
    said = [model.languages[k] for k in model.scores(language.Spectrum(), other)[0].argmax(1)]
    # a part of the labels themselves is wrong
    assert np.mean([a == b for a, b in zip(said, truth)]) > 0.85
    own = lambda t: language.languages(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), model).collect()
    assert own("Проценты начисляются ежедневно на остаток долга, включая все налоги.")[0]["lang"] == "ru"
    assert own("Tokosagumary hashvegrvum e orakan ktrvatsqov, mnacordi nkatmamb, isk och rezidentneri hamar, arandzin paymannerov.")[0]["lang"] == "hy"
    mixed = own("Interest accrues daily on the outstanding balance, all taxes included.\n\nПроценты начисляются ежедневно на остаток долга, включая все налоги, за исключением сотрудников банка.\n12%")
    assert {(r["line_no"], r["lang"]) for r in mixed} == {(-1, "ru"), (0, "en"), (2, "ru"), (3, "ru")}
    assert own("12% 3.4\n—") == own("") == own(None) == []


# ------------------------------------------------------------ boosting and scans


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.Boost(rounds=60).fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    assert boosting.Boost().fit(np.zeros((0, 4)), np.zeros(0)).probability(x[:3]).tolist() == [0.5] * 3


def test_boosting_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    rows = spark.createDataFrame([(a, b) for a, b in zip(x.tolist(), y.tolist())], "x array<double>, y double")
    for even in (False, True):
        whole = boosting.Boost(rounds=20).fit_rows(rows, 4, even)
        assert ((whole.probability(x) > 0.5) == y).mean() > 0.9
        with monkeypatch.context() as m:
            m.setattr(boosting, "CELLS", 0)
            by_tasks = boosting.Boost(rounds=20).fit_rows(rows.repartition(3), 4, even)
        assert by_tasks.base == whole.base and all((p == q).all() for a, b in zip(by_tasks.trees, whole.trees) for p, q in zip(a, b))
    assert boosting.Boost().fit_rows(rows.limit(0), 4).probability(x[:3]).tolist() == [0.5] * 3
    one = boosting.Boost().fit_rows(rows.where("y = 1"), 4, True)
    assert not one.trees and (one.probability(x[:3]) > 0.99).all()


@pytest.mark.parametrize(("line", "n"), [("Page 20", 20), ("- l -", 1), ("[126]", 126), ("էջ 7/8", 7), ("xiv", 14), ("· 3 ·", 3), ("5 / 6", 5), ("12%", None), ("- 11%", None), ("the loan", None), ("Term 5 years", None)])
def test_page_number(line, n):
    assert scans.page_number(line) == n


@pytest.mark.parametrize(("seen", "meant", "ops"), [("thc", "the", [("c", "e")]), ("rnust", "must", [("rn", "m")]), ("clay", "day", [("cl", "d")]), ("pr0pcrty", "property", [("0", "o"), ("c", "e")]), ("abc", "xyz", None), ("vvhile", "while", [("vv", "w")])])
def test_edits(seen, meant, ops):
    assert scans.edits(seen, meant) == ops
    if ops:
        assert set(scans.gram_keys(seen, True)) & set(scans.gram_keys(meant, False))


@pytest.mark.parametrize("token", ["1O.1%", "l.55%", "0.5°/o", "2o25", "5I", "I72", "29o00", "5B-օրյա"])
def test_misread_numbers(token):
    assert scans.misread_number(token, frozenset({"#.#%", "#", "#-օրյա"}))


@pytest.mark.parametrize("token", ["10.1%", "2025", "12,000", "36-օրյա", "loan", "a", "USD"])
def test_true_numbers(token):
    assert not scans.misread_number(token, frozenset({"#.#%", "#", "#,#", "#-օրյա"}))


def test_find_defects(spark):
    words = "the bank must give every customer a copy of the contract before the first payment is made and keep another one-off".split()
    clean = [(i, f"c{i}", "Bank", 1, " ".join(words) + ".", "html", None) for i in range(30)]
    body = lambda n: f"Bank of Examples\n{' '.join(words[n : n + 7])}.\nthe bank must give every cust-\nomer a copy of tbe contract | before\nthe first payment is made and keep an-\nother one-\noff copy\n{n}"
    pages = clean + [(100 + n, "s", "Bank", n, body(n), "ocr", 80.0) for n in range(1, 9)] + [(200, "t", "Bank", 1, None, "ocr", 80.0), (201, "u", None, None, "", "ocr", 1.0)]
    df = spark.createDataFrame(pages, "page_id bigint, doc_id string, bank string, page_no int, text string, method string, ocr_confidence double")
    got = {tuple(r) for r in scans.find_defects(df).collect()}
    for n in range(101, 109):
        assert {(n, 0, -1, "furniture"), (n, 7, -1, "furniture"), (n, 2, 5, "split"), (n, 4, 7, "split"), (n, 3, 4, "misread"), (n, 3, 6, "misread")} <= got
    assert not any(p < 100 or p >= 200 for p, *_ in got)
    text = " ".join(r["text"] for r in scans.paragraphs(df, scans.repairs(df)).orderBy("doc_id", "block", "paragraph").collect())
    assert "the bank must give every customer a copy of the contract before the first payment is made and keep another one-off copy" in text
    assert "Bank of Examples" not in text and "|" not in text
    assert scans.find_defects(df.limit(0)).count() == 0


def _scans_of(spark, clean: list[str], lines: list[str]):
    """Clean pages of each text, and a scanned document of which each page has one of the lines among clean ones."""
    rows = [(i, f"c{i}", "Bank", 1, t, "html", None) for i, t in enumerate(clean)]
    rows += [(1000 + i, "s", "Bank", i, f"the bank must give every customer\n{x}\nbefore the first payment is made", "ocr", 80.0) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "page_id bigint, doc_id string, bank string, page_no int, text string, method string, ocr_confidence double")


_SAID = "the bank must give every customer a copy of the contract before the first payment is made and keep another one-off"


def test_misread_hyphenated_words_that_recur(spark):
    found = {tuple(r) for r in scans.find_defects(_scans_of(spark, [_SAID] * 30, ["keep another onc-off copy of tbe contract", "tbe onc-off copy"] * 3)).collect()}
    assert {(1000 + i, 1, 2 if i % 2 == 0 else 1, "misread") for i in range(6)} <= found


def test_chance_pairs_are_of_every_script(spark, monkeypatch):
    monkeypatch.setattr(scans, "SAMPLE", 200)
    words = [f"{c}{i:03d}x" for c in ("loan", "ставка", "վարկ") for i in range(400)]
    pairs = spark.createDataFrame([(w, w + "s", 1, 5, 2) for w in words], "word string, meant string, n bigint, n_meant bigint, shared bigint")
    got = [r["word"][0] for r in scans.by_chance(pairs).collect()]
    assert 140 < len(got) < 260 and all(got.count(c) > 40 for c in "lсվ")


def test_defects_do_not_hang_on_a_sample(spark, monkeypatch):
    lines = "Bank of Examples\n{}.\nthe bank must give every cust-\nomer a copy of tbe contract | before\nthe first payment is made and keep an-\nother one-\noff copy\n{}"
    pages = [(i, f"c{i}", "Bank", 1, _SAID, "html", None) for i in range(30)]
    pages += [(100 + n, "s", "Bank", n, lines.format(" ".join(_SAID.split()[n : n + 7]), n), "ocr", 80.0) for n in range(1, 9)]
    df = spark.createDataFrame(pages, "page_id bigint, doc_id string, bank string, page_no int, text string, method string, ocr_confidence double")
    whole = {tuple(r) for r in scans.repairs(df).collect()}
    assert {"furniture", "misread", "split"} == {r[3] for r in whole}
    monkeypatch.setattr(scans, "SAMPLE", 0)
    assert {tuple(r) for r in scans.repairs(df).collect()} == whole


def test_verdicts_count_all_words(spark, monkeypatch):
    letters = str.maketrans("0123456789", "abcdefghij")
    vocabulary = [(f"{c}{i:03d}word".translate(letters), n) for c, n in (("k", 50), ("q", 1)) for i in range(120)]
    unknown = [(w.replace("w", "vv") if i % 3 else w.replace("r", "n"), 1) for i, (w, n) in enumerate(vocabulary) if n > 1]
    spread = [spark.createDataFrame(x, "word string, n bigint").repartition(5) for x in (unknown, vocabulary)]
    judged = lambda: {r["word"]: (r["meant"], r["p"]) for r in scans.verdicts(*spread).collect()}
    whole = judged()
    assert all(whole[w][0] == m for (w, _), (m, _) in zip(unknown, vocabulary))
    monkeypatch.setattr(scans, "SAMPLE", 20)
    assert judged() == whole


def test_all_misreadings_are_counted(spark):
    pairs = spark.createDataFrame([(f"w{i}", "word", 1, 20, 2, [f"{chr(0x4E00 + i)}\tx"], []) for i in range(6000)], scans._CLOSE_SQL)
    learned = scans.confusions(pairs, pairs.limit(0))
    assert learned.count() == 6000 and learned.agg({"noisy": "sum"}).first()[0] == 6000


def test_near_pairs_lose_none_of_few_edits(spark):
    words = ["pr0pcrty", "property", "rnodcrn", "modern", "clay", "day", "vvhilc", "while", "abcdmx", "abcrny", "thc", "the", "loanrntermx", "loanmtermy"]
    index = scans.index_of(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint"))
    got = {(r["word"], r["meant"]) for r in scans.candidates(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"), index).collect()}
    shared = lambda a, b: set(scans.gram_keys(a, True)) & set(scans.gram_keys(b, False))
    assert got == {(a, b) for a in words for b in words if a != b and shared(a, b) and scans.edits(a, b)} and ("loanrntermx", "loanmtermy") in got


def test_clean_words_are_counted_in_scans_too(spark):
    lines = ["the quorum must give a copy"] * 20 + ["the quorurn must give a copy", "the contract rnust give a copy"]
    found = {tuple(r) for r in scans.find_defects(_scans_of(spark, [_SAID] * 30 + ["the quorum"], lines)).collect()}
    assert {(1020, 1, 1, "misread"), (1021, 1, 2, "misread")} <= found
    assert not any(p < 1020 and d == "misread" for p, _, _, d in found)


def test_splitting_tree_of_many_shards():
    counts = np.array([3_000_000, 41, 700_000])
    nodes = mixture.upper_nodes(counts, 100_000, mixture.NODES, 5)
    assert len(nodes) <= mixture.NODES and sum(n for _, n, _, _ in nodes) == 100_000
    at = np.zeros(3, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in nodes]), pa.array([x[1] for x in nodes]), pa.array([x[2].tolist() for x in nodes]), pa.array([x[3].tolist() for x in nodes])], names=["f", "n", "c", "s"])
    shards = set()
    for b in mixture._lower(5)(iter([batch])):
        i, shard, first, last = (np.asarray(c) for c in b.columns)
        for k in range(3):
            own = i == k
            assert (first[own] == np.r_[at[k], last[own][:-1]]).all()  # ranges follow each other without a gap
            at[k] = last[own][-1] if own.any() else at[k]
        shards.update(shard.tolist())
    assert (at == counts).all() and len(shards) == 100_000


def test_long_words_and_numbers_are_judged():
    assert scans.misread_number("1234567890123O5", {"#"} - {"#"}) and not scans.misread_number("123456789012345", {"#"})
    word = "a" * 35 + "b" * 35
    assert set(scans.gram_keys(word[:20] + "x" + word[21:], True)) & set(scans.gram_keys(word, False))
    batch = pa.RecordBatch.from_arrays([pa.array([word]), pa.array([word]), pa.array([1]), pa.array([None], pa.list_(pa.string()))], names=["a", "word", "n", "known"])
    assert next(scans._by_form(iter([batch]))).column(3).to_pylist() == ["ask"]


# ------------------------------------------------------------ boilerplate


def _batch(pages: list[list[tuple[float, float]]]) -> pa.RecordBatch:
    """Pages of lines given by their characters and how much of them the site leaves to the page."""
    lists = lambda i, t: pa.array([[x[i] for x in p] for p in pages], pa.list_(t))
    numbers = pa.array([list(range(len(p))) for p in pages], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([numbers, lists(0, pa.float32()), pa.array([[0.0] * len(p) for p in pages], pa.list_(pa.float32())), lists(1, pa.float32())], names=["no", "chars", "tags", "keep"])


def test_regions_select_the_content():
    assert boilerplate.read_lines("a<b>c</b> &amp; d\nplain")[0] == (0, "ac & d", 2)
    menu, text, footer = [(10.0, 0.01)] * 5, [(300.0, 1.0)] * 4, [(12.0, 0.02)] * 4
    lines = boilerplate.Lines(_batch([menu + text + footer, text, menu, []]))
    v, _, n = boilerplate.own_share(lines, None, None)
    dense = boilerplate.regions(lines, v, n)
    assert dense[:13].tolist() == [False] * 5 + [True] * 4 + [False] * 4
    assert dense[13:17].all() and not dense[17:].any()  # pages of one kind of line
    # what follows a line that leads to offers is no content
    lead = {"n": np.full(13, 9.0), "value": np.r_[np.zeros(5), np.ones(4), np.zeros(4)], "leads": np.eye(13)[4]}
    some = boilerplate.Lines(_batch([menu + text + footer]))
    assert not boilerplate.own_share(some, lead, lead)[0].any()


def test_main_text(spark):
    pages, sites = [], []
    rng = random.Random(6)
    words = "applicant statement income answers request guarantor contract million insurance branch customer partial repayment schedule tariff".split()
    said = lambda: " ".join(["The bank", *rng.sample(words, 9)]) + "."
    names = [f"{a} {b}" for a in ("Gold", "Green", "Quick", "New", "Old") for b in ("Car", "Home", "Garden", "Study", "Farm", "Roof", "Boat", "Van")]
    items = [f"{a} {b}" for a in ("passport", "tax return", "pledge form", "bank statement", "power of attorney") for b in ("copy", "original", "if available", "translated", "sealed", "on request", "for the pledger", "in electronic form")]
    for i in range(400):
        name, other = names[i % 40], names[(i * 7 + 3) % 40]
        body = [f"How to get the {name} loan", said(), f"Amount | {name} | {i}00 000 AMD", f"{name}, term — {i} months", *rng.sample(items, 2), f"{i % 97 + 1}. Do I need a guarantor?", said()]
        page = ["HOME", "Cards", "Contact", *body, "Read also", f"Apply online and get {other} in {i} minutes", said(), "All rights reserved", "© 2020 Bank"]
        pages.append((i, f"d{i}", "\n".join(page)))
        sites.append((f"d{i}", "bank.example"))
    df = spark.createDataFrame([*pages, (999, "d0", None), (998, "none", "")], "page_id bigint, doc_id string, text string")
    judged = boilerplate.judged_lines(df, spark.createDataFrame(sites, "doc_id string, site string"))
    by: dict = {}
    for r in judged.collect():
        by.setdefault(r["page_id"], {})[r["line_no"]] = r["own"]
    right = sum(by[i][k] == (3 <= k <= 10) for i in range(400) for k in range(16))
    wrong = [sum(by[i][k] != (3 <= k <= 10) for i in range(400)) for k in range(16)]
    assert right >= 0.97 * 400 * 16, str(wrong)
    joined = boilerplate.judged_lines(df, spark.createDataFrame(sites, "doc_id string, site string"), lookup_rows=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, judged.collect()))
    text = {r["page_id"]: r["text"] for r in boilerplate.main_text(df.select("page_id", "text"), judged).collect()}
    assert "HOME" not in text[3] and text[998] == ""


# ------------------------------------------------------------ every query


def _names():
    from lodestack.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_rough_and_empty_tables(spark, rough_tables, empty_tables, name):
    from lodestack.llm.queries import QUERIES

    QUERIES[name](spark, rough_tables).collect()
    assert QUERIES[name](spark, empty_tables).count() == 0 or name == "p9_shares"


def test_the_rest_does_not_import_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(f"{root}/lodestack"):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "lodestack.llm" not in open(f"{folder}/{f}").read()
