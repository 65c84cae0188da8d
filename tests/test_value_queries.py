"""Value queries over whole tables."""

from __future__ import annotations

from lodestack.plans.value_queries import QUERIES


def _tables(spark, folder, chunks, pages):
    spark.createDataFrame(chunks, "vec_id bigint, doc_id string, text string").write.parquet(f"{folder}/chunk_vectors.parquet")
    spark.createDataFrame(pages, "page_id bigint, doc_id string, text string").write.parquet(f"{folder}/doc_pages.parquet")
    return str(folder)


def test_quotes_of_all_chunks_are_placed(spark, tmp_path):
    at = _tables(spark, tmp_path, [(i, "d", f"{i}... the rate of loan number {i} is agreed") for i in range(10)], [(100 + i, "d", f"Loans\n the rate of loan  number {i} is agreed") for i in range(10)])
    assert {tuple(r) for r in QUERIES["quote_exact"](spark, at).collect()} == {(i, 100 + i) for i in range(10)}


def test_quotes_are_verified_in_whole_chunks(spark, tmp_path):
    asked = "Q: this loan needs many papers of its borrower and their guarantor, as stated"
    said = asked[2:52].translate(str.maketrans("ae", "eo"))
    at = _tables(spark, tmp_path, [(1, "d", asked), (2, "d", "x" * 500 + said)], [(1, "d", "")])
    got = {r["answer_id"]: r for r in QUERIES["quote_verify"](spark, at).collect()}
    assert got[1]["verified"] and got[1]["passage_id"] == 2
