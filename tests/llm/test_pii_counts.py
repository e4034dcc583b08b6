"""Counts of op1_pii's columns go by kind, whatever place a match has among the spans."""

from __future__ import annotations

from kgspark.llm import pii


def test_counts_by_kind(spark, tmp_path):
    texts = ["4111111111111111 then +49 30 1234567", "1.2.3.4 a@b.cd e@f.gh", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0, 1, 1), 1: (2, 1, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}
