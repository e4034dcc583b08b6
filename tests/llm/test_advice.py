"""Findings of the review: each test is a case that the operators once cut short."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.llm import packing, pii, substring
from kgspark.llm._shared import connected_components


@pytest.mark.parametrize("small", [pii.SMALL, 0])  # flagged terms in every task, and joined
def test_pii_terms_go_wherever_they_stand(spark, monkeypatch, small):
    monkeypatch.setattr(pii, "SMALL", small)
    far = " ".join(["plain words of no note at all here"] * 4)
    rows = [(i, f"ann@corp.example wrote {i}. {far} Falcon {far} and falcon") for i in range(4)]
    rows += [(10, f"The FALCON is elsewhere. {far}"), (11, "bob@falcon.example"), (None, "é falcon"), (None, "é falcon"), (12, None), (13, "")]
    rows += [(100 + i, f"{far} and wrote {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text) for r in pii.sanitise(docs).collect()]
    want = []
    for i, t in rows:
        t = t and t.replace("ann@corp.example", "[EMAIL]").replace("bob@falcon.example", "[EMAIL]")
        for word in ("Falcon", "falcon", "FALCON"):
            t = t and t.replace(word, "[TERM]")
        want.append((i, t))
    assert sorted(out, key=str) == sorted(want, key=str)
    found = pii.find(docs)
    assert found.where("doc_id is null").select(F.sum(F.size("spans"))).first()[0] == 2
    assert found.where("doc_id = 11").first().spans[0].kind == 0


@pytest.mark.parametrize("ids, short", [([5, 7, 5], {7}), ([None, 7, None], {None})])
def test_repeats_between_rows_of_one_document(spark, ids, short):
    """One block, in which a document's rows stand on both sides of another's."""
    passage = " ".join(f"w{k}" for k in range(80))
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [passage] * 3})
    asked = substring._Block(table, substring.WINDOW, 1, (1, 2)).ask_anchors(0)
    assert asked and all(substring.unpack_bits(r["many"], len(r["keys"]) // 4).all() for r in asked)
    docs = spark.createDataFrame([(i, passage) for i in ids], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, 80 if i in short else 0) for i in ids], key=str)


def test_pack_knows_the_end_marker(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|>", "  a  <|endoftext|>  <|endoftext|>\n b  ", "<|endoftext|", "<|ENDOFTEXT|> é<|endoftext|>😀", "plain  text"]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == want, text
    assert 50256 in np.frombuffer(bytes(got[0].ids), "<u4")


def test_components_never_end_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not converged"):
        connected_components(edges, max_rounds=1)
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0), max_rounds=0).count() == 0
