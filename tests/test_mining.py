"""Phrases are mined in few passes over texts that are split once, by counts that a sieve does not change (F1, F2)."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kgspark.operators import mining


def brute(texts: list[str | None], least: int, cohesion: float, freedom: float) -> dict[str, tuple]:
    split = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts if t]
    runs = {n: Counter(tuple(ws[i : i + n]) for ws in split for i in range(len(ws) - n + 1)) for n in (1, 2, 3)}
    total, out = sum(runs[1].values()), {}
    for n in (2, 3):
        for p, c in runs[n].items():
            if c < least:
                continue
            bits = min(math.log2(c * total / (runs[1][p[:1]] * runs[n - 1][p[1:]])), math.log2(c * total / (runs[n - 1][p[:-1]] * runs[1][p[-1:]])))
            at = [(ws, i) for ws in split for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) == p]
            sides = [Counter(ws[i - 1] if i else "" for ws, i in at), Counter(ws[i + n] if i + n < len(ws) else "" for ws, i in at)]
            free = min(math.log2(c) - sum(x * math.log2(x) for x in s.values()) / c for s in sides)
            if bits >= cohesion and free >= freedom:
                out[" ".join(p)] = (c, round(bits, 6), round(free, 6))
    return out


@pytest.mark.parametrize("bits, piece", [(1 << 15, 64), (1 << 27, 8 << 20)])
def test_mined_phrases_equal_brute_force(spark, monkeypatch, bits, piece):
    monkeypatch.setattr(mining, "MOST_BITS", bits)
    monkeypatch.setattr(mining, "PIECE", piece)
    rng = np.random.default_rng(3)
    vocabulary = ["über", "Straße", "naïve", "ΑΒΓ", "東京", "a", "internationalisierungsbeauftragter", "internationalisierungsbeauftragten", *(f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(26))]
    texts: list = [None, "", "12 - 3", "one"]
    for k in range(300):
        ws = list(rng.choice(vocabulary, 9))
        ws[4:4] = [["red", "graph", "store"], ["deep", "sea"], ["internationalisierungsbeauftragter", "X"]][k % 3]
        texts.append(["", "…", " 7 "][k % 3] + [" ", ", ", "-3 "][k % 3].join(ws) + ["", "!", " "][k % 3])
    got = {r.phrase: (r.n, round(r.cohesion, 6), round(r.freedom, 6)) for r in mining.mined(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), least=5, cohesion=1.5, freedom=0.5).collect()}
    want = brute(texts, 5, 1.5, 0.5)
    assert len(want) > 3 and got == want


def test_texts_are_split_once(spark, monkeypatch):
    plans = []
    put = mining.written
    monkeypatch.setattr(mining, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), put(df))[1])
    docs = spark.createDataFrame([(f"{a} deep red sea {a}",) for a in "abcdefgh" for _ in range(5)], "text string")
    found = mining.mined(docs, cohesion=1.0)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert {r.phrase for r in found.collect()} == {"deep red sea"}
    assert sum(p.lower().count("regexp") for p in plans) == 1


def test_a_run_of_rare_words_is_not_counted(spark):
    texts = [("common words " + " ".join(f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20)),) for k in range(40)]
    words = mining.split(spark.createDataFrame(texts, "text string"))
    count = lambda n, sieves: words.mapInArrow(mining._counted(n, spark.sparkContext.broadcast(sieves)), "phrase string, n long").groupBy("phrase").sum("n").toDF("phrase", "n")
    sieve = mining._sieve(mining._slots(count(1, {}).where("n >= 10"), 1))
    assert count(2, {}).count() == 1 + 40 * 20
    assert {tuple(r) for r in count(2, {1: sieve}).where("n >= 10").collect()} == {("common words", 40)} and count(2, {1: sieve}).count() < 40


def test_keywords_of_repeated_ids_are_those_of_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(None if k % 50 == 7 else k // 2, f"{'abcdefghijkl'[k % 12]} deep red sea {'mnopqrstu'[k % 9]} graph store {'vwxyz'[k % 5]}") for k in range(200)]
    rows += [(k, " ".join(f"x{chr(97 + (k * j) % 26)}{chr(97 + j)}" for j in range(20))) for k in range(100, 260)] + [(7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["keywords_mined"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(entry.oracle_sql()["keywords_mined"]).fetchall()
    assert len(want) > 90 and sorted(((r.doc_id, list(r.low_level)) for r in got), key=str) == sorted(((i, list(p)) for i, p in want), key=str)
