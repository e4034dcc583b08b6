"""Small tables for pipeline tests."""

import numpy as np

TOXIC = ["scoundrel", "villain", "dreadful", "loathsome"]


def write_tables(spark, folder: str) -> str:
    """Clean and toxic documents, near copies, a benchmark passage, an address, null and empty texts; both labels."""
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(f"term{k}" for k in rng.integers(0, 500, n))
    item = make(30)
    base = make(200)
    texts = {1: make(50), 2: make(80), 3: base, 4: base + " tail", 5: make(60), 6: make(20) + " " + item + " " + make(10), 7: make(30) + " bob@site.example " + make(5), 8: None, 9: ""}
    for i in range(20, 320):
        words = make(30).split()
        if i % 4 == 0:
            for w in TOXIC:
                words.insert(int(rng.integers(0, 30)), w)
        texts[i] = " ".join(words)
    texts[400], texts[401] = base + " tail end", texts[21]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "extra") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hit_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(1, 1, 0), (2, 1, 0), *((i, 1, int(i % 4 == 0)) for i in range(20, 320))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
