"""The pipeline's near-duplicate stage links from 0.8 on, op7 from 0.85 on."""

import random

import corpus_pipeline
from wegloom.llm import minhash


def test_stage_links_at_80(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows, later = [], {80: set(), 85: set()}
    # one word changed in the middle of n words: n - 9 shingles of n + 1 in common
    for i, n in enumerate((48, 49, 54, 60, 64, 65, 66, 67, 68, 80) * 4):
        text = [word() for _ in range(n)]
        near = [*text[: n // 2], word(), *text[n // 2 + 1 :]]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        for like, found in later.items():
            if 100 * (n - 9) >= like * (n + 1):
                found.add(2 * i + 1)
    assert len(later[80]) > len(later[85]) > 0
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in rows} - kept == later[80]
    assert {r["doc_id"] for r in minhash.near_duplicates(docs).where("not kept").collect()} == later[85]
