"""The pipeline's stages, each against a plain version of what it does to its own input."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import KIND, corpus, plain_groups, plain_substring


def test_stages(spark, tmp_path):
    rows = corpus(7, 40)
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], KIND).drop("shard", "n_words").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i, _ in rows if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "substrings", "packing"]
    good = steps["quality"](spark, docs, sf)
    assert good.columns == docs.columns and good.join(docs, docs.columns, "left_anti").where("text is not null and n_chars is not null").count() == 0
    first = steps["near_duplicates"](spark, docs, sf)
    assert {r["doc_id"] for r in first.collect()} == {i for i, (_, _, kept) in plain_groups(rows, like=80).items() if kept}
    cut = {r["doc_id"]: r["text"] for r in steps["substrings"](spark, docs, sf).collect()}
    for i, (n, gone, _) in plain_substring(rows).items():
        assert (i in cut) == (gone == 0 or gone < n)
        assert i not in cut or len((cut[i] or "").split()) == n - gone or not (cut[i] or "").isascii()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns and public_tokenizers.path("word_bpe_49k.json")
