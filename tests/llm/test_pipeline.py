"""The corpus pipeline stage by stage, and its registration."""

import os

from pyspark.sql import functions as F

import corpus_pipeline as C
from cairn.llm import language_id, near_dup
from cairn.llm.decontaminate import contamination


def test_stages(spark, made, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in made] + [(900, 'a key: password = "hunter2222" of the text', "en", "host1", 43)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(os.path.join(d, "documents.parquet"))
    item = next(t for _, t, _, _ in made if t and len(t.split()) >= 60)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(os.path.join(d, "benchmark.parquet"))
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "mix"]
    now, seen = docs, {}
    for name, stage in C.STAGES:
        out = stage(spark, now, d).cache()
        assert name == "mix" or out.columns == list(C.COLUMNS)
        seen[name] = out
        before, now = now, out
        if name == "language":
            want = {r["doc_id"] for r in language_id.identify(docs).where("lang_pred <> 'und'").collect()}
        elif name == "near_duplicates":
            want = {r["doc_id"] for r in near_dup.near_duplicates(before).where("kept").collect()}
        elif name == "decontamination":
            want = {r["doc_id"] for r in contamination(before, bench).where("not contaminated").collect()}
        elif name == "secrets":
            want = {r["doc_id"] for r in before.collect()}
            assert out.where("doc_id = 900").first()["text"] == 'a key: password = "[ASSIGN]" of the text'
            assert out.join(before.select("doc_id", F.col("text").alias("was")), "doc_id").where("doc_id <> 900 and text <> was").count() == 0
        else:
            want = {r["doc_id"] for r in out.where("taken > 0").collect()}
        assert {r["doc_id"] for r in out.collect()} == want
    assert {tuple(r) for r in C.run(spark, d).collect()} == {tuple(r) for r in seen["mix"].collect()}


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
