"""The corpus pipeline, stage by stage, against brute force."""

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import common, mixing, stages

from .test_near import brute_removed, brute_similar


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    kept: dict[str, list] = {"documents": docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    good = {r["doc_id"] for r in common.table(spark, sf, "labels").where("quality = 1").collect()}
    assert len(good - {r["doc_id"] for r in kept["quality"]}) <= 0.05 * len(good)
    assert len(kept["quality"]) < len(kept["documents"])
    before = sorted(kept["quality"], key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in before]
    firsts = set(brute_similar([r["text"] for r in before], ids))
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(firsts)
    want = brute_removed([(r["doc_id"], r["text"]) for r in kept["near_duplicates"]])
    after = {r["doc_id"]: r for r in kept["repeated_passages"]}
    for r in kept["near_duplicates"]:
        n, gone, runs, _ = want[r["doc_id"]]
        if not gone:
            assert after[r["doc_id"]]["text"] == r["text"]
        elif r["doc_id"] in after:
            assert 0 <= len(after[r["doc_id"]]["text"].encode()) - (n - gone) <= 6 * runs
            assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
        else:
            assert n == gone
    source = spark.createDataFrame(kept["repeated_passages"])
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.poisson_mix(source, mixing.source_rates(source)).collect()}
    assert len(kept["mixing"]) == sum(copies.values()) == len(kept["encoding"])
    final = corpus_pipeline.run(spark, sf)
    rows = lambda frame: sorted(tuple(r) for r in frame)
    assert rows(final.collect()) == rows(kept["encoding"])


def test_stages_of_empty_tables(spark, sf):
    docs = common.table(spark, sf, "documents").where(F.lit(False))
    for stage in (stages.quality, stages.near_duplicates, stages.repeated_passages, stages.mix, stages.encode):
        assert stage(spark, docs, sf).count() == 0


def test_stages_of_odd_rows(spark, odd, sf):
    for stage in (stages.quality, stages.near_duplicates, stages.repeated_passages, stages.mix, stages.encode):
        assert 0 <= stage(spark, odd, sf).count() <= 40


def test_mixing_stage_writes_the_mixtures_order(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    stages.mix(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    got = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == [r["doc_id"] for r in mixing.poisson_mix(docs, mixing.source_rates(docs)).orderBy("position").collect()]
