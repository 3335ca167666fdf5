"""Stages of the pipeline don't begin with heaps that the stages before have filled."""

import corpus_pipeline
import pytest


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "decontamination", "packing"])
def test_a_stage_begins_with_a_collection_on_every_core(spark, name, tmp_path, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)[name]
    began = []

    def stop(*args, **options):
        began.append(full_collections(spark))
        raise InterruptedError

    first = {"language": (corpus_pipeline.langid, "fit"), "lines": (corpus_pipeline.templates, "drop_recurring_lines"), "near_duplicates": (corpus_pipeline.near_copies, "near_copies")}
    monkeypatch.setattr(*first.get(name, (corpus_pipeline, "table") if name == "decontamination" else (corpus_pipeline.packing, "token_pieces")), stop)
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    before = full_collections(spark)
    spark.sparkContext.setJobGroup(f"room-{name}", name)
    try:
        with pytest.raises(InterruptedError):
            stage(spark, docs, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert began[0] > before
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(k).numTasks for job in status.getJobIdsForGroup(f"room-{name}") for k in status.getJobInfo(job).stageIds]
    assert tasks == [spark.sparkContext.defaultParallelism]
