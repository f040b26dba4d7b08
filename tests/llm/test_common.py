import gc
import os
import time

from corpusloom.llm import common, quality, splitting


def jobs_of(spark, group, make):
    spark.sparkContext.setJobGroup(group, group)
    frame = make()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    return frame, n


def test_no_job_before_the_result_is_asked_for(spark, data):
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    frame, n = jobs_of(spark, "plan-only", lambda: splitting.split_oversized(chunks))
    assert n == 0 and frame.count() > 0


def test_tables_go_when_no_frame_reads_them(spark):
    table = common.cut(spark.range(10))
    path = next(p for p, (_, ref) in common._TABLES.items() if ref.refersTo(table._jdf.queryExecution().analyzed().relation().location()))
    derived = table.where("id > 3").selectExpr("id + 1 AS x")
    del table
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
        common.sweep()
    assert os.path.isdir(path) and derived.count() == 6
    del derived
    until = time.time() + 30
    while os.path.isdir(path) and time.time() < until:
        gc.collect()
        spark.range(3).count()  # the last plan is held until the next one
        spark._jvm.System.gc()
        time.sleep(0.2)
        common.sweep()
    assert not os.path.isdir(path)


def test_an_operator_leaves_nothing(spark):
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    docs = spark.createDataFrame([(1, "the cat is here.")], "doc_id bigint, text string")
    before = set(common._TABLES)
    quality.text_statistics(docs, words).collect()
    until = time.time() + 30
    while set(common._TABLES) - before and time.time() < until:
        gc.collect()
        spark.range(3).count()
        spark._jvm.System.gc()
        time.sleep(0.2)
        common.sweep()
    assert not set(common._TABLES) - before
