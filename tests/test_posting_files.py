"""Searches write postings and queries as files: Spark carries paths, counts of terms and answers, in batches of bounded size."""

import random

from pyspark.sql import functions as F

from wattlore.functions import steps
from wattlore.operators import retrieval, textindex


def made(spark, n=50):
    rng = random.Random(1)
    docs = [(i, [f"w{rng.randrange(60)}" for _ in range(20)]) for i in range(n)]
    return textindex.bm25_index(spark.createDataFrame(docs, "item_id int, tokens array<string>").repartition(2), "item_id", "tokens", "x")


def test_no_posting_goes_through_spark(spark):
    index = made(spark)
    blocks, files, _, _ = retrieval._layer_blocks(index, "x", 100)
    assert blocks.columns == ["path"] and files == blocks.count() == 10
    own = steps.read_batch(blocks.first().path)
    assert own.num_rows == 1 and {"ids", "item", "tf"} <= set(own.schema.names) and own.column("tf").type.value_type.bit_width == 8


def test_batches_are_small_only_while_a_search_writes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    index = made(spark)
    own = retrieval.written
    try:
        retrieval.written = lambda df: seen.append(spark.conf.get(name)) or own(df)
        found = retrieval.bm25_topk(spark.createDataFrame([(1, ["w1", "w2"])], "qid int, tokens array<string>"), index, "x", 3)
    finally:
        retrieval.written = own
    assert found.count() == 3 and "16m" in seen and spark.conf.get(name) == before


def test_parents_come_from_the_ids(spark):
    texts = spark.createDataFrame([(7, "one. " * 60), (-3, "two. " * 60), (None, "three. " * 60)], "doc_id long, text string")
    subs = textindex.split_subchunks(texts, "doc_id", "text").withColumn("own", textindex.parent_of_subchunk("sub_id", "bigint"))
    assert subs.count() > 6 and subs.filter(~F.col("own").eqNullSafe(F.col("parent_id"))).count() == 0
    named = textindex.split_subchunks(spark.createDataFrame([("a-s001", "x")], "doc_id string, text string"), "doc_id", "text").select(textindex.parent_of_subchunk("sub_id").alias("p"))
    assert named.first().p == "a-s001"
    ranked = spark.createDataFrame([(1, "7-s001", 2.0, 1), (1, "7-s000", 1.0, 2), (1, "8-s000", 0.5, 3)], "qid int, item_id string, score double, rank int")
    assert [tuple(r) for r in retrieval.first_parent(ranked, textindex.parent_of_subchunk("item_id", "bigint"), 5).orderBy("rank").collect()] == [(1, 7, 2.0, 1), (1, 8, 0.5, 2)]


def test_items_that_are_no_candidates_are_not_shuffled(spark):
    items = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(40)], "item_id int, tokens array<string>")
    candidates = spark.createDataFrame([(1, 3, 2.0), (1, 5, 1.0), (2, 5, 1.0)], "qid int, item_id int, score double")
    own = retrieval.wanted_items(candidates, items)
    assert sorted(r.item_id for r in own.collect()) == [3, 5] == sorted(r.item_id for r in retrieval.wanted_items(candidates, items, few=1).collect())
    assert "hashpartitioning" not in own._jdf.queryExecution().executedPlan().toString()
