"""Segments are found without shuffling the texts again for a join."""

from wattlore.operators import chunking


def test_dp_segment_joins_nothing_and_keeps_every_column(spark):
    rows = [(1, 1, k, "word " * 20 * (k % 3 + 1), "paragraph", 0.6 if k < 9 else None) for k in range(10)] + [(2, 1, 0, None, "paragraph", None)]
    runs = spark.createDataFrame(rows, "doc_id long, run_id long, order int, text string, type string, glue double")
    out = chunking.dp_segment(runs)
    assert out.columns == ["doc_id", "run_id", "order", "text", "type", "glue", "seg"]
    assert sorted(tuple(r)[:6] for r in out.collect()) == sorted(rows)
    lengths, glue = [len(r[3]) for r in rows[:10]], [r[5] or 0.0 for r in rows[:10]]
    ends = chunking.best_cuts(lengths, glue, 400, 700, 120, 0.5)
    assert [r.seg for r in out.filter("doc_id = 1").orderBy("order").collect()] == [sum(e <= k for e in ends) for k in range(10)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
