"""Pages of many documents in one file."""

import pathlib

from wattlore.plans.registered import QUERIES


def test_pages_round_trip_writes_no_file_for_each_document(spark, tmp_path):
    texts = {i: f"t{i}\n\"q\" \\ \r ü\n\n" + "line\n" * i for i in range(60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("part-*"))
    got = {r.doc_id: (r.n_blocks, r.last_page, r.chars, r.last_block) for r in QUERIES["pages_round_trip"](spark, str(tmp_path)).collect()}
    lines = {i: t.split("\n") for i, t in texts.items()}
    assert got == {i: (len(x), (len(x) - 1) // 10, sum(map(len, x)), len(x) - 1) for i, x in lines.items()}
    assert 0 < len(set(shared.rglob("part-*")) - before) < 30
