import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlore.operators import chunking, corpus, rank_eval, retrieval, textindex
from wattlore.sources import files


def test_table_to_markdown(spark):
    html = "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>"
    df = spark.createDataFrame([(html,), ("",), (None,), ("<table><tr><td> </td></tr></table>",)], "h string")
    rows = [r.m for r in df.select(corpus.html_table_to_markdown("h").alias("m")).collect()]
    assert tuple(rows[0]) == ("| a | b |\n|---|---|\n| 1 |  |", 2, 2)
    assert all(tuple(r) == ("", 0, 0) for r in rows[1:])


def test_heading_levels(spark):
    cases = [("第1章 X", 1), ("1.2 X", 2), ("1.2.3 X", 3), ("（一）X", 2), ("3) X", 3), ("Foo", 2), ("摘 要", 1)]
    got = spark.createDataFrame([c[0:1] for c in cases], "t string").select(corpus.heading_level(F.col("t")).alias("l")).collect()
    assert [r.l for r in got] == [c[1] for c in cases]
    blocks = spark.createDataFrame([("d", 0, "title", "Top"), ("d", 1, "title", "x" * 61), ("d", 2, "title", "1.1 a"), ("d", 3, "paragraph", "p")], "doc_dir string, block_order int, type string, text string")
    out = {r.block_order: (r.type, r.level) for r in corpus.infer_title_level(blocks).collect()}
    assert out == {0: ("title", 0), 1: ("paragraph", None), 2: ("title", 2), 3: ("paragraph", None)}


def test_section_path(spark):
    rows = [("d", i, lv, t) for i, (lv, t) in enumerate([(0, "T"), (1, "a"), (2, "b"), (2, "c"), (1, "d"), (None, "body"), (0, "T2"), (None, "x")])]
    got = corpus.section_path(spark.createDataFrame(rows, "doc_dir string, block_order int, level int, text string")).orderBy("block_order").collect()
    assert [r.section_path for r in got] == [[], ["a"], ["a", "b"], ["a", "c"], ["d"], ["d"], [], []]


def test_pages_to_units(spark, tmp_path):
    block = lambda t, s: {"type": t, "content": {"text": s}}
    for name, pages in {"doc a": [[block("title", "T"), block("paragraph", "runs")], [block("paragraph", " on."), block("page_header", "h")]], "b": [[block("equation", "x"), block("equation", "y"), block("paragraph", "where x is")]]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pages.json").write_text(json.dumps(pages))
    docs = files.read_pages(spark, str(tmp_path / "*"))
    assert {r.doc_dir for r in docs.collect()} == {"doc a", "b"}
    blocks = corpus.flatten_pages(docs).withColumn("text", corpus.clean_text(F.get_json_object("content", "$.text")))
    kept, dropped = corpus.drop_noise(blocks, ["title", "paragraph", "equation"])
    assert [(r.reason, r["count"]) for r in dropped.collect()] == [("noise:page_header", 1)]
    units = corpus.merge_and_group(kept.drop("content")).orderBy("doc_dir", "block_order").collect()
    assert [(r.type, r.text, r.merged_pages, r.latex, r.context_after) for r in units] == [
        ("equation", "x\ny", [], ["x", "y"], "where x is"), ("paragraph", "where x is", [], [], None), ("title", "T", [], [], None), ("paragraph", "runson.", [1], [], None),
    ]
    ids = corpus.assign_unit_ids(corpus.merge_and_group(kept.drop("content"))).orderBy("doc_dir", "order").collect()
    assert ids[0].unit_id.endswith("-0000") and len(ids[0].doc_id) == 12


def test_captions(spark):
    rows = [("d", 0, "paragraph", "Table 1 about x", None), ("d", 1, "table", "t", None), ("d", 2, "image", "i", ""), ("d", 3, "paragraph", "Figure 2 y", None), ("d", 4, "table", "t", "own")]
    got = {r.block_order: r.caption for r in corpus.infer_captions(spark.createDataFrame(rows, "doc_dir string, block_order int, type string, text string, caption string")).collect()}
    assert got == {1: "Table 1 about x", 2: "Figure 2 y", 4: "own"}


def test_spans(spark):
    df = spark.createDataFrame([([("text", "a  "), ("inline_equation", "x^2"), ("list_item", "one"), ("list_item", "two")],)], "s array<struct<type:string,content:string>>")
    assert df.select(corpus.spans_to_text(F.col("s")).alias("t")).first().t == "a $x^2$- one\n- two"


def test_split_and_cuts():
    assert chunking.pack_sentences("abcde", 2) == ["ab", "cd", "e"]
    assert chunking.pack_sentences("aa。bb。", 3) == ["aa。", "bb。"]
    assert chunking.pack_sentences("", 5) == []
    import itertools

    def cost(lengths, glue, ends, target, max_len, min_len, alpha):
        total, a = 0.0, 0
        for z in ends:
            n = sum(lengths[a:z]) + z - a - 1
            if n > max_len and z - a > 1:
                return float("inf")
            # too short: twice the missing share of the least length; up to the target: half the distance; beyond: one and a half, and 5 more over the maximum
            size = (min_len - n) / min_len * 2 if n < min_len else (target - n) / target * 0.5 if n <= target else (n - target) / target * 1.5
            total += 2 * (1 - alpha) * (size + (5 if n > max_len else 0)) + (2 * alpha * glue[z - 1] if z < len(lengths) else 0)
            a = z
        return total

    import random

    rng = random.Random(0)
    for _ in range(40):
        n = rng.randint(1, 7)
        lengths, glue = [rng.randint(1, 60) for _ in range(n)], [rng.choice([0.6, 2, 3]) for _ in range(n)]
        how = (40, 70, 12, 0.5)
        got = chunking.best_cuts(lengths, glue, *how)
        best = min(cost(lengths, glue, [*c, n], *how) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert cost(lengths, glue, got, *how) == pytest.approx(best)


def runs(spark):
    rows = [(1, i, f"u{i}", t, x, ["A"] if s == "A" else ["B"], 0, "Doc") for i, (t, x, s) in enumerate([("title", "h", "A"), ("paragraph", "aaaa", "A"), ("paragraph", "bbbb", "A"), ("table", "cc", "B"), ("paragraph", "dddd", "A")])]
    return chunking.section_runs(spark.createDataFrame(rows, "doc_id long, order int, unit_id string, type string, text string, section_path array<string>, page int, doc_title string"))


def test_runs_and_segments(spark):
    r = runs(spark)
    assert [x.run_id for x in r.orderBy("order").collect()] == [1, 1, 2, 3]
    chunks = chunking.assemble_chunks(chunking.dp_segment(chunking.glue_cost(r))).orderBy("seq").collect()
    assert [(c.chunk_id, c.body, c.has_anchor) for c in chunks] == [("1-c0000", "aaaa\nbbbb", False), ("1-c0001", "cc", True), ("1-c0002", "dddd", False)]
    assert chunks[0].text.startswith("《Doc》 A\n")
    windows = chunking.fixed_window_segment(r, 6, 2).filter("run_id = 1").orderBy("seg").collect()
    assert [(w.body, w.unit_ids) for w in windows] == [("aaaa\nb", ["u1", "u2"]), ("\nbbbb", ["u2"])]
    assert [x.unit_ids for x in chunking.title_segment(r, 5).filter("run_id = 1").collect()] == [["u1", "u2"]] * 2


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("a", ["x", "y", "y"]), ("b", ["x"]), ("c", ["z", "q"]), ("d", ["w"]), ("e", ["v"])], "item_id string, tokens array<string>")
    index = textindex.bm25_index(docs, "item_id", "tokens", "chunk")
    q = spark.createDataFrame([(1, ["y", "y", "x"]), (2, ["none"]), (3, [])], "qid int, tokens array<string>")
    top = retrieval.bm25_topk(q, index, "chunk", 5).collect()
    assert [(r.qid, r.item_id, r.rank) for r in sorted(top, key=lambda r: r.rank)] == [(1, "a", 1), (1, "b", 2)]
    import math

    df, n, avg = 1, 5, 8 / 5
    y = 2 * (math.log(n - df + 0.5) - math.log(df + 0.5)) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    x = (math.log(n - 2 + 0.5) - math.log(2.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert top[0].score == pytest.approx(x + y, abs=1e-6)
    one = spark.createDataFrame([(1, "a", 1)], "qid int, item_id string, rank int")
    two = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "qid int, item_id string, rank int")
    fused = {r.item_id: r for r in retrieval.rrf_fuse({"bm25": one, "sub": two}).collect()}
    assert fused["a"].score == pytest.approx(1 / 61 + 1.2 / 62) and fused["a"].channels == {"bm25": 1, "sub": 2}


def test_dense_blocks(spark):
    items = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "item_id long, embedding array<float>")
    q = spark.createDataFrame([(10, [2.0, 1.0, 0.0, 0.0]), (11, [0.0, 0.0, 0.0, 3.0])], "qid long, embedding array<float>")
    for size in (16_000_000, 4):
        got = {(r.qid, r.rank): r.item_id for r in retrieval.dense_topk(q, items, 2, size).collect()}
        assert got[10, 1] == 0 and got[10, 2] == 1 and got[11, 1] == 3


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "h", "x"), (2, "h", "y")], "qid int, type string, item_id string")
    hits = spark.createDataFrame([(1, "x", 4), (1, "q", 1)], "qid int, item_id string, rank int")
    row = rank_eval.ranking_metrics(hits, gold).filter("type = 'ALL'").first()
    assert (row.n, row.recall_1, row.recall_3, row.recall_5, row.recall_10, row.mrr) == (2, 0, 0, 0.5, 0.5, 0.125)


def test_grade_and_kappa(spark):
    pairs = spark.createDataFrame([(1, "a", ["x", "y"], ["x"], ["y"]), (1, "b", [], ["x"], []), (1, "c", ["x", "y"], ["q"], [])], "qid int, item_id string, query_tokens array<string>, tokens array<string>, heading_tokens array<string>")
    idf = spark.createDataFrame([("x", 3.95), ("y", 1.05)], "term string, idf double")
    assert {r.item_id: r.grade for r in rank_eval.lexical_grade(pairs, idf).collect()} == {"a": 3, "b": 1, "c": 0}
    same = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int")
    assert rank_eval.agreement(same, "a", "b")[0].first().kappa == 1
    assert rank_eval.agreement(same.filter("a = 1"), "a", "b")[0].first().kappa is None


def test_chunking_ablation(spark):
    schema = "chunk_id string, unit_ids array<string>, tokens array<string>"
    one = spark.createDataFrame([("c1", ["u1", "u2"], ["x", "y"]), ("c2", ["u3"], ["z"]), ("c3", ["u4"], ["w"])], schema)
    two = spark.createDataFrame([("d1", ["u1"], ["x"]), ("d2", ["u2"], ["y"]), ("d3", ["u4"], ["w"])], schema)
    q = spark.createDataFrame([(1, "h", ["y"], "u2"), (2, "h", ["z"], "u3")], "qid int, type string, tokens array<string>, source_unit_id string")
    metrics, skipped = rank_eval.chunking_ablation({"one": one, "two": two}, q)
    assert {r.config: (r.n, r.recall_1) for r in metrics.filter("type = 'ALL'").collect()} == {"one": (2, 1), "two": (1, 1)}
    assert {r.config: r.skipped for r in skipped.collect()} == {"one": 0, "two": 1}


def test_neighbours_and_spans(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", s) for i, s in enumerate([["a"], ["a", "b"], ["b"], ["z"], ["b"]])], "doc_id string, seq int, chunk_id string, section_path array<string>")
    hits = spark.createDataFrame([(1, "c1")], "qid int, item_id string")
    assert {r.item_id for r in retrieval.neighbors(hits, chunks).collect()} == {"c0", "c2"}
    assert [r.item_id for r in retrieval.section_span(hits, chunks, 2).orderBy("seq").collect()] == ["c0", "c1"]


def test_filter_expand(spark):
    hits = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "c", 1.0)], "qid int, item_id string, score double")
    again = spark.createDataFrame([(1, "z", 9.0), (2, "d", 0.5)], "qid int, item_id string, score double")
    near = spark.createDataFrame([(1, "n", "a"), (1, "b", "a")], "qid int, item_id string, from_id string")
    grades = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "n", 3), (2, "c", 0), (2, "d", 3), (1, "z", 3)], "qid int, item_id string, grade int")
    got = {(r.qid, r.item_id): r.expanded_from for r in rank_eval.filter_expand_regrade(hits, again, near, grades).collect()}
    assert got == {(1, "a"): None, (1, "n"): "a", (2, "d"): None}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" H2 ;CH4;Fail\n1,5;x;pd \n2;3,25;NF\n")
    rows = files.read_semicolon_csv(spark, str(tmp_path / "a.csv"), ["H2", "CH4"], "Fail", "s1").collect()
    assert [(r.H2, r.CH4, r.label) for r in rows] == [(1.5, None, "PD"), (2.0, 3.25, "NF")]
    (tmp_path / "lex.json").write_text(json.dumps({"fault": {"arc": ["spark", "arcing"]}}))
    assert {(r.surface, r.canon, r.type) for r in files.read_lexicon(spark, str(tmp_path / "lex.json")).collect()} == {("arc", "arc", "fault"), ("spark", "arc", "fault"), ("arcing", "arc", "fault")}
    (tmp_path / "s1.csv").write_text("date,OT\n2024-01-01 00:00:00,1.5\nbad,2\n")
    assert [(r.series_id, r.OT) for r in files.read_series(spark, str(tmp_path / "s1.csv")).collect()] == [("s1", 1.5), ("s1", 2.0)]
    src = spark.createDataFrame([("data/synthetic/x",), ("data/real/y",), ("data/real/z",)], "path string")
    roles = spark.createDataFrame([("data/real/z", "test", ["evaluate"])], "path string, role string, allowed array<string>")
    assert {r.path for r in files.forbidden_roles(src, roles, "train").collect()} == {"data/synthetic/x", "data/real/z"}
    with pytest.raises(ValueError):
        files.assert_role(src, roles, "train")


def test_params_round_trip(spark, tmp_path):
    defaults = {
        "prior": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "class string, p double"), "cpt": spark.createDataFrame([("a", "s", 0.5, 0.5, "expert"), ("a", "t", 0.1, 0.9, "expert")], "class string, symptom string, p_true double, p_false double, source string"),
        "weights": spark.createDataFrame([("a", 0.7)], "class string, w double"),
    }
    path = str(tmp_path / "p")
    files.write_params({**defaults, "weights": spark.createDataFrame([("a", 1.7)], "class string, w double"), "t": spark.createDataFrame([(1.2,)], "t double")}, path)
    got = files.read_params(spark, path, defaults)
    assert {r["class"]: r.w for r in got["weights"].collect()} == {"a": 1.0} and got["t"].first().t == pytest.approx(1.2)
    assert {r.symptom: r.source for r in got["cpt"].collect()} == {"s": "learned", "t": "learned"}


def test_queries_over_the_whole_job(spark, tmp_path):
    """All lines as hits, a sub-chunk layer that is indexed, and a history of calls, where the registered ones take less."""
    import datetime
    import re

    from wattlore.plans import queries

    d = str(tmp_path)
    words = ["apple", "bear", "cedar", "dune", "ember", "fjord", "grove", "heath"]
    body = lambda i: "\n".join(f"{words[i % 8]} is near line {'ab' * (j % 3 + 1)}." * 3 for j in range(7))
    docs = [(i, body(i)) for i in range(1, 8)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "apple dune"), (1, "fjord")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = [(r.qid, r.item_id, r.from_id) for r in queries.QUERIES["neighbour_units"](spark, d).collect()]
    want = [(i, f"{i}-{b}", f"{i}-{a}") for i, t in docs for a in range(len(t.split("\n"))) for b in (a - 1, a + 1) if 0 <= b < len(t.split("\n"))]
    assert sorted(got) == sorted(want) and len(want) == 7 * 12

    fused = {(r.qid, r.item_id): r.score for r in queries.QUERIES["rank_fusion"](spark, d).collect()}
    ranks = {(r.qid, r.item_id): r["rank"] for r in queries.benchmark_ranks(spark, d).collect()}
    subs = [(f"{i}-s{k:03d}", i, x) for i, t in docs for k, x in enumerate(textindex.sub_chunks(t, 100, 150))]
    tokens = spark.createDataFrame([(s, re.findall(r"[a-z]{2,}", x.lower())) for s, _, x in subs], "item_id string, tokens array<string>")
    index = textindex.bm25_index(tokens, "item_id", "tokens", "sub")
    asked = spark.createDataFrame([(0, ["apple", "dune"]), (1, ["fjord"])], "qid long, tokens array<string>")
    best = {}
    for r in retrieval.bm25_topk(asked, index, "sub", 30).collect():
        key = (r.qid, dict((s, i) for s, i, _ in subs)[r.item_id])
        best[key] = min(best.get(key, 99), r["rank"])
    place = {}
    for q in (0, 1):
        for n, key in enumerate(sorted((k for k in best if k[0] == q), key=lambda k: (best[k], k[1])), 1):
            place[key] = n
    assert place and any(i % 2 for _, i in place)
    for key in ranks.keys() | place.keys():
        assert fused[key] == pytest.approx((1 / (60 + ranks[key]) if key in ranks else 0) + (1.2 / (60 + place[key]) if key in place else 0), abs=1e-8)
    assert fused.keys() == ranks.keys() | place.keys()

    day = lambda n: datetime.datetime(2024, 1, n)
    events = [(1, day(2), 1, "a"), (2, day(20), 1, "a"), (3, day(20), 1, "b"), (4, day(21), 1, "b"), (5, day(16), 2, "a"), (6, day(15), 3, "a"), (7, day(15), 3, "a")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    assert {(r.event_id, r.reason) for r in queries.QUERIES["repeated_calls"](spark, d).collect()} == {(2, "made"), (4, "repeated")}


def plain_units(doc):
    """merge_and_group of one document, block by block."""
    import re

    caption, context = re.compile(r"^(图|表|Fig(ure)?\.?|Table)\s*[0-9]+", re.I), re.compile(r"^(式中|其中|where\b)", re.I)
    units = []
    for order, page, kind, text in doc:
        last = units[-1] if units else None
        both = last is not None and kind == last["type"]
        if both and kind == "paragraph" and page == last["page"] + 1 and not re.search(r"[。！？.!?;；:：]\s*$", last["text"]) and not caption.match(text) and not caption.match(last["text"]):
            last["text"] += text
            last["pages"].append(page)
        elif both and kind == "equation":
            last["text"] += "\n" + text
            last["latex"].append(text)
        else:
            unit = {"order": order, "page": page, "type": kind, "text": text, "pages": [], "latex": [text] if kind == "equation" else [], "before": None, "after": None}
            if kind == "equation" and last is not None and last["type"] == "paragraph" and len(last["text"]) <= 300:
                unit["before"] = last["text"]
            if kind == "paragraph" and last is not None and last["type"] == "equation" and context.match(text):
                last["after"] = text
            units.append(unit)
    return [tuple(u.values()) for u in units]


def test_merging_against_a_plain_scan(spark):
    rng = np.random.default_rng(7)
    texts = ["open", "closed.", "Table 3 of", "where x", "Figure 2", "ends; ", "long " * 80, "式中 a"]
    rows, want = [], {}
    for d in range(250):
        page, doc = 1, []
        for o in range(int(rng.integers(1, 25))):
            page += int(rng.choice([0, 0, 1, 1, 1, 2], p=[0.25, 0.2, 0.25, 0.15, 0.1, 0.05]))
            doc.append((o, page, str(rng.choice(["paragraph", "title", "equation", "table"], p=[0.8, 0.05, 0.1, 0.05])), str(rng.choice(texts, p=[0.6, 0.08, 0.06, 0.08, 0.04, 0.04, 0.05, 0.05]))))
        want[f"d{d}"] = plain_units(doc)
        rows += [(f"d{d}", *x) for x in doc]
    df = spark.createDataFrame(rows, "doc_dir string, block_order int, page int, type string, text string")
    got = {}
    for r in corpus.merge_and_group(df).orderBy("doc_dir", "block_order").collect():
        got.setdefault(r.doc_dir, []).append((r.block_order, r.page, r.type, r.text, r.merged_pages, r.latex, r.context_before, r.context_after))
    assert got == want
    assert corpus.merge_and_group(df.limit(0)).count() == 0


def test_best_words_against_every_path():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lexicon = {"".join(rng.choice(list("甲乙丙"), rng.integers(1, 4))) for _ in range(4)}
        by_first = {}
        for w in sorted(lexicon, key=lambda w: (-len(w), w)):
            by_first.setdefault(w[0], []).append(w)
        run = "".join(rng.choice(list("甲乙丙丁"), rng.integers(1, 9)))

        def paths(i):
            if i == len(run):
                yield ()
                return
            for rest in paths(i + 1):
                yield ((run[i], False), *rest)
            for w in lexicon:
                if run.startswith(w, i):
                    for rest in paths(i + len(w)):
                        yield ((w, True), *rest)

        cost = lambda p: (sum(not x for _, x in p), sum(x for _, x in p))
        best = min(map(cost, paths(0)))
        got = textindex.best_words(run, by_first)
        assert "".join(p for p, _ in got) == run and (sum(len(p) for p, x in got if not x), sum(x for _, x in got)) == best
        assert all(a or b for (_, a), (_, b) in zip(got, got[1:])) and all(p in lexicon for p, x in got if x)


def test_sealed_hash_is_the_files_own(spark):
    import hashlib

    from wattlore.operators import sealed

    rows = [(f, i, f"line {i} é" * (i % 3)) for f in ("a", "b") for i in range(200)] + [("c", 0, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "f string, i int, line string").repartition(5)
    got = {r.f: (r.n, r.sha256) for r in sealed.sealed_hash(df, "i", "line", "f", piece_bytes=100).collect()}
    whole = lambda name: hashlib.sha256("".join(x + "\n" for f, _, x in rows if f == name and x is not None).encode()).hexdigest()
    assert got == {"a": (200, whole("a")), "b": (200, whole("b")), None: (1, whole(None))}
    registry = spark.createDataFrame([("a", 200, whole("a")), ("b", 199, whole("b")), ("d", 1, "x")], "f string, n long, sha256 string")
    status = {r.f: r.status for r in sealed.check_sealed(sealed.sealed_hash(df, "i", "line", "f"), registry, "f").collect()}
    assert status == {"a": "OK", "b": "CHANGED", None: "MISSING", "d": "GONE"}
