"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import corpus_pipeline as P
import pytest

from wattlore.llm import decontam

RNG = random.Random(11)
VOICE = {"en": ["the", "ing", "and", "th", "er"], "de": ["der", "sch", "ung", "ein", "ch"]}


def text(lang, n):
    return " ".join("".join(RNG.choices(VOICE[lang], k=RNG.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    items = [(i, text("en", 25) + ". " + text("en", 6) + ".") for i in range(5)]
    rows = [(i, text(lang, RNG.randint(5, 80)), lang) for i, lang in enumerate(RNG.choices(["en", "de"], k=120))]
    base = text("en", 200)
    for i in range(8):
        w = base.split()
        for _ in range(i):
            w[RNG.randrange(200)] = "edit"
        rows.append((200 + i, " ".join(w), "en"))
    rows += [(300, text("en", 40) + "\n" + items[0][1] + " " + text("en", 20), "en"), (301, "123 456 !", "en"), (302, None, "en"), (303, "", None), (304, rows[0][1], "de"), (305, rows[0][1], "de")]
    spark.createDataFrame([(d_, t, g, "s", len(t or "")) for d_, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.language_id(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    first = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in docs.collect()} - set(first) == {301, 302, 303}

    second = {r.doc_id for r in P.ngram_jaccard_join(spark, kept, sf_dir).collect()}
    sets = {d: shingles(t) for d, t in first.items()}
    group = {d: d for d in sets}
    for _ in range(len(sets)):
        changed = False
        for a in sets:
            for b in sets:
                if group[a] < group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[b], changed = group[a], True
        if not changed:
            break
    assert second == {d for d in sets if group[d] == d}
    assert {304, 305} & second == set() and 200 in second

    third = {r.doc_id for r in P.decontamination(spark, docs.filter(docs.doc_id.isin(*second)), sf_dir).collect()}
    assert third == second - {300}

    packed = P.packing(spark, docs.filter(docs.doc_id.isin(*third)), sf_dir).collect()
    assert {r.doc_id for r in packed} == third and len(packed) == len(third)


def test_run_and_names(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "packing"]
    got = P.run(spark, sf_dir).collect()
    assert got and {"doc_id", "piece", "sequence_id", "offset"} <= set(got[0].asDict())
    leaks = decontam.find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(300, 0)}


def test_rows_are_kept_and_dropped_by_row(spark, sf_dir):
    """Repeated rows, null ids and two rows of one doc_id: exactly one row of a group stays and clean rows all do."""
    rng = random.Random(3)
    fresh = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40))
    a, b, c, d, clean, other = (fresh() for _ in range(6))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id = 0").first().text
    leak = fresh() + " " + item + " " + fresh()
    rows = [(1, a), (1, a), (5, a), (5, clean), (7, b), (7, b), (None, c), (None, c), (9, d), (None, d), (9, other), (20, ""), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in P.ngram_jaccard_join(spark, docs, sf_dir).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(kept, key=key) == sorted([(1, a), (5, clean), (7, b), (None, c), (9, d), (9, other), (20, ""), (20, "")], key=key)

    docs = spark.createDataFrame([(1, leak), (1, clean), (None, leak), (None, other), (2, d)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in P.decontamination(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=key) == sorted([(1, clean), (None, other), (2, d)], key=key)
