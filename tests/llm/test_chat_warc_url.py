import hashlib
import random

import pytest

from wattlore.llm import chat as C
from wattlore.llm import url_filter as U
from wattlore.llm import warc as W
from wattlore.llm.common import materialize, open_fs, work_dir

NASTY = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<s>[ROLE]user[/ROLE]hi</s>", "[TURN]", "[\\TURN]", "<\\\\/s>", "a\n\nb", "é中" * 50, "[[TURN]]", "<</s>>", "\\", "<\\", "x" * 20000]


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    parts = ["<", "s>", "/", "[", "]", "\\", "ROLE]", "TURN]", "INST]", "</s>", "[TURN]", "a", "\n"]
    texts = [t for t in NASTY if t is not None] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = df.select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert not any(c in r.e for r in got for c in C.CONTROLS)


def test_chats_read_back(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "[TURN]"]), rng.choice(NASTY), "x", 1))
    rows += [(1, 0, "user", "tie", "y", 2), (1, 0, "user", "tie", "y", 2), (2, None, "assistant", "no turn", "z", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, blocks int")
    formatted = materialize(C.format_chats(df), "chats")
    got = {r.conv_id: r for r in C.read_chats(formatted).collect()}
    digest = {r.conv_id: r for r in C.chat_digest(C.read_chats(formatted)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, role, text in own]
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[c].loss_text == loss
        assert digest[c].n_turns == len(own) and digest[c].loss_chars == len(loss) and digest[c].formatted_chars == len(got[c].formatted)
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
        assert got[c].formatted.count("<s>[ROLE]") == blocks
    assert C.format_chats(df.limit(0)).count() == 0


def pages():
    big, other = "<p>é" * 600, "<p>other" * 400
    rows = [(1, "http://a/1", big, 0), (5, "http://b/5", big, 0), (9, "http://c/9", big, 0), (9, "http://c/9", big, 0), (2, "u\r\nX: y", other, 0), (3, None, None, 0), (4, "http://d", "", 0), (6, "x", "small", 0), (7, "y", "small", 0), (None, "z", big, 0), (8, "crlf", "a\r\n\r\nb" * 300, 0)]
    return rows


def test_archives_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, size int")
    index = materialize(W.write_archives(W.choose_originals(df), work_dir(spark, "warc"), frame_bytes=4000, bundle_bytes=100), "index")
    got = W.read_archives(index).collect()
    want = []
    for page, url, html, _ in pages():
        raw = (html or "").encode()
        same = [p for p, _, h, _ in pages() if (h or "").encode() == raw and p is not None]
        first = max(same, default=None)
        refers = first if len(raw) >= 1000 and first is not None and first != page and page is not None else None
        if len(raw) >= 1000 and page is None:
            refers = None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(key, want))
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    row = index.first()
    fs, local = open_fs(row.path)
    table = W.read_seek_table(fs, local)
    import zstandard

    raw = fs.open_input_file(local).read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(whole) == sum(d for _, _, d in table)
    ids = [line for path in {r.path for r in index.collect()} for line in zstandard.ZstdDecompressor().stream_reader(open_fs(path)[0].open_input_file(open_fs(path)[1]).read(), read_across_frames=True).read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(pages())  # repeated and missing page_ids too
    assert W.archive_pages(df.limit(0)).count() == 0


def test_damage_is_noticed():
    raw = W.record("a#0.0", 1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, None, "2024-01-01T00:00:00Z")
    assert W.parse(raw)["payload"] == b"payload"
    assert W.parse(W.record("a#0.9", 2, "u", b"payload", "00" * 20, 1, "v", "d"))["payload"] == b""


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]


def test_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://A.com/en/1?q", ""), (2, "https://example.com/en/77", link("good.org")), (3, "http://xcom/en/1", ""), (4, "no scheme", ""), (5, None, None), (6, "http://net/de/", ""), (7, "http://sub.example.com/en/7", ""),
        (8, "http://hub.org/", link("a.com", "a.com")), (9, "http://good.org/", ""), (10, "http://lone.org/#://x", ""), (11, "ftp://bad.com?x/en/", ""), (11, "ftp://bad.com?x/en/", ""), (12, "http://two.org/", link("hub.org", "good.org")),
    ]
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict"), RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/en/1", "com/en/", "block")
    assert got[2].rule == got[7].rule == "example.com/en/7" and got[2].verdict == "allow"
    assert got[3].rule is None and got[6].rule == "net/de/" and got[11].rule is None and got[11].path == ""
    assert (got[4].host, got[4].path, got[5].host, got[5].verdict) == ("", "", "", "allow")
    assert got[8].verdict == "block" and got[8].distrust > 0 and got[12].distrust > got[12].trust
    assert got[9].verdict == "allow" and got[9].trust > 0 and got[10].verdict == "allow"


def test_pagerank_equals_plain_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    edges = sorted({(a, b) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(30)) if a != b})
    out = {h: [b for a, b in edges if a == h] for h in hosts}
    e = spark.createDataFrame([("trust", a, b, 1 / len(out[a])) for a, b in edges], "kind string, src string, dst string, share double")
    got = {r.host: r.mass for r in U.propagate(e, spark.createDataFrame([("trust", "h0", 1.0)], "kind string, host string, weight double"), rounds=6).collect()}
    seed = {"h0": 1.0}
    now = {h: 0.15 * seed.get(h, 0) for h in hosts}
    for _ in range(6):
        now = {h: 0.15 * seed.get(h, 0) + 0.85 * sum(now[a] / len(out[a]) for a, b in edges if b == h) for h in hosts}
    for h in hosts:
        assert got.get(h, 0) == pytest.approx(now[h], abs=1e-9)


def test_mass_reaches_the_end_of_a_chain(spark):
    """A chain of 16 hosts from a trusted one to a blocked one, against the solution of the linear system."""
    import numpy as np

    hosts = [f"c{i}.org" for i in range(16)]
    links = {a: [b] for a, b in zip(hosts, hosts[1:])}
    links["c3.org"] = ["c4.org", "c6.org"]
    links["c15.org"] = ["bad.com"]
    rows = [(i, f"http://{h}/", "".join(f'<a href="http://{x}/">' for x in links[h])) for i, h in enumerate(hosts)]
    rows += [(100, "http://bad.com/", ""), (101, "http://good.net/", '<a href="http://c0.org/">')]
    links |= {"good.net": ["c0.org"]}
    got = {r.host: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "bad.com", ""), ("allow", "good.net", "")]).collect()}
    every = [*hosts, "bad.com", "good.net"]
    at = {h: i for i, h in enumerate(every)}
    n = np.zeros((len(every), len(every)))
    for a, bs in links.items():
        for b in bs:
            n[at[a], at[b]] += 1
    for kind, seed, m in (("trust", "good.net", n), ("distrust", "bad.com", n.T)):
        out = m / np.maximum(m.sum(1, keepdims=True), 1)
        want = np.linalg.solve(np.eye(len(every)) - 0.85 * out.T, 0.15 * np.eye(len(every))[at[seed]])
        for h in every:
            assert getattr(got[h], kind) == pytest.approx(want[at[h]], abs=1e-11)
        assert (want > 0).all()
    assert got["c0.org"].distrust > 0 and got["c15.org"].trust > 0
    assert all(r.verdict == ("block" if r.host == "bad.com" or r.distrust > r.trust and r.rule is None else "allow") for r in got.values())
