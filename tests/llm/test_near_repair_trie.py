"""SimHash groups, conversation repair and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wattlore.llm import viterbi
from wattlore.llm.chat_repair import damage, repair_conversations
from wattlore.llm.parentheses import WIDTH, Trie
from wattlore.llm.prefix_trie import NO_END, prefix_trie
from wattlore.llm.simhash import bucket_links, near_pairs, simhash_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, links):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min((x for x in (least.get(k), r) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def test_simhash_groups_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "dé", "e", "Zeta", "éta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One two", "A b c d e " * 3] + base + base[:3]
    for b in base[:8]:
        w = b.split()
        for _ in range(3):
            w[rng.randrange(80)] = rng.choice(words)
            texts.append("  ".join(w))
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    rows = [(i if i != 7 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, COMPONENT_ID int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_groups(docs).collect()}
    prints = [plain_print(t) for t in texts]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = plain_groups([r[0] for r in rows], links)
    assert got == {(r[0], f"{p:016x}"): c for r, p, c in zip(rows, prints, want)}
    assert simhash_groups(docs.limit(0)).count() == 0
    assert simhash_groups(docs.limit(1)).count() == 1


def test_near_pairs_deal_heavy_buckets_again_and_lose_nothing(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 15, 2**64 - 16}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randrange(9)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_groups(signed, [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for most in (4_000_000, 30_000):
        at = {f: i for i, f in enumerate(signed)}
        pairs = [(r.a, r.b) for r in near_pairs(df, most=most).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)
        assert plain_groups(signed, [(at[a], at[b]) for a, b in pairs]) == want


def test_bucket_links_of_one_variant():
    a, b = bucket_links(np.array([0, 1, 3, 12], np.int64), np.array([2, 2, 2, 2]), 60, 4)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} >= {frozenset((0, 1)), frozenset((0, 3)), frozenset((0, 12))}


# Conversation repair

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """rows (turn, role, text) of one conversation in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(None)
    def best(i, q, left):
        options = []
        if i == len(rows) and q in (0, 3):
            options.append((0, "", ()))
        add = lambda cost, letter, line, rest: options.append((cost + rest[0], letter + rest[1], line + rest[2])) if rest else None
        nxt = 3 if q == 2 else 2
        said = {2: "user", 3: "assistant"}[nxt]
        if left:
            add(2, "I", (f"{said}:",), best(i, nxt, left - 1))
        if i < len(rows):
            add(3, "D", (), best(i + 1, q, 4))
            if faults[i] not in ("blank", "duplicate"):
                cut = int(faults[i] == "truncated")
                add(2 + cut, "R", (f"{said}:{rows[i][2]}",), best(i + 1, nxt, 4))
                if (k := to[q].get(rows[i][1][:1])) is not None:
                    add(cut, "K", (f"{rows[i][1]}:{rows[i][2]}",), best(i + 1, k, 4))
        return min(options, key=lambda x: x[:2], default=None)

    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    for i in range(len(rows), 0, -10):  # from behind, so that no call goes deep
        for q in range(4):
            best(i, q, 4)
    cost, audit, lines = best(0, 0, 4)
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_repairs(rows):
    by = defaultdict(list)
    for conv, *rest in plain_damage(rows):
        by[conv].append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: plain_repair(sorted(by[c], key=order)) for c in {r[0] for r in rows}}


def chats(rng, n, roles=("system", "user", "assistant", "user", "assistant", "tool", None, "")):
    texts = ["Hi.", "no end", "", " \n", None, "Well! ", "a?\t", "ok. so"]
    return [(c if c != 3 else None, None if rng.random() < 0.1 else t * rng.choice((1, 1, 2)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.random()}.")
            for c in range(n) for t in range(rng.randrange(1, 9))]


SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(df, **kw):
    return {r.conv_id: tuple(r)[1:] for r in repair_conversations(damage(df), **kw).collect()}


@pytest.mark.parametrize("most", [4096, 2])
def test_repair_against_all_edits(spark, most):
    rows = chats(random.Random(2), 60)
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), most_rows=most)
    assert got == plain_repairs(rows)


def test_repair_of_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(("user", "assistant", "assistant", "system", "x")), rng.choice(("Same.", "cut", f"Own {t}."))) for t in range(700)]
    rows += [(8, t // 50, "user", "Same.") for t in range(300)] + [(9, t, "tool", f"All {t}.") for t in range(200)] + [(10, 0, "user", "Long " * 50_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_head", __import__("pyspark").sql.functions.lit(1))
    want = plain_repairs(rows)
    assert repaired(df, most_rows=50) == want == repaired(df)


def test_repair_of_nothing_and_of_lost_conversations(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)) == {lost: (0, 0, 0, 0, 0, 0, "", NO_END)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 10, 9, 11, 6]), max_size=40), st.integers(0, 40))
def test_fix_up_gives_exact_costs_up_to_a_constant(codes, cut):
    codes = np.array(codes, np.uint8)
    cut = min(cut, len(codes))
    exact = viterbi.first_pass(codes, viterbi.LAST)
    right = viterbi.first_pass(codes[cut:], viterbi.LAST)
    guess = viterbi.first_pass(codes[:cut], viterbi.GUESS)
    fixed, _ = viterbi.fix_up(codes[:cut], viterbi.GUESS, guess, right)
    assert fixed.tolist() == exact.tolist()


def test_fix_up_stops_where_costs_differ_by_a_constant():
    codes = np.array([2, 3] * 200, np.uint8)
    right = np.array([9, 9, 9, 1])
    _, ran = viterbi.fix_up(codes, viterbi.GUESS, viterbi.first_pass(codes, viterbi.GUESS), right)
    assert ran < 10


# Prefix trie

def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [r[2:] for r in sorted(x)] for c, x in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = by.get(c - int(np.fmod(c, 100)), [])
        built[c] = tuple(base[:h]) + tuple(own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below, leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    del below
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(df, **kw):
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=str)


@pytest.mark.parametrize("most,parts", [(65536, 4), (2, 7)])
def test_prefix_trie_against_brute_force(spark, most, parts):
    rng = random.Random(11)
    rows = []
    for c in [*range(-105, -98), *range(0, 60), *range(100, 130), *range(250, 262), 400, 401]:
        kind = rng.randrange(4)
        for t in range(rng.randrange(1, 10)):
            said = f"{c}" if kind == 0 else f"{c % 3}" if kind == 1 else "same" if kind == 2 else None
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "user", None)), f"{said} {t}" if said else None))
    for c in (500, 501, 502, 503):
        rows += [(c, t, "user", f"deep {t if c < 503 or t < 120 else -t}") for t in range(150)]
    rows += [(None, 0, "user", "nobody"), (0, 0, "user", "0 0"), (400, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "'z' AS Path")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert trie_of(df, most_rows=most) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefix_trie_of_small_tables(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []
    rows = [(5, 0, "user", "a")]
    assert trie_of(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)
    rows = [(c, 0, "user", "a") for c in range(300, 310)]
    assert trie_of(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=150), min_size=1, max_size=12))
def test_parentheses_against_paths(paths):
    raw = sorted({b"".join(bytes([x]) * WIDTH for x in p) for p in paths})
    trie = Trie(raw)
    nodes = sorted({p[:k] for p in raw for k in range(0, len(p) + 1, WIDTH)})
    assert trie.depth.tolist() == [len(p) // WIDTH for p in nodes]
    assert trie.size.tolist() == [sum(q.startswith(p) for q in nodes) for p in nodes]
    childless = [not any(q.startswith(p) and q != p for q in nodes) for p in nodes]
    assert trie.leaves.tolist() == [sum(c and q.startswith(p) for c, q in zip(childless, nodes)) for p in nodes]
    values = np.arange(len(nodes)) * 7 % 13
    assert trie.subtree_least(values).tolist() == [min(v for v, q in zip(values.tolist(), nodes) if q.startswith(p)) for p in nodes]
