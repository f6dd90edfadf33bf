"""Greedy assignment of calls against a plain version over random calls."""

import json
import random
import re

from wattlore.operators import logs


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-6
    if isinstance(a, list) and isinstance(b, list):
        return sorted(map(str, a)) == sorted(map(str, b))
    if isinstance(a, str) and isinstance(b, str):
        x, y = (set(re.findall(r"\w+", s.lower())) for s in (a, b))
        return a.strip() == b.strip() or bool(x and y) and (a in b or b in a or len(x & y) / len(x | y) >= 0.5)
    return a == b


def plain(gold, pred):
    free, out = list(range(len(pred))), []
    for name, args in gold:
        best = None
        for i in free:
            if pred[i][0] == name:
                g, p = json.loads(args or "{}"), json.loads(pred[i][1] or "{}")
                share = sum(k in p and same(v, p[k]) for k, v in g.items()) / len(g) if g else 1.0
                if best is None or share > best[0]:
                    best = (share, i)
        if best:
            free.remove(best[1])
        out.append(best[0] if best else 0.0)
    return out


def test_shares_against_a_plain_version(spark):
    rng = random.Random(9)
    values = ["gas in oil", "Gas in", "öl gas", "", " x ", "x", 1, 1.0000001, 2.5, True, False, None, [1, 2], [2, 1], ["a"], {"k": 1}, {"k": 2}]
    call = lambda: (rng.choice("fg"), rng.choice([None, json.dumps({k: rng.choice(values) for k in rng.sample("abc", rng.randrange(4))})] + [json.dumps({k: rng.choice(values) for k in rng.sample("abc", rng.randrange(4))})] * 5))
    rows = [(k, [call() for _ in range(rng.randrange(5))], [call() for _ in range(rng.randrange(6))], None, None) for k in range(300)]
    got = {r.id: (r.params, r.complete) for r in logs.score_calls(spark.createDataFrame(rows, f"id int, gold {logs.CALLS}, pred {logs.CALLS}, gold_ask boolean, pred_ask boolean")).collect()}
    for k, gold, pred, _, _ in rows:
        want = plain(gold, pred)
        assert (got[k][0] is None and not gold) or abs(got[k][0] - sum(want) / len(want)) < 1e-9, (gold, pred)
    required = [(k, i, *g) for k, gold, _, _, _ in rows for i, g in enumerate(gold)]
    calls = [(k, i, *p) for k, _, pred, _, _ in rows for i, p in enumerate(pred)]
    found = logs.match_required_calls(spark.createDataFrame(required, "item_id int, pos int, tool string, arguments string"), spark.createDataFrame(calls, "item_id int, call_index int, tool string, arguments string"))
    assert "python" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    by = {(r.item_id, r.pos): r.share for r in found.collect()}
    assert by == {(k, i): s for k, gold, pred, _, _ in rows for i, s in enumerate(plain(gold, pred))}


def test_broken_arguments_share_nothing(spark):
    rows = [(1, [("f", "{"), ("f", '{"a": 1}')], [("f", '{"a": 1}'), ("f", "[1]")], None, None)]
    assert logs.score_calls(spark.createDataFrame(rows, f"id int, gold {logs.CALLS}, pred {logs.CALLS}, gold_ask boolean, pred_ask boolean")).first().params == 0.0
