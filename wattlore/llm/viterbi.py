"""Least-cost edits that give a sequence of roles the form (s?(ua)+)?, by min-plus steps over four states (no Spark here).

A row is one byte: the class of its role (0 other, 1 system, 2 user, 3 assistant), and bits for rows that must go and for
truncated ones. States: what has been written so far is nothing, a system turn, ends with a user or with an assistant turn.
Costs run backwards: b[q] is the least cost of everything that follows in state q, insertions at this point included.
"""

from __future__ import annotations

import numpy as np

ROLE, GONE, CUT = 3, 4, 8
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed turn, for each state: only one role can follow.
NEXT = np.array([USER, USER, ASSISTANT, USER])
DELETE, CHANGE, INSERT = 3, 2, 2
_NEVER = 1 << 40
#: State after a kept row of each class (columns) in each state (rows); -1: it can't be kept.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: Costs after the last row: nothing and an assistant turn may end, the others need turns.
LAST = np.array([0, 4, 2, 0], np.int64)
#: Any costs will do where those of the next chunk aren't known yet.
GUESS = np.zeros(4, np.int64)


def step(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs before a row of each code, from the costs (n, 4) after it."""
    cut = ((codes & CUT) > 0).astype(np.int64)[:, None]
    to = KEPT[:, codes & ROLE].T
    kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), _NEVER)
    stay = np.minimum(kept, CHANGE + after[:, NEXT]) + cut
    b = np.minimum(DELETE + after, np.where((codes & GONE)[:, None] > 0, _NEVER, stay))
    u, a = b[:, USER].copy(), b[:, ASSISTANT].copy()
    b[:, USER], b[:, ASSISTANT] = np.minimum(u, INSERT + a), np.minimum(a, INSERT + u)
    b[:, START], b[:, SYSTEM] = np.minimum(b[:, START], INSERT + b[:, USER]), np.minimum(b[:, SYSTEM], INSERT + b[:, USER])
    return b


def _layers(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequences, longest first; their lengths; how many are longer than t for each t)."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    return order, n[order], len(n) - np.searchsorted(np.sort(n), np.arange(longest), "right")


def backward(codes: np.ndarray, bounds: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs before each row, costs after it) of many sequences one after another, all at once; end: the costs after each sequence."""
    order, n, active = _layers(bounds)
    before, after = np.zeros((len(codes), 4), np.int64), np.zeros((len(codes), 4), np.int64)
    b = end[order].astype(np.int64)
    for t, m in enumerate(active.tolist()):
        rows = bounds[1:][order[:m]] - 1 - t
        after[rows] = b[:m]
        b[:m] = before[rows] = step(codes[rows], b[:m])
    return before, after


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two cost vectors differ only by a constant: from there on they choose the same edits."""
    return bool(np.ptp(np.asarray(a) - np.asarray(b)) == 0)


def first_pass(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs before a chunk's first row, from (perhaps speculative) costs after its last."""
    b = np.asarray(end, np.int64)[None, :]
    for i in range(len(codes) - 1, -1, -1):
        b = step(codes[i : i + 1], b)
    return b[0]


def fix_up(codes: np.ndarray, old_end: np.ndarray, old_start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """(costs before a chunk's first row from other costs after its last, rows that were run again).

    Both vectors are run until they differ only by a constant; what lies before is the old result plus that constant.
    """
    both = np.array([old_end, end], np.int64)
    for i in range(len(codes) - 1, -1, -1):
        if alike(both[0], both[1]):
            return np.asarray(old_start, np.int64) + int(both[1, 0] - both[0, 0]), len(codes) - 1 - i
        both = step(np.repeat(codes[i : i + 1], 2), both)
    return both[1], len(codes)


def trace(codes: np.ndarray, bounds: np.ndarray, end: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest edits, and of these the ASCII-least, of many sequences from a state each.

    Returns for each row: insertions before it, its letter (D, K or R), the state before its insertions; for each
    sequence: insertions after its last row (only where last), the state in the end.
    """
    before, after = backward(codes, bounds, end)
    order, _, active = _layers(bounds)
    inserted, letter, came = np.zeros(len(codes), np.uint8), np.zeros(len(codes), np.uint8), np.zeros(len(codes), np.uint8)
    q = state[order].astype(np.int64)
    for t, m in enumerate(active.tolist()):
        rows = bounds[:-1][order[:m]] + t
        came[rows] = q[:m]
        open_ = np.arange(m)
        while len(open_):
            r, s = rows[open_], q[open_]
            b, a, c = before[r], after[r], codes[r]
            at = np.arange(len(r))
            drop = DELETE + a[at, s] == b[at, s]
            insert = ~drop & (INSERT + b[at, NEXT[s]] == b[at, s])
            to = KEPT[s, c & ROLE]
            cut = ((c & CUT) > 0).astype(np.int64)
            keep = ~drop & ~insert & (to >= 0) & ((c & GONE) == 0) & (cut + a[at, np.maximum(to, 0)] == b[at, s])
            inserted[r[insert]] += 1
            letter[r[~insert]] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))[~insert]
            q[open_] = np.where(drop, s, np.where(keep, to, NEXT[s]))
            open_ = open_[insert]
    out = np.empty_like(q)
    out[order] = q
    more = np.where(last, LAST[out] // INSERT, 0)
    return inserted, letter, came, more.astype(np.uint8), out
