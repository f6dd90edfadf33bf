"""Tries of sorted paths as balanced parentheses, with range min-max blocks over the excess (no Spark here)."""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Bytes of a step's digest in a path.
WIDTH = 16


class Parentheses:
    """A sequence of brackets (1 opens, 0 closes) in which every subtree is an interval."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(self.bits)
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        #: rank of leaf pairs: how many "()" start before a place
        self.leaf_rank = np.concatenate([np.cumsum(pair[1:]), [0]])
        n = max(1, -(-len(bits) // BLOCK))
        padded = np.full(n * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.padded = padded
        self.levels = [padded.reshape(n, BLOCK).min(1)]  # least excess of each block, of each pair of blocks, and so on
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.concatenate([low, [np.iinfo(np.int64).max]])
            self.levels.append(low.reshape(-1, 2).min(1))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing place of every opening place: the first one after it whose excess is one less."""
        want = self.excess[at] - 1
        out = np.full(len(at), -1, np.int64)
        for ahead in range(1, BLOCK):  # the rest of its own block
            open_ = np.flatnonzero(out < 0)
            open_ = open_[(at[open_] % BLOCK) + ahead < BLOCK]
            if not len(open_):
                break
            place = at[open_] + ahead
            hit = self.padded[place] == want[open_]
            out[open_[hit]] = place[hit]
        left = np.flatnonzero(out < 0)
        block, goal = at[left] // BLOCK, want[left]
        level = np.zeros(len(left), np.int64)
        climbing = np.ones(len(left), bool)
        while climbing.any():  # up until a right sibling reaches the goal
            for k in np.unique(level[climbing]).tolist():
                some = np.flatnonzero(climbing & (level == k))
                here = self.levels[k]
                right = (block[some] % 2 == 0) & (block[some] + 1 < len(here))
                good = np.zeros(len(some), bool)
                good[right] = here[block[some[right]] + 1] <= goal[some[right]]
                block[some[good]] += 1
                climbing[some[good]] = False
                block[some[~good]] //= 2
                level[some[~good]] += 1
        for k in range(len(self.levels) - 1, 0, -1):  # down to the first block that reaches it
            some = np.flatnonzero(level == k)
            first = 2 * block[some]
            block[some] = np.where(self.levels[k - 1][first] <= goal[some], first, first + 1)
            level[some] -= 1
        for a in range(0, len(left), 4096):
            own = slice(a, a + 4096)
            inside = self.padded[block[own, None] * BLOCK + np.arange(BLOCK)[None, :]] <= goal[own, None]
            out[left[own]] = block[own] * BLOCK + inside.argmax(1)
        return out


def common_steps(a: bytes, b: bytes) -> int:
    """How many leading steps two paths share."""
    n = min(len(a), len(b)) // WIDTH
    if n > 64:
        x, y = (np.frombuffer(p, f"V{WIDTH}", n) for p in (a, b))
        apart = x != y
        return int(apart.argmax()) if apart.any() else n
    k = 0
    while k < n and a[WIDTH * k : WIDTH * k + WIDTH] == b[WIDTH * k : WIDTH * k + WIDTH]:
        k += 1
    return k


class Trie:
    """The trie of paths in ascending order; node ids are in pre-order, 0 is the root.

    depth, parent, owner (the first path through it) for each node; end: the node of each path's last step; open, close:
    its brackets; size: nodes in its subtree; leaves: childless ones among them.
    """

    def __init__(self, paths: list[bytes]) -> None:
        bits, depth, parent, owner, end = [1], [0], [-1], [0], []
        stack, before, steps_before = [0], b"", 0
        for i, path in enumerate(paths):
            steps, k = len(path) // WIDTH, common_steps(before, path)
            bits += [0] * (steps_before - k) + [1] * (steps - k)
            del stack[k + 1 :]
            for d in range(k + 1, steps + 1):
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d)
                owner.append(i)
            end.append(stack[-1])
            before, steps_before = path, steps
        bits += [0] * (steps_before + 1)
        self.depth, self.parent, self.owner, self.end = (np.array(x, np.int64) for x in (depth, parent, owner, end))
        self.brackets = Parentheses(np.array(bits, np.int8))
        self.open = self.brackets.opens
        self.close = self.brackets.find_close(self.open)
        self.size = (self.close - self.open + 1) // 2
        self.leaves = self.brackets.leaf_rank[self.close] - np.where(self.open > 0, self.brackets.leaf_rank[self.open - 1], 0)
        self.children = np.bincount(self.parent[1:], minlength=len(depth))

    def subtree_sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of values (one for each node) over each node's subtree, by a cumulative array over pre-order."""
        total = np.concatenate([[0], np.cumsum(values)])
        at = np.arange(len(values))
        return total[at + self.size] - total[at]

    def subtree_least(self, values: np.ndarray) -> np.ndarray:
        """The least of values (one for each node) in each node's subtree, by tables of minima over powers of two."""
        table = [np.asarray(values, np.int64)]
        width = self.size
        while (1 << len(table)) <= int(width.max()):
            low, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(low[:-half], low[half:]))
        power = np.frexp(width.astype(np.float64))[1] - 1
        at, out = np.arange(len(width)), np.zeros(len(width), np.int64)
        for k in np.unique(power).tolist():
            some = np.flatnonzero(power == k)
            out[some] = np.minimum(table[k][at[some]], table[k][at[some] + width[some] - (1 << k)])
        return out

    def ancestors(self, node: int) -> list[int]:
        """Nodes from the root down to node."""
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]
