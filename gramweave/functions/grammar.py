"""Straight-line grammars of one string: factors, builders, transforms, blocks.

A grammar is a list of nodes; a node is a terminal with its symbol or a pair of earlier nodes. Equal
pairs are one node wherever a builder shares. The empty string has no grammar (root None).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

SENTINEL = -1
#: Characters beyond which factors come from the suffix automaton: its time does not grow with the square.
LONG = 30_000


def factorize(text) -> list[tuple[int, int]]:
    """LZ factors as inclusive ranges: the leftmost earlier copy, wholly in front, of the longest
    prefix of the rest that has one, else the position itself. A copy is followed as far as it agrees;
    then one longer is searched for, from there on."""
    out, i, n = [], 0, len(text)
    while i < n:
        begin, size, at = i, 0, 0
        while i + size < n:
            at = text.find(text[i : i + size + 1], at, i)
            if at < 0:
                break
            begin, size, room = at, size + 1, min(i - at, n - i)
            while size < room and text[at + size] == text[i + size]:
                size += 1
        size = max(size, 1)
        out.append((begin, begin + size - 1))
        i += size
    return out


def factorize_automaton(text) -> list[tuple[int, int]]:
    """The same factors from a suffix automaton of the part in front, grown factor by factor."""
    nexts: list[dict] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0

    def extend(c, position: int) -> None:
        nonlocal last
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(position)
        new, p = len(nexts) - 1, last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                copy = len(nexts) - 1
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new

    out, i = [], 0
    while i < len(text):
        state, size = 0, 0
        while i + size < len(text) and text[i + size] in nexts[state]:
            state = nexts[state][text[i + size]]
            size += 1
        out.append((end[state] - size + 1, end[state]) if size else (i, i))
        for k in range(i, i + max(size, 1)):
            extend(text[k], k)
        i += max(size, 1)
    return out


@dataclass
class Grammar:
    """Nodes by number. left is -1 for terminals."""

    symbol: list = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    height: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    root: int | None = None
    _known: dict = field(default_factory=dict)

    def _add(self, symbol, left: int, right: int, height: int, size: int) -> int:
        for column, value in zip((self.symbol, self.left, self.right, self.height, self.size), (symbol, left, right, height, size)):
            column.append(value)
        return len(self.symbol) - 1

    def terminal(self, symbol, shared: bool = True) -> int:
        if not shared:
            return self._add(symbol, -1, -1, 0, 1)
        if symbol not in self._known:
            self._known[symbol] = self._add(symbol, -1, -1, 0, 1)
        return self._known[symbol]

    def pair(self, left: int, right: int, shared: bool = True) -> int:
        if shared:
            key = (left, right)
            found = self._known.get(key)
            if found is not None:
                return found
            self._known[key] = len(self.symbol)
        x, y = self.height[left], self.height[right]
        self.symbol.append(None)
        self.left.append(left)
        self.right.append(right)
        self.height.append((x if x > y else y) + 1)
        self.size.append(self.size[left] + self.size[right])
        return len(self.symbol) - 1

    def balance(self, node: int) -> int:
        return 0 if self.left[node] < 0 else self.height[self.left[node]] - self.height[self.right[node]]

    def _level(self, left: int, right: int) -> int:
        """A pair whose heights differ by two at most, rotated to differ by one at most."""
        lean = self.height[left] - self.height[right]
        if lean > 1:
            a, b = self.left[left], self.right[left]
            if self.height[a] >= self.height[b]:
                return self.pair(a, self.pair(b, right))
            return self.pair(self.pair(a, self.left[b]), self.pair(self.right[b], right))
        if lean < -1:
            a, b = self.left[right], self.right[right]
            if self.height[b] >= self.height[a]:
                return self.pair(self.pair(left, a), b)
            return self.pair(self.pair(left, self.left[a]), self.pair(self.right[a], b))
        return self.pair(left, right)

    def join(self, left: int, right: int) -> int:
        """Concatenation of balanced trees: down the higher one's inner flank, balanced on the way up."""
        lean = self.height[left] - self.height[right]
        if lean > 1:
            return self._level(self.left[left], self.join(self.right[left], right))
        if lean < -1:
            return self._level(self.join(left, self.left[right]), self.right[right])
        return self.pair(left, right)

    def harvest(self, node: int, begin: int, end: int) -> list[int]:
        """The fewest nodes under `node` that spell the half-open range."""
        out, todo = [], [(node, begin, end)]
        while todo:
            at, a, b = todo.pop()
            if a <= 0 and b >= self.size[at]:
                out.append(at)
                continue
            cut = self.size[self.left[at]]
            if b > cut:
                todo.append((self.right[at], a - cut, b - cut))
            if a < cut:
                todo.append((self.left[at], a, b))
        return out

    def reached(self) -> list[int]:
        """Nodes that the root needs, children in front of parents."""
        if self.root is None:
            return []
        need, todo = {self.root}, [self.root]
        while todo:
            node = todo.pop()
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if child not in need:
                        need.add(child)
                        todo.append(child)
        return sorted(need)

    def productions(self) -> int:
        return len(self.reached())

    def ratio(self) -> float | None:
        return None if self.root is None else self.productions() / self.size[self.root]

    def spell(self, node: int | None = None) -> list:
        """The symbols a node derives."""
        node = self.root if node is None else node
        if node is None:
            return []
        out, todo = [], [node]
        symbol, left, right = self.symbol, self.left, self.right
        while todo:
            at = todo.pop()
            while left[at] >= 0:
                todo.append(right[at])
                at = left[at]
            out.append(symbol[at])
        return out

    def text(self) -> str:
        return "".join(self.spell())


def balanced(text) -> Grammar:
    """A balanced tree without sharing: 2n - 1 nodes."""
    return _halved(text, shared=False)


def halved(text) -> Grammar:
    """A balanced tree whose equal parts are one node."""
    return _halved(text, shared=True)


def _halved(text, shared: bool) -> Grammar:
    g = Grammar()
    if not len(text):
        return g
    level = [g.terminal(c, shared) for c in text]
    symbol, left, right, height, size, known = g.symbol, g.left, g.right, g.height, g.size, g._known

    def build(a: int, b: int) -> int:
        if b - a == 1:
            return level[a]
        cut = (a + b + 1) // 2
        x, y = build(a, cut), build(cut, b)
        if shared:
            found = known.get((x, y))
            if found is not None:
                return found
            known[x, y] = len(symbol)
        symbol.append(None)
        left.append(x)
        right.append(y)
        height.append(height[x] + 1)  # the first half is the longer one
        size.append(b - a)
        return len(symbol) - 1

    g.root = build(0, len(text))
    return g


def compressed(text, factors: list[tuple[int, int]] | None = None) -> Grammar:
    """A height-balanced grammar from the LZ factors: copies are harvested from what is spelt already and joined.

    What is spelt is a row of trees, each higher than the next one; a piece joins the last ones when it is as high, and all
    are joined at the end. So a factor does not rebuild the flank of one tree of the whole text."""
    g, spelt = Grammar(), 0
    if factors is None:
        factors = factorize(text) if len(text) <= LONG else factorize_automaton(text)
    left, right, height, size_of, join = g.left, g.right, g.height, g.size, g.join
    trees, starts = [], []
    for begin, end in factors:
        if begin == spelt:
            piece, size = g.terminal(text[begin]), 1
        else:
            size = end - begin + 1
            parts, last = [], bisect_right(starts, end)
            for k in range(bisect_right(starts, begin) - 1, last):
                todo = [(trees[k], begin - starts[k], end + 1 - starts[k])]
                while todo:  # as harvest
                    at, a, b = todo.pop()
                    if a <= 0 and b >= size_of[at]:
                        parts.append(at)
                        continue
                    cut = size_of[left[at]]
                    if b > cut:
                        todo.append((right[at], a - cut, b - cut))
                    if a < cut:
                        todo.append((left[at], a, b))
            while len(parts) > 1:  # neighbours of like height first
                parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
            piece = parts[0]
        start = spelt
        while trees and height[trees[-1]] <= height[piece]:
            piece, start = join(trees.pop(), piece), starts.pop()
        trees.append(piece)
        starts.append(start)
        spelt += size
    while len(trees) > 1:
        last = trees.pop()
        trees[-1] = join(trees[-1], last)
    g.root = trees[0] if trees else None
    return g


BUILDERS = {"balanced": balanced, "halved": halved, "compressed": compressed}


def blow_up(g: Grammar, sentinel=SENTINEL) -> Grammar:
    """Every terminal a becomes (a, sentinel): one more production for each symbol and one for the sentinel."""
    out, moved = Grammar(), {}
    if g.root is None:
        return out
    mark = out.terminal(("sentinel", sentinel))
    out.symbol[mark] = sentinel
    for node in g.reached():
        if g.left[node] < 0:
            moved[node] = out.pair(out.terminal(g.symbol[node]), mark)
        else:
            moved[node] = out.pair(moved[g.left[node]], moved[g.right[node]])
    out.root = moved[g.root]
    return out


def block_length(n: int, productions: int, xfactor: float = 1.0, ffactor: float = 1.0, least: int = 1) -> int:
    """Block size from compressibility (a fixed formula): f = max(2, ff * N / n), x = max(f / sqrt(log2 f), min(5, N)),
    then min(floor(x * xf), N). The direct route knows no least size: 0 there."""
    if not n:
        return least
    f = max(2.0, ffactor * n / max(1, productions))
    x = max(f / np.sqrt(np.log2(f)), min(5, n))
    return max(least, min(int(x * xfactor), n))


def blocks(g: Grammar, x: int) -> list[tuple[str, tuple[int, ...]]]:
    """A cover by blocks (kind, nodes in order): `key` is a node of x..2x-1 symbols whose children
    are shorter than x. Between two keys lie the right children on the way up from the first one (`right`) and
    then the left children on the way down to the second one (`left`); such blocks have fewer than 2x symbols.
    A text shorter than x is one `left` block."""
    if x < 1:
        raise ValueError("blocks have one symbol at least")
    if g.root is None:
        return []
    out: list[tuple[str, tuple[int, ...]]] = []
    held: list[int] = []
    kind, size = "left", 0

    def close() -> None:
        nonlocal size
        if held:
            out.append((kind, tuple(held)))
            held.clear()
            size = 0

    todo = [(g.root, "left")]
    while todo:
        node, side = todo.pop()
        if g.size[node] < x:
            if side != kind or size + g.size[node] >= 2 * x:
                close()
            kind, size = side, size + g.size[node]
            held.append(node)
        elif g.left[node] < 0 or max(g.size[g.left[node]], g.size[g.right[node]]) < x:
            close()
            out.append(("key", (node,)))
        else:
            todo += [(g.right[node], "right"), (g.left[node], "left")]
    close()
    return out


def block_id(symbols: list) -> str:
    """Equal contents have one id."""
    return hashlib.sha256(repr(symbols).encode()).hexdigest()[:24]


def to_dot(g: Grammar, folded: bool = True) -> str:
    """GraphViz text: each node once with numbered children, or the parse tree with a node an occurrence."""
    label = lambda k: str(g.symbol[k]).replace('"', '\\"') if g.left[k] < 0 else f"X{k}"
    lines = []
    if g.root is not None and folded:
        for k in reversed(g.reached()):
            lines.append(f'  n{k} [label="{label(k)}"];')
            if g.left[k] >= 0:
                lines += [f"  n{k} -> n{g.left[k]};", f"  n{k} -> n{g.right[k]};"]
    elif g.root is not None:
        count = 0
        todo = [(g.root, None)]
        while todo:
            k, parent = todo.pop()
            lines.append(f'  n{count} [label="{label(k)}"];')
            if parent is not None:
                lines.append(f"  n{parent} -- n{count};")
            if g.left[k] >= 0:
                todo += [(g.right[k], count), (g.left[k], count)]
            count += 1
    return "\n".join([("digraph" if folded else "graph") + " slp {", *lines, "}"])


def heights(g: Grammar) -> dict[int, list[int]]:
    """Reached nodes by height."""
    out = defaultdict(list)
    for k in g.reached():
        out[g.height[k]].append(k)
    return dict(out)
