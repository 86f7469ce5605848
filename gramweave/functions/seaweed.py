"""Boundary-transfer tables of two strings and their algebra.

For strings A (m symbols, down) and B (n, across), a permutation of m + n describes how longest
common subsequences pass from the left and top border to the bottom and right one. Inputs and outputs
run from the bottom left corner, up and right (inputs) or right and up (outputs). Tables compose by
the unit-Monge product. The plain distance has dense (min,+) tables in the same order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gramweave.functions.grammar import Grammar, factorize

FAR = np.int64(1) << 40
SMALL = 16
#: Products of one depth up to which their staircases are walked one by one.
STEPPED = 128
#: Symbols of both strings up to which a product with H goes through H itself.
DENSE = 48
#: Cells that a product of Monge tables looks at at once.
COLUMNS = 1 << 22
#: Cells up to which a table is combed cell by cell rather than put together from parts.
COMBED = 1 << 24


# dense algebra


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """C(i, j) = min over k of A(i, k) + B(k, j)."""
    if a.size * b.shape[1] <= 1 << 16:
        return (a[:, :, None] + b[None]).min(1)
    return np.stack([(row[:, None] + b).min(0) for row in a])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -min_plus(-a, -b)


def monge_min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of two finite Monge tables, in n^2 log n steps of whole arrays.

    The first place k of a minimum falls neither from row to row nor from column to column. Rows halve their distance in each
    round, and a row searches between the places of its neighbours only, so a round looks at each column's places once.
    """
    n, inner, m = len(a), len(b), b.shape[1]
    keyed, other = a * inner + np.arange(inner), np.ascontiguousarray(b.T) * inner  # least values, then least places
    out = np.empty((n, m), np.int64)
    for row in {0, n - 1}:
        out[row] = (keyed[row] + other).min(1)
    step, width = 1 << max(0, n - 1).bit_length(), max(1, COLUMNS // (n + inner))
    while step > 1:
        step //= 2
        rows = np.arange(step, n - 1, 2 * step)
        for first in range(0, m if len(rows) else 0, width):
            columns = np.arange(first, min(m, first + width))
            low = (out[np.ix_(rows - step, columns)] % inner).ravel()
            sizes = (out[np.ix_(np.minimum(rows + step, n - 1), columns)] % inner).ravel() - low + 1
            start = np.cumsum(sizes) - sizes
            places = np.arange(start[-1] + sizes[-1]) + np.repeat(low - start, sizes)
            sums = keyed[np.repeat(np.repeat(rows, len(columns)), sizes), places] + other[np.repeat(np.tile(columns, len(rows)), sizes), places]
            out[np.ix_(rows, columns)] = np.minimum.reduceat(sums, start).reshape(len(rows), -1)
    return out // inner


def distribution(a: np.ndarray) -> np.ndarray:
    """S(i, j): the sum over rows from i on and columns before j."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int64)
    out[:-1, 1:] = a[::-1].cumsum(0)[::-1].cumsum(1)
    return out


def density(s: np.ndarray) -> np.ndarray:
    return s[:-1, 1:] - s[:-1, :-1] - s[1:, 1:] + s[1:, :-1]


def unfolded(perm: np.ndarray) -> np.ndarray:
    """The 0/1 matrix of a permutation."""
    out = np.zeros((len(perm), len(perm)), np.int64)
    out[np.arange(len(perm)), perm] = 1
    return out


def h_matrix(s: np.ndarray, rows: int) -> np.ndarray:
    """H(i, j) = j - (i - rows) - S(i, j); the same formula leads back."""
    i, j = np.indices(s.shape)
    return j - (i - rows) - s


# permutations


def inverse(perm: np.ndarray) -> np.ndarray:
    out = np.empty_like(perm)
    out[perm] = np.arange(len(perm))
    return out


def is_permutation(perm: np.ndarray) -> bool:
    return bool((np.sort(perm) == np.arange(len(perm))).all())


def direct_sum(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.concatenate([p, q + len(p)])


def multiply(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The unit-Monge product: the permutation whose distribution is the (min,+) product of both.

    The inner index is halved. Each half is a smaller product; of the two, the minimum takes the
    lower half's on one side of a staircase and the upper half's on the other, and the points that
    neither side keeps go on the stairs, lowest row with highest column. All products of one depth are
    one pass: they lie side by side in whole arrays, and their staircases are walked in step.
    """
    if len(p) <= SMALL:
        return _small_product(np.asarray(p, np.int64), np.asarray(q, np.int64))
    return multiply_many(p, q, np.array([0, len(p)]))


def multiply_many(p: np.ndarray, q: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of permutations that lie side by side from `starts` on, each counted from 0; see multiply."""
    n, begins = len(p), starts
    if not n:
        return p.copy()
    p, q = np.asarray(p, np.int64), np.asarray(q, np.int64)
    levels = []
    while np.diff(starts).max() > SMALL:
        sizes = np.diff(starts)
        half = sizes // 2
        base = np.repeat(starts[:-1], sizes)
        low = p < np.repeat(half, sizes)
        column = base + q
        row_of = np.empty(n, np.int64)
        row_of[column] = np.arange(n)
        inner_low = (np.arange(n) - base < np.repeat(half, sizes))[row_of]  # by column: whether its inner index is in the lower half
        new_starts = np.empty(2 * len(sizes) + 1, np.int64)
        new_starts[::2], new_starts[1::2] = starts, starts[:-1] + half
        to = []  # where rows and columns go: lower halves first, each in order
        for flag in (low, inner_low):
            before = np.cumsum(flag) - flag
            before = before - np.repeat(before[np.minimum(starts[:-1], n - 1)], sizes)
            at = np.arange(n) - base
            to.append(base + np.where(flag, before, np.repeat(half, sizes) + at - before))
        levels.append((starts, low, to))
        moved = np.empty(n, np.int64)
        moved[to[0]] = np.where(low, p, p - np.repeat(half, sizes))
        fresh = np.repeat(new_starts[:-1], np.diff(new_starts))
        p, q, starts = moved, to[1][column] - fresh, new_starts
    out = _small_products(p, q, starts) + np.repeat(starts[:-1], np.diff(starts))
    for starts, low, (rows, columns) in reversed(levels):
        back = np.empty(n, np.int64)
        back[columns] = np.arange(n)
        out = _combined(back[out][rows], low, starts)
    return out - np.repeat(begins[:-1], np.diff(begins))


#: Columns that count, for each column of a permutation of up to SMALL rows.
_BEFORE = np.arange(SMALL + 1)


def _small_product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One product by the definition."""
    n = len(p)
    if n <= 1:
        return p.copy()
    sums = np.zeros((2, n + 1, n + 1), np.int8)
    np.less(np.stack((p, q))[:, ::-1, None], _BEFORE[: n + 1], out=sums[:, 1:], casting="unsafe")
    sums = np.add.accumulate(sums, 1, np.int8)[:, ::-1]  # rows from i on, columns before j
    least = (sums[0][:, :, None] + sums[1]).min(1)
    steps = least[:-1] - least[1:]
    return (steps[:, 1:] - steps[:, :-1]).argmax(1)


def _small_products(p: np.ndarray, q: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products by the definition, those of equal size at once."""
    out, sizes = np.empty(len(p), np.int64), np.diff(starts)
    for n in np.unique(sizes[sizes > 0]):
        own = starts[:-1][sizes == n]
        for some in np.array_split(own, max(1, len(own) * (n + 1) ** 2 >> 21)):
            at = some[:, None] + np.arange(n)
            sums = []
            for perm in (p[at], q[at]):
                s = np.zeros((len(some), n + 1, n + 1), np.int16)
                s[:, :-1, 1:] = perm[:, :, None] < np.arange(1, n + 1)
                sums.append(s[:, ::-1].cumsum(1, dtype=np.int16)[:, ::-1])
            least = sums[0][:, :, :1] + sums[1][:, :1, :]
            for j in range(1, n + 1):
                np.minimum(least, sums[0][:, :, j, None] + sums[1][:, None, j], out=least)
            found = least[:, :-1, 1:] - least[:, :-1, :-1] - least[:, 1:, 1:] + least[:, 1:, :-1]
            out[at] = found.argmax(2)
    return out


def _combined(column_of: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products from both halves' points: `column_of` of each row; low: whether the lower half has it."""
    n = len(low)
    row_of = np.empty(n, np.int64)
    row_of[column_of] = np.arange(n)
    stairs = _stairs if len(starts) <= STEPPED else _stairs_in_step
    # a point stays if its half rules at all four corners of its cell: at the last corner for the lower half, the first for the
    # upper. Upper points whose first corner is a tie lie on the stairs, in the same order as what is left over there.
    ruled = stairs(column_of, row_of, low, starts)
    at = np.arange(n) + np.repeat(np.arange(len(starts) - 1), np.diff(starts))  # a product of n rows has n + 1 stairs
    kept = np.where(low, column_of + 1 <= ruled[at + 1], column_of > ruled[at])
    taken = np.zeros(n, bool)
    taken[column_of[kept]] = True
    # left-over rows and columns of one product meet in opposite order
    rows, columns = np.flatnonzero(~kept), np.flatnonzero(~taken)
    product = np.searchsorted(starts, columns, "right")
    out = column_of.copy()
    out[rows] = columns[np.lexsort((-columns, product))]
    return out


def _stairs(columns: np.ndarray, rows: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each i in 0..n the last k at which the lower half doesn't exceed the upper; products one by one.

    The excess at (i, k) is the number of upper points in rows before i and columns before k, less the
    lower points in rows from i and columns from k on; it grows in i and in k, and is 0 at most at the first k.
    """
    column_of, row_of, from_low, found = columns.tolist(), rows.tolist(), low.tolist(), []
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
        out, k, excess = [0] * (last - first + 1), first, 0
        for i in range(last, first - 1, -1):
            if i < last:
                excess -= column_of[i] >= k if from_low[i] else column_of[i] < k
            while k < last:
                row = row_of[k]
                if row >= i if from_low[row] else row < i:
                    if not excess:
                        break
                    excess += 1
                k += 1
            out[i - first] = k
        found.append(np.array(out))
    return np.concatenate(found)


def _stairs_in_step(columns: np.ndarray, rows: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same for many products at once, each of which goes one step to the right or up in turn."""
    n, products = len(low), len(starts) - 1
    first, last = starts[:-1], starts[1:]
    out = np.empty(n + products, np.int64)
    row_low = low[rows]  # by column
    i, k, excess = last.copy(), first.copy(), np.zeros(products, np.int64)
    live = np.arange(products)
    while len(live):
        a, b, e = i[live], k[live], excess[live]
        column = np.minimum(b, n - 1)
        row = rows[column]
        more = e + np.where(row_low[column], row >= a, row < a)
        right = (b < last[live]) & (more <= 0)
        out[a + live] = b
        a = np.where(right, a, a - 1)
        up = np.clip(a, 0, n - 1)
        change = np.where(low[up], columns[up] >= b, columns[up] < b)
        excess[live] = np.where(right, more, e - change)
        i[live], k[live] = a, b + right
        live = live[a >= first[live]]
    return out


# boundary tables of the common subsequence


@dataclass(frozen=True)
class Table:
    """rows: symbols of A; cols: symbols of B; perm: the permutation of both."""

    rows: int
    cols: int
    perm: np.ndarray


def cell(same: bool) -> Table:
    """The table of two single symbols."""
    return Table(1, 1, np.array([0, 1] if same else [1, 0], np.int64))


def swapped(t: Table) -> Table:
    """The table with both strings exchanged: the reversed complement."""
    return Table(t.cols, t.rows, (len(t.perm) - 1 - t.perm)[::-1].copy())


def stacked(top: Table, bottom: Table) -> Table:
    """The table of A's upper and lower part over one B."""
    if top.cols != bottom.cols:
        raise ValueError("tables of different columns")
    first = direct_sum(np.arange(bottom.rows), top.perm)
    second = direct_sum(bottom.perm, np.arange(top.rows))
    return Table(top.rows + bottom.rows, top.cols, multiply(first, second))


def beside(left: Table, right: Table) -> Table:
    """The table of one A over B's left and right part."""
    return swapped(stacked(swapped(left), swapped(right)))


def h_of(t: Table) -> np.ndarray:
    return h_matrix(distribution(unfolded(t.perm)), t.rows)


def from_h(h: np.ndarray, rows: int) -> Table:
    """The table of an H matrix: the density of its distribution."""
    return Table(rows, len(h) - 1 - rows, density(h_matrix(h, rows)).argmax(1))


def _among(s: np.ndarray, before: int, after: int) -> np.ndarray:
    """The distribution of a direct sum (identity, P, identity) from that of P."""
    p = len(s) - 1
    at = np.arange(before + p + after + 1)
    inner, first, last = np.clip(at - before, 0, p), np.minimum(at, before), np.maximum(at - before - p, 0)
    steps = lambda v: np.maximum(v[None] - v[:, None], 0)
    return steps(first) + s[np.ix_(inner, inner)] + steps(last)


def h_stacked(top: np.ndarray, bottom: np.ndarray, cols: int) -> np.ndarray:
    """H of A's upper and lower part over one B of so many symbols: a (min,+) product of distributions."""
    m1, m2 = len(top) - 1 - cols, len(bottom) - 1 - cols
    return h_matrix(monge_min_plus(_among(h_matrix(top, m1), m2, 0), _among(h_matrix(bottom, m2), 0, m1)), m1 + m2)


def h_beside(left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """H of one A of so many symbols over B's left and right part."""
    n1, n2 = len(left) - 1 - rows, len(right) - 1 - rows
    return h_matrix(monge_min_plus(_among(h_matrix(left, rows), 0, n2), _among(h_matrix(right, rows), n1, 0)), rows)


def vector_times_h(vector: np.ndarray, t: Table) -> np.ndarray:
    """max over i of vector(i) + H(i, j), by the definition."""
    return (vector[:, None] + h_of(t)).max(0)


def vector_times_h_runs(vector: np.ndarray, t: Table) -> np.ndarray:
    """The same without H, in n log n steps of whole arrays.

    The place of a column's maximum never falls from column to column. Columns halve their distance in each
    round; a column searches between the places of its two neighbours only, where S differs from a
    constant by a running count, so a round passes over the vector once.
    """
    n = len(t.perm)
    i = np.arange(n + 1)
    value = vector.astype(np.int64) - (i - t.rows)
    perm = np.append(t.perm, n)
    keyed = value * (n + 2) - i  # greater values, then lesser places
    where = np.full(n + 1, -1, np.int64)
    where[0] = keyed.argmax()
    where[n] = (keyed + i * (n + 2)).argmax()  # S(i, n) = n - i
    step = 1 << max(0, n - 1).bit_length()
    while step > 1:
        step //= 2
        columns = np.arange(step, n, 2 * step)
        if not len(columns):
            continue
        low, high = where[columns - step], where[np.minimum(columns + step, n)]
        sizes = high - low + 1
        start = np.cumsum(sizes) - sizes
        at = np.arange(start[-1] + sizes[-1]) + np.repeat(low - start, sizes)
        before = perm[at] < np.repeat(columns, sizes)
        best = np.maximum.reduceat(keyed[at] + (np.cumsum(before) - before) * (n + 2), start)
        where[columns] = -best % (n + 2)
    # S on the path of the places: from (i, j) to (i', j + 1)
    rank = inverse(t.perm)
    held = np.searchsorted(where, np.arange(n), "right") - 1  # rows from where[j] on are passed at column j
    passed = t.perm < held
    total = np.concatenate([[0], np.cumsum(passed[where[0] :])])[where - where[0]]
    s = np.concatenate([[0], np.cumsum(rank >= where[1:])]) - total
    return value[where] + i - s


def _passed(border: np.ndarray, m: int, n: int, product) -> np.ndarray:
    i = np.arange(m + n + 1)
    return product(border + np.where(i < m, i - m, 0)) + np.where(i >= n, n - i, 0)


def applied(t: Table, border: np.ndarray) -> np.ndarray:
    """Outputs of a block from its inputs (values of the common subsequence along the border)."""
    product = vector_times_h if t.rows + t.cols <= DENSE else vector_times_h_runs
    return _passed(border, t.rows, t.cols, lambda v: product(v, t))


def h_applied(h: np.ndarray, rows: int, border: np.ndarray) -> np.ndarray:
    """The same outputs from the dense H."""
    return _passed(border, rows, len(h) - 1 - rows, lambda v: (v[:, None] + h).max(0))


def combed(a: np.ndarray, b: np.ndarray) -> Table:
    """The table of two sequences of whole numbers, one anti-diagonal of cells at a time.

    One strand enters each cell from the left and one from above. They cross unless the symbols are equal or
    they have crossed before; where the strands leave is the permutation.
    """
    m, n = len(a), len(b)
    up = np.ascontiguousarray(a[::-1])
    kind = np.int16 if m + n < 1 << 15 else np.int32
    left, top = np.arange(m, dtype=kind), np.arange(m, m + n, dtype=kind)
    for d in range(m + n - 1):
        first, size = max(0, m - 1 - d), min(d + 1, m, n, m + n - 1 - d)
        rows, cols = slice(first, first + size), slice(first + d - m + 1, first + d - m + 1 + size)
        h, v = left[rows], top[cols]
        turned = (up[rows] == b[cols]) | (h > v)
        moved = (h ^ v) * turned
        h ^= moved
        v ^= moved
    perm = np.empty(m + n, np.int64)
    perm[left] = np.arange(n, n + m)
    perm[top] = np.arange(n)
    return Table(m, n, perm)


def table_of(a, b) -> Table:
    """The table of two non-empty sequences: combed, or, where that is too many cells, put together along their
    grammars from combed parts. Parts of equal content are built once, so repetitive sequences need few."""
    names = {symbol: k for k, symbol in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([names[c] for c in part], np.int32) for part in (a, b))
    if len(a) * len(b) <= COMBED:
        return combed(x, y)
    # one grammar for both, whose nodes are shared wherever contents are
    g, nodes = Grammar(), []
    for part in (x, y):
        text, spelt, root = "".join(chr(0x10000 + k) for k in part.tolist()), 0, None
        for begin, end in factorize(text):
            parts = [g.terminal(ord(text[begin]) - 0x10000)] if begin == spelt else g.harvest(root, begin, end + 1)
            for piece in parts:
                root = piece if root is None else g.join(root, piece)
            spelt += end - begin + 1
        nodes.append(root)
    known: dict[tuple[int, int], Table] = {}

    def merged(p: int, q: int) -> Table:
        if (p, q) not in known:
            if g.size[p] * g.size[q] <= COMBED // 4:
                known[p, q] = combed(np.array(g.spell(p), np.int32), np.array(g.spell(q), np.int32))
            elif g.size[p] >= g.size[q]:
                known[p, q] = stacked(merged(g.left[p], q), merged(g.right[p], q))
            else:
                known[p, q] = beside(merged(p, g.left[q]), merged(p, g.right[q]))
        return known[p, q]

    return merged(*nodes)


# dense tables of the distance


def distance_cell(same: bool) -> np.ndarray:
    return np.array([[0, 1, FAR], [1, 0 if same else 1, 1], [FAR, 1, 0]], np.int64)


def _filled(table: np.ndarray, rows: int, cols: int, far: int) -> np.ndarray:
    """The table with its corners, where there is no path, filled so that all of it is Monge: the farther from the band, the more."""
    i, j = np.indices(table.shape)
    gap = np.maximum(j - i - cols, i - j - rows)
    return np.where(gap > 0, far * gap, table)


def _through(first: np.ndarray, second: np.ndarray, far: int) -> np.ndarray:
    found = monge_min_plus(first, second)
    return np.where(found < far, found, FAR)


def distance_beside(left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """Paths over the left block to its bottom, or to the shared side and over the right one."""
    n1, n2 = len(left) - 1 - rows, len(right) - 1 - rows
    far = 8 * (rows + n1 + n2)
    out = np.full((rows + n1 + n2 + 1, n1 + n2 + rows + 1), FAR)
    out[: rows + n1 + 1, : n1 + 1] = left[:, : n1 + 1]
    out[: rows + n1 + 1, n1:] = _through(_filled(left, rows, n1, far)[:, n1:], _filled(right, rows, n2, far)[: rows + 1], far)
    out[rows + n1 :, n1:] = np.minimum(out[rows + n1 :, n1:], right[rows:])
    return out


def distance_stacked(top: np.ndarray, bottom: np.ndarray, cols: int) -> np.ndarray:
    """Paths over the upper block to its right side, or to the shared side and over the lower one."""
    m1, m2 = len(top) - 1 - cols, len(bottom) - 1 - cols
    far = 8 * (cols + m1 + m2)
    out = np.full((m2 + m1 + cols + 1, cols + m2 + m1 + 1), FAR)
    out[: m2 + 1, : cols + m2 + 1] = bottom[: m2 + 1]
    out[m2:, : cols + m2 + 1] = _through(_filled(top, m1, cols, far)[:, : cols + 1], _filled(bottom, m2, cols, far)[m2:], far)
    out[m2:, cols + m2 :] = np.minimum(out[m2:, cols + m2 :], top[:, cols:])
    return out


def distance_applied(table: np.ndarray, border: np.ndarray) -> np.ndarray:
    return (border[:, None] + table).min(0)


def distance_table_of(a, b) -> np.ndarray:
    """The dense table of two non-empty sequences: rows of the plain recurrence from all inputs at once."""
    m, n = len(a), len(b)
    names = {symbol: k for k, symbol in enumerate(dict.fromkeys([*a, *b]))}
    other = np.array([names[c] for c in b])
    across, starts = np.arange(n + 1), np.arange(m + n + 1)
    row = across - (starts[:, None] - m)  # from the top: right only
    row = np.where((row < 0) | (starts[:, None] < m), FAR, row)
    right = [row[:, -1]]
    for r, c in enumerate(a, 1):
        best = np.empty_like(row)
        best[:, 0] = np.where(starts >= m - r, np.minimum(row[:, 0] + 1, np.where(starts == m - r, 0, FAR)), FAR)
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (other != names[c]))
        row = np.minimum(np.minimum.accumulate(best - across, 1) + across, FAR)
        right.append(row[:, -1])
    return np.concatenate([row, np.stack(right[-2::-1], 1)], 1)


# sweep of the block grid


def sweep(rows: list[int], cols: list[int], apply_block, left: np.ndarray, top: np.ndarray) -> int:
    """The value at the bottom right corner: columns of blocks from the left, each from the top down.

    rows, cols: lengths of the blocks; left, top: values down the left border and along the top one;
    apply_block(i, j, border) gives a block's outputs.
    """
    down = left
    at = 0
    for j, width in enumerate(cols):
        across, start, nexts = top[at : at + width + 1], 0, [top[at + width : at + width + 1]]
        for i, height in enumerate(rows):
            side = down[start : start + height + 1]
            out = apply_block(i, j, np.concatenate([side[::-1], across[1:]]))
            across = out[: width + 1]
            nexts.append(out[width:][::-1][1:])
            start += height
        down = np.concatenate(nexts)
        at += width
    return int(down[-1])
