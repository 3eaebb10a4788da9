"""Summed distances to many rows, by a tree of boxes around them.

Rows are halved along the widest axis of their box until few are left.  Seen from
outside at some distance, a box's rows act like weights on a small grid of
Chebyshev nodes in it: |x - y| is smooth there, so its polynomial in y through the
nodes is as good as the function.  The same holds for a box of targets, whose
sums are taken at the nodes and read off at those of its halves, and in the end for
each target.  Boxes too near are left to the halves or opened, and rows of the last
ones are measured one by one, so the work for n targets and n rows grows about as
n log n.  ``NODES`` and ``GAP`` keep the sums
within about 1e-10 of theirs one by one.

Only axes along which a box extends count: equal rows are a single node with
their number, which is exact, and a box gets no grid with more nodes than half
its rows.  Where no box has one, as for wide vectors, all rows are measured one
by one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 512
NODES = 12
# Boxes are apart if this many times the longer half side lies between them.
GAP = 2.5
# Grids have at most this many axes.
GRID_AXES = 3
# Distances per matrix product, sized for a core's cache.
CHUNK = 1 << 16

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_COEFFICIENTS = np.cos(np.arange(NODES)[:, None] * np.arccos(_AT)) * (2 - (np.arange(NODES) == 0)[:, None]) / NODES


def _basis(unit: np.ndarray) -> np.ndarray:
    """n x NODES: what each node's value counts for at places in [-1, 1]."""
    angle = np.arccos(np.clip(unit, -1, 1))
    return np.cos(angle[:, None] * np.arange(NODES)) @ _COEFFICIENTS


@functools.lru_cache(maxsize=256)
def _unit_grid(axes: tuple[int, ...], width: int) -> np.ndarray:
    out = np.zeros((NODES ** len(axes), width))
    for axis, at in zip(axes, np.meshgrid(*[_AT] * len(axes), indexing="ij")):
        out[:, axis] = at.ravel()
    return out


def _bases(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, axes: tuple[int, ...]) -> list[np.ndarray]:
    return [_basis((2 * x[:, a] - lo[a] - hi[a]) / (hi[a] - lo[a])) for a in axes]


def _onto_grid(x: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Weights of the nodes that stand for weighted points."""
    if not axes:
        return np.array([weight.sum()])
    first, *others = _bases(x, lo, hi, axes)
    spread = weight[:, None]
    for basis in reversed(others):
        spread = (basis[:, :, None] * spread[:, None, :]).reshape(len(x), -1)
    return (first.T @ spread).ravel()


def _off_grid(values: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    """Values at points, by their ``_bases``, from those at the nodes."""
    if not bases:
        return values[0]
    first, *others = bases
    out = first @ values.reshape(NODES, -1)
    for basis in others:
        out = np.einsum("ip,ipq->iq", basis, out.reshape(len(basis), NODES, -1))
    return out[:, 0]


def _axes(lo: np.ndarray, hi: np.ndarray) -> tuple[int, ...] | None:
    """Axes of the box's grid; none (not even an empty one) for too many or a box without bounds."""
    if not np.isfinite(hi - lo).all():
        return None
    axes = tuple(np.flatnonzero(hi > lo).tolist())
    return axes if len(axes) <= GRID_AXES else None


def _cut(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The rows in order of the widest axis, and the change of value nearest to the middle."""
    side = hi - lo
    if not len(side) or not np.isfinite(side).all() or not side.max() > 0:
        return None
    values = x[:, side.argmax()]
    order = np.argsort(values, kind="stable")
    values, half = values[order], len(x) // 2
    below, above = np.searchsorted(values, values[half], "left"), np.searchsorted(values, values[half], "right")
    at = below if below > 0 and (half - below <= above - half or above == len(x)) else above
    return order, int(at)


@dataclass
class Boxes:
    """Boxes of one or more trees, a box before those within it.

    ``spans`` holds first row, end, the second of the two boxes within (0: a
    leaf; the first one is the next box) and the place of the weights (-1: none).
    """

    lo: np.ndarray
    hi: np.ndarray
    spans: np.ndarray
    weights: np.ndarray

    @functools.cached_property
    def kinds(self) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The sets of axes that boxes extend along, and the number of each box's set."""
        sets, kind = np.unique(self.hi > self.lo, axis=0, return_inverse=True)
        return [tuple(np.flatnonzero(extends).tolist()) for extends in sets], kind.ravel()


def build(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Boxes]:
    """The order in which each box's rows are neighbours, and the boxes."""
    order, width = np.arange(len(x)), x.shape[1]
    x = np.array(x, float, order="F")  # put in order as it goes; narrow rows are quicker to bound and to cut by columns
    los, his, spans = [], [], []
    todo = [(0, len(x), -1)]
    while todo:
        start, end, parent = todo.pop()
        if parent >= 0:
            spans[parent][2] = len(spans)
        rows = x[start:end]
        los.append(rows.min(axis=0, initial=np.inf))
        his.append(rows.max(axis=0, initial=-np.inf))
        cut = _cut(rows, los[-1], his[-1]) if end - start > leaf else None
        if cut is not None:
            order[start:end], x[start:end] = order[start:end][cut[0]], rows[cut[0]]
            todo += [(start + cut[1], end, len(spans)), (start, start + cut[1], -1)]
        spans.append([start, end, 0, -1])
    lo, hi = np.array(los).reshape(-1, width), np.array(his).reshape(-1, width)
    grids, at = {}, 0
    for i in range(len(spans) - 1, -1, -1):
        (start, end, second, _), axes = spans[i], _axes(lo[i], hi[i])
        if axes is None or 2 * NODES ** len(axes) > end - start and axes:
            continue
        weight = np.zeros(NODES ** len(axes))
        for inside in (i + 1, second) if second else (i,):
            if inside in grids:  # nodes of a box within stand for its rows
                grid, own = grids[inside]
            else:
                grid = x[spans[inside][0] : spans[inside][1]]
                own = np.ones(len(grid))
            weight += _onto_grid(grid, own, lo[i], hi[i], axes)
        middle, half = (lo[i] + hi[i]) / 2, (hi[i] - lo[i]) / 2
        grids[i] = (middle + half * _unit_grid(axes, width), weight)
    for i in sorted(grids):
        spans[i][3] = at
        at += len(grids[i][1])
    weights = np.concatenate([grids[i][1] for i in sorted(grids)]) if grids else np.empty(0)
    return order, Boxes(lo, hi, np.array(spans, np.int64).reshape(-1, 4), weights)


def groups(x: np.ndarray, most: int = LEAF_ROWS) -> Iterator[np.ndarray]:
    """Rows of ``x`` in groups of neighbours, of at most ``most`` if they differ."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        part = x[rows]
        cut = _cut(part, part.min(axis=0), part.max(axis=0)) if len(rows) > most else None
        if cut is None:
            yield rows
        else:
            todo += [rows[cut[0][cut[1] :]], rows[cut[0][: cut[1]]]]


def _nodes(boxes: Boxes, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of some boxes that have them."""
    width = boxes.lo.shape[1]
    lo, hi, at, kind = boxes.lo[chosen], boxes.hi[chosen], boxes.spans[chosen, 3], boxes.kinds[1][chosen]
    points, weights = [], []
    for k in np.flatnonzero(np.bincount(kind)).tolist():
        mine = np.flatnonzero(kind == k)
        unit = _unit_grid(boxes.kinds[0][k], width)
        middle, half = (lo[mine] + hi[mine]) / 2, (hi[mine] - lo[mine]) / 2
        points.append((middle[:, None] + half[:, None] * unit).reshape(-1, width))
        weights.append(boxes.weights[at[mine, None] + np.arange(len(unit))].ravel())
    return np.concatenate(points), np.concatenate(weights)


def _apart(boxes: Boxes, todo: np.ndarray, lo: np.ndarray, hi: np.ndarray, last: bool):
    """Box numbers for a box of targets: those to be seen from its nodes, from each target, and to be measured by rows.

    Leaves among the first may lack a grid; the last are leaves.  A box of targets
    that is not the ``last`` has the boxes that are too near for its nodes
    in the fourth place, opened until they are smaller than it, and no others.
    """
    far, seen, near, kept = ([np.empty(0, np.int64)] for _ in range(4))
    half = (hi - lo).max(initial=0) / 2
    while len(todo):
        other_lo, other_hi, spans = boxes.lo[todo], boxes.hi[todo], boxes.spans[todo]
        gap = np.sqrt(np.square(np.maximum(0, np.maximum(other_lo - hi, lo - other_hi))).sum(axis=1))
        with np.errstate(invalid="ignore"):
            other_half = (other_hi - other_lo).max(axis=1) / 2
            clear = (gap >= GAP * other_half) & np.isfinite(gap)
            by_nodes = clear & (gap >= GAP * half) & (gap > 0)
        leaf, grid = spans[:, 2] == 0, spans[:, 3] >= 0
        by_nodes &= grid | leaf
        far.append(todo[by_nodes])
        if last:
            by_target = ~by_nodes & clear & grid
            rest = ~by_nodes & ~by_target
            seen.append(todo[by_target])
            near.append(todo[rest & leaf])
            opened = rest & ~leaf
        else:
            opened = ~by_nodes & ~leaf & (other_half >= half)
            kept.append(todo[~by_nodes & ~opened])
        todo = np.concatenate([todo[opened] + 1, spans[opened, 2]])
    return tuple(np.concatenate(found) for found in (far, seen, near, kept))


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges, those that touch joined."""
    spans = spans[np.argsort(spans[:, 0])]
    new = np.flatnonzero(np.append(True, spans[1:, 0] != spans[:-1, 1])) if len(spans) else []
    return [(int(spans[a, 0]), int(spans[b - 1, 1])) for a, b in zip(new, [*new[1:], len(spans)])]


def _product_sums(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted distances by a matrix product; only where nothing in ``b`` is near ``a``."""
    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    left = np.column_stack([a, np.square(a).sum(axis=1), np.ones(len(a))])
    right = np.vstack([-2 * b.T, np.ones(len(b)), np.square(b).sum(axis=1)])
    out, step = np.zeros(len(a)), max(1, CHUNK // len(a))
    for i in range(0, len(b), step):
        sq = left @ right[:, i : i + step]
        out += np.sqrt(np.maximum(sq, 0, out=sq), out=sq) @ weights[i : i + step]
    return out


class _Side:
    """One box of targets: its rows, its grid, and how values at the nodes above it are read off."""

    def __init__(self, x: np.ndarray, start: int, end: int, above: "_Side | None"):
        self.start, self.end, self.x = start, end, x[start:end]
        self.lo, self.hi = self.x.min(axis=0), self.x.max(axis=0)
        self.halves: list[_Side] = []
        axes = _axes(self.lo, self.hi)
        self.axes = axes if axes is not None and NODES ** len(axes) < end - start else None
        self.above = above if above is None or above.axes is not None else above.above

    @functools.cached_property
    def at(self) -> np.ndarray:
        if self.axes is None:
            return self.x
        middle, half = (self.lo + self.hi) / 2, (self.hi - self.lo) / 2
        return middle + half * _unit_grid(self.axes, len(middle))

    @functools.cached_property
    def from_above(self) -> list[np.ndarray]:
        return _bases(self.at, self.above.lo, self.above.hi, self.above.axes)

    @functools.cached_property
    def from_own(self) -> list[np.ndarray]:
        return _bases(self.x, self.lo, self.hi, self.axes)


class Targets:
    """A tree of boxes around targets, halved like the rows down to ``most`` if they differ."""

    def __init__(self, x: np.ndarray, most: int = LEAF_ROWS):
        # narrow rows are quicker to bound and to cut by columns
        self.order, columns = np.arange(len(x)), np.array(x, float, order="F")
        cuts, todo = {}, [(0, len(x))] if len(x) > most else []
        while todo:
            start, end = todo.pop()
            part = columns[start:end]
            cut = _cut(part, part.min(axis=0), part.max(axis=0))
            if cut is not None:
                self.order[start:end] = self.order[start:end][cut[0]]
                columns[start:end] = part[cut[0]]
                cuts[start, end] = middle = start + cut[1]
                todo += [span for span in ((start, middle), (middle, end)) if span[1] - span[0] > most]
        self.x = columns
        self.root = _Side(columns, 0, len(x), None) if len(x) else None
        below = [self.root] if len(x) else []
        while below:
            side = below.pop()
            middle = cuts.get((side.start, side.end))
            if middle is not None:
                side.halves = [_Side(columns, *span, side) for span in ((side.start, middle), (middle, side.end))]
                below += side.halves

    def sums(self, boxes: Boxes, root: int, rows, measured, wanted: np.ndarray | None = None) -> np.ndarray:
        """Summed distances from the targets (0 where not ``wanted``) to all rows of a tree.

        A box of targets takes at its nodes what is far from it, and hands its
        nodes' values and what is nearer on to its halves: a box of the tree is
        met by targets spread about as far as its rows.  ``rows(ranges)`` yields
        blocks of the rows in some ranges, ``measured(x, points, weights)`` sums
        distances one by one (no weights: 1).
        """
        total = np.zeros(len(self.x))
        mine = None if wanted is None else wanted[self.order]
        todo = [(self.root, np.array([root]), None)] if self.root else []
        while todo:
            side, chosen, above = todo.pop()
            part = side.x
            if mine is not None:
                asked = mine[side.start : side.end]
                if not asked.any():
                    continue
            if side.halves and side.axes is None:
                todo += [(half, chosen, above) for half in side.halves]
                continue
            far, seen, near, chosen = _apart(boxes, chosen, side.lo, side.hi, not side.halves)
            values = np.zeros(len(side.at))
            if above is not None:
                values += _off_grid(above, side.from_above)
            grid = boxes.spans[far, 3] >= 0
            if grid.any():
                values += _product_sums(side.at, *_nodes(boxes, far[grid]))
            if not grid.all():
                for block in rows(_merged(boxes.spans[far[~grid]])):
                    values += _product_sums(side.at, block, np.ones(len(block)))
            if side.halves:
                todo += [(half, chosen, values) for half in side.halves]
                continue
            own = np.zeros(len(part))
            own += values if side.axes is None else _off_grid(values, side.from_own)
            if len(seen) or len(near):
                some = slice(None) if mine is None or asked.all() else np.flatnonzero(asked)
                part = part[some]
                if len(seen):
                    own[some] += measured(part, *_nodes(boxes, seen))
                for block in rows(_merged(boxes.spans[near])):
                    own[some] += measured(part, block, None)
            total[self.order[side.start : side.end]] = own
        return total if wanted is None else np.where(wanted, total, 0)


def sums(x: np.ndarray, boxes: Boxes, root: int, rows, measured) -> np.ndarray:
    """``Targets.sums`` of some rows."""
    return Targets(x).sums(boxes, root, rows, measured)


def pieces(boxes: Boxes, root: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Means and numbers of rows of up to about ``most`` boxes that hold the tree's rows; none if some have no grid."""
    todo, done = np.array([root]), []
    while len(todo) and (len(todo) + sum(map(len, done)) < most or (boxes.spans[todo, 3] < 0).any()):
        leaf = boxes.spans[todo, 2] == 0
        done.append(todo[leaf])
        todo = np.concatenate([todo[~leaf] + 1, boxes.spans[todo[~leaf], 2]])
    chosen = np.concatenate([*done, todo])
    if (boxes.spans[chosen, 3] < 0).any():
        return None
    n, means = boxes.spans[chosen, 1] - boxes.spans[chosen, 0], []
    for box, rows in zip(chosen, n):  # a grid's weights keep sums of coordinates
        points, weights = _nodes(boxes, np.array([box]))
        means.append(boxes.lo[box] + weights @ (points - boxes.lo[box]) / rows)
    return np.array(means), n
