"""Histogram trees grown level by level (M5-M7): forests with one or several outputs, and Newton boosting.

Every row carries channels: a weight and sums that belong to it.  The worth of a node is the sum over the channels of
sum² / (weight + smoothing); a split's gain is what its two sides are worth more than the node.

* Forest: weight = how often the row was drawn, sums = weight × label, one per output.  The gain is then half the
  decrease of Gini impurity summed over all outputs, so a tree with six outputs splits for all six at once.
* Boosting: weight = hessian, sum = gradient, smoothing = ``lambda``; half the gain less ``gamma`` is the decrease of the
  loss (minimum split loss), and a leaf is -gradient / (hessian + lambda).

Features are cut into at most ``MAX_BINS`` bins, from all rows.  A forest's node looks at features drawn
by a hash of its place in the tree, so a tree cut at a smaller depth is the tree grown to that depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MAX_BINS = 16
UNLIMITED = 64  # depth that no tree reaches


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Bins:
    """Upper edges of each feature's bins but the last; bin b holds edge[b - 1] < value <= edge[b]."""

    at: np.ndarray
    edges: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, max_bins: int = MAX_BINS) -> Bins:
        """Midpoints of distinct values where they are few, else quantiles of the rows."""
        edges = []
        for col in np.asarray(x, dtype=np.float64).T:
            values = np.unique(col)
            if len(values) > max_bins:
                values = np.unique(np.quantile(col, np.linspace(0, 1, max_bins + 1)[1:-1], method="lower"))
                edges.append(values[values < col.max()])
            else:
                edges.append((values[1:] + values[:-1]) / 2)
        return cls(np.append(0, np.cumsum([len(e) for e in edges])), np.concatenate(edges) if edges else np.zeros(0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, dtype=np.uint8)
        for j in np.flatnonzero(np.diff(self.at)).tolist():
            out[:, j] = np.searchsorted(self.edges[self.at[j]:self.at[j + 1]], x[:, j])
        return out


@dataclass
class Trees:
    """Nodes of several trees; the children of node i are ``left[i]`` and ``left[i] + 1``; -1 where it is a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # bins up to it go left
    left: np.ndarray
    depth: np.ndarray
    weight: np.ndarray
    value: np.ndarray  # nodes × outputs

    @classmethod
    def joined(cls, several: list[Trees]) -> Trees:
        """All trees of ``several``, in their order."""
        shift = np.cumsum([0] + [len(t.left) for t in several])[:-1].tolist()
        return cls(np.concatenate([t.roots + s for t, s in zip(several, shift, strict=True)]),
                   *(np.concatenate([getattr(t, f) for t in several]) for f in ("feature", "cut")),
                   np.concatenate([np.where(t.left < 0, -1, t.left + s) for t, s in zip(several, shift, strict=True)]),
                   *(np.concatenate([getattr(t, f) for t in several]) for f in ("depth", "weight", "value")))

    def first(self, n: int) -> Trees:
        """The first ``n`` trees; nodes of the others stay unreached."""
        return Trees(self.roots[:n], self.feature, self.cut, self.left, self.depth, self.weight, self.value)

    def leaves(self, binned: np.ndarray, max_depth: int = UNLIMITED, min_split: float = 0) -> np.ndarray:
        """Node of each (tree, row) where it ends, in trees cut at ``max_depth`` and at nodes lighter than ``min_split``."""
        stop = (self.left < 0) | (self.depth >= max_depth) | (self.weight < min_split)
        node = np.repeat(self.roots[:, None], len(binned), axis=1)
        row = np.broadcast_to(np.arange(len(binned)), node.shape)
        going = ~stop[node]
        while going.any():
            at = node[going]
            node[going] = self.left[at] + (binned[row[going], self.feature[at]] > self.cut[at])
            going = ~stop[node]
        return node


@dataclass
class Growth:
    """State of trees that are being grown; one level at a time, so histograms may come from anywhere."""

    n_trees: int
    channels: int
    n_features: int
    n_tried: int | None = None  # features drawn per node; None: all
    max_depth: int = UNLIMITED
    min_split: float = 2
    min_leaf: float = 1
    smoothing: float = 0.0
    least_gain: float = 0.0
    seed: int = 666
    first: int = 0  # number of the first tree in its forest
    parts: list[dict] = field(default_factory=list)
    n_nodes: int = 0

    def __post_init__(self):
        roots = np.arange(self.n_trees)
        self.frontier = roots
        self.key = mix64((roots + self.first).astype(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.depth = 0
        self.n_nodes = self.n_trees

    def features(self, keys: np.ndarray, j: int) -> np.ndarray:
        """The j-th feature that each node looks at."""
        step = np.uint64((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        return (mix64(keys + step) % np.uint64(self.n_features)).astype(np.int64)

    def worth(self, sums: np.ndarray) -> np.ndarray:
        """``sums``: channels first, the weight before the others."""
        square = sums[1] * sums[1]
        for s in sums[2:]:
            square += s * s
        return square / np.maximum(sums[0] + self.smoothing, 1e-12)

    def best(self, side: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gain, cut) of each node; ``side``: channels × nodes × cuts, the sums on one side; ``total``: nodes × channels."""
        other = total.T.astype(side.dtype)[:, :, None] - side
        worth = self.worth(side)
        worth += self.worth(other)
        worth[np.minimum(side[0], other[0]) < self.min_leaf] = -np.inf
        cut = np.argmax(worth, axis=1)
        return worth[np.arange(len(total)), cut] - self.worth(total.T), cut

    def advance(self, total: np.ndarray, gain: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Closes the level: the frontier's channel sums and best splits; returns the new frontier's parents (by place)."""
        split = (gain > self.least_gain) & (total[:, 0] >= self.min_split) & (self.depth < self.max_depth)
        left = np.full(len(total), -1, dtype=np.int64)
        left[split] = self.n_nodes + 2 * np.arange(int(split.sum()))
        self.parts.append({"feature": np.where(split, feature, -1), "cut": np.where(split, cut, 0), "left": left,
                           "depth": np.full(len(total), self.depth), "total": total})
        self.n_nodes += 2 * int(split.sum())
        parent = np.flatnonzero(split)
        self.frontier = np.repeat(left[parent], 2) + np.tile([0, 1], len(parent))
        self.key = mix64(np.repeat(self.key[parent], 2) * np.uint64(2) + np.tile(np.array([1, 2], dtype=np.uint64), len(parent)))
        self.depth += 1
        return parent

    def finished(self, value) -> Trees:
        """``value``: function of the nodes' channel sums."""
        whole = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        narrow = {"feature": np.int32, "cut": np.int16, "left": np.int32, "depth": np.int16}
        return Trees(np.arange(self.n_trees), *(whole[k].astype(kind) for k, kind in narrow.items()),
                     whole["total"][:, 0], value(whole["total"]))


def node_sums(place: np.ndarray, stats: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, weights=s, minlength=n) for s in stats], axis=1)


PACK = float(1 << 26)  # two whole numbers below it share a double


def drawn_histograms(binned: np.ndarray, rows: np.ndarray, place: np.ndarray, stats: np.ndarray, features: np.ndarray,
                     n_bins: int) -> np.ndarray:
    """Channel sums (channels, nodes, bins) of one drawn feature per node; ``place`` is an entry's node.

    ``stats``: whole numbers, whose sums stay below ``PACK``; two of them are added at once.
    """
    key = binned.ravel().take(rows * binned.shape[1] + features.take(place)) + place * n_bins
    n = len(features) * n_bins
    out = np.empty((len(stats), n))
    for c in range(0, len(stats) - 1, 2):
        both = np.bincount(key, weights=stats[c] + PACK * stats[c + 1], minlength=n)
        out[c + 1] = np.floor(both / PACK)
        out[c] = both - PACK * out[c + 1]
    if len(stats) % 2:
        out[-1] = np.bincount(key, weights=stats[-1], minlength=n)
    return out.reshape(len(stats), len(features), n_bins)


def best_cut(growth: Growth, hist: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, last bin on the left) of each node's best cut."""
    return growth.best(np.cumsum(hist[:, :, :-1], axis=2), total)


# Nodes whose histograms a forest, and cells of those that boosting, holds at a time.
NODES_HELD = 1 << 14
CELLS_HELD = 1 << 21


def drawn_best(binned: np.ndarray, rows: np.ndarray, place: np.ndarray, stats: np.ndarray, growth: Growth, keys: np.ndarray,
               total: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, cut) of each node's best cut over the features it draws."""
    gain, feature, cut = np.full(len(total), -np.inf), np.zeros(len(total), dtype=np.int64), np.zeros(len(total), dtype=np.int64)
    for j in range(growth.n_tried if len(total) else 0):
        f = growth.features(keys, j)
        g, c = best_cut(growth, drawn_histograms(binned, rows, place, stats, f, n_bins), total)
        better = g > gain
        gain, feature, cut = np.where(better, g, gain), np.where(better, f, feature), np.where(better, c, cut)
    return gain, feature, cut


def grow_forest(binned: np.ndarray, y: np.ndarray, draws: np.ndarray, growth: Growth, n_bins: int = MAX_BINS,
                where: np.ndarray | None = None) -> Trees:
    """Trees of ``draws`` (trees × rows: how often each drew a row) on labels ``y`` (rows × outputs); ``where``: the rows'
    places in ``binned``, if they are some of its rows."""
    tree, rows = np.nonzero(draws)
    weight = draws[tree, rows].astype(np.float64)
    stats = np.concatenate([weight[None], (weight[:, None] * y[rows]).T])
    rows = rows if where is None else where[rows]
    place = tree
    while len(growth.frontier):
        n = len(growth.frontier)
        total = node_sums(place, stats, n)
        # a node with equal labels, or too light, is a leaf: its entries go
        mixed = (total[:, 1:] * (total[:, :1] - total[:, 1:])).max(axis=1) > 1e-9
        heavy = total[:, 0] >= max(growth.min_split, 2 * growth.min_leaf)
        open_ = mixed & heavy & (growth.depth < growth.max_depth)
        number = np.cumsum(open_) - 1
        kept = open_[place]
        rows, stats, place = rows[kept], stats[:, kept], place[kept]
        small, keys, sub = number[place], growth.key[open_], total[open_]
        if len(sub) > NODES_HELD:  # entries of a node side by side, so that some nodes' entries are a slice
            order = np.argsort(small, kind="stable")
            rows, stats, place, small = rows[order], stats[:, order], place[order], small[order]
        found = []
        for a in range(0, len(sub), NODES_HELD):
            b = a + NODES_HELD
            e = slice(*np.searchsorted(small, (a, b))) if len(sub) > NODES_HELD else slice(None)
            found.append(drawn_best(binned, rows[e], small[e] - a, stats[:, e], growth, keys[a:b], sub[a:b], n_bins))
        gain, feature, cut = map(np.concatenate, zip(*found)) if found else (np.zeros(0),) * 3
        whole = [np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
        for to, values in zip(whole, (gain, feature, cut), strict=True):
            to[open_] = values
        rows, stats, place = _descend(growth, binned, rows, stats, place, total, *whole)
    return growth.finished(lambda t: t[:, 1:] / np.maximum(t[:, :1], 1e-12))


def _descend(growth: Growth, binned, rows, stats, place, total, gain, feature, cut):
    """Closes a level and moves the entries of split nodes to the children."""
    parent = growth.advance(total, gain, feature, cut)
    child = np.full(len(total), -1)
    child[parent] = 2 * np.arange(len(parent))
    kept = child[place] >= 0
    rows, stats, place = rows[kept], stats[:, kept], place[kept]
    return rows, stats, child[place] + (binned[rows, feature[place]] > cut[place])


class Segments:
    """The (row, cut) entries of binned rows for histograms over all features: entry of bin b stands for each cut below b."""

    def __init__(self, binned: np.ndarray, at: np.ndarray):
        self.at = at  # cuts of feature j: at[j] to at[j + 1]
        self.row, col = np.nonzero(binned)
        self.cell = at[col] + binned[self.row, col] - 1
        self.feature = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.cut = np.arange(at[-1]) - at[:-1][self.feature]
        self.end = at[1:][self.feature]  # first cut of the next feature

    def right_sums(self, place: np.ndarray, stats: np.ndarray, n: int) -> np.ndarray:
        """(channels, nodes, cuts): sums of each node's rows right of each cut; ``place`` -1 leaves a row out."""
        width = len(self.cut)
        used = place[self.row] >= 0
        row, key = self.row[used], place[self.row[used]] * width + self.cell[used]
        run = np.empty((len(stats), n, width + 1), dtype=np.float32)
        run[..., -1] = 0
        for to, s in zip(run, stats, strict=True):
            hist = np.bincount(key, weights=s[row], minlength=n * width).reshape(n, width)
            to[:, :-1] = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
        return run[..., :-1] - run[..., self.end]  # sums from the right within each feature


def best_of_all(growth: Growth, segments: Segments, right: np.ndarray, total: np.ndarray):
    """(gain, feature, cut) of each node over all features; ``right``: channels × nodes × cuts."""
    worth, best = growth.best(right, total)
    return worth / 2, segments.feature[best], segments.cut[best]


def boost(binned: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, gamma: float,
          smoothing: float = 1.0, least_hessian: float = 1.0, segments=None, where: np.ndarray | None = None) -> Trees:
    """Newton boosting of the logistic loss from margin 0: trees whose values times ``rate`` add up to the margin.

    ``gamma``: the loss a split must save at least.  ``where``: the rows' places in ``binned``, if they are some of its rows;
    ``segments`` are then theirs.
    """
    segments = Segments(binned, at) if segments is None else segments
    where = np.arange(len(y)) if where is None else where
    margin = np.zeros(len(y))
    some = max(1, CELLS_HELD // max(int(at[-1]), 1))
    out = []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        stats = np.stack([p * (1.0 - p), p - y])
        growth = Growth(1, 2, len(at) - 1, max_depth=depth, min_split=0, min_leaf=least_hessian, smoothing=smoothing,
                        least_gain=max(gamma, 1e-9))
        place, node = np.zeros(len(y), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        while len(growth.frontier):
            n, inside = len(growth.frontier), place >= 0
            total = node_sums(place[inside], stats[:, inside], n)
            gain, feature, cut = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            open_ = (total[:, 0] >= 2 * least_hessian) & (growth.depth < depth) & (at[-1] > 0)
            if open_.any():
                number = np.where(open_, np.cumsum(open_) - 1, -1)
                small = np.where(inside, number[place], -1)
                opened = np.flatnonzero(open_)
                for a in range(0, len(opened), some):
                    these = opened[a:a + some]
                    mine = np.where((small >= a) & (small < a + some), small - a, -1)
                    right = segments.right_sums(mine, stats, len(these))
                    gain[these], feature[these], cut[these] = best_of_all(growth, segments, right, total[these])
            base = growth.n_nodes
            parent = growth.advance(total, gain, feature, cut)
            child = np.full(n, -1)
            child[parent] = 2 * np.arange(len(parent))
            at_row = np.flatnonzero(inside)
            to = child[place[at_row]]
            to = np.where(to >= 0, to + (binned[where[at_row], feature[place[at_row]]] > cut[place[at_row]]), -1)
            place[at_row] = to
            node[at_row[to >= 0]] = base + to[to >= 0]
        trees = growth.finished(lambda t: -t[:, 1:2] / (t[:, :1] + smoothing))
        margin += rate * trees.value[node, 0]
        out.append(trees)
    return Trees.joined(out)
