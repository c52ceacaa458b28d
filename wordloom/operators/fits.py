"""Fitted classifiers as plain arrays (M1-M6), fitted on rows held in memory or read in slices.

``fit_candidates`` fits many candidates of a kind on the same rows and shares what they share: the penalties of a loss
advance in one coefficient matrix and stop at every (tol, max_iter) on one path; forests of 50, 100 and 250 trees, of
every depth and every least node are read off one forest; 50 and 100 rounds are read off one boosting run; a kernel map's
projections serve every gamma.

Few rows are ``Prepared`` whole.  More are ``stored.StoredRows``, whose ``parts`` are prepared slices: sums over the parts
are the sums over the rows, so both take the same steps.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from .kernels import KernelMap, gamma_of
from .linear import Objective, decision, solve_parts, with_intercept
from .trees import UNLIMITED, Bins, Growth, Segments, Trees, boost, grow_forest

SEED = 666
SVM_STOP = (1e-3, 500)  # tol and steps of the support vector machines
# Bytes of stored rows that a linear fit keeps dense between its steps; more are read again in every step.
KEPT_BYTES = 128 << 20
# Rows times trees that a forest on stored rows grows at once.
GROWN_ROWS = 1_000_000
TREE_ARRAYS = ("roots", "feature", "cut", "left", "depth", "weight", "value")


class Prepared:
    """Rows of features in the forms that the models read, each made when first asked for."""

    held = True
    which = None  # all rows of ``binned``
    n = property(lambda self: len(self.x))
    d = property(lambda self: self.x.shape[1])

    def __init__(self, x: np.ndarray, bins: Bins):
        self.x, self.bins = x, bins
        self._made: dict = {}

    def _once(self, key, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def rows(self, which: np.ndarray) -> Prepared:
        out = Prepared(self.x[which], self.bins)
        out._made = {k: v[which] for k, v in self._made.items() if isinstance(v, np.ndarray)}
        return out

    def parts(self) -> Iterator[tuple[int, Prepared]]:
        yield 0, self

    def gamma(self, setting: str | float) -> float:
        return gamma_of(setting, self.x)

    def segments(self) -> Segments:
        return Segments(self.binned, self.bins.at)

    @property
    def binned(self) -> np.ndarray:
        return self._once("binned", lambda: self.bins.apply(self.x))

    @property
    def single(self) -> np.ndarray:
        return self._once("single", lambda: self.x.astype(np.float32))

    def base(self, mapping: KernelMap) -> np.ndarray:
        return self._once(mapping.kind, lambda: mapping.base(self.x))

    def mapped(self, mapping: KernelMap) -> np.ndarray:
        return mapping.of_base(self.base(mapping))


@dataclass
class Model:
    """``arrays`` are all that a prediction needs besides ``params``."""

    kind: str
    params: dict
    arrays: dict[str, np.ndarray]
    shared: dict = field(default_factory=dict)  # results that read-offs of one fit have in common

    def margin(self, rows: Prepared) -> np.ndarray:
        a = self.arrays
        if self.kind == "nb":
            return _posterior(a, rows.x)
        if self.kind in ("rf", "gbt"):
            trees = Trees(*(a[n] for n in TREE_ARRAYS))
            p = self.params
            depth = p.get("max_depth") if self.kind == "rf" else None
            light = float(p.get("min_samples_split", 2)) if self.kind == "rf" else 0.0
            n = int(p["n_estimators"])
            key = (id(rows), depth, light)
            if key not in self.shared:
                self.shared[key] = (rows, trees.value[trees.leaves(rows.binned, UNLIMITED if depth is None else depth, light), 0])
            value = self.shared[key][1][:n]
            return value.mean(axis=0) - 0.5 if self.kind == "rf" else float(p["learning_rate"]) * value.sum(axis=0)
        if "map" in a:
            return decision(rows.mapped(_map_of(a["map"])), a["w"])
        return decision(rows.x, a["w"])

    def outputs(self, rows: Prepared) -> np.ndarray:
        """Mean leaf values of a forest with several outputs: rows × outputs."""
        trees = Trees(*(self.arrays[n] for n in TREE_ARRAYS))
        total = np.zeros((len(rows.x), trees.value.shape[1]))
        for leaf in trees.leaves(rows.binned):
            total += trees.value[leaf]
        return total / len(trees.roots)

    def predict(self, rows: Prepared) -> tuple[np.ndarray, np.ndarray]:
        """(0/1, score): probabilities for naive Bayes, logistic regression, forests and boosting, else the margin."""
        m = self.margin(rows)
        score = m + 0.5 if self.kind == "rf" else m if self.kind == "svm" else 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
        return (m > 0).astype(np.int64), score

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.arrays, _meta=np.array(json.dumps([self.kind, self.params])))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Model:
        with np.load(io.BytesIO(blob), allow_pickle=False) as z:
            arrays = {k: z[k] for k in z.files}
        kind, params = json.loads(str(arrays.pop("_meta")))
        return cls(kind, params, arrays)


def _map_of(spec: np.ndarray) -> KernelMap:
    kind, gamma, dim = json.loads(str(spec))
    return KernelMap(kind, gamma, dim)


def _posterior(a: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log odds of class 1."""
    if a["prior"].min() <= 0:  # a class without rows
        return np.full(len(x), np.inf if a["prior"][1] > 0 else -np.inf)
    joint = []
    for k in (0, 1):
        mean, var = a["mean"][k], a["var"][k]
        constant = np.log(a["prior"][k]) - 0.5 * np.sum(np.log(2 * np.pi * var)) - 0.5 * np.sum(mean * mean / var)
        joint.append(constant - 0.5 * ((x * x) @ (1 / var)) + x @ (mean / var))
    return joint[1] - joint[0]


def _fit_nb(candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    n, mean, var = _moments(rows, y)
    largest = float(var[2].max()) or 1.0
    return [Model("nb", p, {"prior": n[:2] / n[2], "mean": mean[:2], "var": var[:2] + float(p["var_smoothing"]) * largest})
            for p in candidates]


def _moments(rows: Prepared, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, means and variances of the rows of class 0, of class 1 and of all; 0 of a class without rows."""
    n = np.array([np.sum(y == 0), np.sum(y == 1), len(y)])

    def over_rows(of) -> np.ndarray:
        total = np.zeros((3, rows.d))
        for start, part in rows.parts():
            own = y[start:start + part.n]
            for k, x in enumerate((part.x[own == 0], part.x[own == 1], part.x)):
                total[k] += of(k, x).sum(axis=0)
        return total / np.maximum(n, 1)[:, None]

    mean = over_rows(lambda _, x: x)
    return n, mean, over_rows(lambda k, x: (x - mean[k]) ** 2)


def _signed(rows: Prepared, y: np.ndarray, form: Callable[[Prepared], np.ndarray], width: int) -> Callable[[], Iterable]:
    """The parts of ``rows`` (``width`` numbers a row) as the solver reads them, kept if they are held anyway or small enough."""
    sign = np.where(y > 0, 1.0, -1.0)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start, part in rows.parts():
            yield with_intercept(form(part)), sign[start:start + part.n]

    if not rows.held and rows.n * width * 4 > KEPT_BYTES:
        return parts
    whole = list(parts())
    return lambda: whole


def _fit_logreg(candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    stops = sorted({(float(p["tol"]), int(p["max_iter"])) for p in candidates})

    def objective(p: dict) -> Objective:
        none = p["penalty"] in (None, "none")
        return Objective("logistic", None if none else p["penalty"], 1.0 if none else float(p["C"]))

    objectives = sorted({objective(p) for p in candidates}, key=repr)
    w = solve_parts(_signed(rows, y, lambda part: part.single, rows.d), rows.n, objectives, stops)
    return [Model("logreg", p, {"w": w[objectives.index(objective(p)), stops.index((float(p["tol"]), int(p["max_iter"])))]})
            for p in candidates]


def _fit_svm(candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    def space(p: dict):
        return None if p["kernel"] == "linear" else (p["kernel"], rows.gamma(p["gamma"]))

    out: list[Model | None] = [None] * len(candidates)
    for s in sorted({space(p) for p in candidates}, key=repr):
        mine = [i for i, p in enumerate(candidates) if space(p) == s]
        mapping = None if s is None else KernelMap(s[0], s[1], rows.d)
        parts = _signed(rows, y, lambda part, m=mapping: part.single if m is None else part.mapped(m).astype(np.float32),
                        rows.d if mapping is None else mapping.components)
        w = solve_parts(parts, rows.n, [Objective("hinge", "l2", float(candidates[i]["C"])) for i in mine], [SVM_STOP])
        spec = {} if s is None else {"map": np.array(json.dumps([*s, rows.d]))}
        for i, v in zip(mine, w[:, 0], strict=True):
            out[i] = Model("svm", candidates[i], {"w": v, **spec})
    return out


def _grown(p: dict) -> tuple[int, bool]:
    """What of a forest's candidate its growth depends on."""
    return int(p["min_samples_leaf"]), bool(p["bootstrap"])


def _forest(rows: Prepared, y: np.ndarray, n_trees: int, leaf: int, bootstrap: bool) -> Iterator[Trees]:
    """The trees of a forest in their order, as many at once as ``GROWN_ROWS`` allows."""
    n, draw = rows.n, np.random.default_rng(SEED)
    some = n_trees if rows.held else max(1, GROWN_ROWS // n)
    for first in range(0, n_trees, some):
        k = min(some, n_trees - first)
        draws = draw.multinomial(n, np.full(n, 1 / n), size=k) if bootstrap else np.ones((k, n), dtype=np.int64)
        growth = Growth(k, 2, rows.d, n_tried=max(1, int(rows.d ** 0.5)), min_leaf=leaf, seed=SEED, first=first)
        yield grow_forest(rows.binned, y[:, None].astype(np.float64), draws, growth, where=rows.which)


def _fit_rf(candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    out: list[Model | None] = [None] * len(candidates)
    for grown in sorted({_grown(p) for p in candidates}):
        mine = [i for i, p in enumerate(candidates) if _grown(p) == grown]
        trees = Trees.joined(list(_forest(rows, y, max(int(candidates[i]["n_estimators"]) for i in mine), *grown)))
        arrays, shared = {f: getattr(trees, f) for f in TREE_ARRAYS}, {}
        for i in mine:
            out[i] = Model("rf", candidates[i], arrays, shared)
    return out


def _forest_predictions(candidates: list[dict], rows: Prepared, y: np.ndarray, held: Prepared) -> list[np.ndarray]:
    """``fit_candidates`` and the predictions of forests whose trees are dropped as soon as ``held`` has met them."""
    value = [np.zeros(held.n) for _ in candidates]
    for grown in sorted({_grown(p) for p in candidates}):
        mine, first = [i for i, p in enumerate(candidates) if _grown(p) == grown], 0
        for trees in _forest(rows, y, max(int(candidates[i]["n_estimators"]) for i in mine), *grown):
            for start, part in held.parts():
                met: dict[tuple, np.ndarray] = {}
                for i in mine:
                    p = candidates[i]
                    cut = UNLIMITED if p["max_depth"] is None else p["max_depth"], float(p["min_samples_split"])
                    if cut not in met:
                        met[cut] = trees.value[trees.leaves(part.binned, *cut), 0]
                    value[i][start:start + part.n] += met[cut][:max(int(p["n_estimators"]) - first, 0)].sum(axis=0)
            first += len(trees.roots)
    return [(v / int(p["n_estimators"]) - 0.5 > 0).astype(np.int64) for v, p in zip(value, candidates, strict=True)]


def grow_outputs(rows: Prepared, y: np.ndarray, first: int, n_trees: int) -> Trees:
    """Trees ``first`` to ``first + n_trees`` of a forest with an output per column of ``y``."""
    n, d, whole = rows.n, rows.d, []
    some = n_trees if rows.held else max(1, GROWN_ROWS // (n * y.shape[1]))
    for t in range(first, first + n_trees, some):
        k = min(some, first + n_trees - t)
        draws = np.stack([np.random.default_rng((SEED, t + i)).multinomial(n, np.full(n, 1 / n)) for i in range(k)])
        growth = Growth(k, 1 + y.shape[1], d, n_tried=max(1, int(d ** 0.5)), seed=SEED + first, first=t - first)
        whole.append(grow_forest(rows.binned, y.astype(np.float64), draws, growth, where=rows.which))
    return Trees.joined(whole)


def _fit_gbt(candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    def run(p: dict):
        return float(p["gamma"]), float(p["learning_rate"]), int(p["max_depth"])

    out: list[Model | None] = [None] * len(candidates)
    for gamma, rate, depth in sorted({run(p) for p in candidates}):
        mine = [i for i, p in enumerate(candidates) if run(p) == (gamma, rate, depth)]
        rounds = max(int(candidates[i]["n_estimators"]) for i in mine)
        trees = boost(rows.binned, rows.bins.at, y.astype(np.float64), rounds, depth, rate, gamma, segments=rows.segments(),
                      where=rows.which)
        arrays, shared = {f: getattr(trees, f) for f in TREE_ARRAYS}, {}
        for i in mine:
            out[i] = Model("gbt", candidates[i], arrays, shared)
    return out


def prepare(kind: str, rows: Prepared) -> None:
    """Makes the forms of held ``rows`` that every fold of a kind reads, so that folds only pick their rows."""
    if not rows.held:
        return
    if kind in ("rf", "gbt"):
        rows.binned  # noqa: B018
    elif kind in ("svm", "logreg"):
        rows.single  # noqa: B018
    if kind == "svm":
        for kernel in ("rbf", "poly"):
            rows.base(KernelMap(kernel, 1.0, rows.x.shape[1]))


FITS = {"nb": _fit_nb, "svm": _fit_svm, "logreg": _fit_logreg, "rf": _fit_rf, "gbt": _fit_gbt}


def fit_candidates(kind: str, candidates: list[dict], rows: Prepared, y: np.ndarray) -> list[Model]:
    """A fitted model per candidate, in their order."""
    return FITS[kind](candidates, rows, y)


def fitted_predictions(kind: str, candidates: list[dict], rows: Prepared, y: np.ndarray, held: Prepared) -> list[np.ndarray]:
    """0/1 of every candidate, fitted on ``rows``, for the rows of ``held``."""
    if kind == "rf" and not rows.held:
        return _forest_predictions(candidates, rows, y, held)
    models = fit_candidates(kind, candidates, rows, y)
    told: list[list[np.ndarray]] = [[] for _ in models]
    for _, part in held.parts():
        for to, m in zip(told, models, strict=True):
            to.append(m.predict(part)[0])
        for m in models:
            m.shared.clear()
    return [np.concatenate(t) for t in told]


def jobs_of(kind: str, candidates: list[dict]) -> list[list[int]]:
    """Candidates (by place) that share fits, as jobs that can run apart."""
    shares = {"rf": ("min_samples_leaf", "bootstrap"), "gbt": ("gamma", "learning_rate", "max_depth")}.get(kind, ())
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(candidates):
        groups.setdefault(tuple(p[k] for k in shares), []).append(i)
    return list(groups.values())
