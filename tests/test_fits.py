"""Trees, linear paths, kernel maps and searches on a bounded sample, against brute force and definitions."""

import numpy as np
import pytest

from wordloom.functions.constants import LEVELS, REFERENCE_GRIDS
from wordloom.operators import blocks as bl
from wordloom.operators import fits, kernels, linear, search, trees
from wordloom.operators.models import distinct_candidates


def table(n=60, d=5, outputs=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (x[:, :outputs] + 0.5 * r.normal(size=(n, outputs)) > 0).astype(float)
    return x, y


# ------------------------------------------------------------- trees


def gini(y, w):
    total = w.sum()
    return sum(2 * (p := (w * y[:, k]).sum() / total) * (1 - p) for k in range(y.shape[1])) * total


def brute_tree(x, y, w, rows, depth, most):
    """Nested (feature, rows left) of the splits that lower the summed impurity most."""
    rows = rows[w[rows] > 0]
    now = gini(y[rows], w[rows])
    if depth == most or now < 1e-9 or w[rows].sum() < 2:
        return tuple(sorted(rows.tolist()))
    best = None
    for j in range(x.shape[1]):
        for v in np.unique(x[rows, j])[:-1]:
            left = rows[x[rows, j] <= v]
            right = rows[x[rows, j] > v]
            gain = now - gini(y[left], w[left]) - gini(y[right], w[right])
            if best is None or gain > best[0] + 1e-9:
                best = gain, left, right
    if best is None or best[0] <= 1e-12:
        return tuple(sorted(rows.tolist()))
    return brute_tree(x, y, w, best[1], depth + 1, most), brute_tree(x, y, w, best[2], depth + 1, most)


def leaf_sets(t):
    return [t] if not t or isinstance(t[0], int) else leaf_sets(t[0]) + leaf_sets(t[1])


@pytest.mark.parametrize("outputs", [1, 3])
def test_joint_tree_splits_for_all_outputs_at_once(outputs):
    x, y = table(outputs=outputs)
    bins = trees.Bins.fit(x, 256)
    draws = np.random.default_rng(1).multinomial(len(x), np.full(len(x), 1 / len(x)), size=3)
    growth = trees.Growth(3, 1 + outputs, x.shape[1], n_tried=80, max_depth=3)
    grown = trees.grow_forest(bins.apply(x), y, draws, growth, 256)
    leaf = grown.leaves(bins.apply(x))
    for t in range(3):
        want = leaf_sets(brute_tree(x, y, draws[t].astype(float), np.arange(len(x)), 0, 3))
        got = {}
        for row in np.flatnonzero(draws[t]):
            got.setdefault(int(leaf[t, row]), []).append(int(row))
        assert sorted(map(tuple, got.values())) == sorted(want)
        for node, rows in got.items():
            assert np.allclose(grown.value[node], np.average(y[rows], axis=0, weights=draws[t][rows]))


def test_cut_trees_are_the_trees_grown_to_that_depth_and_weight():
    x, y = table(200, 8, 1)
    bins = trees.Bins.fit(x)
    binned, draws = bins.apply(x), np.ones((4, 200), dtype=np.int64)
    whole = trees.grow_forest(binned, y, draws, trees.Growth(4, 2, 8, n_tried=3))
    for depth, light in ((2, 2), (5, 10), (64, 25)):
        grown = trees.grow_forest(binned, y, draws, trees.Growth(4, 2, 8, n_tried=3, max_depth=depth, min_split=light))
        assert np.array_equal(grown.value[grown.leaves(binned)], whole.value[whole.leaves(binned, depth, light)])


def test_newton_gain_and_minimum_split_loss():
    x, y = table(80, 4, 1)
    y = y[:, 0]
    bins = trees.Bins.fit(x, 256)
    binned = bins.apply(x)
    g, h = 0.5 - y, np.full(len(y), 0.25)

    def side(m):
        return g[m].sum() ** 2 / (h[m].sum() + 1.0)

    gains = []
    for j in range(4):
        for v in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= v
            if min(h[left].sum(), h[~left].sum()) >= 1.0:
                gains.append((0.5 * (side(left) + side(~left) - side(np.ones(len(y), bool))), j, v))
    gain, feature, value = max(gains)
    for gamma, nodes in ((gain * 0.999, 3), (gain * 1.001, 1)):
        t = trees.boost(binned, bins.at, y, 1, 1, 0.3, gamma)
        assert len(t.left) == nodes
    t = trees.boost(binned, bins.at, y, 1, 1, 0.3, 0.0)
    left = x[:, feature] <= value
    assert t.feature[0] == feature and np.array_equal(t.leaves(binned)[0] == t.left[0], left)
    for node, m in ((t.left[0], left), (t.left[0] + 1, ~left)):
        assert np.isclose(t.value[node, 0], -g[m].sum() / (h[m].sum() + 1.0))


def test_boosting_lowers_the_loss_in_every_round():
    x, y = table(300, 6, 1, 5)
    bins = trees.Bins.fit(x)
    binned = bins.apply(x)
    t = trees.boost(binned, bins.at, y[:, 0], 20, 4, 0.3, 0.0)
    value = t.value[t.leaves(binned), 0]
    loss = [np.mean(np.logaddexp(0, -(2 * y[:, 0] - 1) * 0.3 * value[:k].sum(axis=0))) for k in range(21)]
    assert all(b < a for a, b in zip(loss, loss[1:]))


# ------------------------------------------------------------- linear


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_coefficients_meet_the_optimality_conditions(loss):
    x, y = table(200, 6, 1, 2)
    y = y[:, 0]
    objectives = [linear.Objective(loss, p, c) for p in ("l1", "l2") for c in (0.05, 1.0)] + [linear.Objective(loss, "l2", 10.0)]
    w = linear.solve(x, y, objectives, [(1e-9, 20000)])[:, 0]
    one = linear.with_intercept(x)
    for o, v in zip(objectives, w):
        g = linear.gradient(one, np.where(y > 0, 1.0, -1.0), v[:, None], [loss])[:, 0] / len(x)
        strength = 1 / (o.c * len(x))
        assert abs(g[-1]) < 1e-5  # the intercept is free
        if o.penalty == "l2":
            assert np.abs(g[:-1] + strength * v[:-1]).max() < 1e-5
        else:
            zero = v[:-1] == 0
            assert np.abs(g[:-1] + strength * np.sign(v[:-1]))[~zero].max(initial=0) < 1e-5
            assert (np.abs(g[:-1][zero]) <= strength + 1e-5).all()
    assert (w[0, :-1] == 0).sum() > (w[1, :-1] == 0).sum()


def test_stops_are_read_off_one_path():
    x, y = table(150, 6, 1, 3)
    objectives = [linear.Objective("logistic", "l2", 1.0), linear.Objective("logistic", None, 1.0)]
    stops = [(1e-2, 200), (1e-4, 200), (1e-4, 5)]
    together = linear.solve(x, y[:, 0], objectives, stops)
    for i, o in enumerate(objectives):
        for s, stop in enumerate(stops):
            assert np.allclose(linear.solve(x, y[:, 0], [o], [stop])[0, 0], together[i, s])
    assert not np.allclose(together[0, 0], together[0, 1])


# ------------------------------------------------------------- kernels


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_kernel_maps_approximate_the_exact_kernel(kind):
    x, _ = table(80, 20, 1, 4)
    gamma = kernels.gamma_of("scale", x)
    errors = [kernels.kernel_error(kernels.KernelMap(kind, gamma, 20, components=c), x) for c in (64, 512, 8192)]
    assert errors[2] < errors[0] and errors[2] < 0.12
    other = kernels.KernelMap(kind, 2 * gamma, 20)
    assert not np.allclose(other(x), kernels.KernelMap(kind, gamma, 20)(x))


def test_all_candidates_of_the_grids_differ():
    counts = {k: len(distinct_candidates(k, search.expand_grid(g))) for k, g in REFERENCE_GRIDS.items()}
    assert counts == {"nb": 3, "svm": 20, "logreg": 42, "rf": 162, "gbt": 24}


# ------------------------------------------------------------- searches


def test_halving_rungs_follow_the_number_of_candidates():
    rungs = {n: search.halving_schedule(n, 2000, 3, 3) for n in (3, 16, 42, 54, 24, 162)}
    assert {n: len(s) for n, s in rungs.items()} == {3: 2, 16: 3, 42: 4, 54: 4, 24: 3, 162: 5}
    assert rungs[42] == [(42, 74), (14, 222), (5, 666), (2, 1998)]
    assert search.halving_schedule(162, 106, 3, 3) == [(162, 12), (54, 36)]  # the least rows allow two rungs
    assert search.halving_schedule(1, 50, 3, 3) == [(1, 50)]
    assert search.halving_schedule(9, 5, 3, 3)[0] == (9, 5)


SMALL = {
    "nb": REFERENCE_GRIDS["nb"],
    "svm": {"C": [1], "gamma": ["scale"], "kernel": ["linear", "poly", "rbf"]},
    "logreg": {"penalty": ["l1", "none"], "C": [1], "solver": ["saga"], "tol": [0.01, 0.001], "max_iter": [50]},
    "rf": {"n_estimators": [5, 10], "max_depth": [None, 3], "max_features": ["sqrt"], "min_samples_split": [2, 10],
           "min_samples_leaf": [1], "bootstrap": [True, False]},
    "gbt": {"gamma": [0.1], "learning_rate": [0.5], "max_depth": [3], "n_estimators": [5, 10]},
}


@pytest.fixture(scope="module")
def frame(spark):
    from pyspark.ml.linalg import Vectors

    x, y = table(120, 6, 2, 9)
    x = np.where(np.abs(x) < 0.5, 0, x)
    rows = [(i, Vectors.sparse(6, {j: float(v) for j, v in enumerate(x[i]) if v}) if i % 2 else Vectors.dense(x[i].tolist()),
             float(y[i, 0]), float(y[i, 1]), i % 3, (i // 3) % 3) for i in range(120)]
    return spark.createDataFrame(rows, ["doc_id", "features", "remember", "apply", "fold_remember", "fold_apply"]).repartition(3)


@pytest.fixture(scope="module")
def work(spark, frame):
    return search.share(spark, bl.labelled_sample(frame, ["remember", "apply"], 6, 100, "s"))


def test_sample_is_bounded_and_holds_the_rows(work, frame):
    sample = work.value.sample
    assert len(sample.x) == 100 and sample.y.shape == sample.fold.shape == (100, 2)
    by_id = {tuple(np.round(r["features"].toArray(), 12)): (r["remember"], r["apply"]) for r in frame.collect()}
    dense = sample.x.dense()
    assert all(by_id[tuple(np.round(dense[i], 12))] == tuple(sample.y[i]) for i in range(100))


def test_grid_scores_equal_single_fits(spark, work):
    grids = {k: search.expand_grid(g) for k, g in SMALL.items()}
    rows = search.grid_search(spark, work, ["remember", "apply"], grids, 3)
    assert len(rows) == sum(len(distinct_candidates(k, g)) for k, g in grids.items()) * 2 * 3
    found = {(lv, k, p, f): s for lv, k, p, _, f, s in rows}
    sample, bins = work.value.sample, work.value.bins
    whole = fits.Prepared(sample.x.dense(), bins)
    for at, lv in enumerate(("remember", "apply")):
        for kind, grid in grids.items():
            for p in distinct_candidates(kind, grid):
                for f in range(3):
                    own = sample.fold[:, at] == f
                    m = fits.fit_candidates(kind, [p], whole.rows(np.flatnonzero(~own)), sample.y[~own, at])[0]
                    if kind == "rf":  # trees of a smaller forest are the first of the larger one only if draws agree
                        continue
                    want = search.f1_of(sample.y[own, at], m.predict(whole.rows(np.flatnonzero(own)))[0])
                    assert found[lv, kind, search.params_key(p), f] == pytest.approx(want), (lv, kind, p, f)
    best = {(r["level"], r["model"]) for r in search.best_params(search.scores_frame(spark, rows)).collect()}
    assert best == {(lv, k) for lv in ("remember", "apply") for k in SMALL}


def test_halving_keeps_the_best_of_every_rung(spark, work):
    grids = {k: search.expand_grid(SMALL[k]) for k in ("nb", "rf")}
    rows = search.halving_search(spark, work, ["remember"], grids, 3, 3)
    per = {}
    for _, kind, params, rung, _, score in rows:
        per.setdefault((kind, rung), {}).setdefault(params, []).append(score)
    plan = search.halving_schedule(len(distinct_candidates("rf", grids["rf"])), 100, 3, 3)
    assert [len(per["rf", r]) for r in range(len(plan))] == [n for n, _ in plan]
    first = per["rf", 0]
    ranked = sorted(first, key=lambda p: (-np.mean([s for s in first[p] if s is not None]), p))
    assert set(per["rf", 1]) == set(ranked[:plan[1][0]])


def test_refit_save_load_and_predict(spark, work, frame, tmp_path):
    wanted = [(lv, k, search.expand_grid(g)[-1]) for k, g in SMALL.items() for lv in ("remember", "apply")]
    rows = search.refit(spark, work, wanted)
    path = str(tmp_path / "models")
    search.save_models(spark, rows, path)
    models = search.load_models(spark, path)
    assert {(lv, k) for lv, k, _ in models} == {(lv, k) for lv, k, _ in wanted}
    told = search.predict_models(frame, models, work.value.bins, 6).collect()
    assert len(told) == 120 * 10 and all(r["yhat"] in (0, 1) and r["score"] == r["score"] for r in told)
    x = fits.Prepared(np.array([r["features"].toArray() for r in frame.orderBy("doc_id").collect()]), work.value.bins)
    got = {(r["doc_id"], r["level"], r["model"]): (r["yhat"], r["score"]) for r in told}
    for lv, kind, m in models:
        yhat, score = m.predict(x)
        assert all(got[i, lv, kind][0] == yhat[i] and got[i, lv, kind][1] == pytest.approx(score[i]) for i in range(120))
    y = {r["doc_id"]: r for r in frame.collect()}
    for lv, kind, _ in models:
        right = np.mean([got[i, lv, kind][0] == y[i][lv] for i in range(120)])
        assert right > 0.7, (lv, kind, right)


def test_joint_forest_has_an_output_per_level(spark, work, frame):
    model = search.joint_forest(spark, work, 25, trees_a_job=10)
    assert len(model.arrays["roots"]) == 25 and model.arrays["value"].shape[1] == 2
    told = search.predict_outputs(frame, model, ["remember", "apply"], work.value.bins, 6).collect()
    y = {r["doc_id"]: r for r in frame.collect()}
    assert len(told) == 240 and np.mean([r["yhat"] == y[r["doc_id"]][r["level"]] for r in told]) > 0.8
    again = search.joint_forest(spark, work, 25, trees_a_job=10)
    assert all(np.array_equal(model.arrays[k], again.arrays[k]) for k in model.arrays)


def test_levels_of_the_grids():
    assert len(LEVELS) == 6


def test_naive_bayes_on_vectors_equals_the_moments_of_dense_rows(spark, frame):
    from wordloom.operators import naive_bayes as nb

    models = nb.fit_vectors(frame, ["remember", "apply"], var_smoothing=1e-3)
    rows = frame.orderBy("doc_id").collect()
    x = np.array([r["features"].toArray() for r in rows])
    for lv, m in models.items():
        y = np.array([r[lv] for r in rows])
        for k in (0, 1):
            assert np.allclose(m.arrays["mean"][k], x[y == k].mean(axis=0))
            assert np.allclose(m.arrays["var"][k], x[y == k].var(axis=0) + 1e-3 * x.var(axis=0).max(), rtol=1e-4)
        told, p = m.predict(fits.Prepared(x, None))
        log = [np.log(np.mean(y == k)) - 0.5 * (np.log(2 * np.pi * v) + (x - a) ** 2 / v).sum(axis=1)
               for k, a, v in ((k, m.arrays["mean"][k], m.arrays["var"][k]) for k in (0, 1))]
        assert np.allclose(p, 1 / (1 + np.exp(log[0] - log[1]))) and np.array_equal(told, (log[1] > log[0]).astype(int))
    one = nb.fit_vectors(frame.where("remember = 1"), ["remember"])["remember"]
    assert one.predict(fits.Prepared(x, None))[0].all()  # a class without rows is never chosen


def test_stored_linear_model_scores_batches_of_vectors(spark, frame, tmp_path):
    from wordloom.operators import inference as inf

    w = [0.5, -1.0, 0.0, 2.0, 0.25, -0.5]
    path = str(tmp_path / "linear")
    spark.createDataFrame([(-1, 0.1), *enumerate(w)], "pos int, weight double").write.parquet(path)
    got = {r["doc_id"]: r["score"] for r in inf.score_vectors(frame, path).collect()}
    for r in frame.collect():
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(r["features"].toArray() @ np.array(w) + 0.1))))
