"""Fits and searches on all rows, read in slices from files, against the same fits on rows held in memory."""

import numpy as np
import pytest

from wordloom.functions.constants import LEVELS
from wordloom.operators import fits, search, stored, trees
from wordloom.operators.blocks import labelled_sample
from wordloom.operators.models import distinct_candidates

TWO = ["remember", "apply"]
GRIDS = {
    "nb": [{"var_smoothing": 1e-9}, {"var_smoothing": 1e-2}],
    "svm": [{"C": c, "gamma": g, "kernel": k} for c in (0.1, 10) for g in ("scale", "auto") for k in ("linear", "poly", "rbf")],
    "logreg": [{"penalty": p, "C": 1, "solver": "saga", "tol": 1e-3, "max_iter": m} for p in ("l1", "l2", "none") for m in (5, 40)],
    "rf": [{"n_estimators": n, "max_depth": d, "max_features": "sqrt", "min_samples_split": s, "min_samples_leaf": leaf,
            "bootstrap": b} for n in (3, 8) for d in (None, 3) for s in (2, 10) for leaf in (1, 2) for b in (True, False)],
    "gbt": [{"gamma": 0.1, "learning_rate": 0.5, "max_depth": d, "n_estimators": n} for d in (2, 5) for n in (4, 8)],
}


@pytest.fixture(scope="module")
def frame(spark):
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 7)), 2)
    x[np.abs(x) < 0.6] = 0
    x[:, 5] = r.integers(0, 3, 300)  # few values
    x[:, 6] = 0
    y = (x[:, :2] + 0.4 * r.normal(size=(300, 2)) > 0).astype(float)
    rows = [(i, Vectors.sparse(7, {j: float(v) for j, v in enumerate(x[i]) if v}) if i % 3 else Vectors.dense(x[i].tolist()),
             float(y[i, 0]), float(y[i, 1]), i % 3, (i // 3) % 3) for i in range(300)]
    return spark.createDataFrame(rows, ["doc_id", "features", *TWO, *[f"fold_{lv}" for lv in TWO]]).repartition(4)


@pytest.fixture(scope="module")
def sample(frame):
    return labelled_sample(frame, TWO, 7, 300, "s")


@pytest.fixture(scope="module")
def work(frame):
    return search.share_rows(frame, TWO, 7, "s", held=50)


@pytest.fixture
def narrow(monkeypatch):
    """Bounds that a small table passes."""
    monkeypatch.setattr(stored, "HELD_ROWS", 20)
    monkeypatch.setattr(stored, "COUNTED_ROWS", 32)
    monkeypatch.setattr(fits, "GROWN_ROWS", 700)
    monkeypatch.setattr(fits, "KEPT_BYTES", 100_000)  # raw rows are kept, mapped ones are not
    monkeypatch.setattr(trees, "NODES_HELD", 3)
    monkeypatch.setattr(trees, "CELLS_HELD", 100)


def test_bins_are_those_of_all_rows(work, sample):
    want = trees.Bins.fit(sample.x.dense())
    assert np.array_equal(work.value.bins.at, want.at) and np.allclose(work.value.bins.edges, want.edges)
    assert want.at[-1] == want.at[6] and 0 < want.at[6] - want.at[5] < 3  # no value but 0; few values


def test_bins_of_hidden_zeros_and_negative_values(spark):
    from pyspark.ml.linalg import Vectors

    x = np.zeros((100, 3))
    x[:, 0] = np.arange(100) - 50.0
    x[:30, 1] = -np.arange(30)
    x[90:, 2] = np.arange(10) * 0.5
    df = spark.createDataFrame([(Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(3, {j: float(w) for j, w in enumerate(v) if w}),)
                                for i, v in enumerate(x)], ["features"])
    got, want = stored.bins_of(df, 3, 100), trees.Bins.fit(x)
    assert np.array_equal(got.at, want.at) and np.allclose(got.edges, want.edges)


def test_stored_rows_are_all_rows_in_their_order(work, sample):
    rows = work.value.sample.open(work.value.bins)
    assert rows.n == work.value.sample.n == 300 and not rows.held
    assert np.array_equal(rows.dense(np.arange(300)), sample.x.dense())
    assert np.array_equal(rows.y, sample.y) and np.array_equal(rows.fold, sample.fold)
    assert np.array_equal(rows.binned, work.value.bins.apply(sample.x.dense()))
    some = np.array([5, 7, 280])
    assert np.array_equal(np.concatenate([p.x for _, p in rows.rows(some).parts()]), sample.x.dense()[some])


@pytest.mark.parametrize("kind", sorted(GRIDS))
def test_fits_on_stored_rows_equal_fits_on_held_rows(work, sample, narrow, kind):
    bins, grid = work.value.bins, distinct_candidates(kind, GRIDS[kind])
    whole, rows = fits.Prepared(sample.x.dense(), bins), work.value.sample.open(work.value.bins)
    train, val = np.flatnonzero(sample.fold[:, 0] != 1), np.flatnonzero(sample.fold[:, 0] == 1)
    y = sample.y[train, 0]
    assert not rows.rows(train).held and not rows.rows(val).held
    held, kept = fits.fit_candidates(kind, grid, whole.rows(train), y), fits.fit_candidates(kind, grid, rows.rows(train), y)
    told = fits.fitted_predictions(kind, grid, rows.rows(train), y, rows.rows(val))
    for a, b, t in zip(held, kept, told, strict=True):
        want, score = a.predict(whole.rows(val))
        close = np.abs(score - (0.0 if kind == "svm" else 0.5)) < 1e-4
        assert np.allclose(score, b.predict(whole.rows(val))[1], atol=1e-4), (kind, a.params)
        assert np.array_equal(t[~close], want[~close]), (kind, a.params)


def test_joint_forest_on_stored_rows_equals_that_on_held_rows(work, sample, narrow):
    rows = work.value.sample.open(work.value.bins)
    whole = fits.Prepared(sample.x.dense(), work.value.bins)
    a, b = fits.grow_outputs(whole, sample.y, 10, 5), fits.grow_outputs(rows, np.array(rows.y), 10, 5)
    for binned in (whole.binned,):
        assert np.allclose(a.value[a.leaves(binned)], b.value[b.leaves(binned)])


def test_search_on_stored_rows_scores_as_on_held_rows(spark, work, sample):
    held = search.share(spark, sample)
    grids = {k: GRIDS[k] for k in ("nb", "logreg", "gbt")}
    for found in (search.grid_search, lambda *a: search.halving_search(*a, 3)):
        a, b = ({r[:5]: r[5] for r in found(spark, w, TWO, grids, 3)} for w in (held, work))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    fitted = search.refit(spark, work, [("apply", k, GRIDS[k][0]) for k in GRIDS])
    assert [r[4] for r in fitted] == [300] * 5
    joint = search.joint_forest(spark, work, 4, trees_a_job=2)
    assert len(joint.arrays["roots"]) == 4


@pytest.fixture
def many(spark, monkeypatch):
    """2,400 training rows in place of a model frame; the rows after the first 2,000 in md5 order have other labels."""
    import hashlib

    from pyspark.ml.linalg import Vectors

    from wordloom.functions.constants import HALVING_SEED
    from wordloom.plans import q_ml

    order = sorted(range(2400), key=lambda i: hashlib.md5(f"{HALVING_SEED}:{i}".encode()).hexdigest())
    place = {i: p for p, i in enumerate(order)}
    r = np.random.default_rng(4)
    rows = []
    for i in range(2500):
        late = place.get(i, 0) >= 2000
        y = float(late or r.random() < 0.3)
        rows.append((i, "train" if i < 2400 else "test", Vectors.dense([float(late) * 5 + r.normal(), y + r.normal(), 1.0]),
                     *[y] * 6, *[i % 3] * 6))
    df = spark.createDataFrame(rows, ["doc_id", "split", "features", *LEVELS, *[f"fold_{lv}" for lv in LEVELS]]).cache()
    key = q_ml._key(spark, "many", "frame")
    monkeypatch.setitem(q_ml._FRAMES, key, df)
    monkeypatch.setattr(q_ml, "_dim", lambda spark, sf_dir: 3)
    yield df
    for k in [k for k in q_ml._FRAMES if k[-2:-1] == ("many",) and k != key]:
        del q_ml._FRAMES[k]


def test_queries_fit_and_search_on_all_training_rows(spark, many, monkeypatch):
    from wordloom.plans import q_ml

    train = many.where("split = 'train'").toPandas().sort_values("doc_id")
    x, y = np.stack([v.toArray() for v in train["features"]]), train["remember"].to_numpy().astype(int)
    monkeypatch.setattr(q_ml, "DEFAULTS", {"nb": {"var_smoothing": 1e-9}})
    monkeypatch.setattr(q_ml, "TUNE_GRIDS", {"nb": GRIDS["nb"]})
    model = next(m for lv, _, m in q_ml._default_models(spark, "many") if lv == "remember")
    assert model.arrays["prior"][1] == pytest.approx(y.mean())  # that of the first 2,000 rows is some 0.3
    assert np.allclose(model.arrays["mean"], [x[y == k].mean(axis=0) for k in (0, 1)])
    for f in range(3):
        own = train["doc_id"].to_numpy() % 3 == f
        whole = fits.Prepared(x, None)
        for p in GRIDS["nb"]:
            m = fits.fit_candidates("nb", [p], whole.rows(np.flatnonzero(~own)), y[~own])[0]
            want = search.f1_of(y[own], m.predict(whole.rows(np.flatnonzero(own)))[0])
            got = q_ml.search_grid(spark, "many").where(
                f"level = 'remember' AND fold = {f} AND params = '{search.params_key(p)}'").first()["f1"]
            assert got == pytest.approx(want, abs=1e-6)
    last = {r["rung"] for r in q_ml.search_halving(spark, "many").collect()}
    assert last == {0}  # two candidates, all rows at once
    fitted = spark.read.parquet(q_ml._winners(spark, "many"))
    assert {r["n_rows"] for r in fitted.collect()} == {2400}


def test_sketch_of_the_entries_is_the_sketch_of_dense_rows():
    from wordloom.operators import kernels

    x = np.random.default_rng(5).normal(size=(30, 40)) * (np.random.default_rng(6).random((30, 40)) < 0.2)
    h, s = kernels._arrays("poly", 40, 512, kernels.SEED)
    want = np.ones((30, 257), dtype=complex)
    for k in range(kernels.DEGREE):
        sketch = np.zeros((30, 512))
        for j in range(40):
            sketch[:, h[k, j]] += x[:, j] * s[k, j]
        want = want * np.fft.rfft(sketch, axis=1)
    assert np.allclose(kernels.KernelMap("poly", 1.0, 40).base(x), np.fft.irfft(want, n=512, axis=1))
    assert kernels.KernelMap("poly", 1.0, 40).base(x[:0]).shape == (0, 512)
