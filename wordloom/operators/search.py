"""Hyper-parameter search (M9-M12, M17): k-fold grid search, successive halving, refits, predictions on any table.

Candidates are fitted on all training rows, in md5 order.  Up to ``LABELLED_ROWS`` of them travel once as a broadcast
variable (``blocks.labelled_sample``); more are written as files and read in slices by the tasks (``stored``).  Every
(kind, level, fold, group of candidates that share a fit) is one row of a job table and one task of one Spark
job, so a search is a few jobs however many candidates it has.  Scores come back as rows; fitted winners are written as a
table in the shared folder and read again for predictions, which run over all rows of a table in one narrow pass.
"""

from __future__ import annotations

import itertools
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .blocks import Sample, Sparse, labelled_sample
from .fits import TREE_ARRAYS, Model, Prepared, fit_candidates, fitted_predictions, grow_outputs, jobs_of, prepare
from .models import distinct_candidates, params_key
from .stored import HELD_ROWS, Store, StoredRows, bins_of, write_rows
from .trees import Bins, Trees

# Rows up to which a search's rows are held whole by the driver and every worker.
LABELLED_ROWS = HELD_ROWS
# Rows that the smallest rung must have, per class and fold.
LEAST_ROWS = 2
SCORE_SCHEMA = "level string, model string, params string, rung int, fold int, f1 double"
MODEL_SCHEMA = "level string, model string, params string, fit_seconds double, n_rows long, blob binary"


def expand_grid(grid: dict) -> list[dict]:
    """All candidates of a grid given as name → list of values, first name varying slowest."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def f1_of(y: np.ndarray, yhat: np.ndarray) -> float:
    """F1 of the positive class; 0 where it is undefined."""
    hit, said, real = int((y & yhat).sum()), int(yhat.sum()), int(y.sum())
    return 2.0 * hit / (said + real) if hit else 0.0


@dataclass
class Work:
    """What all tasks of a search share."""

    sample: Sample | Store
    bins: Bins
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


_PREPARED: dict[str, tuple] = {}


def _prepared(work: Work) -> tuple[Prepared | StoredRows, Sample | StoredRows]:
    """(rows, what has their labels and folds) in this worker, made once for all tasks of a search."""
    if work.name not in _PREPARED:
        _PREPARED.clear()
        if isinstance(work.sample, Store):
            rows = work.sample.open(work.bins)
            _PREPARED[work.name] = rows, rows
        else:
            _PREPARED[work.name] = Prepared(work.sample.x.dense(), work.bins), work.sample
    return _PREPARED[work.name]


def _n_rows(work) -> int:
    sample = work.value.sample
    return sample.n if isinstance(sample, Store) else len(sample.x)


def _run_jobs(spark: SparkSession, work, jobs: list[dict], run, schema: str) -> list:
    """One task per job, the dear ones first; ``run(rows, sample, job)`` gives the job's result rows."""
    if not jobs:
        return []
    ship(spark)
    dear = {"rf": 0, "gbt": 1}
    sent_jobs = spark.sparkContext.broadcast(sorted(jobs, key=lambda j: dear.get(j["kind"], 2)))
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                got = run(*_prepared(work.value), sent_jobs.value[i])
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names)

    n = len(jobs)
    return spark.range(0, n, 1, n).mapInArrow(task, schema).collect()


def _scores(rows: Prepared, sample: Sample, job: dict) -> list[tuple]:
    """(place, level, fold, f1) of the job's candidates; f1 null in a rung too small to hold the fold."""
    level, fold, n = job["level"], job["fold"], job["n"]
    at = sample.levels.index(level)
    own = sample.fold[:n, at] == fold
    train, val = np.flatnonzero(~own), np.flatnonzero(own)
    if not len(train) or not len(val):
        return [(i, level, fold, None) for i in job["places"]]
    y = sample.y[:, at].astype(np.int64)
    prepare(job["kind"], rows)
    told = fitted_predictions(job["kind"], job["params"], rows.rows(train), y[train], rows.rows(val))
    return [(i, level, fold, f1_of(y[val], yhat)) for i, yhat in zip(job["places"], told, strict=True)]


def _score_all(spark, work, alive: dict[tuple[str, str], list[int]], grids: dict[str, list[dict]], k: int,
               n_rows: dict[str, int]) -> dict[tuple, float | None]:
    """{(kind, level, place, fold): f1} of the candidates ``alive`` for each (kind, level)."""
    jobs = []
    for (kind, level), places in alive.items():
        for group in jobs_of(kind, [grids[kind][i] for i in places]):
            mine = [places[g] for g in group]
            jobs += [{"kind": kind, "level": level, "fold": f, "n": n_rows[kind], "places": mine,
                      "params": [grids[kind][i] for i in mine]} for f in range(k)]

    def run(rows: Prepared, sample: Sample, job: dict) -> list[tuple]:
        return [(job["kind"], *r) for r in _scores(rows, sample, job)]

    got = _run_jobs(spark, work, jobs, run, "kind string, place long, level string, fold long, f1 double")
    return {(r["kind"], r["level"], r["place"], r["fold"]): r["f1"] for r in got}


def _mean(scores: list[float | None]) -> float:
    """Mean of the folds that have a score; candidates without any come last."""
    known = [s for s in scores if s is not None]
    return sum(known) / len(known) if known else -math.inf


def grid_search(spark: SparkSession, work, levels: list[str], grids: dict[str, list[dict]], k: int) -> list[tuple]:
    """Rows (level, model, params, rung=0, fold, f1) for every kind × level × different candidate × fold."""
    grids = {kind: distinct_candidates(kind, g) for kind, g in grids.items()}
    n = _n_rows(work)
    found = _score_all(spark, work, {(kind, lv): list(range(len(g))) for kind, g in grids.items() for lv in levels}, grids, k,
                       dict.fromkeys(grids, n))
    return [(lv, kind, params_key(grids[kind][i]), 0, f, s) for (kind, lv, i, f), s in found.items()]


def halving_schedule(n_candidates: int, n_rows: int, factor: int, k: int, n_classes: int = 2) -> list[tuple[int, int]]:
    """(candidates, rows) of every rung: candidates shrink and rows grow by ``factor``; the last rung uses what the
    number of rungs allows, starting from the most rows with which that many rungs still fit."""
    least = k * LEAST_ROWS * n_classes
    wanted = 1 + int(math.log(max(n_candidates, 1), factor) + 1e-9)
    first = max(least, n_rows // factor ** (wanted - 1))
    possible = 1 + (int(math.log(n_rows / first, factor) + 1e-9) if n_rows >= first else 0)
    return [(math.ceil(n_candidates / factor ** r), min(n_rows, first * factor ** r)) for r in range(min(wanted, possible))]


def halving_search(spark: SparkSession, work, levels: list[str], grids: dict[str, list[dict]], k: int, factor: int) -> list[tuple]:
    """Successive halving: rung r scores the best candidates of rung r - 1 on more rows (nested, in md5 order).
    Every kind has the rungs of its own number of candidates; kinds with a further rung run in one job."""
    grids = {kind: distinct_candidates(kind, g) for kind, g in grids.items()}
    n = _n_rows(work)
    schedule = {kind: halving_schedule(len(g), n, factor, k) for kind, g in grids.items()}
    alive = {(kind, lv): list(range(len(g))) for kind, g in grids.items() for lv in levels}
    out: list[tuple] = []
    for r in range(max(map(len, schedule.values()))):
        alive = {key: places for key, places in alive.items() if r < len(schedule[key[0]])}
        found = _score_all(spark, work, alive, grids, k, {kind: s[min(r, len(s) - 1)][1] for kind, s in schedule.items()})
        out += [(lv, kind, params_key(grids[kind][i]), r, f, s) for (kind, lv, i, f), s in found.items()]
        for (kind, lv), places in alive.items():
            if r + 1 < len(schedule[kind]):
                mean = {i: _mean([found[kind, lv, i, f] for f in range(k)]) for i in places}
                ranked = sorted(places, key=lambda i: (-mean[i], params_key(grids[kind][i])))
                alive[kind, lv] = ranked[:schedule[kind][r + 1][0]]
    return out


def scores_frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCORE_SCHEMA)


def best_params(scores: DataFrame, digits: int | None = 6) -> DataFrame:
    """Top candidate per level and model on its last rung: mean F1 over folds, ties by params text."""
    last = scores.groupBy("level", "model").agg(F.max("rung").alias("_last"))
    s = scores.join(last, ["level", "model"]).filter(F.col("rung") == F.col("_last"))
    mean = s.groupBy("level", "model", "params").agg(F.avg("f1").alias("mean_f1"))
    w = Window.partitionBy("level", "model").orderBy(F.desc_nulls_last("mean_f1"), F.asc("params"))
    top = mean.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return top.select("level", "model", "params", (F.round("mean_f1", digits) if digits is not None else F.col("mean_f1")).alias("mean_f1"))


def refit(spark: SparkSession, work, winners: list[tuple[str, str, dict]]) -> list[tuple]:
    """(level, kind, params, seconds, rows, model as bytes) of each (level, kind, params), fitted on all rows."""
    jobs = [{"kind": kind, "level": lv, "params": p} for lv, kind, p in winners]

    def run(rows: Prepared, sample: Sample, job: dict) -> list[tuple]:
        begin = time.time()
        y = sample.y[:, sample.levels.index(job["level"])].astype(np.int64)
        model = fit_candidates(job["kind"], [job["params"]], rows, y)[0]
        return [(job["level"], job["kind"], params_key(job["params"]), time.time() - begin, rows.n, model.to_bytes())]

    return [tuple(r) for r in _run_jobs(spark, work, jobs, run, MODEL_SCHEMA)]


def save_models(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """A row per (level, model): parameters, fit seconds and the model's arrays."""
    spark.createDataFrame(rows, MODEL_SCHEMA).write.parquet(path)


def load_models(spark: SparkSession, path: str) -> list[tuple[str, str, Model]]:
    return [(r["level"], r["model"], Model.from_bytes(r["blob"])) for r in spark.read.parquet(path).orderBy("model", "level").collect()]


def predict_models(frame: DataFrame, models: list[tuple[str, str, Model]], bins: Bins, dim: int, id_col: str = "doc_id",
                   features_col: str = "features") -> DataFrame:
    """(id, level, model, yhat, score) of every row of ``frame`` and every model, in one narrow pass."""
    spark = frame.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((models, bins))
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, edges = sent.value
        for batch in batches:
            sparse = Sparse.of_vectors(batch.column("_x"), dim)
            for start, x in sparse.slices():
                ids = batch.column(id_col).slice(start, len(x))
                rows = Prepared(x, edges)
                for level, name, model in fitted:
                    yhat, score = model.predict(rows)
                    model.shared.clear()
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([level] * len(x)), pa.array([name] * len(x)), pa.array(yhat, pa.int32()), pa.array(score)],
                        [id_col, "level", "model", "yhat", "score"])

    return frame.select(id_col, F.col(features_col).alias("_x")).mapInArrow(
        run, f"`{id_col}` {kind}, level string, model string, yhat int, score double")


def share(spark: SparkSession, sample: Sample):
    """Held rows and their bins as a broadcast variable; its size is bounded by the number of rows."""
    return spark.sparkContext.broadcast(Work(sample, Bins.fit(sample.x.dense())))


def share_rows(frame: DataFrame, levels: list[str], dim: int, seed: str, held: int = LABELLED_ROWS, **columns):
    """All rows of ``frame`` for a search: up to ``held`` in a broadcast variable, more in files of which it has the names."""
    spark, n = frame.sparkSession, frame.count()
    if n <= held:
        return share(spark, labelled_sample(frame, levels, dim, max(n, 1), seed, **columns))
    store = write_rows(frame, levels, dim, seed, **columns)
    return spark.sparkContext.broadcast(Work(store, bins_of(frame, dim, n, columns.get("features_col", "features"))))


def joint_forest(spark: SparkSession, work, n_trees: int, trees_a_job: int = 10) -> Model:
    """One forest with an output per level: every split lowers the Gini impurity summed over all levels (M7).

    Full depth, square root of the features a node, rows drawn with repeats; a job grows ``trees_a_job`` of the trees.
    """
    jobs = [{"kind": "rf", "first": t, "n": min(trees_a_job, n_trees - t)} for t in range(0, n_trees, trees_a_job)]

    def run(rows: Prepared, sample: Sample, job: dict) -> list[tuple]:
        trees = grow_outputs(rows, sample.y, job["first"], job["n"])
        return [(job["first"], Model("joint_rf", {"n_estimators": job["n"]}, {f: getattr(trees, f) for f in TREE_ARRAYS}).to_bytes())]

    parts = sorted(map(tuple, _run_jobs(spark, work, jobs, run, "first long, blob binary")))
    trees = Trees.joined([Trees(*(Model.from_bytes(blob).arrays[f] for f in TREE_ARRAYS)) for _, blob in parts])
    return Model("joint_rf", {"n_estimators": n_trees}, {f: getattr(trees, f) for f in TREE_ARRAYS})


def predict_outputs(frame: DataFrame, model: Model, levels: list[str], bins: Bins, dim: int, id_col: str = "doc_id",
                    features_col: str = "features") -> DataFrame:
    """(id, level, yhat, score): the six probabilities of a joint forest for every row, in one narrow pass."""
    spark = frame.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model, bins))
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, edges = sent.value
        for batch in batches:
            for start, x in Sparse.of_vectors(batch.column("_x"), dim).slices():
                ids = batch.column(id_col).slice(start, len(x))
                score = fitted.outputs(Prepared(x, edges))
                for k, level in enumerate(levels):
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([level] * len(x)), pa.array((score[:, k] > 0.5).astype(np.int32)), pa.array(score[:, k])],
                        [id_col, "level", "yhat", "score"])

    return frame.select(id_col, F.col(features_col).alias("_x")).mapInArrow(
        run, f"`{id_col}` {kind}, level string, yhat int, score double")
