"""Metrics, post-processing and hash-ordered splits: golden cases and properties."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from wordloom.functions import post
from wordloom.operators import evaluate as ev
from wordloom.operators import sampling as sm


def pred_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, level string, y int, yhat int, score double")


def test_threshold_edge_and_argmax_tie(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (0.0,)], "p double")
    assert [r[0] for r in df.select(post.threshold(F.col("p"))).collect()] == [1, 0, 0]
    a = spark.createDataFrame([([0.3, 0.3],), ([0.1, 0.9, 0.9],)], "a array<double>")
    assert [r[0] for r in a.select(post.argmax(F.col("a"))).collect()] == [0, 1]
    s = spark.createDataFrame([(0.0,)], "x double").select(post.sigmoid(F.col("x"))).first()[0]
    assert s == 0.5


def test_kappa_one_when_equal_and_hard_auc_is_mean_recall(spark):
    rows = [(i, "a", y, y, 0.0) for i, y in enumerate([0, 1, 1, 0, 1])]
    h = ev.headline(pred_frame(spark, rows), ["level"]).first()
    assert (h.accuracy, h.kappa, h.auc, h.f1) == (1.0, 1.0, 1.0, 1.0)
    rows = [(0, "a", 1, 1, 0.0), (1, "a", 1, 0, 0.0), (2, "a", 0, 0, 0.0), (3, "a", 0, 0, 0.0), (4, "a", 0, 1, 0.0)]
    h = ev.headline(pred_frame(spark, rows), ["level"]).first()
    assert h.auc == round((1 / 2 + 2 / 3) / 2, 6)
    assert h.f1 == round(2 / (2 + 1 + 1), 6)


def test_one_class_only_guards(spark):
    rows = [(i, "a", 1, 1, 0.5) for i in range(4)]
    h = ev.headline(pred_frame(spark, rows), ["level"]).first()
    assert h.kappa is None and h.auc is None and h.accuracy == 1.0
    assert ev.auc_scores(pred_frame(spark, rows), ["level"]).first().auc is None


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return round(tot / (len(pos) * len(neg)), 6)


def test_auc_scores_equals_pairwise_count_with_ties(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for lv in ("a", "b"):
        ys = [rnd.randint(0, 1) for _ in range(300)]
        ss = [rnd.choice([0.1, 0.2, 0.3, 0.35, 0.9]) if lv == "a" else rnd.random() for _ in range(300)]
        rows += [(i, lv, y, 0, s) for i, (y, s) in enumerate(zip(ys, ss))]
        want[lv] = brute_auc(ys, ss)
    got = {r.level: r.auc for r in ev.auc_scores(pred_frame(spark, rows), ["level"], n_buckets=16).collect()}
    assert got == want


def test_report_binary_rows(spark):
    rows = [(0, "a", 1, 1, 0.0), (1, "a", 1, 0, 0.0), (2, "a", 0, 0, 0.0), (3, "a", 0, 1, 0.0)]
    rep = {r.row_name: r for r in ev.report_binary(pred_frame(spark, rows), ["level"]).collect()}
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5 and rep["1"].support == 2
    assert rep["accuracy"].precision is None and rep["accuracy"].f1 == 0.5
    assert rep["macro avg"].f1 == 0.5 and rep["weighted avg"].support == 4


def _md5_rank(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_random_split_equals_global_md5_order_and_is_a_partition(spark):
    n = 5000
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    out = sm.random_split(df, "doc_id", "42", __import__("fractions").Fraction(1, 5))
    got = {r.doc_id: r.split for r in out.collect()}
    assert len(got) == n
    order = _md5_rank(range(n), "42")
    cut = math.ceil(n / 5)
    assert {i for i in order[:cut]} == {i for i, s in got.items() if s == "test"}


def test_kfold_stratified_sizes(spark):
    rows = [(i, i % 7 == 0) for i in range(1000)]
    df = spark.createDataFrame([(i, int(b)) for i, b in rows], "doc_id long, y int")
    out = sm.kfold(df, "doc_id", "9", 3, strata=["y"])
    sizes = {(r.y, r.fold): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        n = sum(1 for _, b in rows if int(b) == y)
        want = [math.ceil(n / 3), math.ceil(2 * n / 3) - math.ceil(n / 3), n - math.ceil(2 * n / 3)]
        assert [sizes[(y, f)] for f in range(3)] == want


def test_undersample_balances_classes(spark):
    df = spark.createDataFrame([(i, "q", int(i % 5 == 0)) for i in range(500)], "doc_id long, level string, y int")
    out = sm.undersample(df, "doc_id", "0", ["level"], "y")
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 100}


def test_split_plan_has_no_single_partition_window(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    plan = sm.random_split(df, "doc_id", "1", __import__("fractions").Fraction(1, 5))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("InMemoryRelation")[0]


def test_split_keeps_rows_with_null_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(400)], "doc_id long, y int")
    out = sm.random_split(df, "doc_id", "5", __import__("fractions").Fraction(1, 5), strata=["y"])
    assert out.count() == 400
    nulls = out.filter("y IS NULL").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in nulls} == {"test": 20, "train": 80}


def test_split_with_finer_buckets_still_equals_global_order(spark, monkeypatch):
    """Buckets over the edge bound take more hex digits; the parts stay the exact global order."""
    monkeypatch.setattr(sm, "EDGE_BUCKET_ROWS", 2)
    n = 3000
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    out = sm.kfold(df, "doc_id", "77", 3)
    got = {r.doc_id: r.fold for r in out.collect()}
    order = _md5_rank(range(n), "77")
    cuts = [math.ceil(n / 3), math.ceil(2 * n / 3)]
    want = {d: sum(1 for c in cuts if i + 1 > c) for i, d in enumerate(order)}
    assert got == want


def test_split_reads_wide_rows_once_without_shuffling_them(spark):
    """The rows themselves pass through broadcast joins only: no union of two scans, no exchange of text."""
    df = spark.createDataFrame([(i, "text " * 5) for i in range(300)], "doc_id long, text string")
    plan = sm.random_split(df, "doc_id", "3", __import__("fractions").Fraction(1, 5))._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]
    assert "Union" not in top
    assert "SortMergeJoin" not in top


def test_metrics_of_counts_beyond_long_products(spark):
    """Counts of 1e11 rows: products leave the range of long."""
    n = 10**11
    c = spark.createDataFrame([(4 * n, n, n, 4 * n, 10 * n)], "tp long, fp long, fn long, tn long, n long")
    got = c.select(ev.kappa().alias("k"), ev.accuracy().alias("a"), ev.f1_pos().alias("f")).first()
    assert abs(got.k - 0.6) < 1e-12 and abs(got.a - 0.8) < 1e-12 and abs(got.f - 0.8) < 1e-12


def test_auc_is_the_same_for_any_number_of_buckets(spark):
    rows = [("a", (i * 37) % 101 / 101.0, int((i * 53) % 7 < 3)) for i in range(700)] + [("b", 0.5, i % 2) for i in range(9)]
    df = spark.createDataFrame(rows, "level string, score double, y int")
    want = sorted(map(tuple, ev.auc_scores(df, ["level"], n_buckets=1).collect()))
    for buckets in (None, 4, 64):
        assert sorted(map(tuple, ev.auc_scores(df, ["level"], n_buckets=buckets).collect())) == want


def test_split_keeps_null_ids_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sm, "EDGE_BUCKET_ROWS", 2)
    rows = [(i,) for i in range(300)] + [(None,)] * 5 + [(i,) for i in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "doc_id long")
    out = sm.kfold(df, "doc_id", "7", 3)
    assert out.count() == len(rows)
    assert out.groupBy("doc_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_splits_and_auc_have_no_single_partition(spark):
    """No task sees all buckets or scores, in the plan or below its cached tables."""
    from fractions import Fraction

    df = spark.range(5000).withColumn("g", F.col("id") % 3).repartition(4)
    plans = [sm.random_split(df, "id", "s", Fraction(1, 5)), sm.kfold(df, "id", "s", 3),
             sm.random_split(df, "id", "s", Fraction(1, 5), ["g"])]
    for out in plans:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryRelation" in plan and "SinglePartition" not in plan
    scores = df.select(F.col("g").alias("level"), (F.col("id") % 2).alias("y"), (F.col("id") / 7).alias("score"))
    assert "SinglePartition" not in ev.auc_scores(scores, ["level"])._jdf.queryExecution().executedPlan().toString()


def test_split_ranks_equal_the_sorted_keys_with_many_digits(spark, monkeypatch):
    import hashlib
    from fractions import Fraction

    monkeypatch.setattr(sm, "EDGE_BUCKET_ROWS", 1)  # the longest buckets
    rows = [(i, "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(3)

    def want(ids):
        order = sorted(ids, key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())
        return set(order[:-(-len(ids) // 5)])

    got = {r["id"] for r in sm.random_split(df, "id", "s", Fraction(1, 5)).where("split = 'test'").collect()}
    assert got == want(list(range(600)))
    got = {r["id"] for r in sm.random_split(df, "id", "s", Fraction(1, 5), ["g"]).where("split = 'test'").collect()}
    assert got == want(list(range(0, 600, 2))) | want(list(range(1, 600, 2)))
