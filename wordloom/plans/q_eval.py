"""Evaluation and post-processing queries (E1-E11, M13, M14) on rule predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import post
from ..functions.constants import LEVELS
from ..operators import evaluate as ev
from . import views
from .registry import register

_COUNTS = """SELECT level,
  CAST(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  count(*) AS n
FROM v_pred GROUP BY level"""


def _div0(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


ACC = "CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE)"
KAPPA = ("CASE WHEN (tn + fp) * (fp + tp) + (fn + tp) * (tn + fn) > 0 THEN 1.0 - CAST((fp + fn) * n AS DOUBLE) / "
         "CAST((tn + fp) * (fp + tp) + (fn + tp) * (tn + fn) AS DOUBLE) END")
AUC_HARD = ("CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) + "
            "CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE)) / 2.0 END")
F1 = _div0("2 * tp", "2 * tp + fp + fn")
F1_NEG = _div0("2 * tn", "2 * tn + fp + fn")


def _metric_sql(expr: str) -> str:
    return f"WITH {views.sql_pred()}, c AS ({_COUNTS}) SELECT level, round({expr}, 6) AS value FROM c"


def _pred(spark, sf_dir):
    return views.pred(spark, sf_dir)


@register("eval_accuracy", _metric_sql(ACC))
def eval_accuracy(spark, sf_dir):
    return ev.single_metric(_pred(spark, sf_dir), ["level"], "accuracy")


@register("eval_kappa", _metric_sql(KAPPA))
def eval_kappa(spark, sf_dir):
    return ev.single_metric(_pred(spark, sf_dir), ["level"], "kappa")


@register("eval_auc_hard", _metric_sql(AUC_HARD))
def eval_auc_hard(spark, sf_dir):
    return ev.single_metric(_pred(spark, sf_dir), ["level"], "auc_hard")


@register("eval_f1", _metric_sql(F1))
def eval_f1(spark, sf_dir):
    return ev.single_metric(_pred(spark, sf_dir), ["level"], "f1")


@register("eval_f1_macro", _metric_sql(f"({F1} + {F1_NEG}) / 2.0"))
def eval_f1_macro(spark, sf_dir):
    return ev.single_metric(_pred(spark, sf_dir), ["level"], "f1_macro")


@register(
    "eval_f1_micro",
    f"""WITH {views.sql_pred()}, c AS ({_COUNTS}),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
SELECT round({F1}, 6) AS value FROM t""",
)
def eval_f1_micro(spark, sf_dir):
    return ev.f1_micro(_pred(spark, sf_dir))


@register(
    "eval_subset_accuracy",
    f"""WITH {views.sql_pred()}
SELECT round(avg(CAST(ok AS DOUBLE)), 6) AS value
FROM (SELECT doc_id, min(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS ok FROM v_pred GROUP BY doc_id)""",
)
def eval_subset_accuracy(spark, sf_dir):
    return ev.subset_accuracy(_pred(spark, sf_dir), ["doc_id"])


@register(
    "eval_auc_scores",
    f"""WITH {views.sql_pred()},
s AS (SELECT level, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM v_pred GROUP BY level, score),
c AS (SELECT level, score, pos, neg,
             coalesce(sum(neg) OVER (PARTITION BY level ORDER BY score
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM s)
SELECT level,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN round(CAST(sum(pos * (2 * nb + neg)) AS DOUBLE)
                       / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) END AS auc
FROM c GROUP BY level""",
)
def eval_auc_scores(spark, sf_dir):
    return ev.auc_scores(_pred(spark, sf_dir), ["level"])


def _report_binary_sql() -> str:
    p1, r1 = _div0("tp", "tp + fp"), _div0("tp", "tp + fn")
    p0, r0 = _div0("tn", "tn + fn"), _div0("tn", "tn + fp")
    s0, s1 = "(tn + fp)", "(tp + fn)"
    rows = [
        f"SELECT level, '0' AS row_name, round({p0}, 6) AS precision, round({r0}, 6) AS recall, round({F1_NEG}, 6) AS f1, {s0} AS support FROM c",
        f"SELECT level, '1', round({p1}, 6), round({r1}, 6), round({F1}, 6), {s1} FROM c",
        f"SELECT level, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round({ACC}, 6), n FROM c",
        f"SELECT level, 'macro avg', round(({p0} + {p1}) / 2.0, 6), round(({r0} + {r1}) / 2.0, 6), "
        f"round(({F1_NEG} + {F1}) / 2.0, 6), n FROM c",
        f"SELECT level, 'weighted avg', round(({p0} * {s0} + {p1} * {s1}) / n, 6), "
        f"round(({r0} * {s0} + {r1} * {s1}) / n, 6), round(({F1_NEG} * {s0} + {F1} * {s1}) / n, 6), n FROM c",
    ]
    return f"WITH {views.sql_pred()}, c AS ({_COUNTS}) " + " UNION ALL ".join(rows)


@register("eval_report_binary", _report_binary_sql())
def eval_report_binary(spark, sf_dir):
    return ev.report_binary(_pred(spark, sf_dir), ["level"])


def _report_multi_sql() -> str:
    per = (f"SELECT level AS row_name, {_div0('tp', 'tp + fp')} AS precision, {_div0('tp', 'tp + fn')} AS recall, "
           f"{F1} AS f1, tp + fn AS support, tp, fp, fn FROM c")
    return f"""WITH {views.sql_pred()}, c AS ({_COUNTS}), per AS ({per}),
micro AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS support FROM per),
rs AS (SELECT doc_id, sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS b, sum(y) AS ny, sum(yhat) AS np
       FROM v_pred GROUP BY doc_id),
allrows AS (
  SELECT row_name, precision, recall, f1, support FROM per
  UNION ALL SELECT 'micro avg', {_div0('tp', 'tp + fp')}, {_div0('tp', 'tp + fn')}, {_div0('2 * tp', '2 * tp + fp + fn')}, support FROM micro
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', {_div0('sum(precision * support)', 'sum(support)')},
                   {_div0('sum(recall * support)', 'sum(support)')}, {_div0('sum(f1 * support)', 'sum(support)')},
                   sum(support) FROM per
  UNION ALL SELECT 'samples avg', avg({_div0('b', 'np')}), avg({_div0('b', 'ny')}), avg({_div0('2 * b', 'ny + np')}),
                   sum(ny) FROM rs)
SELECT row_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allrows"""


@register("eval_report_multilabel", _report_multi_sql())
def eval_report_multilabel(spark, sf_dir):
    return ev.report_multilabel(_pred(spark, sf_dir), ["doc_id"], levels=LEVELS)


@register(
    "eval_headline",
    f"""WITH {views.sql_pred()}, c AS ({_COUNTS.replace('SELECT level,', 'SELECT dataset, level,').replace('GROUP BY level', 'GROUP BY dataset, level')})
SELECT dataset, level, round({ACC}, 6) AS accuracy, round({KAPPA}, 6) AS kappa, round({AUC_HARD}, 6) AS auc,
       round({F1}, 6) AS f1 FROM c""",
)
def eval_headline(spark, sf_dir):
    return ev.headline(_pred(spark, sf_dir), ["dataset", "level"])


# ------------------------------------------------------- post-processing


@register(
    "post_sigmoid_threshold",
    f"""WITH {views.sql_logits()}
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(p, 6) AS p, CAST(CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS INTEGER) AS yhat
FROM (SELECT vec_id, pos, 1.0 / (1.0 + exp(-x)) AS p
      FROM (SELECT vec_id, unnest(range(0, len(logits))) AS pos, unnest(logits) AS x FROM v_logits))""",
)
def post_sigmoid_threshold(spark, sf_dir):
    lg = views.logits(spark, sf_dir).select("vec_id", F.posexplode("logits").alias("pos", "x"))
    p = post.sigmoid(F.col("x"))
    return lg.select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.round(p, 6).alias("p"), post.threshold(p).alias("yhat")
    )


@register(
    "post_argmax",
    f"WITH {views.sql_logits()} SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS yhat FROM v_logits",
)
def post_argmax(spark, sf_dir):
    return views.logits(spark, sf_dir).select("vec_id", post.argmax(F.col("logits")).alias("yhat"))
