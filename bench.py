"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with the ``noop`` sink (full plan, nothing
collected).  A warm-up job and the fitted state shared between queries (lexicon,
vocabularies, model frame) are timed apart, under ``setup``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans import catalog  # noqa: E402
from wordloom.plans.q_features import feature_state  # noqa: E402
from wordloom.plans.q_ml import model_frame  # noqa: E402
from wordloom.plans.registry import builtin_lexicon  # noqa: E402
from wordloom.session import get_spark  # noqa: E402

HEADLINE = [
    "lex_scores_by_quality",
    "lex_category_scores",
    "lex_scores_wide",
    "lex_surface_stats",
    "txt_tokens",
    "feat_unigram_vocab",
    "feat_tfidf",
    "feat_transform_test",
    "feat_matrix_long",
    "feat_ari",
    "seq_encode_pad",
    "split_random_80_20",
    "split_kfold_stratified",
    "agg_label_counts",
    "agg_length_profile",
    "eval_headline",
    "eval_auc_scores",
    "eval_report_multilabel",
    "topk_features_per_level",
    "nb_gaussian_predict",
    "logreg_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = catalog.queries()

    def run(name: str) -> float:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - t0, 3)

    # the session's first job, and the state that several queries share, are timed apart
    setup = {"warm_up": run("agg_length_profile")}
    for name, build in (("lexicon", lambda: builtin_lexicon(spark)), ("features", lambda: feature_state(spark, sf_dir)),
                        ("model_frame", lambda: model_frame(spark, sf_dir))):
        t0 = time.time()
        build()
        setup[name] = round(time.time() - t0, 3)
    times = {name: run(name) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "setup": setup,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
