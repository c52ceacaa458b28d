"""Driver contract: entry() and every SQL-checked query against DuckDB on sf0.001; plan checks."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def canon(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"quality", "category", "n_docs", "mean_score"}
    assert df.count() > 0


def test_every_query_has_a_name_and_oracles_are_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["lex_category_scores", "feat_tfidf", "eval_headline", "split_kfold_stratified",
                                  "topk_features_per_level", "nb_gaussian_predict", "eval_auc_scores"])
def test_plans_have_no_cartesian_or_python(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad


TEXT_QUERIES = ["lex_category_scores", "lex_scores_wide", "lex_coverage", "txt_tokens", "feat_unigram_counts",
                "feat_matrix_long", "seq_encode_pad", "eval_headline", "topk_features_per_level"]


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_no_tokenizer_in_scan_filters(spark, name):
    """Each text is tokenized after the rows are spread, never again inside the (possibly
    single-partition) scan through a filter Catalyst inferred from an explode."""
    import re

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # long filter lists are cut with "..." before ", Format", so match up to that separator
    for filters in re.findall(r"DataFilters: ([^\n]*?), Format", plan):
        assert not re.search(r"regexp|rlike|split\(|size\(", filters), filters[:200]
