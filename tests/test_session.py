from wordloom.session import cached_size_bytes, checked_broadcast


def _hinted(df) -> bool:
    return "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()


def test_checked_broadcast_hints_small_tables(spark):
    b = checked_broadcast(spark.range(1000).selectExpr("id", "cast(id AS string) AS t"))
    assert _hinted(b)
    assert cached_size_bytes(b) > 0


def test_checked_broadcast_leaves_tables_over_the_byte_bound_to_a_shuffle_join(spark):
    b = checked_broadcast(spark.range(1000).selectExpr("id", "repeat('x', 100) AS t"), byte_limit=1000)
    assert not _hinted(b)
    assert b.count() == 1000


def test_checked_broadcast_leaves_tables_over_the_row_bound(spark):
    b = checked_broadcast(spark.range(50), limit=10)
    assert not _hinted(b)
