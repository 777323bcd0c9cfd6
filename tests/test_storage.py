import pytest

from windrow.operators.count_windows import count_windows
from windrow.storage import child_names, intermediates, make_dir, materialize, new_path, shared_dir


def left(spark):
    base = f"{shared_dir(spark)}/windrow/{spark.sparkContext.applicationId}"
    make_dir(spark, base)
    return set(child_names(spark, base))


def test_block_leaves_nothing(spark):
    before = left(spark)
    metrics = spark.range(12).selectExpr("'d' AS deviceId", "current_timestamp() AS timestamp", "'m' AS name", "double(id) AS value", "id")
    with intermediates(spark):
        assert count_windows(metrics, order_by=["id"]).count() == 3
        assert left(spark) != before
    assert left(spark) == before


def test_block_is_cleared_after_an_error(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), intermediates(spark):
        materialize(spark.range(3), "x")
        raise ZeroDivisionError
    assert left(spark) == before


def test_kept_table_outlives_its_block_only(spark):
    before = left(spark)
    with intermediates(spark):
        with intermediates(spark) as scope:
            first = materialize(spark.range(5), "x")
            kept = scope.keep(first.selectExpr("id * 2 AS twice"), "y")
            assert len(left(spark) - before) == 1
        assert sorted(r.twice for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert left(spark) == before


def test_paths_outside_a_block_are_the_callers(spark):
    assert new_path(spark, "a") != new_path(spark, "a")
