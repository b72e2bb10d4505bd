"""Tables between the steps of a job lie in one folder that goes with the run."""

import os

import pytest

from kifulake.session import delete_path, materialise, scratch_path, scratch_scope


def test_scope_drops_its_tables(spark):
    keep = scratch_path(spark, "keep")
    with scratch_scope(spark) as outer:
        a = materialise(spark.range(10), "a")
        with scratch_scope(spark, "inner") as inner:
            materialise(a, "b")
            assert os.path.dirname(inner) == outer and len(os.listdir(inner)) == 1
        assert not os.path.exists(inner)
        a.where("id > 3").write.parquet(keep)
    assert not os.path.exists(outer)
    assert spark.read.parquet(keep).count() == 6
    delete_path(spark, keep)
    delete_path(spark, keep)
    assert not os.path.exists(keep)


def test_scope_goes_when_a_job_fails(spark):
    with pytest.raises(ZeroDivisionError), scratch_scope(spark) as path:
        materialise(spark.range(3), "a")
        raise ZeroDivisionError
    assert not os.path.exists(path)
    assert not scratch_path(spark, "next").startswith(path)
