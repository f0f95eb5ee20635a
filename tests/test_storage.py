"""Bounds, required columns and written tables."""

import os

import pytest
from pyspark.sql import functions as F

from leafwright import storage


def test_bounds(spark):
    df = spark.range(5)
    assert len(storage.bounded_rows(df, 5, "the rows")) == 5
    with pytest.raises(storage.TooLarge):
        storage.bounded_rows(df, 4, "the rows")
    assert storage.hinted(df, 4) is df


def test_columns_that_differ_in_case_only(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("A"), F.lit(3).alias("b"))
    assert storage.require(df, "A", "b").first().asDict() == {"A": 2, "b": 3}
    with pytest.raises(ValueError, match="missing"):
        storage.require(df, "c")


def test_written_tables_are_read_back_and_cleared(spark):
    kept = storage.written(spark.range(3), "numbers")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    folder = storage.work_dir(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    storage.clear(spark)
    assert not os.path.exists(folder)
