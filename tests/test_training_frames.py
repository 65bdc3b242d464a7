"""Frames that every pass of the training reads."""

import pytest

from cohortlab.plans import frames, training

from conftest import SF_SMALL


class Reached(Exception):
    pass


def test_training_rows_are_not_dealt_by_shuffle_partitions(spark, monkeypatch):
    """The learners read stored rows in as many parts as their bytes fill, whatever the number of shuffle partitions."""
    seen = []

    def noted(train, *args):
        seen.append(train.rdd.getNumPartitions())
        raise Reached
    monkeypatch.setattr(training.models, "fit_stack_bases", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        with pytest.raises(Reached):
            training.train(frames.prepared(spark, SF_SMALL), training.TrainConfig.quick())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] <= spark.sparkContext.defaultParallelism
