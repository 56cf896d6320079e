"""Ranks as a stored table: each run replaces the one before, whole or not at all."""

import pytest

from chatlens.plans import scratch_path
from chatlens.sources.ranks import RankTable


def ranks(spark, rows):
    return spark.createDataFrame(rows, "user_num_id long, rank_forward double, page_rank double")


def rows_of(held):
    return sorted(map(tuple, held.ranks().select("user_num_id", "page_rank").collect()))


def test_a_run_replaces_the_one_before(spark):
    held = RankTable(spark, scratch_path(spark, "ranks-test"))
    assert rows_of(held) == []
    held.save(ranks(spark, [(1, 0.0, 0.5), (2, 0.0, 1.5), (None, 0.0, 9.0)]))
    assert rows_of(held) == [(1, 0.5), (2, 1.5)]
    before = held.ranks()
    held.save(ranks(spark, [(2, 0.0, 0.25), (3, 0.0, 1.0)]))
    # User 1 left; the frame read before still has its files.
    assert rows_of(held) == [(2, 0.25), (3, 1.0)] and before.count() == 2
    held.save(ranks(spark, []))
    assert rows_of(held) == []


def test_a_run_that_fails_leaves_the_ranks(spark):
    held = RankTable(spark, scratch_path(spark, "ranks-test"))
    held.save(ranks(spark, [(1, 0.0, 0.5)]))
    broken = ranks(spark, [(1, 0.0, 7.0)]).selectExpr("user_num_id", "raise_error('lost') as page_rank")
    with pytest.raises(Exception, match="lost"):
        held.save(broken)
    assert rows_of(held) == [(1, 0.5)]
    held.save(ranks(spark, [(1, 0.0, 2.0)]))
    assert rows_of(held) == [(1, 2.0)]


def test_users_with_their_ranks(spark):
    held = RankTable(spark, scratch_path(spark, "ranks-test"))
    held.save(ranks(spark, [(1, 0.0, 0.5)]))
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_num_id long, login string")
    assert sorted((r["login"], r["page_rank"]) for r in held.of(users).collect()) == [("a", 0.5), ("b", None)]
