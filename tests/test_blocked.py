"""Block-wise running totals against plain windows, with one group holding most rows."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.plans import materialize, materialize_dealt, met, numbered, ranged, scratch_path, with_running
from chatlens.plans.blocked import _carried


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    groups = ["hot"] * 400 + ["a"] * 100 + ["b"] * 50 + [None] * 120
    data = [(g, i, rng.randrange(60), rng.choice([None, *range(20)])) for i, g in enumerate(groups)]
    return spark.createDataFrame(data, "g string, id long, at long, v long").cache()


def plain(rows):
    window = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return {
        row.id: tuple(row)[1:]
        for row in rows.select(
            "id",
            F.count("v").over(window),
            F.sum("v").over(window),
            F.max("v").over(window),
            F.min("v").over(window),
        ).collect()
    }


AGGS = {"n": ("count", "v"), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_totals_equal_a_plain_window(rows, width):
    cut = rows.withColumn("b", F.floor(F.col("at") / width))
    got = with_running(cut, ["g"], [["b"]], ["at", "id"], AGGS)
    assert {row.id: (row.n, row.s, row.hi, row.lo) for row in got.collect()} == plain(rows)


@pytest.mark.parametrize("pieces", [1, 30, None])
def test_running_totals_over_ranges(rows, pieces):
    got = with_running(ranged(rows, ["g"], ["at", "id"], pieces), ["g"], [["_block"]], ["at", "id"], AGGS)
    assert {row.id: (row.n, row.s, row.hi, row.lo) for row in got.collect()} == plain(rows)


def test_two_levels_of_blocks(rows):
    cut = rows.withColumn("b", F.floor(F.col("at") / 7)).withColumn("c", F.col("at"))
    got = with_running(cut, ["g"], [["b"], ["c"]], ["at", "id"], AGGS)
    assert {row.id: (row.n, row.s, row.hi, row.lo) for row in got.collect() if row.g is not None} == {
        row.id: plain(rows)[row.id] for row in rows.collect() if row.g is not None}


def test_the_whole_input_as_one_group(rows):
    blocked = rows.withColumn("b", F.floor(F.col("id") / 50))
    got = {row.id: row.s for row in with_running(blocked, [], [["b"]], ["id"], {"s": ("sum", "v")}).collect()}
    total, want = 0, {}
    for row in sorted(rows.collect(), key=lambda row: row.id):
        total += row.v or 0
        want[row.id] = total
    first = min(row.id for row in rows.collect() if row.v is not None)
    assert {key: value for key, value in got.items() if key >= first} == {k: v for k, v in want.items() if k >= first}


def test_positions_downwards(rows):
    got = numbered(rows, ["g"], [F.desc("at"), F.col("id")], "place", pieces=20)
    window = Window.partitionBy("g").orderBy(F.desc("at"), "id")
    want = rows.select("id", F.row_number().over(window).alias("place"))
    assert sorted(map(tuple, got.select("id", "place").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("key", ["concat('chat--0b7e--', lpad(id, 6, '0'))", "cast(id as string)"])
def test_every_large_group_is_cut_whatever_its_ids_look_like(spark, key):
    """1,100 groups, and one of them with most rows; ids of direct chats of one user, and plain numbers."""
    rows = spark.range(1_100).selectExpr("id as g", "'x' as k").unionByName(spark.range(20_000).selectExpr("0L as g", f"{key} as k"))
    cut = ranged(rows, ["g"], ["k"], 50)
    sizes = [row["count"] for row in cut.filter("g = 0").groupBy("_block").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2_000


def test_groups_in_the_final_block_alone_are_not_chained(spark):
    """Rows of the final block feed no other: chaining adds up the rows of the blocks before it only."""
    rows = spark.createDataFrame([("a", 0, 1), ("a", 9, 2), ("b", 0, 5), (None, 9, 3), (None, 0, 4)], "g string, at long, v long")
    cut = rows.withColumn("b", F.floor(F.col("at") / 4))
    got = with_running(cut, ["g"], [["b"]], [F.desc("at")], {"s": ("sum", "v")}, descending=True, final=0)
    assert {(row.g, row.at): row.s for row in got.collect()} == {("a", 0): 3, ("a", 9): 2, ("b", 0): 5, (None, 9): 3, (None, 0): 7}
    chained = _carried(cut.withColumn("_fed_s", F.col("v")), ["g"], [["b"]], {"s": ("sum", "v")}, True, 0)
    assert "b" not in {row.g for row in chained.collect()}


def test_rows_meet_by_digest_as_by_their_keys(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), (None, 1, "z"), ("b", 2, "u"), ("b", 2, "u")], "k string, n int, v string")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0), ("b", 2, 4.0)], "k string, n int, w double")
    want = left.join(right, ["k", "n"])
    got = met(left, right, ["k", "n"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("pieces", [1, 30, None])
def test_positions_are_counted_where_the_ranges_lie(rows, pieces):
    got = numbered(rows, ["g"], ["at", "id"], "p", pieces)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the counts of blocks, by group
    want = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("at", "id")))
    assert {row.id: row.p for row in got.collect()} == {row.id: row.p for row in want.collect()}


@pytest.mark.parametrize("dealt", [False, True])
def test_a_written_table_leaves_no_shuffle_files(spark, dealt):
    """Whatever led to a table is not read again; on disk it would add up over the steps of a query."""
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(at).getName() for at in range(files.size()) if files.apply(at).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    path = scratch_path(spark, "written")
    table = materialize_dealt(df, path, 2, ["k"])[0] if dealt else materialize(df, path)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.count() == 7 and df.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
