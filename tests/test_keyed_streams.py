"""Keyed state on streams: the per-record grace rule, stored tables that streams update, folding of versions."""

import datetime as dt
import importlib
import random
import time

import pytest
from pyspark.sql import functions as F

from chatlens.operators import cursors, windows
from chatlens.plans.lineage import listed
from chatlens.streaming import VersionedTable, run_available, to_compacted, to_keyed, to_kept_and_late

LOG = "chat_id string, partition int, offset long, server_time timestamp, content string, size long"
START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(str, (tuple(row) for row in df.collect())))


def forget(checkpoints, name):
    """Forget that the last batch was finished, so that a restart repeats it."""
    commits = checkpoints / name / "commits"
    last = max(int(path.name) for path in commits.iterdir() if path.name.isdigit())
    for path in list(commits.iterdir()):
        if path.name.strip(".").removesuffix(".crc") == str(last):
            path.unlink()


class Files:
    """A folder of parquet files, each one micro-batch, in the order they were added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.all = spark, str(folder), schema, []

    def add(self, records):
        self.all += records
        self.spark.createDataFrame(records, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        reader = self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema)
        return reader.option("maxFilesPerTrigger", 1).parquet(self.folder)

    def batch(self):
        return self.spark.createDataFrame(self.all, self.schema)


# --- grace ----------------------------------------------------------------------------


def log_records(draw, low, high):
    """Arrivals from low to high, mixed; times run on with jumps back over minutes. One chat holds most."""
    found = []
    for at in range(low, high):
        chat = draw.choice(["busy"] * 4 + ["a", "b"])
        ms = at * 2_000 - draw.choice([0, 0, 0, 5, 61_000, 59_996, 120_000]) + draw.choice([0, 4, 5, 6])
        time = None if draw.random() < 0.02 else START + dt.timedelta(milliseconds=ms)
        found.append((chat, at % 2, at, time, None if at % 7 else "x", None if at % 3 else 2**60 + at))
    draw.shuffle(found)
    return found


@pytest.fixture
def traffic(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield Files(spark, tmp_path / "log", LOG)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


SPACE = ["chat_id", "partition"]


def test_kept_and_late_records_equal_the_batch_rule(spark, traffic, tmp_path):
    draw = random.Random(4)
    for low in (0, 150, 155, 400):
        traffic.add(log_records(draw, low, {0: 150, 150: 155, 155: 400, 400: 520}[low]))

    def run():
        run_available(to_kept_and_late(traffic.stream(), str(tmp_path / "out"), "offset", SPACE), "grace", str(tmp_path / "checkpoints"))
        return spark.read.parquet(str(tmp_path / "out"))

    def check(got):
        marked = windows.with_lateness(traffic.batch(), "offset", key_space=SPACE).filter("late is not null")
        assert rows(got.select(*marked.columns)) == rows(marked)
        late = windows.late_records(traffic.batch(), "offset", key_space=SPACE)
        assert rows(got.filter("late").select(*late.columns)) == rows(late) and late.count() > 20

    got = run()
    assert got.select("batch_id").distinct().count() == 4
    check(got)
    # A restart goes on with the stream times of the first run; a repeated batch changes nothing.
    traffic.add(log_records(draw, 520, 700))
    check(run())
    forget(tmp_path / "checkpoints", "grace")
    check(run())


# --- updates of a stored table -----------------------------------------------------------

OFFSETS = ["o0", "o1"]
MEMBERS = "user_id string, chat_id string, message_time long, o0 long, o1 long, accepted long"
UPDATES = "user_id string, chat_id string, last_message_time long, partition_offsets array<struct<partition:int,offset:long>>, arrival long"


def updates(draw, count):
    found = []
    for arrival in range(count):
        named = [(part, draw.randint(0, 40)) for part in range(2)]
        found.append((f"u{draw.randint(0, 8)}", draw.choice(["hot", "c1", "gone"]), arrival, named, arrival))
    return found


def merge(stored, changes):
    return cursors.apply_offset_updates(stored, changes, OFFSETS, "accepted")


@pytest.mark.parametrize("cuts", [(20, 40), (1, 2), (59, 60)])
def test_updates_in_any_split_end_in_the_batch_result(spark, tmp_path, cuts):
    members = [(f"u{i}", chat, 0, i, 5, None) for i in range(9) for chat in ("hot", "c1")]
    members = spark.createDataFrame(members, MEMBERS)
    series = updates(random.Random(cuts[0]), 61)
    want = cursors.apply_offset_updates(members, spark.createDataFrame(series, UPDATES), OFFSETS, "accepted")
    plain = cursors.apply_offset_updates(members.drop("accepted"), spark.createDataFrame(series, UPDATES), OFFSETS)
    assert rows(want.drop("accepted")) == rows(plain)

    path, files = str(tmp_path / "members"), Files(spark, tmp_path / "updates", UPDATES)
    table = VersionedTable(spark, path, members.schema, ["user_id", "chat_id"], parts=4)
    table.load(members)

    def run():
        writer = to_keyed(files.stream(), path, members.schema, ["user_id", "chat_id"], merge, compact_every=2, parts=4)
        run_available(writer, "updates", str(tmp_path / "checkpoints"))

    for low, high in zip((0, *cuts), (*cuts, 61)):
        files.add(series[low:high])
        run()
        before = rows(table.state())
        forget(tmp_path / "checkpoints", "updates")
        run()
        assert rows(table.state()) == before
    assert rows(table.state()) == rows(want)
    with pytest.raises(ValueError, match="already"):
        table.load(members)


# --- folding ----------------------------------------------------------------------------


def totals(files):
    return files.stream().groupBy("chat_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


def small(draw, count=30):
    return [(f"c{draw.randint(0, 12)}", 0, i, START, "x", i) for i in range(count)]


def test_folding_keeps_the_result_and_bounds_the_files(spark, tmp_path):
    draw, files = random.Random(8), Files(spark, tmp_path / "log", LOG)
    for _ in range(7):
        files.add(small(draw))
    path, schema = str(tmp_path / "out"), totals(files).schema
    run_available(to_compacted(totals(files), path, ["chat_id"], compact_every=3, parts=4), "totals", str(tmp_path / "checkpoints"))
    table = VersionedTable(spark, path, schema, ["chat_id"], parts=4)
    want = rows(files.batch().groupBy("chat_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    assert rows(table.state()) == want
    assert table.folded() == 5 and table.batches() == [3, 4, 5, 6]  # one state before the last fold stays readable
    snapshot, tail = table.paths()
    assert len(snapshot) <= 4 and len(tail) <= 4
    table.compact()
    assert rows(table.state()) == want and table.paths()[1] == [] and table.folded() == 6
    table.compact()  # nothing to fold
    assert rows(table.state()) == want


def test_a_fold_rewrites_only_touched_parts(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v int").schema
    table = VersionedTable(spark, str(tmp_path), schema, ["k"], parts=8)
    table.load(spark.range(64).selectExpr("cast(id as int) k", "0 v"))
    before = set(table.paths()[0])
    table.write(spark.createDataFrame([(5, 1)], schema), 0)
    table.compact()
    assert len(before & set(table.paths()[0])) == 7 and len(table.paths()[0]) == 8
    assert {row.k: row.v for row in table.state().collect()} == {k: int(k == 5) for k in range(64)}


@pytest.mark.parametrize("step", ["before the snapshot is whole", "before the switch", "before the cleaning"])
def test_a_fold_that_fails_loses_nothing(spark, tmp_path, monkeypatch, step):
    schema = spark.createDataFrame([], "k int, v int").schema
    table = VersionedTable(spark, str(tmp_path), schema, ["k"], parts=3)
    for batch in range(4):
        table.write(spark.range(10).selectExpr("cast(id as int) k", f"{batch} v").filter(f"k % 4 >= {batch}"), batch)
        if batch == 1:
            table.compact()
    want = rows(table.state())

    def fail(*_):
        raise RuntimeError("lost")

    target = {"before the snapshot is whole": (table, "_last"), "before the switch": (table.manifests, "publish"), "before the cleaning": (table, "clean")}
    monkeypatch.setattr(*target[step], fail)
    with pytest.raises(RuntimeError):
        table.compact()
    monkeypatch.undo()
    assert rows(table.state()) == want
    table.write(spark.createDataFrame([(3, 99), (7, 99)], schema), 3)  # the batch is repeated after the failure
    table.compact()
    if step != "before the cleaning":  # there the batch was folded already and stays as it was
        want = sorted([*[row for row in want if row[1] not in "37"], "(3, 99)", "(7, 99)"])
    assert rows(table.state()) == want
    folders = {folder for folder in listed(spark, f"{tmp_path}/_snapshots")}
    assert len(folders) <= 2 and len(table.manifests.names()) <= 2


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v int").schema
    table = VersionedTable(spark, str(tmp_path), schema, ["k"])
    assert table.state().collect() == []
    table.write(spark.createDataFrame([(1, 1)], schema), 0)
    table.write(spark.createDataFrame([(1, 2)], schema), 1)
    (tmp_path / "batch_id=1" / "_SUCCESS").unlink()
    assert [row.v for row in table.state().collect()] == [1]


# --- typing and merging --------------------------------------------------------------------

WRITING = "chat_id string, writer_id string, writer_login string, server_time timestamp"


def signals(*times, writer="w", chat="c"):
    return [(chat, writer, f"login {writer}", START + dt.timedelta(milliseconds=ms)) for ms in times]


def test_typing_goes_on_while_signals_come_and_ends_after_the_last(spark):
    given = spark.createDataFrame(signals(0, 900, 1900, 2901, 5000) + signals(100, writer="me"), WRITING)
    got = cursors.typing_intervals(given, "1 second", me="me").orderBy("typing_from").collect()
    spans = [((r.typing_from - START).total_seconds(), (r.typing_until - START).total_seconds(), r.signals) for r in got]
    # A signal just as the last one ends goes on (900 to 1900); a millisecond later is a new interval.
    assert spans == [(0, 2.9, 3), (2.901, 3.901, 1), (5, 6, 1)]


def test_typing_over_two_batches(spark, tmp_path):
    from chatlens.streaming import to_table

    files = Files(spark, tmp_path / "writing", WRITING)
    files.add(signals(0, 800))
    files.add(signals(1500, 9_000) + signals(300, writer="x"))  # goes on with the interval of the batch before
    files.add(signals(60_000, writer="late"))
    files.add(signals(90_000, writer="late"))
    result = cursors.typing_intervals(files.stream(), "1 second", watermark="10 seconds")
    run_available(to_table(result, str(tmp_path / "out")), "typing", str(tmp_path / "checkpoints"))
    want = cursors.typing_intervals(files.batch(), "1 second").filter(F.col("writer_id") != "late")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns).filter(F.col("writer_id") != "late")
    assert rows(got) == rows(want) and got.count() == 3


def test_merged_streams_hold_each_record_once(spark, tmp_path):
    from chatlens.streaming import to_table

    draw = random.Random(2)
    records = [(f"c{i % 3}", i % 2, i, START + dt.timedelta(seconds=i), "x", i) for i in range(80)]
    loaded, older = Files(spark, tmp_path / "loaded", LOG), Files(spark, tmp_path / "older", LOG)
    for files, low, high in ((loaded, 30, 80), (older, 0, 50)):
        for _ in range(2):  # files fed twice, records out of order
            part = records[low:high]
            draw.shuffle(part)
            files.add(part[:20])
            files.add(part[20:])

    def run():
        merged = cursors.merge_old_new_stream(loaded.stream(), older.stream(), "10 minutes")
        run_available(to_table(merged, str(tmp_path / "out")), "merged", str(tmp_path / "checkpoints"))
        return spark.read.parquet(str(tmp_path / "out"))

    want = rows(cursors.merge_old_new(loaded.batch(), older.batch()))
    columns = loaded.batch().columns
    assert rows(run().select(*columns)) == want
    older.add(records[:10])
    assert rows(run().select(*columns)) == want


def test_no_task_writes_a_whole_large_part(spark, tmp_path):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = VersionedTable(spark, str(tmp_path), rows.schema, ["k"], parts=2)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        table.load(rows.repartition(8))
    finally:
        spark.conf.set(name, before)
    snapshot, _ = table.paths()
    assert all(len(spark.read.parquet(folder).inputFiles()) > 1 for folder in snapshot)
    wanted = spark.createDataFrame([(5,), (7,), (99999,), (None,)], "k long")
    assert {row.k for row in table.state(of=wanted).collect()} == {5, 7}
    assert table.state().count() == 20000


def test_batches_and_folds_leave_no_shuffle_files(spark, tmp_path):
    """A stream runs on for long; what its batches shuffled would stay on disk beside the table."""
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(at).getName() for at in range(files.size()) if files.apply(at).getName().startswith("shuffle_")}

    before = shuffles()
    rows_ = spark.range(500).selectExpr("cast(id as string) as k", "id as v").repartition(3, "k")
    held = VersionedTable(spark, str(tmp_path / "table"), rows_.schema, ["k"])
    held.load(rows_)
    for batch in range(2):
        held.write(rows_.groupBy("k").agg((F.max("v") + batch + 1).alias("v")), batch)
    held.compact()
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert held.state().agg(F.count("v"), F.sum("v")).first() == (500, 500 * 499 // 2 + 2 * 500)


def test_parts_of_a_stream_are_not_copied_first(spark, monkeypatch):
    """Rows that come in thirds are read from their table, without a copy of all of them on disk."""
    queries = importlib.import_module("chatlens.catalog.queries")
    monkeypatch.setattr(queries, "scratch_path", lambda *_: pytest.fail("a table is written"))
    data = [(n, (n * 7) % 100) for n in range(100)] + [(100, None)]
    parts = queries._in_thirds(spark.createDataFrame(data, "id long, at long"), "at")
    found = [[row["at"] for row in part.collect()] for part in parts]
    assert sorted(sum(found, [])) == list(range(100)) and max(found[0]) < min(found[1]) and max(found[1]) < min(found[2])
