"""Sessions by day of expiry: purges against the plain filter, and which files they touch."""

import random

import pytest
from pyspark.sql import functions as F

from chatlens.operators.relational import purge_expired_sessions
from chatlens.sources.sessions import DAY_MS, SessionDays

SCHEMA = "session_id string, user_id string, validity_time long"


def rows(df):
    return sorted(map(str, (tuple(row) for row in df.select("session_id", "user_id", "validity_time").collect())))


@pytest.fixture
def given(spark):
    draw = random.Random(1)
    times = [draw.choice([3 * DAY_MS + draw.randint(0, DAY_MS - 1), draw.randint(0, 9 * DAY_MS)]) for _ in range(300)]
    times += [3 * DAY_MS, 3 * DAY_MS + 500, 3 * DAY_MS + 499, -5]
    return spark.createDataFrame([(f"s{i}", f"u{i % 7}", ms) for i, ms in enumerate(times)], SCHEMA)


@pytest.fixture
def held(spark, given, tmp_path):
    days = SessionDays(spark, str(tmp_path / "days"), given.schema)
    half = F.xxhash64("session_id") % 2 == 0
    days.add(given.filter(half))
    days.add(given.filter(~half))
    return days


def files(held):
    return {day: {row.f for row in held._read({day: folders}).select(F.input_file_name().alias("f")).collect()} for day, folders in held.days().items()}


@pytest.mark.parametrize("cutoff", [3 * DAY_MS + 500, 3 * DAY_MS, 20 * DAY_MS, -DAY_MS])
def test_one_cutoff_rewrites_its_own_day_only(held, given, cutoff):
    before = files(held)
    held.purge(cutoff)
    assert rows(held.frame()) == rows(purge_expired_sessions(given, cutoff))
    after, border = files(held), cutoff // DAY_MS if cutoff % DAY_MS else None
    assert min(after, default=10**9) >= cutoff // DAY_MS
    assert all(names == before[day] for day, names in after.items() if day != border)
    assert border is None or not after[border] & before[border]


def test_cutoffs_by_user(spark, held, given):
    cutoffs = spark.createDataFrame([("u1", 2 * DAY_MS + 7), ("u2", 5 * DAY_MS + 1), ("nobody", 1)], "user_id string, cutoff long")
    before = files(held)
    held.purge(cutoffs)
    assert rows(held.frame()) == rows(purge_expired_sessions(given, cutoffs))
    assert all(names == before[day] for day, names in files(held).items() if day > 5)
    held.purge(cutoffs.limit(0))
    assert rows(held.frame()) == rows(purge_expired_sessions(given, cutoffs))


def test_later_sessions_come_without_older_days(held, given):
    since = 4 * DAY_MS + 99
    found = held.frame(since)
    assert rows(found) == rows(given.filter(F.col("validity_time") >= since))
    assert not any(f"day={day}/" in name for day in range(4) for name in found.inputFiles())


def test_a_purge_that_fails_changes_nothing(held, given, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(held.manifests, "publish", fail)
    with pytest.raises(RuntimeError):
        held.purge(3 * DAY_MS + 500)
    monkeypatch.undo()
    assert rows(held.frame()) == rows(given)
    held.purge(3 * DAY_MS + 500)
    assert rows(held.frame()) == rows(purge_expired_sessions(given, 3 * DAY_MS + 500))


def test_a_reader_of_the_state_before_goes_on(held, given):
    found = held.frame()
    held.purge(3 * DAY_MS + 500)
    assert rows(found) == rows(given)


def test_empty(spark, tmp_path):
    days = SessionDays(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    days.purge(5)
    days.add(spark.createDataFrame([("s", "u", None)], SCHEMA))
    assert days.frame().collect() == [] and days.frame(3).collect() == []
