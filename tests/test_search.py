"""Search by the gram index: the same hits as testing every pattern on every user."""

import re

import pytest
from pyspark.sql import functions as F

from chatlens.operators import relational, search

LOGINS = [
    "Supplier#000000001", "supplier#000000010", "ANNA.maria", "anna_maria", "Ben-99", "BÄR", "bär", "Straße", "a+b", "abc", "abccc", "abdef",
    "abcdef", "xx[yy]", "foo", "fooo", "", "Kelvin", "kelvin", "tab\tname", "dot.com", "d0t,com", "ſupplier",
]
PATTERNS = [
    "supplier#0+1", "[1-3]0$", "99", "anna", "ANNA.MARIA", r"anna\.maria", "abc", "abc+", "abcd*ef", "ab(c|d)", "abc|foo", "^abc$", "fo{2}",
    "fooo?", "fo{2,}o", "bär", "Straße", r"\bkelvin", "k.lvin", r"\x61nna", r"\Qa+b\E", "[a-c]+def", r"xx\[yy\]", "", ".", "zzz", "nosuchlogin",
    "foo??", "supplier#0++1", "(?-i)ANNA", r"dot\Wcom", "[[a-b]c]def", "tab\tname", "sup{0}plier",
]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(f"u{i}", login) for i, login in enumerate(LOGINS)] + [("n", None)], "user_id string, login string")


def listed(df):
    return sorted(tuple(row) for row in df.select("pattern", "user_id", "login").collect())


def table(spark, patterns):
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def test_equals_testing_everything(spark, users):
    got = listed(search.search_users_indexed(users, table(spark, [*PATTERNS, "abc", None])))
    assert got == listed(relational.search_users(users, PATTERNS)) and len(got) > 60


def test_grams_are_in_every_match(spark, users):
    grams = table(spark, PATTERNS).select("pattern", search.required_grams(F.col("pattern")).alias("grams")).collect()
    hits = listed(relational.search_users(users, PATTERNS))
    held = {row.pattern: row.grams for row in grams}
    fold = str.maketrans(search._UPPER, search._LOWER)
    for pattern, _, login in hits:
        assert all(gram in login.translate(fold) for gram in held[pattern]), (pattern, login, held[pattern])
    assert held["anna"] == ["ann", "nna"] and held["abc|foo"] == [] and held[r"\x61nna"] == []


def test_a_stored_index_and_many_patterns(spark, users, tmp_path):
    many = spark.range(3_000).select(F.concat(F.lit("user-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("login"), F.col("id").cast("string").alias("user_id"))
    search.login_index(many).write.parquet(str(tmp_path / "index"))
    patterns = spark.range(10_000).select(F.concat(F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("$")).alias("pattern"))
    found = search.search_users_indexed(many, patterns, spark.read.parquet(str(tmp_path / "index")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
    assert found.count() == 3_000 and found.filter(~F.col("login").endswith(F.left("pattern", F.lit(5)))).count() == 0


def test_lists_of_patterns_without_plain_text(spark, users):
    patterns = [f"^.{{{n}}}$" for n in range(300)]
    got = listed(search.search_users_indexed(users, table(spark, patterns)))
    assert got == listed(relational.search_users(users, patterns)) and len(got) == len([x for x in LOGINS])


def test_no_patterns_and_no_users(spark, users):
    assert listed(search.search_users_indexed(users, table(spark, []))) == []
    assert listed(search.search_users_indexed(users.limit(0), table(spark, PATTERNS))) == []
