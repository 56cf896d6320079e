"""Search of logins by many patterns at once, through an index of 3-grams.

Every piece of plain text that a pattern cannot match without gives 3-grams, and only users that have
the rarest of them are tested. Patterns without such a piece go through all users on a path of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
RAREST = 2  # posting lists that are intersected per pattern
PATTERNS_AT_ONCE = 64  # patterns without plain text that meet a user in one row
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "\x00"


def _folded(text: Column | str) -> Column:
    """A-Z in lower case, which is what a search without case takes for equal."""
    return F.translate(text, _UPPER, _LOWER)


def _grams(text: Column) -> Column:
    count = F.greatest(F.length(text) - F.lit(GRAM - 1), F.lit(0))
    each = F.transform(F.sequence(F.lit(1), count), lambda at: F.substring(text, at, F.lit(GRAM)))
    return F.when(count > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def required_grams(pattern: Column) -> Column:
    """3-grams that every match of a regular expression contains; none where that is not plain to see.

    Groups, alternatives, escapes other than of classes and marks, and brackets in brackets give none. A character that
    may be absent is no plain text, and a bracket, a dot or an anchor ends a piece.
    """
    unclear = pattern.rlike(r"[|(\x00]") | pattern.rlike(r"\\[^dDwWsSbB\W]") | pattern.rlike(r"\\_")
    rest = F.regexp_replace(pattern, r"\\.", _BREAK)
    rest = F.regexp_replace(rest, r"\[[^\[\]]*\]", _BREAK)
    unclear |= rest.rlike(r"[\[\]\\]")
    rest = F.regexp_replace(rest, r"(?s).(?:[*?]|\{[^}]*\})[+?]?", _BREAK)
    pieces = F.split(F.regexp_replace(rest, r"[+^$.{})]", _BREAK), _BREAK)
    grams = F.array_distinct(F.flatten(F.transform(pieces, lambda piece: _grams(_folded(piece)))))
    return F.when(unclear, F.array().cast("array<string>")).otherwise(grams)


def login_index(users: DataFrame) -> DataFrame:
    """(gram, user_id, login): the users of every 3-gram of a login, once each."""
    return users.select(F.explode(_grams(_folded("login"))).alias("gram"), "user_id", "login")


def _hit(pattern: str = "pattern") -> Column:
    return F.rlike(F.col("login"), F.concat(F.lit("(?i)"), F.col(pattern)))


def search_users_indexed(users: DataFrame, patterns: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(pattern, user_id, login) for every row of ``patterns`` (pattern) and user, users being unique, as ``search_users`` gives for a list.

    ``index`` is a stored ``login_index`` of the users; without one it is made here. A pattern that comes twice counts once,
    a null one not at all.
    """
    index = login_index(users) if index is None else index
    wanted = patterns.select("pattern").filter("pattern IS NOT NULL").distinct().withColumn("_grams", required_grams(F.col("pattern")))
    return _by_index(wanted.filter(F.size("_grams") > 0), index).unionByName(
        scan_users(users, wanted.filter(F.size("_grams") == 0).select("pattern"))
    )


def _by_index(wanted: DataFrame, index: DataFrame) -> DataFrame:
    asked = wanted.select("pattern", F.explode("_grams").alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_users"))
    # A gram without users rules its pattern out: it stays as the rarest, and finds nobody.
    rated = asked.join(often.hint("merge"), "gram", "left").withColumn("_users", F.coalesce("_users", F.lit(0)))
    order = Window.partitionBy("pattern").orderBy("_users", "gram")
    rarest = rated.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= RAREST)
    rarest = rarest.select("pattern", "gram", F.least(F.size(required_grams(F.col("pattern"))), F.lit(RAREST)).alias("_lists"))
    met = rarest.hint("merge").join(index, "gram").groupBy("pattern", "user_id", "login", "_lists").agg(F.count(F.lit(1)).alias("_in"))
    return met.filter((F.col("_in") == F.col("_lists")) & _hit()).select("pattern", "user_id", "login")


def scan_users(users: DataFrame, patterns: DataFrame, at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """The path for patterns without plain text: every user is tested against every one of them.

    Patterns go together in lists; all lists and a share of the users meet by an equi-join.
    """
    lists = max(1, -(-patterns.count() // at_once))
    spread = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = patterns.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(lists)).alias("_list")).agg(F.collect_list("pattern").alias("_patterns"))
    dealt = dealt.select("_patterns", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_share"))
    shared = users.select("user_id", "login", F.pmod(F.xxhash64("user_id"), F.lit(spread)).cast("int").alias("_share"))
    met = shared.hint("merge").join(dealt, "_share")
    hits = F.filter("_patterns", lambda pattern: F.rlike(F.col("login"), F.concat(F.lit("(?i)"), pattern)))
    return met.select(F.explode(hits).alias("pattern"), "user_id", "login")
