"""The graph of users who share chats, and their rank in it.

Two users of a chat are joined by an edge from the smaller to the larger number, one edge per
shared chat. A chat of m members has m(m-1)/2 edges, so edges are never listed: a member's
edges in a chat lead to exactly the members after it, and whatever flows along them is a
running sum over the chat's members in number order. Work grows with memberships, not pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chatlens.plans import digest, discard, materialize, materialize_dealt, ranged, scratch_path

TOLERANCE = 0.001  # fixed value: smaller changes of a rank are not passed on
RESET = 0.15  # fixed value: rank every vertex starts from
ROWS_PER_BUCKET = 2_000_000  # memberships that one task passes ranks along


def vertices(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_num_id").alias("id"), "user_id")


def graph_membership(users: DataFrame, users_chats: DataFrame) -> DataFrame:
    """Distinct (chat_id, id) with the users' numbers as ids."""
    ids = users.select("user_id", F.col("user_num_id").alias("id"))
    return users_chats.select("user_id", "chat_id").join(ids, "user_id").select("chat_id", "id").distinct()


def co_membership_edges(members: DataFrame, pieces: int | None = None) -> DataFrame:
    """The edges, one row per member and chat: how many lead from and to the member there.

    Edges of a row lead to the ``out_edges`` members with the next larger numbers.
    """
    return _placed_edges(ranged(members, ["chat_id"], ["id"], pieces)).drop("block", "mark")


def _placed_edges(blocked: DataFrame, buckets: int | None = None) -> DataFrame:
    """The same of members in ranges, dealt by ``mark``, a digest of chat and range; with ``block``, the part of its chat
    a row lies in; null in chats that lie in one part."""
    spark = blocked.sparkSession
    # Only chats on a bound lie in several ranges. They are written first, so the planner knows how few they are.
    counts = blocked.filter("chat_id is not null").groupBy("chat_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    of_chat = Window.partitionBy(digest("chat_id"), "chat_id").orderBy("_block")
    whole = of_chat.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = counts.select(
        "chat_id",
        "_block",
        F.sum("_n").over(of_chat.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
        F.count("_n").over(whole).alias("_parts"),
    )
    cut = materialize(cut.filter("_parts > 1").drop("_parts"), scratch_path(spark, "cut"))
    marked = blocked.filter("chat_id is not null").withColumn("mark", digest("chat_id", "_block"))
    dealt = marked.repartition(buckets, "mark") if buckets else marked
    inside = Window.partitionBy("mark", "chat_id", "_block").orderBy("id")
    placed = dealt.select(
        "*",
        F.row_number().over(inside).alias("_place"),
        F.count(F.lit(1)).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_own"),
    )
    place = F.col("_place") + F.coalesce("_before", F.lit(0))
    return placed.join(cut, ["chat_id", "_block"], "left").select(
        "mark",
        "chat_id",
        F.when(F.col("_size").isNotNull(), F.col("_block")).alias("block"),
        "id",
        (F.coalesce("_size", "_own") - place).alias("out_edges"),
        (place - 1).alias("in_edges"),
    )


def edges_of(members: DataFrame, who: DataFrame) -> DataFrame:
    """The edges that touch the given vertices (id), listed as (src, dst, chat_id).

    The result has one row per vertex asked for and fellow member, so ask for some vertices,
    not for all.
    """
    asked = who.select("id").distinct().join(members.select("id", "chat_id"), "id")
    other = members.select("chat_id", F.col("id").alias("_other"))
    pairs = asked.join(other, "chat_id").filter(F.col("id") != F.col("_other"))
    return pairs.select(
        F.least("id", "_other").alias("src"), F.greatest("id", "_other").alias("dst"), "chat_id"
    ).distinct()


def _superstep(members: DataFrame, state: DataFrame, tolerance: float, chained: bool) -> DataFrame:
    """Pass changes above the tolerance along all edges, in both directions at once.

    ``chained`` says whether any chat is cut into blocks. Members lie by ``mark``, a digest of chat and range, so
    they are neither shuffled nor put in order again where what is passed on fits a broadcast.
    """
    sent = members.join(
        state.selectExpr(
            "id",
            f"if(change > {tolerance}D and out_degree > 0, change / out_degree, 0D) as down",
            f"if(change_rev > {tolerance}D and in_degree > 0, change_rev / in_degree, 0D) as up",
        ),
        "id",
    )
    block = "over (partition by mark, chat_id, block order by id rows between unbounded preceding and"
    received = sent.selectExpr(
        "chat_id",
        "block",
        "id",
        f"sum(down) {block} current row) - down as down",
        f"sum(up) {block} unbounded following) - sum(up) {block} current row) as up",
    )
    if chained:
        totals = sent.filter("block is not null").groupBy("chat_id", "block").agg(
            F.sum("down").alias("down"), F.sum("up").alias("up")
        )
        other = "rows between unbounded preceding and 1 preceding"
        carried = totals.selectExpr(
            "chat_id as _chat",
            "block as _block",
            f"sum(down) over (partition by chat_id order by block {other}) as _down",
            f"sum(up) over (partition by chat_id order by block desc {other}) as _up",
        )
        # What the parts before and after pass on is added to the members of cut chats alone.
        further = members.filter("block is not null").join(carried, F.expr("chat_id = _chat and block = _block"))
        received = received.select("id", "down", "up").unionByName(
            further.selectExpr("id", "coalesce(_down, 0D) as down", "coalesce(_up, 0D) as up")
        )
    received = received.groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    kept = 1.0 - RESET
    return state.drop("change", "change_rev").join(received, "id", "left").selectExpr(
        "id",
        "out_degree",
        "in_degree",
        f"rank + {kept}D * coalesce(down, 0D) as rank",
        f"{kept}D * coalesce(down, 0D) as change",
        f"rank_rev + {kept}D * coalesce(up, 0D) as rank_rev",
        f"{kept}D * coalesce(up, 0D) as change_rev",
    )


def page_ranks(
    users: DataFrame,
    users_chats: DataFrame,
    tolerance: float = TOLERANCE,
    pieces: int | None = None,
) -> DataFrame:
    """Rank of every user along the edges, against them, and the mean of both.

    Each user starts with RESET and passes the share 1 - RESET of every change of its rank on,
    split evenly over its edges, until all changes are within the tolerance. Ranks are scaled
    to add up to the number of users. Every step is written to the shared folder, so a step
    that has to be repeated starts from the last table and not from the sources.
    """
    spark = users.sparkSession
    root = scratch_path(spark, "ranks")
    cut = Observation()
    blocked = ranged(graph_membership(users, users_chats), ["chat_id"], ["id"], pieces)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocked.count() // ROWS_PER_BUCKET + 1)
    edges, name = materialize_dealt(
        _placed_edges(blocked, buckets),
        f"{root}/edges",
        buckets,
        ["mark"],
        ["mark", "chat_id", "block", "id"],
        cut,
        F.count("block").alias("rows"),
    )
    members = edges.select("mark", "chat_id", "block", "id")
    degrees = edges.groupBy("id").agg(F.sum("out_edges").alias("out_degree"), F.sum("in_edges").alias("in_degree"))
    state = vertices(users).select("id").join(degrees, "id", "left").selectExpr(
        "id",
        "coalesce(out_degree, 0) as out_degree",
        "coalesce(in_degree, 0) as in_degree",
        *[f"{RESET}D as {name}" for name in ("rank", "change", "rank_rev", "change_rev")],
    )
    # Written before the first step, so that the planner knows its size in every step.
    state = materialize(state, f"{root}/start")
    moving = f"(change > {tolerance}D and out_degree > 0) or (change_rev > {tolerance}D and in_degree > 0)"
    # What is passed on shrinks by RESET in every step, so the loop ends.
    for step in count():
        seen = Observation()
        state = materialize(
            _superstep(members, state, tolerance, chained=cut.get["rows"] > 0),
            f"{root}/step-{step}",
            seen,
            F.expr("count(1) as users"),
            F.expr("sum(rank) as total"),
            F.expr("sum(rank_rev) as total_rev"),
            F.expr(f"count_if({moving}) as moving"),
        )
        if step:
            discard(spark, f"{root}/step-{step - 1}")
        if not seen.get["moving"]:
            break
    spark.sql(f"DROP TABLE {name}")
    discard(spark, f"{root}/edges")
    figures = seen.get
    scale, scale_rev = (
        figures["users"] / figures[name] if figures["users"] else 1.0 for name in ("total", "total_rev")
    )
    forward, backward = F.col("rank") * F.lit(scale), F.col("rank_rev") * F.lit(scale_rev)
    return state.select(
        F.col("id").alias("user_num_id"),
        forward.alias("rank_forward"),
        backward.alias("rank_reversed"),
        ((forward + backward) / 2).alias("page_rank"),
    )


# --- property graphs ------------------------------------------------------------------


def default_vertices(edges: DataFrame, known: DataFrame, default: dict[str, str]) -> DataFrame:
    """All vertices of a graph: the known ones, and edge ends without an entry under default
    attributes. ``default`` names every attribute column."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    unknown = ends.join(known.select("id"), "id", "left_anti")
    return known.select("id", *default).unionByName(
        unknown.select("id", *[F.lit(value).alias(name) for name, value in default.items()])
    )


def triplets(edges: DataFrame, known: DataFrame, name: str, relation: str) -> DataFrame:
    """Each edge as a sentence: source, relation, target."""
    source = known.select(F.col("id").alias("src"), F.col(name).alias("_from"))
    target = known.select(F.col("id").alias("dst"), F.col(name).alias("_to"))
    return edges.join(source, "src").join(target, "dst").select(
        "src",
        "dst",
        F.concat(F.col("_from"), F.lit(" is the "), F.col(relation), F.lit(" of "), F.col("_to")).alias("fact"),
    )


def count_vertices(known: DataFrame, condition: Column) -> DataFrame:
    return known.agg(F.count_if(condition).alias("vertices"))


def count_descending_edges(edges: DataFrame) -> DataFrame:
    """Number of edges that lead from a larger to a smaller id."""
    return edges.agg(F.count_if(F.col("src") > F.col("dst")).alias("edges"))


def rank_join(forward: DataFrame, backward: DataFrame, columns: Sequence[str] = ("rank", "rank")) -> DataFrame:
    """Mean of two rank tables (id, rank) per vertex of the first; one missing from the second
    keeps its rank."""
    ours = forward.select("id", F.col(columns[0]).alias("_one"))
    other = backward.select("id", F.col(columns[1]).alias("_other"))
    mean = (F.col("_one") + F.col("_other")) / 2
    return ours.join(other, "id", "left").select("id", F.coalesce(mean, F.col("_one")).alias("rank"))
