"""Ranks against a plain propagation over listed edges."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from chatlens.operators import graph


def propagate(ids, edges, tolerance=0.001):
    out = Counter(src for src, _ in edges)
    rank = dict.fromkeys(ids, 0.15)
    change = dict(rank)
    while True:
        received = defaultdict(float)
        for src, dst in edges:
            if change.get(src, 0) > tolerance:
                received[dst] += change[src] / out[src]
        if not received:
            break
        change = {v: 0.85 * message for v, message in received.items()}
        for v, delta in change.items():
            rank[v] += delta
    total = sum(rank.values())
    return {v: value * len(ids) / total for v, value in rank.items()}


def frames(spark, ids, chats):
    users = spark.createDataFrame([(f"u{i}", i, f"n{i}") for i in ids], "user_id string, user_num_id long, login string")
    rows = [(f"u{i}", chat) for chat, members in chats.items() for i in members]
    return users, spark.createDataFrame(rows, "user_id string, chat_id string")


@pytest.fixture(scope="module")
def world():
    rng = random.Random(2)
    ids = list(range(40))
    chats = {"hot": rng.sample(ids, 30)}
    for i in range(8):
        chats[f"c{i}"] = rng.sample(ids[:36], rng.randrange(1, 6))
    edges = [pair for members in chats.values() for pair in combinations(sorted(members), 2)]
    return ids, chats, edges


@pytest.mark.parametrize("pieces", [12, None])
def test_edges_in_factored_form(spark, world, pieces):
    ids, chats, edges = world
    got = graph.co_membership_edges(graph.graph_membership(*frames(spark, ids, chats)), pieces).collect()
    for row in got:
        members = chats[row.chat_id]
        assert row.out_edges == sum(m > row.id for m in members) and row.in_edges == sum(m < row.id for m in members)
    assert sum(r.out_edges for r in got) == len(edges) and len(got) == sum(map(len, chats.values()))


@pytest.mark.parametrize("pieces", [12, None])
def test_ranks_equal_a_propagation_over_listed_edges(spark, world, pieces):
    ids, chats, edges = world
    forward, backward = propagate(ids, edges), propagate(ids, [(b, a) for a, b in edges])
    got = graph.page_ranks(*frames(spark, ids, chats), pieces=pieces).collect()
    assert len(got) == len(ids)
    for row in got:
        assert row.rank_forward == pytest.approx(forward[row.user_num_id], abs=1e-9)
        assert row.rank_reversed == pytest.approx(backward[row.user_num_id], abs=1e-9)
        assert row.page_rank == pytest.approx((row.rank_forward + row.rank_reversed) / 2)
    assert sum(row.page_rank for row in got) == pytest.approx(len(ids))


def test_edges_of_some_users(spark, world):
    ids, chats, _ = world
    want = {
        (*sorted((i, other)), chat) for chat, members in chats.items() for i in (1, 5) if i in members for other in members if other != i
    }
    members = graph.graph_membership(*frames(spark, ids, chats))
    got = graph.edges_of(members, spark.createDataFrame([(1,), (5,)], "id long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_one_direct_chat_ranks_both_alike(spark):
    got = graph.page_ranks(*frames(spark, [1, 2], {"c": [1, 2]})).collect()
    assert {round(row.page_rank, 9) for row in got} == {1.0}


def test_sample_property_graph(spark):
    known = spark.createDataFrame(
        [(3, "rxin", "student"), (7, "jgonzal", "postdoc"), (5, "franklin", "prof"), (2, "istoica", "prof")],
        "id long, name string, role string",
    )
    edges = spark.createDataFrame(
        [(3, 7, "collab"), (5, 3, "advisor"), (2, 5, "colleague"), (5, 7, "pi"), (5, 0, "friend")],
        "src long, dst long, relation string",
    )
    everyone = graph.default_vertices(edges, known, {"name": "John Doe", "role": "Missing"})
    assert {(r.id, r.name) for r in everyone.collect()} - {(r.id, r.name) for r in known.collect()} == {(0, "John Doe")}
    facts = {r.fact for r in graph.triplets(edges, everyone, "name", "relation").collect()}
    assert facts == {
        "rxin is the collab of jgonzal",
        "franklin is the advisor of rxin",
        "istoica is the colleague of franklin",
        "franklin is the pi of jgonzal",
        "franklin is the friend of John Doe",
    }
    assert graph.count_vertices(everyone, everyone.role == "postdoc").first()[0] == 1
    assert graph.count_descending_edges(edges).first()[0] == 2


def test_rank_join_keeps_vertices_of_the_first(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, rank double")
    other = spark.createDataFrame([(1, 4.0), (3, 9.0)], "id long, rank double")
    assert {tuple(r) for r in graph.rank_join(one, other).collect()} == {(1, 3.0), (2, 4.0)}
