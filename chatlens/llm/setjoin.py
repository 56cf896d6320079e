"""Exact verification of set similarity inside buckets of candidates, without listing pairs.

A bucket is any set of nodes among which similar ones must be found. First every node is
compared with the smallest node of each of its buckets; that joins nearly all copies. Only
buckets whose other nodes are then still in different components are opened: the nodes outside the
component of the bucket's head are compared with all nodes of other components but the head, which
they have met. Buckets above a bound are cut into chunks for this, so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import Scratch, components, runs, shared_count, slices

Sets = Callable[[list], list]
# Elements of the sets of one side of an opened unit.
CHUNK = 2_000_000
# Pairs compared at once, and cells of a matrix of sets and elements (4 bytes each).
PAIRS, CELLS = 1 << 21, 1 << 22


def similar(common, size_a, size_b, percent: int):
    """100 * intersection >= percent * union, in integers."""
    return 100 * common >= percent * (size_a + size_b - common)


def spanning_links(sets: list[np.ndarray], left: np.ndarray, percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that join everything connected by (left, any) pairs; no link is left out
    unless its ends are joined already.

    ``left`` marks the sets to be compared with all others, ``joined`` has equal numbers for sets that are joined
    from the beginning. Sizes rule pairs out first. Overlaps come from one product of the matrix of sets and shared
    elements where that is small and not much work; else postings of shared elements give the overlaps of one
    set with all others at once. The union of the others bounds them before.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    parent = np.arange(len(sets)) if joined is None else joined.copy()
    nodes = np.flatnonzero(left)
    few = len(nodes) * len(sets) <= PAIRS
    if few:
        own = sizes[nodes, None]
        fits = 100 * np.minimum(own, sizes) >= percent * np.maximum(own, sizes)
        nodes = nodes[(fits & (parent[nodes, None] != parent)).any(axis=1)]
    if not len(nodes):
        return []
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [len(values)]]))
    group = np.empty(len(values), np.int64)
    group[order] = np.repeat(np.arange(len(first)), length)
    kept = length[group] > 1
    groups_of = group[kept]
    bounds = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
    rank = np.cumsum(length > 1) - 1
    wide = int(rank[-1]) + 1 if len(rank) else 0
    marks = None
    if few and len(sets) * wide <= CELLS and len(nodes) * len(sets) * wide <= 64 * int(length[groups_of].sum()):
        marks = np.zeros((len(sets), wide), np.float32)
        marks[owner[kept], rank[groups_of]] = 1
        overlaps = (marks[nodes] @ marks.T).astype(np.int64)
    else:
        owner = owner[order]
    links = []
    for at, node in enumerate(nodes):
        own = groups_of[bounds[node] : bounds[node + 1]]
        # Elements that the union of all other sets has too.
        if 100 * len(own) < percent * sizes[node] or (parent == parent[node]).all():
            continue
        if marks is None:
            spans = length[own]
            places = np.repeat(first[own] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(int(spans.sum()))
            common = np.bincount(owner[places], minlength=len(sets))
        else:
            common = overlaps[at]
        others = np.flatnonzero(similar(common, sizes[node], sizes, percent) & (common > 0) & (parent != parent[node]))
        while len(others):
            parent[parent == parent[others[0]]] = parent[node]
            links.append((int(node), int(others[0])))
            others = others[parent[others] != parent[node]]
    return links


def star_links(pairs: DataFrame, texts: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar."""
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(other, "b")

    def check(batches):
        held, held_set = None, None
        for batch in batches:
            texts, heads = batch.column("text").to_pylist(), batch.column("text_b").to_pylist()
            keep = []
            # Sets of a bounded stretch of text at a time.
            for low, high in slices(texts, 1 << 18):
                for own, head in zip(sets_of(texts[low:high]), heads[low:high], strict=True):
                    if head != held:
                        held, held_set = head, sets_of([head])[0]
                    common = shared_count(own, held_set)
                    keep.append(common > 0 and bool(similar(common, len(own), len(held_set), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text", "text_b").mapInArrow(check, pairs.select("a", "b").schema)


def opened_links(rows: DataFrame, texts: DataFrame, sets_of: Sets, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join what is similar between the left and the right nodes of each bucket.

    ``rows``: (bucket, node, n, left, right), and ``component`` where nodes are joined already; a bucket within one
    component is not opened. Each side is cut into chunks of about ``chunk`` elements, and every left chunk
    meets every right chunk in a unit of its own.
    """
    known = [name for name in ("component",) if name in rows.columns]
    total = lambda side: F.sum(F.when(F.col(side), F.greatest("n", F.lit(1))).otherwise(0))
    apart = (F.min("component") < F.max("component")) if known else F.lit(True)
    sizes = rows.groupBy("bucket").agg(total("left").alias("l"), total("right").alias("r"), apart.alias("apart"))
    cuts = sizes.filter("l > 0 and r > 0 and apart").select(
        "bucket", F.ceil(F.col("l") / chunk).cast("int").alias("lefts"), F.ceil(F.col("r") / chunk).cast("int").alias("rights")
    )
    cut = rows.join(cuts, "bucket")
    mine = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)).cast("int")
    left = cut.filter("left").select(
        "bucket", "node", *known, F.lit(True).alias("left"), (mine % F.col("lefts")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"),
    )
    right = cut.filter("right").select(
        "bucket", "node", *known, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"),
        (mine % F.col("rights")).alias("j"),
    )
    units = left.unionByName(right).select("node", *known, "left", F.concat_ws("/", F.col("bucket").cast("string"), "i", "j").alias("unit"))
    kind = dict(units.dtypes)["node"]

    def check(batches):
        for unit in runs(batches, "unit"):
            nodes = unit.column("node").to_pylist()
            marks = unit.column("left").to_pylist()
            seen: dict = {}
            for at, key in enumerate(zip(nodes, unit.column("text").to_pylist(), strict=True)):
                seen.setdefault(key, []).append(at)
            keys = list(seen)
            texts = [text for _, text in keys]
            sets = [one for low, high in slices(texts, 1 << 20) for one in sets_of(texts[low:high])]
            marked = np.array([any(marks[at] for at in places) for places in seen.values()], bool)
            joined = None
            if known:
                joined = unit.column("component").to_numpy()[[places[0] for places in seen.values()]]
            found = spanning_links(sets, marked, percent, joined)
            del sets
            kinds = unit.schema.field("node").type
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[a][0] for a, _ in found], kinds), pa.array([keys[b][0] for _, b in found], kinds)], ["a", "b"]
            )

    ready = units.join(texts, "node").repartition("unit").sortWithinPartitions("unit")
    return ready.mapInArrow(check, f"a {kind}, b {kind}")


def join_buckets(
    buckets: DataFrame, texts: Callable[[DataFrame], DataFrame], sets_of: Sets, percent: int, chunk: int = CHUNK
) -> DataFrame:
    """(node, component) of nodes with links; others are left out.

    ``buckets``: distinct rows (bucket, node, n) with n the size of the node's set. ``texts``
    gives (node, text) for the nodes of a frame, ``sets_of`` the sets of a list of texts.
    """
    scratch = Scratch(buckets.sparkSession)
    buckets = scratch.table(buckets, "buckets")
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"))
    heads = scratch.table(heads.filter("members > 1"), "heads")
    inside = buckets.join(heads, "bucket")
    pairs = scratch.table(inside.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = scratch.table(texts(nodes), "texts")
    links = scratch.table(star_links(pairs, found, sets_of, percent), "links")
    joined = scratch.table(components(links), "joined")

    own = joined.select(F.col("node"), F.col("component").alias("c"))
    head = joined.select(F.col("node").alias("head"), F.col("component").alias("hc"))
    marked = (
        inside.filter("members > 2 and node <> head").join(own, "node", "left").join(head, "head", "left")
        .select("bucket", "node", "n", F.coalesce("c", "node").alias("component"), F.coalesce("hc", "head").alias("hc"))
    )
    marked = scratch.table(marked, "marked")
    rows = marked.select("bucket", "node", "n", "component", (F.col("component") != F.col("hc")).alias("left"), F.lit(True).alias("right"))
    more = scratch.table(opened_links(rows, found, sets_of, percent, chunk), "opened")
    found = components(links.unionByName(more))
    scratch.clear()
    return found
