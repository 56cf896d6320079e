"""Operator 4: vectors with a cosine above a bound, joined in epsilon grid order.

Unit vectors with cosine c lie at distance sqrt(2 - 2 c). They are projected on their leading
principal directions, cut into grid cells of that width and sorted by cell. The sorted sequence is
cut into intervals, intervals into smaller ones. Pairs of intervals are split recursively; a pair
whose bounding boxes are farther apart than epsilon is skipped with everything in it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import components, finite, matrix, principal_axes, runs, table

COSINE = 0.98
AXES = 6
BLOCK = 1024
_FAN = 4


def _sequence(groups: DataFrame, axes: np.ndarray, epsilon: float, block: int, count: int) -> DataFrame:
    """Vectors with their projection p and the interval (block) of grid order they lie in."""
    width, dims = axes.shape
    shared = groups.sparkSession.sparkContext.broadcast(axes)
    names = [f"p{at}" for at in range(dims)]

    def project(batches):
        for batch in batches:
            rows = matrix(batch.column("v"), width)
            found = (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ shared.value
            for at, name in enumerate(names):
                batch = batch.append_column(name, pa.array(found[:, at]))
            yield batch

    schema = "label long, size int, v array<double>, node long, weight long, " + ", ".join(f"{name} double" for name in names)
    projected = groups.mapInArrow(project, schema)
    cells = [F.floor(F.col(name) / epsilon) for name in names]
    order = ["label", "size", *cells, "node"]
    tasks = max(1, -(-count // (block * 16)))
    ready = projected.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def cut(batches):
        number, filled, last = -1, 0, None
        base = TaskContext.get().partitionId() << 24
        for batch in batches:
            out = []
            for key in zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if key != last or filled == block:
                    number, filled, last = number + 1, 0, key
                filled += 1
                out.append(base + number)
            yield batch.append_column("block", pa.array(out, pa.int64()))

    return ready.mapInArrow(cut, f"{schema}, block long")


def _near(boxes: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of intervals that may hold near vectors, by splitting pairs of larger ones."""
    top = max(int(boxes.agg(F.max("block")).first()[0] or 0).bit_length(), 1)
    shifts = list(range(0, top + _FAN, _FAN))[::-1]

    def level(shift: int) -> DataFrame:
        bounds = [f(name).alias(name) for at in range(dims) for f, name in ((F.min, f"lo{at}"), (F.max, f"hi{at}"))]
        sides = [F.min("first").alias("first"), F.max("last").alias("last")]
        named = boxes.withColumn("id", F.shiftright("block", shift))
        return named.groupBy("id").agg(*bounds, *sides).withColumn("up", F.shiftright("id", _FAN))

    pairs = None
    for shift in shifts:
        nodes = level(shift)
        left = nodes.select(*[F.col(name).alias(f"a_{name}") for name in nodes.columns])
        right = nodes.select(*[F.col(name).alias(f"b_{name}") for name in nodes.columns])
        if pairs is None:
            both = left.join(right, F.col("a_up") == F.col("b_up"))
        else:
            both = pairs.join(left, F.col("a") == F.col("a_up")).join(right, F.col("b") == F.col("b_up"))
        gaps = [
            F.greatest(F.lit(0.0), F.col(f"a_lo{at}") - F.col(f"b_hi{at}"), F.col(f"b_lo{at}") - F.col(f"a_hi{at}"))
            for at in range(dims)
        ]
        square = sum((gap * gap for gap in gaps), F.lit(0.0))
        # Labels lie in ascending order, so intervals without a common one are apart.
        meet = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
        kept = both.filter((F.col("a_id") <= F.col("b_id")) & meet & (square <= (epsilon + 1e-9) ** 2))
        pairs = kept.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs


def _compare(units: DataFrame, width: int, cosine: float) -> DataFrame:
    """Per unit (two intervals) the links of its vectors: counts (node, n) and pairs (node, other)
    that connect what is linked."""

    def check(batches):
        for unit in runs(batches, "unit"):
            rows = matrix(unit.column("v"), width)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            nodes, weights = unit.column("node").to_numpy(), unit.column("weight").to_numpy()
            keys = list(zip(unit.column("label").to_pylist(), unit.column("size").to_pylist(), strict=True))
            side = unit.column("side").to_numpy()
            same = (side == 2).all()
            left = np.flatnonzero(side != 1)
            right = left if same else np.flatnonzero(side != 0)
            if not len(left) or not len(right) or keys[left[0]] != keys[right[0]]:
                continue
            near = rows[left] @ rows[right].T >= cosine
            if same:
                np.fill_diagonal(near, False)
            out = {"node": [], "n": [], "other": []}

            def add(own, n, other):
                out["node"].append(own)
                out["n"].append(n)
                out["other"].append(other)

            for mine, theirs, hit in ((left, right, near),) if same else ((left, right, near), (right, left, near.T)):
                counts = hit @ weights[theirs]
                for at in np.flatnonzero(counts):
                    add(nodes[mine[at]], counts[at], None)
            parent: dict = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for at in np.flatnonzero(near.any(axis=1)):
                own = nodes[left[at]]
                for other in nodes[right[near[at]]]:
                    a, b = root(own), root(other)
                    if a != b:
                        parent[a] = b
                        add(own, 0, other)
            yield pa.RecordBatch.from_pydict(out, schema=check.schema)

    check.schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(check, "node long, n long, other long")


def embedding_components(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, dims: int = AXES) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors with equal labels and equally many components are compared. A vector that is null,
    zero or holds null or non-finite components, or has no label, links with nothing. Equal vectors
    link; each row that repeats one counts. Without a vec_id a row links with nothing, has no component and is kept.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )
    good = finite("v") & F.exists("v", lambda x: x != 0)
    rows = table(rows.withColumn("ok", good & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    usable = rows.filter("ok").drop("ok")
    groups = usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    groups = table(groups.select("label", F.size("v").alias("size"), "v", "node", "weight"), "distinct")
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("width")).first()
    width = stats["width"] or 1
    dims = min(dims, width)
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    unit = groups.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    axes = principal_axes(unit.select(F.transform("v", lambda x: x / F.col("norm")).alias("u")), "u", width)[:, :dims].copy()
    ordered = table(_sequence(groups, axes, epsilon, block, stats["n"]), "sequence")
    bounds = [f(f"p{at}").alias(f"{name}{at}") for at in range(dims) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = table(ordered.groupBy("block").agg(*bounds, F.min("label").alias("first"), F.max("label").alias("last")), "boxes")
    pairs = table(_near(boxes, dims, epsilon), "pairs")
    side = F.when(F.col("a") == F.col("b"), 2)
    named = pairs.select(F.concat_ws("/", "a", "b").alias("unit"), "a", "b")
    ends = named.select("unit", F.col("a").alias("block"), F.coalesce(side, F.lit(0)).alias("side")).unionByName(
        named.filter("a <> b").select("unit", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    found = table(_compare(ends.join(ordered.select("block", "node", "label", "size", "v", "weight"), "block"), width, cosine), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = groups.join(counts, "node", "left").join(joined, "node", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    linked = usable.join(groups, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
  SELECT * FROM v WHERE v IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.vec_id, (SELECT count(*) FROM links l WHERE l.a = n.vec_id) AS n_links, component_id, n.vec_id = component_id AS kept
FROM named n
"""
