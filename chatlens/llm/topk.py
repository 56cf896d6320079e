"""Operator 1: exact top-k by inner product.

Candidates lie in blocks of descending length. Vectors are rotated onto the singular directions of
all candidates, so the first coordinates of a product carry most of it; what the others can still
add is bounded by Cauchy-Schwarz with the lengths of the remaining parts. A pair is dropped as soon as
that bound is below the k-th score its query has already. Survivors are scored in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import finite, matrix, principal_axes, runs, table

K = 20
EVERY = 20
SCALE = 64
BLOCK = 8192
QUERIES = 2048
BANDS = 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector with an id."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = usable.filter(F.col("vec_id").isNotNull() & finite("embedding"))
    return usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def best_in_block(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, floor: np.ndarray, axes: np.ndarray, k: int):
    """Top k of every query within one block: (query row, candidate row, score) arrays.

    ``floor`` holds for every query a score that its k-th result reaches anyway. q and c are
    integer valued; own and ids are the queries' and candidates' ids.
    """
    width = axes.shape[0]
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c, ids, place = c[order], ids[order], order
    rq, rc = q @ axes, c @ axes
    cuts = sorted({max(1, width // 2), max(1, 3 * width // 4)})
    rest_q = [np.sqrt(np.einsum("ij,ij->i", rq[:, at:], rq[:, at:])) for at in [0, *cuts]]
    rest_c = [np.sqrt(np.einsum("ij,ij->i", rc[:, at:], rc[:, at:])) for at in [0, *cuts]]
    floor = floor.astype(np.float64).copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    for low in range(0, len(c), 1024):
        high = min(low + 1024, len(c))
        # Rounding of the rotation is far below this.
        slack = 1e-6 * (1 + rest_q[0] * rest_c[0][low])
        open_ = np.flatnonzero(rest_q[0] * rest_c[0][low] + slack >= floor)
        if not len(open_):
            break
        for part in np.array_split(open_, max(1, len(open_) // 512)):
            sums = rq[part, : cuts[0]] @ rc[low:high, : cuts[0]].T
            a, b = np.nonzero(sums + np.outer(rest_q[1][part], rest_c[1][low:high]) + slack[part, None] >= floor[part, None])
            if len(cuts) > 1 and len(a):
                more = sums[a, b] + np.einsum("ij,ij->i", rq[part[a], cuts[0] : cuts[1]], rc[low + b, cuts[0] : cuts[1]])
                alive = more + rest_q[2][part[a]] * rest_c[2][low + b] + slack[part[a]] >= floor[part[a]]
                a, b = a[alive], b[alive]
            a, b = part[a], low + b
            keep = own[a] != ids[b]
            a, b = a[keep], b[keep]
            score = np.einsum("ij,ij->i", q[a].astype(np.int64), c[b].astype(np.int64))
            bounds = np.searchsorted(a, np.arange(len(q) + 1))
            for query in np.unique(a):
                span = slice(bounds[query], bounds[query + 1])
                row = np.concatenate([best[query][0], b[span]])
                value = np.concatenate([best[query][1], score[span]])
                top = np.lexsort((ids[row], -value))[:k]
                best[query] = row[top], value[top]
                if len(top) == k:
                    floor[query] = max(floor[query], value[top[-1]])
    count = [len(row) for row, _ in best]
    queries = np.repeat(np.arange(len(q)), count)
    rows = np.concatenate([row for row, _ in best]) if best else np.zeros(0, np.int64)
    return queries, place[rows], np.concatenate([value for _, value in best]) if best else rows


def _scored(queries: DataFrame, candidates: DataFrame, axes: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of units: queries (unit, vec_id, v, floor), candidates (unit, vec_id, v)."""
    width = len(axes)
    shared = queries.sparkSession.sparkContext.broadcast(axes)

    def score(batches):
        for unit in runs(batches, "unit"):
            side = unit.column("floor").is_valid().to_numpy()
            ids, all_rows = unit.column("vec_id").to_numpy(), matrix(unit.column("v"), width)
            floor = unit.column("floor").to_numpy()[side]
            if not len(floor) or side.all():
                continue
            a, b, value = best_in_block(all_rows[side], all_rows[~side], ids[side], ids[~side], floor, shared.value, k)
            yield pa.RecordBatch.from_pydict({"query_id": ids[side][a], "vec_id": ids[~side][b], "score": value})

    rows = queries.select("unit", "vec_id", "v", "floor").unionByName(
        candidates.select("unit", "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    )
    dealt = rows.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(score, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, chunk: int = QUERIES) -> DataFrame:
    """Per query its k highest inner products among ``vectors``: query_id, rank, vec_id, score.

    Both frames are (vec_id, v) with integer valued components. Ties go to the smaller vec_id; the
    query's own id is no result. Missing components of shorter vectors count as zero. An id that
    repeats among the queries is asked once, with its smallest vector; among the candidates every
    row counts. Fewer than k candidates give fewer rows, empty tables none.
    """
    vectors = table(vectors.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), "candidates")
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    asked = table(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_asked = asked.count()
    width = max(stats["width"] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    axes = principal_axes(vectors, "v", width)
    bands = max(1, min(BANDS, stats["n"] // block))
    salts = max(1, -(-stats["n"] // (bands * block)))
    # Bands of length, longest first, from at most 63 quantiles.
    cuts = []
    if bands > 1:
        cuts = vectors.agg(F.percentile_approx("length2", [i / bands for i in range(1, bands)], 10_000)).first()[0]
    band = sum([(F.col("length2") < F.lit(float(cut))).cast("int") for cut in cuts], F.lit(0))
    blocks = vectors.select("vec_id", "v", "length2", band.alias("band"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"))
    longest = {row["band"]: row["m"] for row in blocks.groupBy("band").agg(F.max("length2").alias("m")).collect()}
    chunks = max(1, -(-n_asked // chunk))
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int").alias("i"))

    def units(part: DataFrame) -> DataFrame:
        spread = part.select("vec_id", "v", "band", "salt", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("i"))
        return spread.withColumn("unit", F.concat_ws("/", "i", "band", "salt"))

    head = (F.col("band") == 0) & (F.col("salt") == 0)
    first_band = min(longest, default=0)
    head = (F.col("band") == first_band) & (F.col("salt") == 0)
    start = asked.withColumn("floor", F.lit(float("-inf"))).withColumn("unit", F.concat_ws("/", "i", F.lit(first_band), F.lit(0)))
    first = table(_scored(start, units(blocks.filter(head)), axes, k), "first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m"))
    floors = floors.filter(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), F.col("m").cast("double").alias("floor"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    reach = F.array(*[
        F.when(F.coalesce("floor", F.lit(float("-inf"))) <= length * float(np.sqrt(most)) + 1e-6 * (1 + most), F.lit(at))
        for at, most in sorted(longest.items())
    ]) if longest else F.array().cast("array<int>")
    later = asked.join(floors, "vec_id", "left").select("vec_id", "v", "i", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"),
                                                         F.explode(F.array_compact(reach)).alias("band"))
    later = later.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).filter(~head)
    later = later.withColumn("unit", F.concat_ws("/", "i", "band", "salt"))
    rest = _scored(later, units(blocks.filter(~head)), axes, k)
    ranked = _ranked(first.unionByName(rest), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
