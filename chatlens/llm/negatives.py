"""Operator 12: hard negatives by exact integer scores from a residue number system.

Component matrices are taken modulo a few small primes and multiplied in float32, where every
partial sum stays below 2**24 and is exact. Chinese remaindering puts the residues together to the signed
score; the number of primes follows from the longest vectors. Windows over the scores select.

Vectors lie in blocks of one bucket of labels. Anchors are sent to the blocks: for their positives to those of
their own bucket, for their negatives to all. A task holds one block and lets the anchors pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import Scratch, finite, matrix

# Fixed values of the mining task.
SCALE = 256
EVERY, TURNED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LEAST_SHARE, MOST_SHARE = 80, 100

# Components added up before a residue is taken again; with residues of at most 255 (primes to 511) sums
# stay below 2**24.
RUN = 256
LARGEST = 511
# Numbers in the matrix of a block, and scores held at a time.
BLOCK_CELLS = 1 << 22
SCORE_CELLS = 1 << 21
BUCKETS = 64


def primes_for(bound: int) -> list[int]:
    """Largest primes up to ``LARGEST`` whose product exceeds 2 * bound."""
    sieve = [p for p in range(3, LARGEST + 1) if all(p % d for d in range(2, int(p**0.5) + 1))]
    found, product = [], 1
    while product <= 2 * bound:
        found.append(sieve.pop())
        product *= found[-1]
    return found


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Whole numbers modulo each prime, as float32 between -(p - 1) / 2 and (p - 1) / 2."""
    out = []
    for p in primes:
        rest = np.fmod(rows, p)
        rest[rest > p // 2] -= p
        rest[rest < -(p // 2)] += p
        out.append(rest.astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> list[np.ndarray]:
    """Residues of left @ right.T as whole numbers from 0 to p - 1."""
    out = []
    for a, b, p in zip(left, right, primes, strict=True):
        total = np.zeros((len(a), len(b)), np.int32)
        for low in range(0, a.shape[1], RUN):
            total += (a[:, low : low + RUN] @ b[:, low : low + RUN].T).astype(np.int32) % p
        out.append(total % p)
    return out


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these residues, by mixed radices; the product of the primes bounds them.

    Digits are found one prime after another and stay small; the sum is taken in 64 bits, where wrapping
    does no harm as the signed result fits.
    """
    product = 1
    for p in primes:
        product *= p
    digits: list[np.ndarray] = []
    for at, p in enumerate(primes):
        digit, base = parts[at].astype(np.int64), 1
        for earlier, q in zip(digits, primes, strict=False):
            digit = (digit - earlier * base) % p
            base = base * q % p
        digits.append(digit * pow(base, -1, p) % p)
    value, weight = np.zeros(parts[0].shape, np.uint64), 1
    for digit, p in zip(digits, primes, strict=True):
        value += digit.astype(np.uint64) * np.uint64(weight % 2**64)
        weight *= p
    # Above half of the product lie the negative numbers: compare digit by digit with the half.
    half, above = (product - 1) // 2, np.zeros(parts[0].shape, bool)
    level = np.ones(parts[0].shape, bool)
    half_digits = []
    for p in primes:
        half_digits.append(half % p)
        half //= p
    for digit, limit in zip(reversed(digits), reversed(half_digits), strict=True):
        above |= level & (digit > limit)
        level &= digit == limit
    value[above] -= np.uint64(product % 2**64)
    return value.view(np.int64)


def exact_scores(left: np.ndarray, right: np.ndarray, primes: list[int]) -> np.ndarray:
    return reconstruct(products(residues(left, primes), residues(right, primes), primes), primes)


def labelled_vectors(vectors: DataFrame, scale: int = SCALE, turned: int = TURNED, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, v): usable rows with whole components; every ``turned``-th id gets the next label."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % turned == 0, (label + 1) % labels).otherwise(label)
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))


def _met(anchors: DataFrame, blocks: DataFrame, width: int, primes: list[int], pick, schema: str, extra: list[str]) -> DataFrame:
    """Run ``pick`` on every block with its anchors: anchors (block, vec_id, label, v, *extra), blocks (block, vec_id, label, v).

    ``pick(scores, same, ids, rest)`` gets a matrix of scores, whether labels and ids are equal, the ids of the
    block in rising order, and the anchors as an Arrow batch; it returns a row number of the anchors, one
    of the block, and columns.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def meet(batches):
        block, held, ready = None, [], None

        def prepare():
            table = pa.Table.from_batches(held)
            rows = matrix(table.column("v"), width)
            return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), residues(rows, primes)

        for batch in batches:
            codes, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            kind = codes * 2 + sides
            cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1), len(kind)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if codes[low] != block:
                    block, held, ready = codes[low], [], None
                if sides[low] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                ready = ready or prepare()
                ids, labels, right = ready
                step = max(1, SCORE_CELLS // len(ids))
                for start in range(0, part.num_rows, step):
                    asked = part.slice(start, step)
                    own, own_label = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
                    left = residues(matrix(asked.column("v"), width), primes)
                    scores = reconstruct(products(left, right, primes), primes)
                    same_label, same_id = own_label[:, None] == labels, own[:, None] == ids
                    a, b, more = pick(scores, same_label, same_id, asked)
                    columns = [pa.array(own[a]), pa.array(ids[b]), pa.array(scores[a, b]), *more]
                    yield pa.RecordBatch.from_arrays(columns, names)

    empty = [F.lit(None).cast(dict(anchors.dtypes)[name]).alias(name) for name in extra]
    rows = blocks.select("block", F.lit(0).alias("side"), "vec_id", "label", "v", *empty).unionByName(
        anchors.select("block", F.lit(1).alias("side"), "vec_id", "label", "v", *extra)
    )
    dealt = rows.repartition("block").sortWithinPartitions("block", "side", "vec_id")
    return dealt.mapInArrow(meet, schema)


def _first(mask: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` places with the highest scores inside the mask, ties to the earlier place."""
    found_a, found_b = [], []
    for at in range(len(scores)):
        place = np.flatnonzero(mask[at])
        if len(place) > k:
            value = scores[at, place]
            least = np.partition(value, len(value) - k)[len(value) - k]
            place = place[value >= least]
        place = place[np.argsort(-scores[at, place], kind="stable")][:k]
        found_a.append(np.full(len(place), at))
        found_b.append(place)
    return np.concatenate(found_a), np.concatenate(found_b)


def _ranked(found: DataFrame, keys: list[str], score: str, item: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _length(column: str) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST_SHARE,
    most: int = MOST_SHARE,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    ``vectors`` and ``anchors``: (vec_id, label, v) with whole components and no nulls. An anchor's positives are its
    best rows of the same label; for each, the best rows of other labels follow whose score is between ``least`` and
    ``most`` percent of the positive's. Ties go to the smaller vec_id. Rows with the anchor's own id are neither.
    Rows that repeat an id count each; an anchor that repeats one is asked once, with its smallest label and vector.
    Missing components of shorter vectors are zero. Anchors without positives, and positives without
    negatives in their range, give no rows; so do empty tables. Scores beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.table(vectors.select("vec_id", "label", "v"), "vectors")
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own"))
    asked = scratch.table(asked.select("vec_id", "own.label", "own.v"), "anchors")
    shape = [F.max(F.size("v")).alias("width"), F.max(_length("v")).alias("length"), F.count(F.lit(1)).alias("n")]
    one, two = vectors.agg(*shape).first(), asked.agg(*shape).first()
    width = max(one["width"] or 0, two["width"] or 0, 1)
    bound = int((one["length"] or 0.0) * (two["length"] or 0.0) * 1.000001) + 1
    if bound >= 2**63:
        raise ValueError("scores of these vectors do not fit 64 bits")
    primes = primes_for(bound)

    # Buckets of labels, each cut into blocks of about equal size: at most BUCKETS rows come here.
    per_block = max(1, block_cells // width)
    kinds = vectors.agg(F.approx_count_distinct("label").alias("n")).first()["n"]
    buckets = max(1, min(BUCKETS, kinds))
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")
    sizes = {row["b"]: row["n"] for row in vectors.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = [max(1, -(-sizes.get(b, 0) // per_block)) for b in range(buckets)]
    first = [sum(salts[:b]) for b in range(buckets)]
    starts, widths = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (first, salts))
    # Copies of one vector have ids of their own; rows that repeat an id differ in the second number at most.
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.get(widths, bucket))
    blocks = scratch.table(vectors.select((F.get(starts, bucket) + spread).alias("block"), "vec_id", "label", "v"), "blocks")

    def own_blocks(frame: DataFrame) -> DataFrame:
        ends = F.get(starts, bucket) + F.get(widths, bucket) - 1
        return frame.withColumn("block", F.explode(F.sequence(F.get(starts, bucket), ends)))

    def positive(scores, same_label, same_id, batch):
        a, b = _first(same_label & ~same_id, scores, positives)
        return a, b, []

    best = _met(own_blocks(asked), blocks, width, primes, positive, "anchor_id long, positive_id long, positive_score long", [])
    best = _ranked(best, ["anchor_id"], "positive_score", "positive_id", positives)
    best = scratch.table(best.withColumnRenamed("rank", "positive_rank"), "positives")
    listed = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list("positive_rank")).alias("ranks"), F.sort_array(
        F.collect_list("positive_score"), asc=False).alias("tops"))  # at most ``positives`` of each
    wanted = asked.join(listed.withColumnRenamed("anchor_id", "vec_id").hint("merge"), "vec_id")
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sum(salts) - 1).cast("long"))))

    def negative(scores, same_label, same_id, batch):
        ranks, tops = batch.column("ranks").to_pylist(), batch.column("tops").to_pylist()
        rows, places, rank_of, top_of = [], [], [], []
        for at in range(len(scores)):
            other = np.flatnonzero(~(same_label[at] | same_id[at]))
            value = scores[at, other]
            # Whole numbers of any size: Python's own floor division.
            spans = [(-(-least * top // 100), most * top // 100) for top in tops[at]]
            inside = (value >= min(low for low, _ in spans)) & (value <= max(high for _, high in spans))
            other, value = other[inside], value[inside]
            order = np.argsort(-value, kind="stable")
            other, value = other[order], value[order]
            for rank, top, (low, high) in zip(ranks[at], tops[at], spans, strict=True):
                begin, end = np.searchsorted(-value, -high, "left"), np.searchsorted(-value, -low, "right")
                taken = other[begin : min(end, begin + negatives)]
                rows.append(np.full(len(taken), at))
                places.append(taken)
                rank_of.append(np.full(len(taken), rank, np.int32))
                top_of.append(np.full(len(taken), top, np.int64))
        more = [pa.array(np.concatenate(rank_of), pa.int32()), pa.array(np.concatenate(top_of), pa.int64())]
        return np.concatenate(rows), np.concatenate(places), more

    schema = "anchor_id long, negative_id long, negative_score long, positive_rank int, positive_score long"
    found = _met(wanted, blocks, width, primes, negative, schema, ["ranks", "tops"])
    found = _ranked(found, ["anchor_id", "positive_rank"], "negative_score", "negative_id", negatives)
    named = best.select("anchor_id", "positive_rank", "positive_id")
    found = found.join(named.hint("merge"), ["anchor_id", "positive_rank"])
    result = scratch.table(found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"
    ), "negatives")
    for path in list(scratch.paths[:-1]):
        scratch.drop(path)
    return result


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM scored WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
