"""Operator 6: sources mixed to target weights along a time-varying curriculum.

Each source has a weight schedule over training time; its integral says how many words of the source
have been asked for at any time. The words of a source lie one after the other in an order drawn by a
digest of their documents, once and, where the target is above the source's size, once more. A document's training
position is the time at which the integral reaches its first word, found by inverting it; documents
are range-sorted by position. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import WORD, table

WEIGHTS = (3, 1, 2)
# How the weight of a source changes over training: w(t) = target * (1 + slope * (1 - 2 t)).
SLOPES = (-0.5, 0.5, 0.0)
SHARE = 1.5
REPEATS = 2
# Documents of one source summed up in one task.
RUN = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, docs, target, slope) from (source, source_size, docs): one row per source.

    A target is the weight's share of ``share`` times all words, at most ``repeats`` times the
    source's size; what is cut off is shared out again by weight. In the order of cap by weight the
    sources that are cut come first, so running sums give the common level of all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(value) for value in values]), F.col("turn"))
    rows = sources.withColumn("turn", turn).withColumn("weight", pick(weights)).withColumn("slope", pick([float(s) for s in slopes]))
    rows = rows.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    # The first source that its level does not cut sets the level for all that follow.
    common = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    rows = rows.withColumn("common", common)
    target = F.when(F.col("ratio") <= F.coalesce("common", F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight"))
    return rows.select("source", "source_size", "docs", target.alias("target"), "slope")


def training_position(demand: Column, target: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a source with this schedule has asked for ``demand`` words."""
    u = F.least(F.lit(1.0), demand / target)
    up = 1 + slope
    return 2 * u / (up + F.sqrt(F.greatest(F.lit(0.0), up * up - 4 * slope * u)))


def mixed(docs: DataFrame, run: int = RUN, **options) -> DataFrame:
    """``docs`` with _mix_source_size, _mix_target, _mix_slope, _mix_taken and _mix_ahead, the words of the source before the document.

    ``docs`` has doc_id, source and _mix_size, its words; a null source is one of its own. The order within a source is
    that of md5(doc_id), then doc_id; rows with the same doc_id lie in the order of size. The document at the
    target's end is taken in part, so a source gives its target to the word, rounded down.
    """
    rows = docs
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_mix_key", digest)
    per_source = rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = table(source_targets(per_source, **options), "targets")
    named = targets.select(F.col("source").alias("_mix_name"), F.col("source_size").alias("_mix_source_size"), F.col("docs").alias("_mix_docs"),
                           F.col("target").alias("_mix_target"), F.col("slope").alias("_mix_slope"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_mix_name"))).drop("_mix_name")
    # Parts of a source follow its order: the first 24 bits of the digest, cut evenly.
    part = F.floor(F.conv(F.substring("_mix_key", 1, 6), 16, 10).cast("long") * F.ceil(F.col("_mix_docs") / run) / (1 << 24))
    rows = rows.withColumn("_mix_part", part.cast("int"))
    order = Window.partitionBy("source", "_mix_part").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.groupBy("source", "_mix_part").agg(F.sum("_mix_size").alias("_mix_m"))
    chain = Window.partitionBy("source").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.select(F.col("source").alias("_mix_name"), F.col("_mix_part").alias("_mix_p"), F.coalesce(F.sum("_mix_m").over(chain), F.lit(0)).alias("_mix_base"))
    rows = rows.withColumn("_mix_own", F.coalesce(F.sum("_mix_size").over(order), F.lit(0)))
    rows = rows.join(summed, F.col("source").eqNullSafe(F.col("_mix_name")) & (F.col("_mix_part") == F.col("_mix_p")))
    ahead = F.col("_mix_base") + F.col("_mix_own")
    goal = F.floor("_mix_target")
    copies = range(options.get("repeats", REPEATS))
    taken = sum([F.greatest(F.lit(0), F.least(F.col("_mix_size"), goal - (ahead + F.col("_mix_source_size") * at))) for at in copies], F.lit(0))
    return rows.select(*docs.columns, "_mix_source_size", "_mix_target", "_mix_slope",
                       taken.cast("long").alias("_mix_taken"), ahead.cast("long").alias("_mix_ahead"))


def curriculum(docs: DataFrame, run: int = RUN, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken and position (of its first copy,
    null where nothing is taken), in the order of position. Every row counts; a text without words has size 0."""
    size = word_count(F.col("text").cast("string")).alias("_mix_size")
    rows = mixed(docs.select("doc_id", "source", size), run, **options)
    position = F.when(F.col("_mix_taken") > 0, training_position(F.col("_mix_ahead"), F.col("_mix_target"), F.col("_mix_slope")))
    out = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"), position.alias("position"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, run: int = RUN, **options) -> DataFrame:
    """The training order: ``docs`` range-sorted by position, one row for each copy that is taken.

    A copy taken in part keeps its first words. Documents without words cost nothing and stay once.
    """
    # The mix is worked out on short rows; texts are shuffled to meet it and to be sorted, no more.
    mark = F.xxhash64("text")
    size = word_count(F.col("text").cast("string")).alias("_mix_size")
    short = table(docs.select("doc_id", "source", size, mark.alias("_mix_mark")), "sizes")
    rows = mixed(short, run, **options)
    same = Window.partitionBy("doc_id", "_mix_mark", "source").orderBy("_mix_ahead")
    plan = rows.withColumn("_mix_nth", F.row_number().over(same)).select(
        F.col("doc_id").alias("_mix_doc"), F.col("source").alias("_mix_from"), "_mix_mark", "_mix_nth", "_mix_size", "_mix_source_size",
        "_mix_target", "_mix_slope", "_mix_ahead")
    equal = Window.partitionBy("doc_id", "_mix_mark", "source").orderBy("_mix_mark")
    rows = docs.withColumn("_mix_mark", mark).withColumn("_mix_nth", F.row_number().over(equal))
    on = F.col("doc_id").eqNullSafe(F.col("_mix_doc")) & F.col("source").eqNullSafe(F.col("_mix_from"))
    on = on & (rows["_mix_mark"] == plan["_mix_mark"]) & (rows["_mix_nth"] == plan["_mix_nth"])
    rows = rows.join(plan, on).drop(plan["_mix_mark"]).drop(plan["_mix_nth"])
    repeats = options.get("repeats", REPEATS)
    copies = F.when(F.col("_mix_size") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(repeats - 1)))
    rows = rows.withColumn("_mix_copy", F.explode(copies))
    demand = F.col("_mix_ahead") + F.col("_mix_source_size") * F.col("_mix_copy")
    words = F.least(F.col("_mix_size"), F.floor("_mix_target") - demand)
    rows = rows.withColumn("_mix_words", words).filter((F.col("_mix_words") > 0) | (F.col("_mix_size") == 0))
    position = training_position(demand, F.greatest("_mix_target", F.lit(1.0)), F.col("_mix_slope"))
    rows = rows.withColumn("_mix_position", F.coalesce(position, F.lit(0.0)))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_mix_words"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("_mix_words") < F.col("_mix_size"), cut).otherwise(F.col("text"))
    # Range-sort by position; the copies of one document lie apart.
    ready = rows.withColumn("text", text).orderBy("_mix_position", "doc_id", "_mix_copy")
    return ready.select(*docs.columns)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), turned AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources
), weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CASE turn WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS slope
  FROM turned
), levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted
), common AS (
  SELECT min_by(level, (ratio, source)) AS common FROM levels WHERE level <= ratio
), targets AS (
  SELECT source, source_size, slope,
         CASE WHEN common IS NULL OR ratio <= common THEN CAST(cap AS DOUBLE) ELSE common * weight END AS target
  FROM levels, common
), placed AS (
  SELECT doc_id, size, source_size, target, slope, CAST(coalesce(sum(size) OVER (
           PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CAST(greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - ahead - source_size)) AS BIGINT) AS taken
  FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN 2 * least(1::DOUBLE, ahead / target) / ((1 + slope) + sqrt(greatest(0::DOUBLE,
         (1 + slope) * (1 + slope) - 4 * slope * least(1::DOUBLE, ahead / target)))) END AS position
FROM taken
"""
