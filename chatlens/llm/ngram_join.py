"""Operator 8: documents whose sets of word shingles have a Jaccard similarity above a bound.

Token-group matrix. Similar documents form groups: same first element in the order below and
about the same size. Each group stores the union of its members' leading elements (the matrix,
as rows of element and group). The overlap of two groups in that matrix bounds the overlap of
any two of their members, and only pairs of groups that can qualify are opened and verified.

Order of elements: a third of them is counted over all rows; first the counted ones that are rare, then the
uncounted ones, then the frequent ones, each by hash. Two sets with
similarity t share one of their first n - ceil(t n) + 1 elements in any common order, so only these
leading elements enter the matrix and nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import Scratch, components, fresh, keep_marked, lists, mix, one_of_each, slices, table, word_shingles
from chatlens.llm.setjoin import opened_links, star_links
from chatlens.plans.lineage import discard, materialize, scratch_path

PERCENT = 75
WIDTH = 5
# Elements with a hash below this are counted: a third of them, more than the leading elements of a set.
COUNTED = np.uint64((1 << 64) // 3)
# An element in so many rows is frequent.
OFTEN = 24
# An element that is not counted is frequent with this share of all set entries.
SHARE = 4e-6
# Bits of the bitmap of frequent elements (2 MB).
BITS = 24
# Type of the identity of a row: doc_id, then 62 bits of a digest of its text.
IDENTITY = "decimal(38,0)"
# Ratio of sizes inside a group.
STEP = 1.08


def _sets(width: int):
    def make(texts: list) -> list:
        return word_shingles([text.encode() if isinstance(text, str) else text for text in texts], width)

    return make


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def frequent_elements(docs: DataFrame, width: int = WIDTH, often: int = OFTEN, share: float = SHARE) -> np.ndarray:
    """A bitmap of the frequent elements.

    Elements with a hash below COUNTED are counted over all rows and marked from ``often`` rows on. Of the
    others, those are marked that have ``share`` of all entries, by adding up what is frequent in
    slices of the rows. The bitmap has a fixed size, so an element may be marked by chance; the order stays the
    same for all sets, and only the order depends on it.
    """

    def emit(batches):
        held, size = [], 0

        def rows(tokens: np.ndarray, times: np.ndarray | None, kind: int):
            times = np.ones(len(tokens), np.int64) if times is None else times
            kinds = pa.array(np.full(len(tokens), kind, np.int8))
            return pa.RecordBatch.from_arrays([kinds, pa.array(tokens.view(np.int64)), pa.array(times)], ["kind", "token", "n"])

        def report():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            local = times >= max(4, share * size)
            yield rows(values[local], times[local], 1)
            yield rows(np.zeros(1, np.uint64), np.array([size]), 2)

        for batch in batches:
            texts = _bytes(batch.column(0))
            for low, high in slices(texts):
                found = word_shingles(texts[low:high], width)
                yield rows(np.concatenate([x[: np.searchsorted(x, COUNTED)] for x in found]), None, 0)
                held += [x[np.searchsorted(x, COUNTED) :] for x in found]
                size += sum(map(len, found))
                if size > 2_000_000:
                    yield from report()
                    held, size = [], 0
        if size:
            yield from report()

    tokens = docs.select("text").mapInArrow(emit, "kind byte, token long, n long")
    summed = tokens.groupBy("kind", "token").agg(F.sum("n").alias("n")).filter((F.col("kind") > 0) | (F.col("n") >= often))
    scratch = Scratch(docs.sparkSession)
    summed = scratch.table(summed, "frequent")
    total = summed.filter("kind = 2").agg(F.max("n")).first()[0] or 0
    marked = summed.filter((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("n") >= share * total)))
    spot = F.col("token").bitwiseAND((1 << BITS) - 1)
    words = marked.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for row in words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).collect():
        bitmap[row["w"]] = row["m"]
    scratch.clear()
    return bitmap


def leading(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The elements one of which any similar set must share, in the common order: counted and rare, not counted and
    rare, frequent. And how many of all elements are rare."""
    size = len(tokens)
    length = size - -(-percent * size // 100) + 1
    at = (tokens & np.uint64((1 << BITS) - 1)).astype(np.int64)
    often = ((frequent[at >> 6] >> (at & 63)) & 1).astype(bool)
    rare = tokens[~often]
    # Counted elements have the smaller hashes, so the rare ones are in order already.
    head = rare[:length] if len(rare) >= length else np.concatenate([rare, tokens[often]])[:length]
    return head, len(rare)


def profiles(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n, how many elements are rare, a 128-bit fingerprint of the set, its group and its leading elements."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(batches):
        often = shared.value
        for batch in batches:
            texts = _bytes(batch.column("text"))
            for low, high in slices(texts):
                sets = word_shingles(texts[low:high], width)
                n = np.array([len(x) for x in sets], np.int64)
                found = [leading(x, often, percent) if len(x) else (x, 0) for x in sets]
                heads, rare = [x for x, _ in found], np.array([n for _, n in found], np.int64)
                first = np.array([x[0] if len(x) else 0 for x in heads], np.uint64)
                band = np.floor(np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.uint64)
                group = (mix(first + band * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1023)) | np.minimum(band, 1023)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(n),
                        pa.array(rare),
                        pa.array(np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([mix(x + np.uint64(77)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)),
                        pa.array(group.view(np.int64)),
                        lists(heads),
                    ],
                    ["doc_id", "n", "rare", "f1", "f2", "group", "heads"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        make, f"doc_id {kind}, n long, rare long, f1 long, f2 long, group long, heads array<long>"
    )


def shared_elements(profile: DataFrame) -> DataFrame:
    """The matrix where it matters: (token, group, rare) of elements in several groups."""
    rows = profile.select(F.posexplode("heads").alias("at", "token"), "group", F.col("rare").alias("up_to"))
    matrix = rows.select("token", "group", (F.col("at") < F.col("up_to")).alias("rare")).repartition("token").distinct()
    own = Window.partitionBy("token")
    ends = matrix.select("token", "group", "rare", F.min("group").over(own).alias("head"), F.max("group").over(own).alias("tail"))
    return ends.filter("head <> tail").select("token", "group", "rare")


def _band(column: str):
    return F.col(column).bitwiseAND(1023)


def _qualifying(overlap: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """Of (g1, g2, common) the pairs with members that may be similar; ``spans``: (group, lo, hi, members, ...).

    Members with sizes a <= b need an overlap of t / (1 + t) * (a + b), of which at most t * b
    lies behind the leading elements; the rest must be among the shared leading ones. Told apart by kind:
    what is shared is at most the shared rare leading elements, the rare ones behind the leading of either, and
    the smaller number of frequent ones.
    """
    t = percent / 100

    def ahead(small: str, large: str):
        return t / (1 + t) * (F.col(small) + F.col(large)) - t * F.col(large)

    one = spans.select(*[F.col(name).alias("g1" if name == "group" else f"{name}1") for name in spans.columns])
    two = spans.select(*[F.col(name).alias("g2" if name == "group" else f"{name}2") for name in spans.columns])
    need = F.least(ahead("lo1", "hi2"), ahead("lo2", "hi1")) - 0.001
    fits = (100 * F.col("hi1") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo1"))
    rest = F.greatest("behind1", "behind2") + F.least("often1", "often2")
    need_rare = t / (1 + t) * (F.col("lo1") + F.col("lo2")) - rest - 0.001
    enough = (F.col("common") >= need) & (F.col("common_rare") >= need_rare)
    return overlap.join(one, "g1").join(two, "g2").filter(fits & enough)


def _spans(members: DataFrame, percent: int, *more) -> DataFrame:
    """Per group of (group, node, n, rare) what bounds its members: sizes, rare elements behind the leading ones, frequent ones."""
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return members.groupBy("group").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.greatest(F.lit(0), F.col("rare") - length)).alias("behind"),
        F.max(F.col("n") - F.col("rare")).alias("often"), F.count(F.lit(1)).alias("members"), *more)


def _common() -> list:
    return [F.count(F.lit(1)).alias("common"), F.count_if("rare").alias("common_rare")]


def ngram_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Rows without words (null, empty, blank) have n_shingles 0 and are their own component. Rows
    that repeat a doc_id are one document: what any of them links to, it links to. A row without doc_id links with
    nothing and has no component. Ids are long, or decimals of 38 digits. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = IDENTITY if dict(docs.dtypes)["doc_id"] == IDENTITY else "long"
    docs = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = frequent_elements(docs, width)
    path = scratch_path(spark, "llm-profiles")
    profile = materialize(profiles(docs, frequent, width, percent), path)
    ids = table(profile.drop("heads"), "ids")
    usable = ids.filter("n > 0 and doc_id is not null")
    size = ids.count()
    shared = scratch.table(shared_elements(profile.filter("n > 0 and doc_id is not null")), "matrix")
    discard(spark, path)
    sets = scratch.table(
        usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.min("group").alias("group"), F.min("n").alias("n"),
                                         F.min("rare").alias("rare")), "sets", size
    )
    members = scratch.table(sets.select("group", "node", "n", "rare").distinct(), "members", size)
    spans = scratch.table(_spans(members, percent, F.min("node").alias("head")), "groups", size)
    reach = int(np.ceil(np.log(100 / percent) / np.log(STEP))) + 1

    def named_texts(nodes: DataFrame) -> DataFrame:
        named = docs.withColumnRenamed("doc_id", "node").filter("node is not null")
        return scratch.table(keep_marked(named, "node", nodes).join(nodes, "node", "left_semi"), "texts")

    # First every node against the head of its group, and the heads of groups against one other group for each shared
    # element, of about the same size: the one with the most frequent elements, which is the same for most elements of
    # a cluster. That joins most copies, in as many comparisons as there are groups.
    weights = shared.groupBy("group").agg(F.count_if(~F.col("rare")).alias("weight"))
    def first(step: int):
        around = Window.partitionBy("token", F.floor(_band("group") / step))
        return F.max(F.struct("weight", "group")).over(around)["group"]

    # Once among groups of the same size, once among those of similar size.
    star = shared.join(weights, "group").select("token", "group", "rare", first(1).alias("near"), first(4).alias("far"))
    star = star.select("token", "group", "rare", F.explode(F.array_distinct(F.array("near", "far"))).alias("head"))
    star = star.filter((F.col("group") != F.col("head")) & (F.abs(_band("group") - _band("head")) <= reach))
    star = star.groupBy(F.col("head").alias("g1"), F.col("group").alias("g2")).agg(*_common())
    star = _qualifying(star, spans, percent).select(F.col("head2").alias("a"), F.col("head1").alias("b"))
    inner = members.join(spans.filter("members > 1").select("group", "head"), "group").filter("node <> head")
    pairs = scratch.table(star.unionByName(inner.select(F.col("node").alias("a"), F.col("head").alias("b"))).distinct(), "stars", size)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = scratch.table(star_links(pairs, named_texts(nodes), _sets(width), percent), "links", size)
    joined = scratch.table(components(links, rows=size), "joined", size)

    # Groups within one component merge with the component's other groups of their size.
    placed = members.join(joined, "node", "left").select("group", "node", "n", "rare", F.coalesce("component", "node").alias("c"))
    pure = placed.groupBy("group").agg(F.min("c").alias("c"), F.max("c").alias("d"))
    merged = F.xxhash64(F.lit("m"), "c", _band("group")).bitwiseAND(~1023).bitwiseOR(_band("group"))
    whole = F.col("c") == F.col("d")
    named = pure.select("group", F.when(whole, merged).otherwise(F.col("group")).alias("super"), F.when(whole, F.col("c")).alias("pure"))
    named = scratch.table(named, "supers", size)
    placed = scratch.table(placed.join(named, "group").select(F.col("super").alias("group"), "node", "n", "rare", "c", "pure"), "placed", size)
    spans = scratch.table(_spans(placed, percent, F.min("pure").alias("pure")), "spans", size)
    matrix = shared.join(named, "group").select("token", "rare", F.col("super").alias("g1"), F.col("pure").alias("pure1")).distinct()
    matrix = scratch.table(matrix, "merged", size)
    other = matrix.select("token", F.col("g1").alias("g2"), F.col("pure1").alias("pure2"))
    apart = F.coalesce(F.col("pure1") != F.col("pure2"), F.lit(True))
    overlap = matrix.join(other, "token").filter(
        (F.col("g1") < F.col("g2")) & apart & (F.abs(_band("g1") - _band("g2")) <= reach))
    overlap = overlap.groupBy("g1", "g2").agg(*_common())
    opened = _qualifying(overlap, spans, percent)
    # The smaller group of a pair is the guest: its members meet those of the larger one, once for all its guests.
    larger = F.col("members1") >= F.col("members2")
    opened = opened.select(F.when(larger, F.col("g1")).otherwise(F.col("g2")).alias("host"),
                           F.when(larger, F.col("g2")).otherwise(F.col("g1")).alias("group"))
    opened = scratch.table(opened, "opened-groups", size)
    guests = opened.join(placed, "group").select(F.col("host").alias("bucket"), "node", "n", F.lit(True).alias("left"), F.lit(False).alias("right"))
    hosts = opened.select(F.col("host").alias("group")).distinct()
    heads = placed.filter("pure is null").groupBy("group").agg(F.min(F.struct("node", "c"))["c"].alias("hc"))
    hosts = hosts.unionByName(heads.select("group")).distinct()
    own = placed.join(hosts, "group").join(heads, "group", "left").select(
        F.col("group").alias("bucket"), "node", "n", F.coalesce(F.col("c") != F.col("hc"), F.lit(False)).alias("left"), F.lit(True).alias("right"))
    rows = scratch.table(own.unionByName(guests), "rows", size)
    texts = named_texts(rows.select("node").distinct())
    more = scratch.table(opened_links(rows, texts, _sets(width), percent), "opened")

    # Equal sets link without being compared; repeated ids are one node. What the first links join hangs below its component already.
    copies = usable.join(sets.select("f1", "f2", "node"), ["f1", "f2"]).filter("doc_id <> node")
    edges = copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = edges.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(more)
    whole = components(edges, rows=size).withColumnRenamed("node", "doc_id")
    scratch.clear()
    return ids.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents whose component has a smaller one, by doc_id; columns stay.

    Different texts under one doc_id are documents of their own. Of rows equal in doc_id and text one
    stays; rows without doc_id stay as they are.
    """
    row = fresh(docs, "row")
    digest = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 62))
    identity = F.col("doc_id").cast("long").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + digest
    known = docs.filter("doc_id is not null").withColumn(row, identity.cast(IDENTITY))
    found = ngram_components(known.select(F.col(row).alias("doc_id"), "text"), percent, width)
    found = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(f"{row}_gone")).distinct()
    kept = one_of_each(known, [row]).join(found, F.col(row) == F.col(f"{row}_gone"), "left_anti")
    return kept.drop(row).unionByName(docs.filter("doc_id is null"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
